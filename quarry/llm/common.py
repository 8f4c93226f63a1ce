"""Shared pieces of the corpus operators: whole rows, text keys, words, shared-folder tables."""
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
LOCAL_DIR = "/tmp/quarry-checkpoint"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a local one only where it is
    unset and the session runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = LOCAL_DIR
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_scope: ContextVar[str | None] = ContextVar("scope", default=None)
_tables: dict[str, set[str]] = {}


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets the cleaner delete shuffle files of ended queries
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    if _scope.get():
        _tables.setdefault(_scope.get(), set()).add(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*frames: DataFrame) -> None:
    """Delete materialized tables that no unfinished frame reads any more."""
    for f in frames:
        delete(f.sparkSession, f._quarry_path)
        for paths in _tables.values():
            paths.discard(f._quarry_path)


@contextmanager
def successive(spark: SparkSession, name: str):
    """A step of the run `name`: deletes the tables of the run's earlier steps, whose results
    must have been written, and collects those of this one. Other tables stay."""
    for path in _tables.pop(name, set()):
        delete(spark, path)
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def whole_row(df: DataFrame):
    """All columns as one struct, so that no name of theirs meets one of an operator's."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def row_hash(df: DataFrame):
    """64-bit hash of the row; columns of a type without a hash (maps) are left out."""
    plain = [f for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{f.name.replace('`', '``')}`") for f in plain])


def text_key():
    """256-bit key of a text; equal texts (null as empty) share it."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row per different text: key, text, copies. Copies are pre-aggregated on the map side."""
    return docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")).groupBy("key").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def by_size(pdf, col: str = "text", chars: int = 2_000_000, rows: int = 512):
    """Slices of at most `rows` rows and about `chars` characters; a longer text is a slice alone."""
    start, total = 0, 0
    for i, n in enumerate([0 if x is None else len(x) for x in pdf[col]]):
        if i > start and (total + n > chars or i - start >= rows):
            yield pdf.iloc[start:i]
            start, total = i, 0
        total += n
    if len(pdf):
        yield pdf.iloc[start:]
