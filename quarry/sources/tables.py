"""Tables and files that the engine reads and writes."""
import re

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL with {table} in place of each table; no views are registered."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "�", "").alias("html"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents."""
    return spark.read.schema(schema).json(path, multiLine=True)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n (from 0, blank lines counted) and value of the lines of one file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))


SUMMARY = "map<string, struct<desc: string, overall: map<string, double>, by_category: map<string, map<string, double>>>>"


def summary_rows(doc: DataFrame) -> DataFrame:
    """config, desc, category (null: overall), metric, value of a summary document (column summary)."""
    c = doc.select(F.explode("summary").alias("config", "s")).select("config", "s.*")
    flat = c.select("config", "desc", F.lit(None).cast("string").alias("category"), F.explode("overall").alias("metric", "value"))
    return flat.unionByName(c.select("config", "desc", F.explode("by_category").alias("category", "m")).select("config", "desc", "category", F.explode("m").alias("metric", "value")))


def save_index(index: dict[str, DataFrame], path: str) -> None:
    """A folder per table; a folder that exists raises, so that no reader loses its index."""
    for name, df in index.items():
        df.write.option("compression", "zstd").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: tuple = ("postings", "terms", "stats")) -> dict[str, DataFrame]:
    """A missing index raises."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where it is unset in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or "/tmp/quarry-checkpoint").rstrip("/")
