"""Time-varying curriculum mixing, in DataFrame functions alone (op6).

A source is read in the order of a hash of its rows, round after round, until the words
read reach its target; a document is read whole, and the last one only if at least half
of it lies before the target (a source's first document always), so the words of the
copies miss the target by one document at most. Every source has a linear weight
schedule; its integral up to time t is the source's cumulative demand, and inverting
that at the words read before the middle of a copy gives the copy's training position.
Words before a document are summed in two levels, over RANGES ranges of the hash.

Defined cases: null text has size 0 and takes nothing; a null source is a source of
its own, last in order; repeated rows follow one another; other columns are carried whole and
may have any name; an empty table gives no rows.
The table of sources has one row per source; it is broadcast only under MAX_SOURCES.
"""
from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, documents, materialize, whole_row

MAX_SOURCES = 100_000
RANGES = 256
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (0.6, 0.0, -0.6)


def source_targets(sized: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, target, slope. Water-filling: sources in order of cap*size/weight
    are capped while the level of the rest stays above them."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    i = (F.row_number().over(order) - 1) % 3
    s = s.select("source", "source_size", F.element_at(F.array(*map(F.lit, WEIGHTS)), i + 1).alias("w"), F.element_at(F.array(*map(F.lit, SLOPES)), i + 1).alias("slope"))
    level = Window.orderBy(F.lit(cap) * F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(1))
    s = s.withColumn("lam", (F.sum("source_size").over(all_) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0)))
                     / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("free", F.col("lam") * F.col("w") <= F.lit(cap) * F.col("source_size"))
    s = s.withColumn("lam0", F.min(F.when(F.col("free"), F.struct(F.lit(cap) * F.col("source_size") / F.col("w"), F.col("lam")))).over(all_).getField("lam"))
    return s.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(
        F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("lam0") * F.col("w"), F.lit(cap) * F.col("source_size")))).alias("target"), "slope")


def position(copy):
    """Training position of a row's copy (from 1) by the columns of `mix`."""
    words = (copy - 1) * F.col("source_size") + F.col("before") + F.col("size") / 2
    q = F.when(F.col("target") > 0, F.least(F.lit(1.0), words / F.col("target"))).otherwise(0.0)
    a = F.col("slope")
    return F.when(a == 0, q).otherwise(((a - 1) + F.sqrt((1 - a) * (1 - a) + 4 * a * q)) / (2 * a))


def mix(docs: DataFrame, cap: float = 3.0, keep: list[str] | None = None) -> DataFrame:
    """_row (the whole row, or its columns `keep`) plus size, source_size, target, slope, before,
    copies, taken, position. `before` is the words of the source ahead of the row, `copies` the
    whole repeats of the row, `taken` their words and `position` the place of the first."""
    row = whole_row(docs if keep is None else docs.select(*keep))
    sized = docs.select(row.alias("_row"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                        F.xxhash64("doc_id", "text").alias("_h"))
    if keep is not None and "text" not in keep:
        sized = materialize(sized)
    sized = sized.withColumn("_range", F.pmod("_h", F.lit(RANGES)))
    per = materialize(sized.groupBy("source", "_range").agg(F.sum("size").alias("size")))
    t = materialize(source_targets(per.select("source", "size"), cap)).withColumnRenamed("source", "_source")
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    r = per.select(F.col("source").alias("_of"), F.col("_range").alias("_r"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("_ahead"))
    if t.count() <= MAX_SOURCES:
        t = F.broadcast(t)
    j = sized.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    j = j.join(r, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_r"))).drop("_of", "_r")
    within = Window.partitionBy("source", "_range").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("before", F.col("_ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    rounds = F.ceil((F.col("target") - F.col("before") - F.col("size") / 2) / F.col("source_size"))
    first = F.when((F.col("before") == 0) & (F.col("size") > 0), 1).otherwise(0)
    j = j.withColumn("copies", F.when(F.col("target") > 0, F.greatest(first, rounds)).otherwise(0).cast("int"))
    j = j.withColumn("taken", F.col("copies") * F.col("size"))
    return j.withColumn("position", position(F.lit(1))).drop("_h", "_range", "_ahead")


def op6_curriculum_mix(spark, sf_dir):
    m = mix(documents(spark, sf_dir), keep=["doc_id"])
    return m.select("_row.doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")
