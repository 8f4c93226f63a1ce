"""I-Match fingerprints in DataFrame functions alone (op8).

Terms within a band of document frequencies form the lexicon. A randomised subset of it is
the terms whose hash falls in one of 2^g buckets; a part of a fingerprint hashes the text's
distinct lexicon terms of one subset, in sorted order. A quarter edit changes any part of
many terms, so subsets are graded by size: a text of D distinct terms takes PARTS subsets
of grade g = floor(log2 D) and of grade g + 1, which hold about one of its terms each,
whatever its length. Two fingerprints are compared in the grades that both have: likeness is
the share of equal parts among those that either text fills.

Texts move once: the exchange by row is shared by the heads sent to the document before and
by the texts that meet them. Only ids are sorted. The lexicon has at most (mean distinct
terms per text) / LOW terms whatever the input, and is broadcast only under LEXICON.

Defined cases: null is the empty text; of texts without lexicon terms in their subsets all
distinct terms are hashed instead (none, for empty ones), and they are alike (1) only to
texts with the same; documents are ordered by doc_id, null first, then by a hash of their
text; repeated rows follow one another and give a row each; other columns are ignored; an
empty table gives no rows.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import documents, materialize

PARTS, LOW, HIGH, LEXICON = 24, 0.001, 0.3, 4_000_000
TERM = r"[\p{L}\p{N}]+"


def term_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(t)))


def grade(h: Column) -> Column:
    return F.when(F.size(h) > 0, F.floor(F.log2(F.size(h).cast("double")))).otherwise(0).cast("int")


def bucket(term: Column, g: Column) -> Column:
    return F.xxhash64(F.lit(8), term).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), g) - 1)


def parts(terms: Column, g: Column) -> Column:
    """PARTS hashes of the sorted terms by subset; 0 where there is none."""
    def one(j):
        mine = F.filter(terms, lambda t: bucket(t, g) == j)
        return F.when(F.size(mine) > 0, F.xxhash64(mine).bitwiseAND(F.lit(0x7FFFFFFF))).otherwise(0).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), one)


def likeness(p: Column, q: Column) -> Column:
    """Of fingerprints (g, low, high, rest): parts of grade g and g + 1, hash of all terms."""
    def count(test, *pairs):
        return sum((F.size(F.filter(F.zip_with(a, b, test), lambda z: z)) for a, b in pairs), F.lit(0))

    def share(*pairs):
        used = count(lambda x, y: (x != 0) | (y != 0), *pairs)
        same = count(lambda x, y: (x != 0) & (x == y), *pairs)
        return F.when(used > 0, same / used).otherwise((p["rest"] == q["rest"]).cast("double"))
    return (F.when(p["g"] == q["g"], share((p["low"], q["low"]), (p["high"], q["high"])))
            .when(p["g"] + 1 == q["g"], share((p["high"], q["low"]))).when(q["g"] + 1 == p["g"], share((p["low"], q["high"]))).otherwise(0.0))


def as_string(p: Column) -> Column:
    text = lambda c: F.array_join(F.transform(c, lambda x: F.when(x == 0, "").otherwise(F.lower(F.hex(x)))), "-")
    return F.when(p["any"], F.concat_ws(":", p["g"], text(p["low"]), text(p["high"]))).otherwise(F.concat(F.lit("all:"), F.lower(F.hex(p["rest"]))))


def rows_in_order(docs: DataFrame) -> DataFrame:
    """row, part, again, copies, row_key, next_key, doc_id, n_chars of every different row (doc_id,
    text): the key of the document after it, after the last the first; a row that is repeated
    has a second entry (again), which is followed by itself and stands for copies - 1 rows."""
    d = docs.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("n"))
    d = d.repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")
    d = materialize(d.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "*"))
    # one row per range partition: its first document, and that of the partition after it
    first = d.groupBy("part").agg(F.min_by("row_key", "row").alias("head"))
    w = Window.orderBy("part")
    after = first.select("part", F.coalesce(F.lead("head").over(w), F.first("head").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    d = d.withColumn("lead", F.lead("row_key").over(Window.partitionBy("part").orderBy("row"))).join(after, "part")
    cols = ["row", "part", "row_key", "doc_id", "n_chars"]
    one = d.select(*cols, F.lit(False).alias("again"), F.lit(1).cast("long").alias("copies"), F.coalesce("lead", "head").alias("next_key"))
    return materialize(one.unionByName(d.where("n > 1").select(*cols, F.lit(True).alias("again"), (F.col("n") - 1).alias("copies"), F.col("row_key").alias("next_key"))))


def lexicon_of(docs: DataFrame, n: int) -> DataFrame:
    df = docs.select(F.explode(term_hashes(F.col("text"))).alias("t")).groupBy("t").count()
    out = materialize(df.where(F.col("count").between(max(2, int(LOW * n)), max(2, int(HIGH * n)))).select("t"))
    return F.broadcast(out) if out.count() <= LEXICON else out


def fingerprints(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text), 256))
    docs = docs.select("doc_id", text.alias("text"), key.alias("row_key"))
    order = rows_in_order(docs)
    lexicon = lexicon_of(docs, int(order.agg(F.sum("copies")).first()[0] or 0))

    texts = docs.select("row_key", "text")
    if not order.where("again").isEmpty():
        texts = texts.dropDuplicates(["row_key"])
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    ask = order.select(F.col("next_key").alias("row_key"), F.col("row_key").alias("to"), F.col("again").alias("to_again"), cut.alias("cut"))
    heads = texts.join(ask, "row_key").select(F.col("to").alias("row_key"), "to_again", F.substring("text", F.lit(1), F.col("cut")).alias("head"))
    # by row_key alone, as the texts lie, so that they do not move again
    e = texts.join(order.drop("next_key"), "row_key")
    e = e.join(heads, "row_key").where(F.col("again").cast("int") - F.col("to_again").cast("int") == 0).select("row", "part", "again", "copies", "doc_id", "n_chars", "text", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.col("head")).alias("edited"))
    meta = ["row", "part", "again", "copies", "doc_id", "n_chars", "edited_sha256", "g0", "g1", "rest0", "rest1"]
    e = e.select("*", F.sha2("edited", 256).alias("edited_sha256"), term_hashes(F.col("text")).alias("h0"), term_hashes(F.col("edited")).alias("h1"))
    e = e.select("*", *[grade(F.col(f"h{k}")).alias(f"g{k}") for k in (0, 1)], *[F.xxhash64(F.array_sort(f"h{k}")).alias(f"rest{k}") for k in (0, 1)])
    mine = lambda k: F.transform(F.filter(f"h{k}", lambda t: bucket(t, F.col(f"g{k}")) < PARTS), lambda t: F.struct(F.lit(k).alias("k"), t.alias("t")))
    e = e.select(*meta, F.explode_outer(F.concat(mine(0), mine(1))).alias("kt")).select(*meta, "kt.k", "kt.t")
    e = e.join(lexicon.withColumn("known", F.lit(True)), "t", "left")
    e = e.groupBy(*meta).agg(*[F.array_sort(F.collect_set(F.when(F.col("known") & (F.col("k") == k), F.col("t")))).alias(f"t{k}") for k in (0, 1)])
    print_of = lambda k: F.struct(F.col(f"g{k}").alias("g"), parts(F.col(f"t{k}"), F.col(f"g{k}")).alias("low"), parts(F.col(f"t{k}"), F.col(f"g{k}") + 1).alias("high"),
                                  F.col(f"rest{k}").alias("rest"), (F.size(f"t{k}") > 0).alias("any"))
    r = materialize(e.select("row", "part", "again", "copies", "doc_id", "n_chars", "edited_sha256", print_of(0).alias("p0"), print_of(1).alias("p1")))

    first = r.where("not again").groupBy("part").agg(F.min_by("p0", "row").alias("head"))
    w = Window.orderBy("part")
    after = first.select("part", F.coalesce(F.lead("head").over(w), F.first("head").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    lead = F.lead("p0").over(Window.partitionBy("part", "again").orderBy("row"))
    r = r.withColumn("lead", lead).join(after, "part").withColumn("next", F.when(F.col("again"), F.col("p0")).otherwise(F.coalesce("lead", "head")))
    r = r.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("p0")).alias("fingerprint"), as_string(F.col("p1")).alias("edited_fingerprint"),
                 likeness(F.col("p0"), F.col("p1")).alias("near_edited"), likeness(F.col("p0"), F.col("next")).alias("near_next"), "copies")
    return r.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def op8_imatch(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))
