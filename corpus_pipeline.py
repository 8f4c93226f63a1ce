"""Corpus pipeline: five stages over documents, each written as Parquet and reread.

Defined cases, all stages: null texts count as empty; other columns are carried unchanged
and may have any name; repeated rows are documents of their own (near_dedup keeps one);
an empty table gives no rows. A stage's result must be written before the next is called.
"""
import uuid

from pyspark.sql import functions as F

from quarry.llm import bagminhash, mixing, packing, repeats, toxicity
from quarry.llm.common import shared_dir, successive, text_key, whole_row

ORACLE_SQL = None


def drop_toxic(spark, docs, sf_dir):
    """Documents whose clause grammar scores below the threshold; empty ones stay."""
    with successive(spark, f"pipeline {sf_dir}"):
        model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select("_row.*")


def drop_near_copies(spark, docs, sf_dir):
    """The first document of each near-duplicate class: smallest doc_id (null last), then key of
    the text, then hash of the row; of rows equal in all columns one."""
    with successive(spark, f"pipeline {sf_dir}"):
        return bagminhash.one_of_each(docs)


def cut_repeated_bytes(spark, docs, sf_dir):
    """Texts without their repeated 200-byte strings; characters cut in part go whole. Rows
    whose text changes get its n_chars, if there is such a column."""
    with successive(spark, f"pipeline {sf_dir}"):
        kept = repeats.remove_repeats(docs, 200, "byte").where("n_removed > 0").select("key", repeats.as_text("kept").alias("kept"))
        j = docs.select(whole_row(docs).alias("_row"), text_key().alias("key")).join(kept, "key", "left")
        old = {c: F.col(f"_row.`{c}`") for c in docs.columns}
        new = {"text": F.coalesce("kept", old["text"])}
        if "n_chars" in old:
            new["n_chars"] = F.when(F.col("kept").isNull(), old["n_chars"]).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
        return j.select(*[new.get(c, v).alias(c) for c, v in old.items()])


def mix_sources(spark, docs, sf_dir):
    """Whole copies of documents as their sources' targets ask, range-sorted by training
    position, then doc_id; documents of no words have no copy."""
    with successive(spark, f"pipeline {sf_dir}"):
        m = mixing.mix(docs).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        return m.withColumn("position", mixing.position(F.col("copy"))).orderBy("position", "_row.doc_id", "copy").select("_row.*")


def pack_best_fit(spark, docs, sf_dir):
    """doc_id, piece, first_word, n_words, bin_id, capacity, bin_words of every piece."""
    with successive(spark, f"pipeline {sf_dir}"):
        return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeated_bytes), ("mixing", mix_sources), ("packing", pack_best_fit)]


def run(spark, sf_dir):
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/quarry/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
