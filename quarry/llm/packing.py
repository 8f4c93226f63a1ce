"""Variable-capacity best-fit packing (op5).

Texts are measured in words; longer ones than the largest capacity are cut into pieces
of it and a rest. Pieces are dealt by hash into shards of about SHARD pieces, whatever
their source, and every shard is packed best-fit in descending order.

The cost of a bin grows faster than its capacity, as attention does: capacity + capacity
squared / QUADRATIC, and OVERHEAD for the bin itself. The permitted capacities are chosen
jointly: a plan opens bins at its capacity, or the smallest that holds the piece; every
plan is packed, each bin shrinks to the smallest capacity that holds its contents, and the
shard takes the plan of least cost in the end.

Defined cases: null and empty texts are pieces of length 0 and join some bin; repeated
rows are packed separately; other columns are ignored; an empty table gives no rows.
"""
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import WORD, documents, materialize

CAPACITIES, QUADRATIC, OVERHEAD, SHARD = (256, 512, 1024, 2048, 4096), 16_384, 64, 20_000


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / QUADRATIC + OVERHEAD


def best_fit(sizes: list[int], caps: list[int], opened: int) -> tuple[list[int], list[int]]:
    """Bin of every size, and each bin's smallest sufficient capacity; bins open at `opened`
    or the smallest capacity that holds the piece."""
    bins, open_, used = [0] * len(sizes), [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        k = bisect_left(open_, (s, -1))
        if k < len(open_):
            free, b = open_.pop(k)
        else:
            b, free = len(used), max(opened, caps[bisect_left(caps, s)])
            used.append(0)
        bins[i] = b
        used[b] += s
        insort(open_, (free - s, b))
    return bins, [caps[bisect_left(caps, u)] for u in used]


def pack(sizes: list[int], capacities=CAPACITIES) -> tuple[list[int], list[int]]:
    """Bin of every size, and each bin's capacity, by the plan of least cost."""
    caps = sorted(capacities)
    plans = [best_fit(sizes, caps, c) for c in caps]
    return min(plans, key=lambda p: sum(map(cost, p[1])))


def pack_documents(docs: DataFrame, capacities=CAPACITIES, keep: tuple = ("doc_id",)) -> DataFrame:
    """doc_id, piece, first_word, n_words, bin_id, capacity, bin_words."""
    top = max(capacities)
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    d = docs.select("doc_id", n.alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    p = materialize(d.select("doc_id", "h", "size", F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("size") - 1), F.lit(top))).alias("piece", "first_word")))
    shards = max(1, -(-p.count() // SHARD))
    p = p.select("doc_id", "piece", "first_word", F.least(F.lit(top), F.col("size") - F.col("first_word")).alias("n_words"), F.pmod(F.xxhash64("h", "piece"), F.lit(shards)).alias("shard"))
    p = materialize(p)

    def run(pdf):
        pdf = pdf.sort_values(["doc_id", "piece", "n_words"], kind="stable")
        bins, caps = pack(pdf.n_words.tolist(), capacities)
        words = pd.Series(pdf.n_words.to_numpy()).groupby(bins).sum()
        return pd.DataFrame({"doc_id": pdf.doc_id.to_numpy(), "piece": pdf.piece.to_numpy(), "first_word": pdf.first_word.to_numpy(), "n_words": pdf.n_words.to_numpy(),
                             "bin_id": [f"{s}-{b}" for s, b in zip(pdf.shard, bins)], "capacity": [caps[b] for b in bins], "bin_words": [int(words[b]) for b in bins]})

    return p.groupBy("shard").applyInPandas(run, "doc_id long, piece int, first_word int, n_words int, bin_id string, capacity int, bin_words long")


def op5_best_fit_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))
