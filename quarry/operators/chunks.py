"""Chunking and diverse selection: folds over a document or a group."""
import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

WORDS = re.compile(r"\w+")


def pack_sentences(sentences: list[str], size: int, overlap: int) -> list[str]:
    """Chunks of whole sentences within a token budget; a chunk repeats the trailing sentences
    of the one before it that fit the overlap. A longer sentence is cut into word windows."""
    done, held = [], []
    for s in sentences:
        n = len(WORDS.findall(s))
        if n > size:
            w = s.split(" ")
            done += [" ".join(w[i:i + size]) for i in range(0, len(w), size - overlap)]
            continue
        if held and sum(k for _, k in held) + n > size:
            done.append(" ".join(t for t, _ in held))
            keep, total = len(held), 0
            while keep and total + held[keep - 1][1] <= overlap:
                keep -= 1
                total += held[keep][1]
            held = held[keep:]
        held.append((s, n))
    return done + ([" ".join(t for t, _ in held)] if held else [])


def _slices(batch: pa.RecordBatch, chars: int = 1_000_000, rows: int = 512):
    """Slices of at most `rows` rows and about `chars` bytes of text; a longer text is a slice alone."""
    n, start, total = pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist(), 0, 0
    for i, k in enumerate(n):
        if i > start and (total + k > chars or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += k
    if len(n):
        yield batch.slice(start)


def chunk(docs: DataFrame, id_col: str, size: int, overlap: int, least: int = 10) -> DataFrame:
    """id, chunk_index, text, token_count; short chunks go, their index stays used. A task holds the
    chunks of a slice of its texts at a time."""
    def run(batches):
        for b in batches:
            for part in _slices(b):
                rows = []
                for i, t in zip(part[id_col].to_pylist(), part["text"].to_pylist()):
                    sents = [x for x in (p.strip() for p in re.split(r"(?<=[.!?])\s+", t or "")) if x]
                    for k, c in enumerate(pack_sentences(sents, size, overlap)):
                        n = len(WORDS.findall(c))
                        if n >= least:
                            rows.append((i, k, c, n))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*rows)) or [()] * 4, (pa.int64(), pa.int32(), pa.string(), pa.int32()))], [id_col, "chunk_index", "text", "token_count"])
    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} long, chunk_index int, text string, token_count int")


def word_windows(docs: DataFrame, id_col: str, size: int, overlap: int) -> DataFrame:
    w, step = F.split("text", " "), size - overlap
    return docs.select(id_col, w.alias("w")).select(id_col, "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / step))).alias("piece")).select(
        id_col, "piece", F.array_join(F.slice("w", (F.col("piece") * step + 1).cast("int"), F.lit(size)), " ").alias("text"))


def recursive_split(text: str, separators: tuple, most: int, overlap: int) -> list[str]:
    """Pieces of at most `most` characters at the first separator that gives them; what is longer
    goes to the next separator, in the end to cuts of `most` characters. A piece repeats the
    last `overlap` characters of the one before it, which may lengthen it."""
    if len(text) <= most:
        return [text]
    if not separators or not separators[0]:
        return [text[i:i + most] for i in range(0, len(text), most - overlap)]
    sep, held, out = separators[0], "", []
    for part in text.split(sep):
        if len(part) > most:
            out += [held] * bool(held) + recursive_split(part, separators[1:], most, overlap)
            held = ""
            continue
        longer = held + sep + part if held else part
        if len(longer) <= most:
            held = longer
            continue
        out += [held] * bool(held)
        tail = held[len(held) - min(overlap, len(held)):]
        held = tail + sep + part if tail else part
    return out + [held] * bool(held)


def overlap_length(left, right):
    """Length of the longest end of one text that the next begins with, shorter than that one."""
    n = F.filter(F.sequence(F.lit(0), F.greatest(F.length(right) - 1, F.lit(0))), lambda i: F.startswith(right, F.right(left, i)))
    return F.array_max(n)


def diverse(rows: DataFrame, group: str, quota: int, most: float = 0.5, first: int = 256) -> DataFrame:
    """Greedy by score within each group: at most `quota`, none with Jaccard above `most` to one selected.

    The fold reads a group in order of score and keeps the selected word sets alone. The best
    `first` rows of each group are read first; a group whose quota they do not fill is folded
    whole."""
    schema = rows.select("doc_id", group, "score").schema

    def run(batches):
        have = {}
        for pdf in batches:
            out = []
            for i, g, t, s in zip(pdf.doc_id, pdf[group], pdf.text, pdf.score):
                mine = have.setdefault(g, [])
                if len(mine) >= quota:
                    continue
                w = set((t or "").lower().split())
                if all(len(w & o) <= most * len(w | o) for o in mine):
                    mine.append(w)
                    out.append((i, g, s))
            yield pd.DataFrame(out, columns=["doc_id", group, "score"])

    fold = lambda d: d.repartition(group).sortWithinPartitions(group, F.desc("score"), "doc_id").mapInPandas(run, schema)
    order = Window.partitionBy(group).orderBy(F.desc("score"), "doc_id")
    best = fold(rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first).drop("_n"))
    # at most quota rows a group
    full = best.groupBy(group).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= quota).select(group)
    sizes = rows.groupBy(group).count().where(F.col("count") <= first).select(group)
    done = full.unionByName(sizes).distinct()
    rest = rows.join(F.broadcast(done), rows[group].eqNullSafe(done[group]), "left_anti")
    return best.join(F.broadcast(done), best[group].eqNullSafe(done[group]), "left_semi").unionByName(fold(rest.select("doc_id", group, "text", "score")))
