"""Prompts, and the model calls that users plug in; the defaults need no model."""
import hashlib
import math
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Templates of the context and of the user's prompt.
RULE = "-" * 70
CONTEXT = RULE + "\nSource label: {}\nCompany: {} | Year: {} | Section: {}\nDocument Content:\n{}\n"
USER = "Context documents:\n{}\nQuestion: {}\n\nAnswer:"


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, system: str, user: str) -> str: ...


def filled(template: str, *parts):
    """The template with columns in place of its braces."""
    pieces = template.split("{}")
    return F.concat(F.lit(pieces[0]), *[x for c, p in zip(parts, pieces[1:]) for x in (F.coalesce(c.cast("string"), F.lit("None")), F.lit(p))])


def contexts(ranked: DataFrame) -> DataFrame:
    """query_id, context of ranked rows (query_id, rank, id, ticker, year, section, text)."""
    part = filled(CONTEXT, F.col("id"), F.col("ticker"), F.col("year"), F.col("section"), F.col("text"))
    return _joined(ranked, part, "\n").withColumnRenamed("joined", "context")


def listings(ranked: DataFrame) -> DataFrame:
    """query_id, listing of candidates for a judge."""
    return _joined(ranked, filled("\n[{}] Chunk ID: {}\nText: {}\n", F.col("rank"), F.col("id"), F.col("text")), "").withColumnRenamed("joined", "listing")


def _joined(ranked, part, sep):
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("ps"))  # a query's top rows
    return rows.select("query_id", F.array_join(F.transform("ps", lambda p: p["part"]), sep).alias("joined"))


def prompts(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, prompt."""
    return contexts(ranked).join(queries, "query_id").select("query_id", filled(USER, F.col("context"), F.col("text")).alias("prompt"))


class HashEmbedder:
    """Words hashed to signed dimensions, of length 1: a stand-in for a trained encoder."""
    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, texts):
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def embed(make: Callable[[], Embedder], batch: int = 32):
    """A column function: the embedder is made once per worker and sees `batch` texts at a time."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            texts = s.tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in model.encode(texts[i:i + batch])], dtype=object)
    return run


class Echo:
    """Answers with the last line before the answer's mark: a stand-in for a language model."""
    def generate(self, system, user):
        return user.rsplit("Question: ", 1)[-1].split("\n")[0]


class Retry:
    """Tries again after 5, 10, 20... seconds; in the end gives `failed`."""
    def __init__(self, model: Generator, tries: int = 5, wait: float = 5.0, failed: str = "", sleep=time.sleep):
        self.model, self.tries, self.wait, self.failed, self.sleep = model, tries, wait, failed, sleep

    def generate(self, system, user):
        for i in range(self.tries):
            try:
                return self.model.generate(system, user)
            except Exception:  # noqa: BLE001, whatever a provider raises
                if i + 1 < self.tries:
                    self.sleep(self.wait * 2 ** i)
        return self.failed


class Fallback:
    """The first model until it fails once, from then on the second."""
    def __init__(self, first: Generator, second: Generator, failed: str = "Error: no model answers."):
        self.models, self.failed = [first, second], failed

    def generate(self, system, user):
        while self.models:
            try:
                return self.models[0].generate(system, user)
            except Exception:  # noqa: BLE001, whatever a provider raises
                self.models = self.models[1:]
        return self.failed


def generate(make: Callable[[], Generator], system: str):
    """A column function from prompts to answers; quotes are left out of questions by the caller."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield s.map(lambda p: model.generate(system, p))
    return run


def unquoted(c):
    return F.translate(c, "\"'", "")
