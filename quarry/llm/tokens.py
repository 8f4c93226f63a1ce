"""Tokens of whole texts with a byte-level BPE (op9), stored as canonical Huffman codes (op1).

Long texts are encoded in overlapping chunks. A word boundary that two neighbouring
chunks share, MARGIN characters away from the earlier chunk's end, is proven stable:
the pre-tokenizer reads left to right, so from there on both see the same text. The
chunks are spliced there; where none is shared the overlap is doubled.

For op1 the library encodes each different word of a process once (`Words`). Text of a stated
alphabet, where \\p{L}, \\p{N} and \\s need no tables, is cut into words by the pre-tokenizer's pattern;
other characters, with all up to the nearest certain ends of words, by the pre-tokenizer. Texts
with added tokens, and other kinds of tokenizers, are encoded whole.

A stored file is a folder: `book` holds the code (id, length), `parts` the documents (part,
doc_id, start, n_tokens, bits, checkpoints) in one folder per range of doc_ids, each in
ascending order. Nothing else is needed to read it. Every block of BLOCK ids starts at a
checkpoint, a bit offset of 64 bits, so that blocks decode alone.

Defined cases: null is the empty text with no tokens; repeated rows count separately;
other columns are ignored; an empty table gives no rows.
"""
import json
import re
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import by_size, documents, materialize, release, shared_dir

CHUNK, OVERLAP, MARGIN = 1 << 16, 1 << 10, 32
MAX_BITS, BLOCK, END_ID = 16, 256, 2
LETTERS, DIGITS, SPACES, MARKS = "A-Za-zÀ-ÖØ-öø-ſЀ-ҁ", "0-9", r"\t\n\r\x20", r"!-/:-@\[-`{-~¡§«°»¿‐-‧€"
PLAIN, OTHER = (re.compile(f"[{x}{LETTERS}{DIGITS}{SPACES}{MARKS}]{y}") for x, y in (("", "*"), ("^", "")))
WORDS = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[{MARKS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
# a word always ends between these two: none holds a space after another character
BREAK, LAST_BREAK = re.compile("(?<=[!-~])(?= )"), re.compile("(?s:.*)(?<=[!-~])(?= )")
KEPT_WORDS, KEPT_CHARS = 1 << 20, 64


def load(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _cuts(enc, base):
    """Character position -> index of the token that starts a word there."""
    w, at = enc.word_ids, enc.offsets  # each read copies the whole list
    return {at[i][0] + base: i for i in range(len(w)) if i == 0 or w[i] != w[i - 1]}


def encode_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    if len(text) <= chunk + overlap:
        return tok.encode(text, add_special_tokens=False).ids
    ids, start, first = [], 0, 0  # `first`: where the current chunk's own tokens begin
    cur = tok.encode(text[:chunk + overlap], add_special_tokens=False)
    end = chunk + overlap
    while end < len(text):
        o = overlap
        while True:
            b = max(end - o, start + 1)
            nxt_end = min(b + chunk + o, len(text))
            nxt = tok.encode(text[b:nxt_end], add_special_tokens=False)
            mine, theirs = _cuts(cur, start), _cuts(nxt, b)
            lo = cur.offsets[first][0] + start
            at = [p for p in theirs if p in mine and lo <= p <= end - MARGIN and p > b]
            if at:
                p = at[-1]
                break
            if b == start + 1 or o >= end - start:  # no shared boundary: take a longer chunk
                end = min(end + chunk, len(text))
                cur = tok.encode(text[start:end], add_special_tokens=False)
                if end == len(text):
                    return ids + cur.ids[first:]
                o = overlap
            else:
                o *= 2
        ids += cur.ids[first:mine[p]]
        cur, start, end, first = nxt, b, nxt_end, theirs[p]
    return ids + cur.ids[first:]


def encode_texts(tok, texts) -> list[list[int]]:
    texts = [t or "" for t in texts]
    short = [i for i, t in enumerate(texts) if len(t) <= CHUNK]
    out = [None] * len(texts)
    for i, e in zip(short, tok.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)):
        out[i] = e.ids
    return [encode_long(tok, t) if o is None else o for t, o in zip(texts, out)]


class Words(dict):
    """Ids of a word as bytes of `kind`, asked of the library when first met. Long words are not
    kept, and all are forgotten when KEPT_WORDS are."""
    def __init__(self, path: str, kind: str):
        self.tok, self.kind = load(path), kind
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                     and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout"))
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if self.cuts:
            self.pre, self.model = self.tok.pre_tokenizer.pre_tokenize_str, self.tok.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if len(word) > CHUNK:
            return np.array(encode_long(self.tok, word), self.kind).tobytes()
        # printable ASCII but the space stands for itself in the byte-level alphabet
        pieces = [word.replace(" ", "Ġ")] if word.isascii() and word.isprintable() else [p for p, _ in self.pre(word)]
        ids = np.array([t.id for p in pieces for t in self.model(p)], self.kind).tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def cut(self, text: str) -> list[str]:
        out, start = [], 0
        while m := OTHER.search(text, start):
            before, after = LAST_BREAK.match(text, start, m.start()), BREAK.search(text, m.end())
            lo, hi = before.end() if before else start, after.end() if after else len(text)
            part = text[lo:hi]
            out += WORDS.findall(text, start, lo)
            out += [part[a:b] for _, (a, b) in self.pre(part)]
            start = hi
        return out + WORDS.findall(text, start)

    def encode(self, texts) -> list[bytes]:
        texts, of = [t or "" for t in texts], self.__getitem__
        whole = [i for i, t in enumerate(texts) if not self.cuts or any(a in t for a in self.added)]
        out = dict(zip(whole, encode_texts(self.tok, [texts[i] for i in whole])))
        return [np.array(out[i], self.kind).tobytes() if i in out else b"".join(b"".join(map(of, self.cut(s))) for s in _stretches(t))
                for i, t in enumerate(texts)]


def _stretches(text: str):
    """The text in parts of about CHUNK characters that end where a word does."""
    start = 0
    while len(text) - start > CHUNK and (m := BREAK.search(text, start + CHUNK)):  # looks behind that position too
        yield text[start:m.end()]
        start = m.end()
    yield text[start:]


@lru_cache(2)
def words_of(path: str, kind: str) -> Words:
    """One for all tasks of a process."""
    return Words(path, kind)


def _quiet():
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    def run(batches):
        _quiet()
        tok = load(path)
        for big in batches:
            for pdf in by_size(big, chars=500_000, rows=128):
                n = [len(x) for x in encode_texts(tok, pdf.text)]
                yield pd.DataFrame({"doc_id": pdf.doc_id, "n_bytes": [len((t or "").encode()) for t in pdf.text], "n_tokens": n, "over_limit": [x > limit for x in n]})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Length-limited Huffman code lengths by package-merge; counts are positive."""
    n = len(counts)
    if n == 1:
        return np.array([1])
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, isleaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        m = len(level) // 2 * 2
        packs = level[0:m:2] + level[1:m:2]
        both, leaf = np.concatenate([leaves, packs]), np.concatenate([np.ones(n, bool), np.zeros(len(packs), bool)])
        o = np.argsort(both, kind="stable")
        level = both[o]
        isleaf.append(leaf[o])
    out, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(isleaf):
        k = int(leaf[:take].sum())
        out[:k] += 1
        take = 2 * (take - k)
    res = np.empty(n, np.int64)
    res[order] = out
    return res


def canonical(ids: np.ndarray, lengths: np.ndarray):
    """Codes of `ids` (ordered by length, then id) and the decoding table of MAX_BITS bits."""
    o = np.lexsort((ids, lengths))
    span = (1 << (MAX_BITS - lengths[o])).astype(np.int64)
    firsts = np.concatenate([[0], np.cumsum(span)[:-1]])
    codes = np.empty(len(ids), np.int64)
    codes[o] = firsts >> (MAX_BITS - lengths[o])
    size = 1 << MAX_BITS
    sym, ln = np.zeros(size, np.uint32), np.ones(size, np.int64)
    used = int(span.sum())
    sym[:used], ln[:used] = np.repeat(ids[o], span), np.repeat(lengths[o], span)
    return codes, sym, ln


def pack(codes: np.ndarray, lens: np.ndarray, counts: np.ndarray):
    """Of each document (`counts` codes, 1 at least): the bits as bytes, and the bit offset at which
    every block starts. Documents begin at words of 32 bits while they are packed."""
    ends, last = np.cumsum(lens), np.cumsum(counts)
    first = last - counts
    begin = ends[first] - lens[first]
    bits = ends[last - 1] - begin
    words = (bits + 31) // 32
    word = np.cumsum(words) - words
    rel = ends - lens - np.repeat(begin, counts)
    pos = rel + np.repeat(word * 32, counts)
    v = codes.astype(np.uint64) << (64 - lens - (pos & 31)).astype(np.uint64)
    at = pos >> 5
    runs = np.flatnonzero(np.diff(at, prepend=-1))
    sums, at = np.add.reduceat(v, runs), at[runs]  # codes share no bit, so adding is or
    buf = np.zeros(int(words.sum()) + 1, np.uint64)
    buf[at] = sums >> np.uint64(32)
    buf[at + 1] += sums & np.uint64(0xFFFFFFFF)
    data = buf.astype(">u4").tobytes()
    return ([data[4 * w:4 * w + (b + 7) // 8] for w, b in zip(word.tolist(), bits.tolist())],
            [rel[a:z:BLOCK].astype("<u8").tobytes() for a, z in zip(first.tolist(), last.tolist())])


def unpack(payloads, checkpoints, counts, sym, ln) -> list[np.ndarray]:
    """Decode all blocks side by side; each starts at its own checkpoint."""
    base = np.cumsum([0] + [len(p) for p in payloads[:-1]]) * 8
    data = np.frombuffer(b"".join(payloads) + b"\0\0\0\0", np.uint8).astype(np.uint32)
    ahead = data[:-2] << 16 | data[1:-1] << 8 | data[2:]  # 24 bits from every byte on
    pos = np.concatenate([np.frombuffer(c, "<u8").astype(np.int64) + b for c, b in zip(checkpoints, base)])
    left = np.concatenate([np.minimum(BLOCK, n - np.arange(0, n, BLOCK)) for n in counts])
    order = np.argsort(-left, kind="stable")  # the longest first: those still open are a prefix
    pos, table = pos[order], sym.astype(np.int64) << 5 | ln
    live = np.searchsorted(-left[order], -np.arange(int(left.max())), side="left")
    out = np.zeros((BLOCK, len(pos)), np.uint32)
    for i, k in enumerate(live.tolist()):
        p = pos[:k]
        e = table[ahead[p >> 3] >> (8 - (p & 7)).astype(np.uint32) & 0xFFFF]
        out[i, :k] = e >> 5
        p += e & 31
    back = np.empty((len(pos), BLOCK), np.uint32)
    back[order] = out.T
    flat = back.ravel()[(np.arange(BLOCK) < left[:, None]).ravel()]
    return np.split(flat, np.cumsum(counts)[:-1])


def huffman_store(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the folder `path`."""
    def encode(batches):
        from pyspark import TaskContext
        _quiet()
        words, end = words_of(tokenizer, kind), np.array([END_ID], kind).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for big in batches:
            for pdf in by_size(big, chars=500_000, rows=128):
                rows = []
                for d, x in zip(pdf.doc_id, words.encode(pdf.text)):
                    n = len(x) // len(end) + 1
                    rows.append((part, d, before, n, x + end))
                    before += n
                yield pd.DataFrame(rows, columns=["part", "doc_id", "before", "n_tokens", "ids"])

    def count(batches):
        total = np.zeros(0, np.int64)
        for pdf in batches:
            c = np.bincount(np.frombuffer(b"".join(pdf.ids), kind))
            if len(c) > len(total):
                c, total = total, c.astype(np.int64)
            total[:len(c)] += c
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    spark, kind = docs.sparkSession, "<u2" if load(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
    in_order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")
    raw = materialize(in_order.mapInPandas(encode, "part int, doc_id long, before long, n_tokens long, ids binary"))
    # at most the vocabulary's size in rows
    book = raw.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    if not len(book):
        book = pd.DataFrame({"id": [END_ID], "n": [1]})
    ids, lengths = book.id.to_numpy(), code_lengths(book.n.to_numpy())
    spark.createDataFrame(pd.DataFrame({"id": ids, "length": lengths})).coalesce(1).write.parquet(f"{path}/book")
    codes, _, _ = canonical(ids, lengths)
    # one row per range partition
    parts = raw.groupBy("part").agg(F.min("doc_id").alias("lo"), F.sum("n_tokens").alias("n")).toPandas().sort_values(["lo", "part"], na_position="first")
    base = dict(zip(parts.part, (parts.n.cumsum() - parts.n).astype(int)))
    rank = dict(zip(parts.part, range(len(parts))))
    code_of, len_of = np.zeros(int(ids.max()) + 1, np.int64), np.zeros(int(ids.max()) + 1, np.int64)
    code_of[ids], len_of[ids] = codes, lengths

    def store(batches):
        for big in batches:
            for pdf in by_size(big, "ids", 1_000_000, 1024):
                at = np.frombuffer(b"".join(pdf.ids), kind)
                bits, checkpoints = pack(code_of[at], len_of[at], pdf.n_tokens.to_numpy())
                yield pd.DataFrame({"part": pdf.part.map(rank), "doc_id": pdf.doc_id, "start": pdf.before + pdf.part.map(base), "n_tokens": pdf.n_tokens, "bits": bits, "checkpoints": checkpoints})

    table = raw.mapInPandas(store, "part int, doc_id long, start long, n_tokens long, bits binary, checkpoints binary")
    table.sortWithinPartitions("part", "start").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/parts")
    release(raw)


def huffman_read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) from the folder `path` alone."""
    book = spark.read.parquet(f"{path}/book").orderBy("id").toPandas()  # at most the vocabulary's size in rows

    def read(batches):
        _, sym, ln = canonical(book.id.to_numpy(), book.length.to_numpy())
        for big in batches:
            for pdf in by_size(big, "bits", 500_000):
                out = unpack(list(pdf.bits), list(pdf.checkpoints), pdf.n_tokens.to_numpy(), sym, ln)
                yield pd.DataFrame({"doc_id": pdf.doc_id, "start": pdf.start, "n_tokens": pdf.n_tokens, "ids": [x.astype("<u4").tobytes() for x in out]})

    table = spark.read.schema("doc_id long, start long, n_tokens long, bits binary, checkpoints binary, part int").parquet(f"{path}/parts")
    return table.drop("part").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def op1_huffman_ids(spark, sf_dir):
    import public_tokenizers
    path = f"{shared_dir(spark)}/quarry/{uuid.uuid4().hex}"
    huffman_store(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return huffman_read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_token_counts(spark, sf_dir):
    import public_tokenizers
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
