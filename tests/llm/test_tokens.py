import glob
import pathlib
import random
import subprocess
import sys
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from quarry.llm import tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["don't ", "  \n\n ", "日本語", "é", "x" * 90, "<|endoftext|>", " 12345", "!!!", "'re", "\t", " word", "<|endof"]


def test_splicing_matches_whole_encoding():
    tok, rnd = T.load(PATH), random.Random(5)
    for _ in range(12):
        s = "".join(rnd.choice(ODD) for _ in range(rnd.randrange(50, 900)))
        assert T.encode_long(tok, s, 200, 70) == tok.encode(s, add_special_tokens=False).ids
    for s in ("a" * 3000, " " * 3000, "ab " * 2000):
        assert T.encode_long(tok, s, 200, 70) == tok.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 3, 40, 5000])
def test_lengths_are_complete_and_limited(n):
    c = np.array([int(1.5 ** min(i, 80)) + 1 for i in range(n)], dtype=np.int64)
    l = T.code_lengths(c)
    assert l.min() >= 1 and l.max() <= T.MAX_BITS
    assert n == 1 or sum(2.0 ** -l) == 1


def test_round_trip(spark, tmp_path):
    texts = [None, "", "hello", "hello", "x <|endoftext|> y", "long text " * 30000, "日本語 " * 900]
    df = spark.createDataFrame([(i * 3, t, i) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    T.huffman_store(df, PATH, f"{tmp_path}/a")
    tok, start = T.load(PATH), 0
    got = {r.doc_id: r for r in T.huffman_read(spark, f"{tmp_path}/a").collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i * 3].start, got[i * 3].n_tokens) == (start, len(ids))
        assert zlib.crc32(got[i * 3].ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    counts = {r.doc_id: r.n_tokens for r in T.token_counts(df, PATH).collect()}
    assert all(counts[k] == got[k].n_tokens - 1 for k in counts)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    T.huffman_store(df, PATH, f"{tmp_path}/a")
    assert T.huffman_read(spark, f"{tmp_path}/a").count() == 0 and T.token_counts(df, PATH).count() == 0


def test_order_over_parts_and_files(spark, tmp_path):
    """Every file of a part is in ascending order, parts follow one another, and a process that
    knows the folder alone decodes it."""
    df = spark.createDataFrame([(i * 7 % 1009, f"text number {i} " * (i % 9), i) for i in range(1009)], "doc_id long, text string, part int").repartition(7)
    T.huffman_store(df, PATH, f"{tmp_path}/a")
    last, start = -1, 0
    for part in sorted(glob.glob(f"{tmp_path}/a/parts/part=*"), key=lambda p: int(p.split("=")[-1])):
        t = pd.concat([pd.read_parquet(f) for f in sorted(glob.glob(f"{part}/*.parquet"))])
        assert t.doc_id.is_monotonic_increasing and t.doc_id.iloc[0] > last and t.start.iloc[0] == start
        last, start = t.doc_id.iloc[-1], start + t.n_tokens.sum()
    assert len(glob.glob(f"{tmp_path}/a/parts/part=*")) > 1
    code = f"""
import glob, sys, pandas as pd
sys.path.insert(0, {str(pathlib.Path(T.__file__).parents[2])!r})
from quarry.llm import tokens as T
book = pd.read_parquet("{tmp_path}/a/book")
_, sym, ln = T.canonical(book.id.to_numpy(), book.length.to_numpy())
t = pd.concat([pd.read_parquet(f) for f in glob.glob("{tmp_path}/a/parts/part=*/*.parquet")])
print(sum(int(x.sum()) for x in T.unpack(list(t.bits), list(t.checkpoints), t.n_tokens.to_numpy(), sym, ln)))
"""
    tok = T.load(PATH)
    want = sum(sum(tok.encode(r.text, add_special_tokens=False).ids) + 2 for r in df.collect())
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) == want


def test_words_are_those_of_the_pre_tokenizer():
    """Every character of the alphabet, between others of every class."""
    pre = T.load(PATH).pre_tokenizer
    chars = [c for c in map(chr, range(0x3000)) if T.PLAIN.fullmatch(c)]
    assert len(chars) > 400
    around = ["", "a", "1", "!", " ", "\n", "'", "é", "  "]
    for c in chars:
        for s in ["".join((a, c, b, c, c, a)) for a in around for b in around]:
            assert [s[a:b] for _, (a, b) in pre.pre_tokenize_str(s)] == T.WORDS.findall(s), s


def test_each_word_is_encoded_once_and_texts_as_whole(monkeypatch):
    tok, rnd = T.load(PATH), random.Random(7)
    bits = ODD + ["\u00a0", "\x0b", "\x1c", "\x85", "\u2028", "²", "ª", "Ж", "“", "…", "'ll", "'S", " '", "\r\n", "e\u0301", "😀", "\x00", " the", "é" * 70]
    plain = [b for b in bits if T.PLAIN.fullmatch(b) and "endoftext" not in b]
    texts = [None, ""] + ["".join(rnd.choice(kind) for _ in range(rnd.randrange(1, 40))) for kind in (bits, plain, plain) for _ in range(1500)]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    words, asked = T.Words(PATH, "<u2"), []
    model = words.model
    words.model = lambda w: asked.append(w) or model(w)
    assert [np.frombuffer(x, "<u2").tolist() for x in words.encode(texts)] == want
    kept = len(asked)
    words.encode(["don't  the 😀 word 12345", "the\u00a0word word the word the word"] * 50)
    assert len(asked) - kept <= 20
    kept = len(asked)
    words.encode(["don't  the word 12345" for _ in range(50)])
    assert len(asked) - kept <= 6 and len([w for w in asked if len(w) < 9]) == len({w for w in asked if len(w) < 9})
    monkeypatch.setattr(T, "KEPT_WORDS", 5)
    monkeypatch.setattr(T, "CHUNK", 50)
    odd = [b for b in bits if "endoftext" not in b]
    long = ["".join(rnd.choice(kind) for _ in range(600)) for kind in (plain, odd) for _ in range(20)] + ["日本" * 900, "日本 " * 900, "a" * 3000, " " * 3000, "a  b " * 400]
    assert [np.frombuffer(x, "<u2").tolist() for x in T.Words(PATH, "<u2").encode(long)] == [tok.encode(t, add_special_tokens=False).ids for t in long]


def test_other_tokenizers_encode_whole(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers
    t = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, "Ġ": 3, "Ġab": 4}, [("a", "b"), ("Ġ", "ab")]))
    t.normalizer, t.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.save(f"{tmp_path}/t.json")
    assert np.frombuffer(T.Words(f"{tmp_path}/t.json", "<u2").encode(["AB ab"])[0], "<u2").tolist() == t.encode("AB ab").ids == [4, 4]


def test_documents_packed_together():
    rnd = np.random.default_rng(3)
    ids = np.arange(300)
    lengths = T.code_lengths((1.2 ** (ids % 60)).astype(np.int64) + 1)
    codes, sym, ln = T.canonical(ids, lengths)
    counts = np.array([1, 256, 257, 1, 1, 2000, 31, 512] + list(rnd.integers(1, 40, 200)))
    at = rnd.integers(0, 300, counts.sum())
    bits, checkpoints = T.pack(codes[at], lengths[at], counts)
    docs = np.split(at, np.cumsum(counts)[:-1])
    for d, b, c in zip(docs, bits, checkpoints):
        s = "".join(f"{codes[i]:0{lengths[i]}b}" for i in d)
        assert b == int(s.ljust(-(-len(s) // 8) * 8, "0"), 2).to_bytes(-(-len(s) // 8), "big")
        starts = np.cumsum(lengths[d]) - lengths[d]
        assert np.frombuffer(c, "<u8").tolist() == starts[::T.BLOCK].tolist()
    for d, x in zip(docs, T.unpack(bits, checkpoints, counts, sym, ln)):
        assert x.tolist() == d.tolist()
