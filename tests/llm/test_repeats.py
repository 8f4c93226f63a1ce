import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quarry.llm import repeats
from quarry.llm.common import text_key
from quarry.llm.repeats import remove_repeats


def brute(texts, length, unit):
    parts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") if unit == "word" else (t or "").encode() for t in texts]
    win = lambda p, i: tuple(p[i:i + length])
    c = Counter(win(p, i) for p in parts for i in range(len(p) - length + 1))
    out = []
    for p in parts:
        dead = set()
        for i in range(len(p) - length + 1):
            if c[win(p, i)] > 1:
                dead.update(range(i, i + length))
        kept = [x for i, x in enumerate(p) if i not in dead]
        spans = sum(i in dead and i - 1 not in dead for i in range(len(p)))
        data = " ".join(kept).encode() if unit == "word" else bytes(kept)
        out.append((len(p), len(dead), spans, hashlib.sha256(data).hexdigest()))
    return out


@pytest.mark.parametrize("unit,length", [("word", 35), ("word", 4), ("byte", 200), ("byte", 7)])
def test_against_brute_force(spark, unit, length):
    rnd = random.Random(length)
    w = lambda n: " ".join(rnd.choice(["a", "bé", "\tc", "dd"]) for _ in range(n))
    passage = w(80)
    texts = [None, "", " ", "x", passage, passage, w(30) + " " + passage, passage + w(200), "z " * 90, w(300)]
    texts += [w(rnd.randrange(1, 60)) + " " + passage[rnd.randrange(40):] for _ in range(6)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, h string, n int")
    r = df.select("doc_id", text_key().alias("key")).join(remove_repeats(df.repartition(3), length, unit), "key")
    got = {x.doc_id: (x.n_units, x.n_removed, x.n_spans, x.kept_sha256) for x in r.collect()}
    want = brute(texts, length, unit)
    assert [got[i] for i in range(len(texts))] == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df, 35, "word").count() == 0


def shared(rnd):
    w = lambda n: " ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(n))
    passage = w(200)
    return [w(rnd.randrange(5, 80)) + " " + passage[rnd.randrange(90):][:rnd.randrange(300, 500)] + " " + w(rnd.randrange(5, 80)) for _ in range(90)]


def test_groups_beyond_the_limit(spark, monkeypatch):
    """Many different regions of one anchor."""
    monkeypatch.setattr(repeats, "LIMIT", 8)
    texts = shared(random.Random(3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    r = df.select("doc_id", text_key().alias("key")).join(remove_repeats(df, 200, "byte"), "key")
    got = {x.doc_id: (x.n_units, x.n_removed, x.n_spans, x.kept_sha256) for x in r.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200, "byte")


def test_order_decides(monkeypatch):
    """Repeats are found by neighbours in suffix order alone: in another order they are not."""
    texts = [t.encode() for t in shared(random.Random(4))[:20]]
    pdf = pd.DataFrame({"g": 0, "r1": range(20), "n": 1, "body": texts})
    find = lambda: {(r, o) for r, os in zip(*repeats.sorted_repeats(pdf, 200).to_dict("list").values()) for o in os}
    count = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 199) if count[t[i:i + 200]] > 1}
    assert find() == want and want
    monkeypatch.setattr(repeats, "suffix_order", lambda sym, sizes: np.random.default_rng(1).permutation(len(sym)))
    assert len(find()) < len(want) / 2


def test_regions_of_large_groups_are_split_where_they_differ_alone(spark):
    """Regions of one anchor with different ends: the windows of blocks that repeat as a whole
    make no rows of their own."""
    rnd = random.Random(5)
    w = lambda n: bytes(rnd.choice(b"abcdefghijklmnop") for _ in range(n))
    core = w(299)
    bodies = [w(x) + core[x:299 - y] + w(y) for x, y in [(rnd.randrange(45), rnd.randrange(45)) for _ in range(60)]]
    n = 200
    short = repeats.short_of(n, "byte")
    keep = []
    for b in bodies:
        sym = repeats.BYTES[np.frombuffer(b, np.uint8)]
        first, last, at, _, _ = repeats.runs(sym, np.array([len(b)]), n, short)
        keep += [(b[x:y + n], b[p:p + short]) for x, y, p in zip(first, last, at)]
    anchor = Counter(a for _, a in keep).most_common(1)[0][0]
    texts = sorted({b for b, a in keep if a == anchor})
    assert len(texts) > repeats.LIMIT
    count = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - n + 1) if count[t[i:i + n]] > 1}
    df = spark.createDataFrame([(1, k, 1, t, True) for k, t in enumerate(texts)], "g long, r1 long, n long, body binary, hot boolean")
    rows, write = {}, repeats.materialize

    def counted(table):
        out = write(table)
        rows[",".join(out.columns)] = out.count()
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(repeats, "materialize", counted)
        got = {(r.r1, o) for r in repeats.hot_repeats(df, n).collect() for o in r.offs}
    assert got == want and want
    assert rows["r1,n,off,w1,w2"] < sum(len(t) - n + 1 for t in texts) / 2, rows
