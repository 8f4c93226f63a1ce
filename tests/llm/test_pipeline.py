"""Every stage of the corpus pipeline against a brute-force version on a small table."""
import random
from collections import Counter

import pytest

import corpus_pipeline as P
from quarry.llm import toxicity

CLASHES = [f"{i} AS `{c}`" for i, c in enumerate(("_row", "score", "key", "id", "kept", "size", "source_size", "copies", "copy", "position", "_h", "last", "h", "did", "class", "part", "shard"))]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """documents with nulls, ties, repeated rows and clashing names, and labels without a row."""
    rnd, d = random.Random(12), str(tmp_path_factory.mktemp("sf"))
    w = lambda n: " ".join(rnd.choice("abcdefghij") + rnd.choice("xyz") + str(rnd.randrange(30)) for _ in range(n))
    passage, base = w(90), w(150).split(" ")
    texts = [None, "", "", "short", "you stupid idiot. you moron! trash, all of you", passage + " " + w(40), w(60) + " " + passage, w(5000)]
    for _ in range(5):
        t = list(base)
        t[rnd.randrange(150)] = "edit"
        texts.append(" ".join(t))
    texts += [w(rnd.randrange(20, 300)) for _ in range(30)]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, w(30), None, "s1", 7), (None, None, None, None, None), (20, w(80), "de", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *CLASHES).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """documents and every stage's result, as rows."""
    docs, base, out = spark.read.parquet(f"{sf}/documents.parquet"), tmp_path_factory.mktemp("out"), []
    out.append(docs.collect())
    for name, stage in P.STAGES:
        r = stage(spark, docs, sf)
        if name != "packing":
            assert r.columns == docs.columns
        r.write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out.append(docs.collect())
    return out


def words(t):
    return (t or "").split()


def test_toxicity(steps):
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.INSULTS, toxicity.FIXED))
    keep = [r for r in steps[0] if not toxicity.features(r.text, lexicon)[0] >= toxicity.FIXED]
    assert Counter(map(str, steps[1])) == Counter(map(str, keep)) and len(keep) == len(steps[0]) - 1


def test_near_dedup(steps):
    rows = steps[1]
    bag = lambda t: Counter(tuple(words(t)[i:i + 5]) for i in range(max(1, len(words(t)) - 4))) if words(t) else Counter()
    bags, root = [bag(r.text) for r in rows], list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            all_ = sum((bags[i] | bags[j]).values())
            if (rows[i].text or "") == (rows[j].text or "") or all_ and sum((bags[i] & bags[j]).values()) >= 0.8 * all_:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    assert len(steps[2]) == len(groups)
    order = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert sorted(map(order, steps[2])) == sorted(min(map(order, g)) for g in groups.values())
    assert {str(r) for r in steps[2]} <= {str(r) for r in rows}


def test_suffix_dedup(steps):
    texts = [(r.text or "").encode() for r in steps[2]]
    count = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for r, t in zip(steps[2], texts):
        dead = {j for i in range(len(t) - 199) if count[t[i:i + 200]] > 1 for j in range(i, i + 200)}
        text = bytes(x for i, x in enumerate(t) if i not in dead).decode() if dead else r.text
        want.append(str({**r.asDict(), "text": text, "n_chars": len(text) if dead else r.n_chars}))
    assert Counter(str(r.asDict()) for r in steps[3]) == Counter(want)


def test_mixing(steps):
    before, after = Counter(map(str, steps[3])), Counter(map(str, steps[4]))
    assert set(after) <= set(before) and all(after[k] <= 3 * before[k] for k in after)
    size = Counter()
    for r in steps[3]:
        size[r.source] += len(words(r.text))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(size.values()), {}
    while True:
        free = [s for s in size if s not in fixed]
        target = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3 * size[s] for s in over}
    for s, want in {**fixed, **target}.items():
        taken = sum(len(words(r.text)) for r in steps[4] if r.source == s)
        assert abs(taken - want) <= max(len(words(r.text)) for r in steps[3] if r.source == s)


def test_packing(steps):
    pieces = Counter()
    for r in steps[5]:
        pieces[r.doc_id] += r.n_words
    want = Counter()
    for r in steps[4]:
        want[r.doc_id] += len(words(r.text))
    assert pieces == want
    bins = Counter()
    for r in steps[5]:
        bins[r.bin_id] += r.n_words
    assert all(bins[r.bin_id] == r.bin_words <= r.capacity for r in steps[5])


def test_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_run_leaves_other_results(spark, sf):
    """A run deletes the tables of its own steps alone."""
    from quarry.llm import bagminhash
    lazy = bagminhash.with_class(spark.read.parquet(f"{sf}/documents.parquet"))
    assert P.run(spark, sf).count() > 0 and lazy.count() == 48
