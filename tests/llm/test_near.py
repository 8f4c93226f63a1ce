import random
from collections import Counter

import numpy as np

from quarry.llm import bagminhash as B, packing as P


def test_signature_is_unbiased():
    rnd = np.random.default_rng(1)
    a, b = {i: int(rnd.integers(1, 9)) for i in range(60)}, {i: int(rnd.integers(1, 9)) for i in range(20, 80)}
    want = sum(min(a.get(i, 0), b.get(i, 0)) for i in range(80)) / sum(max(a.get(i, 0), b.get(i, 0)) for i in range(80))
    got = []
    for seed in range(30):
        el = B.mix(np.arange(80, dtype=np.uint64) + np.uint64(1000 * seed + 7))
        bag = lambda m: np.sort(np.concatenate([np.repeat(el[i:i + 1], c) for i, c in m.items()]))
        s = B.signatures([bag(a), bag(b), np.empty(0, np.uint64)])
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - want) < 0.03


def bag(t):
    w = (t or "").split()
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def test_classes_against_brute_force(spark):
    rnd = random.Random(3)
    w = lambda n: [rnd.choice("abcdefghij") + rnd.choice("xyz") for _ in range(n)]
    texts = [None, "", "", "one", "one", "two words"]
    for _ in range(12):
        base = w(rnd.randrange(60, 200))
        for _ in range(rnd.randrange(1, 8)):
            t = list(base)
            for _ in range(rnd.randrange(0, 4)):
                t[rnd.randrange(len(t))] = "edit"
            texts.append(" ".join(t))
    bags, root = [bag(t) for t in texts], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            both, all_ = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (texts[i] or "") == (texts[j] or "") or (all_ and both / all_ >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    got = {r._row.doc_id: r.class_id for r in B.with_class(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert B.with_class(df.limit(0)).count() == 0 and B.one_of_each(df.limit(0)).count() == 0


def test_packing(spark):
    rnd = random.Random(4)
    sizes = [rnd.choice([0, 1, 9, 300, 700, 4096, 5000, 9000]) for _ in range(300)]
    df = spark.createDataFrame([(i, "w " * s if s or i % 2 else None, "x") for i, s in enumerate(sizes)] + [(0, "w " * sizes[0], "x")], "doc_id long, text string, piece string")
    rows = P.pack_documents(df).collect()
    words, cap = Counter(), {}
    for r in rows:
        words[r.bin_id] += r.n_words
        cap[r.bin_id] = r.capacity
        assert r.capacity in P.CAPACITIES
    assert sum(words.values()) == sum(sizes) + sizes[0]
    for b in words:
        assert words[b] <= cap[b] and all(c >= cap[b] or c < words[b] for c in P.CAPACITIES)
    assert sum(words.values()) / sum(cap.values()) > 0.9
    assert P.pack_documents(df.limit(0)).count() == 0


def test_edits_of_edits_in_a_large_group(spark):
    """A text whose near texts leave every bucket with a center that matches them alone."""
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(words) for _ in range(300)]

    def edit(t, k):
        t = list(t)
        for i in rnd.sample(range(len(t)), k):
            t[i] = rnd.choice(words)
        return t

    near = [edit(base, 2) for _ in range(400)]
    texts = [" ".join(t) for t in near] + [" ".join(edit(near[0], 6))]
    bags, root = [bag(t) for t in texts], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i) if i >= 400 else [0]:
            if i != j and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r._row.doc_id: r.class_id for r in B.with_class(df).collect()} == {i: find(i) for i in range(len(texts))}


def test_packing_against_all_assignments():
    """The plan taken costs no more than any single opening capacity, and on tiny sets no more
    than 1.25 times the best of all assignments."""
    rnd, caps = random.Random(8), (4, 8, 16)
    cost = lambda bins: sum(P.cost(min(c for c in caps if c >= u)) for u in bins)

    def best(sizes, bins=()):
        if not sizes:
            return cost(bins)
        s, rest = sizes[0], sizes[1:]
        ways = [bins[:i] + (b + s,) + bins[i + 1:] for i, b in enumerate(bins) if b + s <= max(caps)] + [bins + (s,)]
        return min(best(rest, w) for w in ways)

    for _ in range(30):
        sizes = [rnd.randrange(0, 17) for _ in range(6)]
        bins, room = P.pack(sizes, caps)
        used = [sum(s for s, b in zip(sizes, bins) if b == i) for i in range(len(room))]
        assert all(u <= c and (c == 4 or u > c // 2) for u, c in zip(used, room))
        mine = sum(map(P.cost, room))
        assert mine <= 1.25 * best(sizes)
        assert all(mine <= sum(map(P.cost, P.best_fit(sizes, list(caps), c)[1])) for c in caps)


def test_first_row_of_each_class(spark):
    """Null and repeated doc_ids, rows equal in all columns, and columns named as the operator's own."""
    a, b = "one two three four five six", "some other text of seven words here"
    rows = [(None, a, 1, "p"), (4, a, 1, "q"), (2, a, 9, "r"), (2, a, 9, "r"), (2, a, 8, "s"), (7, b, 0, None), (None, None, 3, "x"), (None, None, 3, "x"), (9, "", 3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, key string").selectExpr("doc_id", "text", "id", "key", "1 AS h", "2 AS last", "3 AS _row", "4 AS band").repartition(4)
    got = sorted((r.doc_id, r.text, r.id, r.key) for r in B.one_of_each(df).collect())
    assert len(got) == 3 and got[0][0] == 2 and got[0][1] == a and got[1:] == [(7, b, 0, None), (9, "", 3, "y")]
    assert got == sorted((r.doc_id, r.text, r.id, r.key) for r in B.one_of_each(df.repartition(2)).collect())
    assert {(r._row.doc_id, r.class_id) for r in B.with_class(df).collect()} == {(None, 2), (4, 2), (2, 2), (7, 7), (None, 9), (9, 9)}


def test_recall_on_random_near_pairs():
    """Share of pairs at similarity 0.8 or a little more that meet in a bucket."""
    rnd, met, n = random.Random(9), 0, 0
    words = [f"w{i}" for i in range(500)]
    while n < 300:
        t = [rnd.choice(words) for _ in range(rnd.randrange(60, 300))]
        u = list(t)
        for i in rnd.sample(range(len(u)), max(1, len(u) // 50)):
            u[i] = rnd.choice(words)
        bags = B.bags_of([" ".join(t), " ".join(u)])
        if 0.8 <= B.similarity(*bags) < 0.9:
            x = B.bands(B.signatures(bags))
            n, met = n + 1, met + bool((x[0] == x[1]).any())
    assert met / n >= 0.99


def test_classes_joined_edge_set_by_edge_set_equal_union_find(spark):
    rng = random.Random(5)
    sets = [[(i, i + 1) for i in range(0, 9)], [(9, 40), (41, 42), (3, 3 + 50)], [(rng.randrange(200), rng.randrange(200)) for _ in range(60)]]
    sets[2] = [(a, b) for a, b in sets[2] if a != b]
    up, root = {}, None

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x
    for edges in sets:
        root = B.joined(root, spark.createDataFrame(edges, "a long, b long"))
        for a, b in edges:
            a, b = sorted((top(a), top(b)))
            up[b] = a
        got = {r.node: r.root for r in root.collect()}
        assert len(got) == root.count()
        assert {n: got.get(n, n) for n in range(200)} == {n: top(n) for n in range(200)}


def test_alike_texts_that_are_not_near_are_not_compared_in_pairs(spark, monkeypatch):
    """Edits of one text that it rejects, some with a near copy: all links are found, and the
    compared pairs do not grow with the square of the group."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(3000)]

    def edit(t, k):
        t = list(t)
        for i in rnd.sample(range(len(t)), k):
            t[i] = rnd.choice(words)
        return t

    base = [rnd.choice(words) for _ in range(300)]
    far = [edit(base, 12) for _ in range(300)]
    texts = [" ".join(t) for t in [base, *far, *[edit(t, 2) for t in far[:20]], *[edit(base, 3) for _ in range(20)]]]
    bags, root = [bag(t) for t in texts], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    compared, check = [], B.with_likeness
    monkeypatch.setattr(B, "FEW", 2, raising=False)
    monkeypatch.setattr(B, "with_likeness", lambda pairs, bags: compared.append(pairs.count()) or check(pairs, bags))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r._row.doc_id: r.class_id for r in B.with_class(df).collect()} == {i: find(i) for i in range(len(texts))}
    assert len({find(i) for i in range(len(texts))}) > 250
    assert sum(compared) < 10 * len(texts), compared
