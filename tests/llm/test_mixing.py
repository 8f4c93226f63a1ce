from quarry.llm.mixing import mix


def targets(sizes, cap=3):
    """Independent water-filling: cap and reshare until none is above."""
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **t}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i % 7 * 10), s, 1) for i, s in enumerate(["b"] * 400 + ["a"] * 8 + [None] * 60 + ["c"] * 3 + ["d"] * 90)] + [(0, None, "b", 1), (1, "w " * 10, "b", 1)]
    r = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size2 int"), keep=["doc_id"]).collect()
    assert len(r) == len(rows)
    sizes = {}
    for x in r:
        sizes[x.source] = sizes.get(x.source, 0) + x["size"]
    want = targets(sizes)
    for s in sizes:
        mine = [x for x in r if x.source == s]
        assert all(abs(x.target - want[s]) < 1e-6 * max(1, want[s]) for x in mine)
        assert abs(sum(x.taken for x in mine) - want[s]) <= 40
    assert all(0 <= x.taken <= 3 * x["size"] and 0 <= x.position <= 1 for x in r)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def mixed(spark):
    rows = [(i, "w " * (5000 if s == "a" else 10 + i % 90), s) for i, s in enumerate(["a"] * 3 + ["b"] * 500 + ["c"] * 40 + [None] * 60)] + [(700, "w " * 50, "c")] * 4
    r = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    return {s: [x for x in r if x.source == s] for s in {x.source for x in r}}


def test_copies_meet_targets(spark):
    for mine in mixed(spark).values():
        assert all(x.taken == x.copies * x["size"] and 0 <= x.copies <= 3 for x in mine)
        assert abs(sum(x.copies * x["size"] for x in mine) - mine[0].target) <= max(x["size"] for x in mine)


def test_positions_follow_cumulative_words(spark):
    """The words of copies up to position t are the integral of the schedule up to t."""
    for mine in mixed(spark).values():
        total, big, a = mine[0].target, max(x["size"] for x in mine), mine[0].slope
        at = 0
        for x in sorted((x for x in mine if x.copies), key=lambda x: x.position):
            place = (1 - a) * x.position + a * x.position ** 2
            assert abs(place * total - at) <= big
            at += x["size"]
        assert len({x.position for x in mine if x._row.doc_id == 700 and x.copies}) == sum(x._row.doc_id == 700 and x.copies > 0 for x in mine)


def test_other_columns_and_caps(spark):
    """Columns named as the operator's own, and a cap that is no whole number."""
    df = spark.createDataFrame([(i, "w " * 10, "a" if i < 4 else "b") for i in range(400)], "doc_id long, text string, source string")
    df = df.selectExpr("*", "'x' AS size", "1 AS _h", "2 AS copies", "3 AS position", "4 AS _row")
    r = mix(df, 2.5).collect()
    a = [x for x in r if x.source == "a"]
    assert all(x._row["size"] == "x" and x._row.copies == 2 for x in r)
    assert a[0].target == 100 and sum(x.taken for x in a) == 100 and all(x.taken <= 30 for x in a)
