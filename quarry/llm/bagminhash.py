"""BagMinHash near-duplicate detection over multisets of five-word shingles (op3).

The weight axis is split into (0,1], (1,2], (2,4], (4,8]... Every interval carries a
Poisson process over all signature parts; a point counts for a shingle if its place,
drawn by halving the interval, lies below the shingle's weight. A part of the signature
keeps the earliest point that counts, so two parts agree with probability equal to the
weighted Jaccard similarity. Points are drawn in order of time and stop once they are
later than all parts, which is early for all but the first shingles of a text.

Signing reads the documents where they lie and keeps the bands alone; texts move once
more, for the bags of those that share a bucket. Different texts get an 8-byte id.

Bands of the signature give candidates. A bucket has a center, the member that meets most
others in all bands; members are compared with it, not with each other, and the exact
similarity is checked. Members that it matches are in one class. Of the others of a center
(those of all its buckets together) a pair is left if it is of two classes so far. In groups
of FEW such pairs are checked, unless the triangle inequality of the distance (1 -
similarity, a metric) rules them out. In larger ones the members' differences from the
center are joined: two near texts differ by at most JOIN of their sizes' sum, so that of a
pair with one end that the center rejects the differences must share an element. Elements are
ordered by how many members have them, rarest first; a pair is checked only if it shares an
element among the first ones and enough can still follow (prefix and positional filter of set
joins, both without loss). So every pair of a bucket is verified, in one class or proven less
similar. Classes are the connected components of verified links.

A center's bag is sent once per DEAL of its pairs, so a center of very many members is
spread over tasks.

Defined cases: equal texts are one text and share a class; a text with fewer than five
words has one shingle, its words; null and empty texts have no shingle and equal each
other alone; repeated rows are copies; null doc_ids come last where a class takes its
smallest doc_id; other columns are carried whole and may have any name; empty tables give
no rows.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import by_size, documents, materialize, release, row_hash, text_key, whole_row
from .repeats import mix, step, symbols_of, words

BANDS, ROWS, WORDS, SIMILARITY = 28, 5, 5, 0.8
PARTS = BANDS * ROWS
#: Near texts of n and m shingles differ by at most JOIN * (n + m) of them.
JOIN = (1 - SIMILARITY) / (1 + SIMILARITY)
FEW = 16  # members of a center up to which all their pairs of two classes are checked
DEAL = 256
GOLD = np.uint64(0x9E3779B97F4A7C15)


def bags_of(texts) -> list[np.ndarray]:
    """Sorted hashes of the shingles, with repeats, of each text."""
    ws = [words(t) if t else [] for t in texts]
    n = np.array([len(w) for w in ws], np.int64)
    sym = symbols_of([x for w in ws for x in w])
    with np.errstate(over="ignore"):
        h = sym
        for k in range(1, WORDS):
            h = step(h[:max(0, len(h) - 1)], GOLD, sym[k:])
        h = mix(h)
    out, at = [], 0
    for k in n.tolist():
        if k >= WORDS:
            out.append(np.sort(h[at:at + k - WORDS + 1]))
        elif k:
            with np.errstate(over="ignore"):
                x = sym[at:at + 1]
                for i in range(1, k):
                    x = step(x, GOLD, sym[at + i:at + i + 1])
                out.append(mix(x + np.uint64(k)))
        else:
            out.append(np.empty(0, np.uint64))
        at += k
    return out


def signatures(bags: list[np.ndarray]) -> np.ndarray:
    """One signature (PARTS values) per sorted multiset; an empty one has all zeros."""
    flat = np.concatenate(bags) if bags else np.empty(0, np.uint64)
    who = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    head = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (who[1:] != who[:-1])])) if len(flat) else np.empty(0, np.int64)
    owner, el, wt = who[head], flat[head], np.diff(np.append(head, len(flat)))
    best = np.full(len(bags) * PARTS, np.inf)
    value = np.zeros(len(bags) * PARTS, np.uint64)
    lo, hi, level = 0, 1, 0
    with np.errstate(over="ignore"):
        while len(el) and (wt > lo).any():
            on = np.flatnonzero(wt > lo)
            o, w = owner[on], wt[on]
            state = mix(el[on] + GOLD * np.uint64(level + 1))
            t = np.zeros(len(on))
            limit = best.reshape(-1, PARTS).max(1)
            while len(o):
                state = mix(state + GOLD)
                t = t - np.log(((state >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53) / (hi - lo)
                ok = t < limit[o]
                if not ok.all():
                    o, w, state, t = o[ok], w[ok], state[ok], t[ok]
                if not len(o):
                    break
                x = mix(state ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                if hi - lo == 1:  # weights are whole: all of a unit interval counts
                    slot, th, sh = o * PARTS + (x % np.uint64(PARTS)).astype(np.int64), t, x
                else:
                    place = lo + (hi - lo) * ((mix(x + GOLD) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)
                    hit = place < w
                    slot, th, sh = o[hit] * PARTS + (x[hit] % np.uint64(PARTS)).astype(np.int64), t[hit], x[hit]
                better = th < best[slot]
                slot, th, sh = slot[better], th[better], sh[better]
                np.minimum.at(best, slot, th)
                won = th == best[slot]
                value[slot[won]] = sh[won]
                touched = np.unique(slot[won] // PARTS)
                limit[touched] = best.reshape(-1, PARTS)[touched].max(1)
            lo, hi, level = hi, hi * 2, level + 1
    return value.reshape(-1, PARTS)


def bands(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = sig.reshape(len(sig), BANDS, ROWS)
        h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD), s.shape[:2])
        for i in range(ROWS):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + s[:, :, i])
    return h.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted arrays with repeats."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) == 0:
        return 0.0
    left = np.searchsorted(b, a, "left")
    rank = np.arange(len(a)) - np.searchsorted(a, a, "left")
    both = int((left + rank < np.searchsorted(b, a, "right")).sum())
    return both / (len(a) + len(b) - both)


def difference(center: np.ndarray, bag: np.ndarray) -> np.ndarray:
    """Elements of bag that center lacks and the reverse, repeats numbered, as hashes."""
    def numbered(x):
        with np.errstate(over="ignore"):
            return mix(x + (np.arange(len(x)) - np.searchsorted(x, x, "left")).astype(np.uint64) * GOLD)
    a, b = numbered(center), numbered(bag)
    return np.concatenate([np.setdiff1d(b, a), ~np.setdiff1d(a, b)]).view(np.int64)


def identified(docs: DataFrame) -> DataFrame:
    """_row (the whole row), key, and last, did, h: the place that orders the rows of a text."""
    return docs.select(whole_row(docs).alias("_row"), text_key().alias("key"), F.col("doc_id").isNull().alias("last"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("did"), row_hash(docs).alias("h"))


PLACE = ["key", "last", "did", "h"]


def signed_texts(docs: DataFrame) -> DataFrame:
    """id, key, last, did, h (the place of its first row), n_first (rows there), copies, bands: per text."""
    def sign(batches):
        for big in batches:
            seen = set()
            for pdf in by_size(big):
                new = []
                for i, k in enumerate(pdf.key):
                    if bytes(k) not in seen:
                        seen.add(bytes(k))
                        new.append(i)
                bags = bags_of([pdf.text.iat[i] for i in new])
                out = [None] * len(pdf)
                for i, b, row in zip(new, bags, bands(signatures(bags)) if new else ()):
                    out[i] = row if len(b) else row[:0]
                yield pd.DataFrame({**{c: pdf[c] for c in PLACE}, "bands": out})

    rows = identified(docs).select(*PLACE, F.col("_row.text").alias("text")).mapInPandas(sign, "key binary, last boolean, did long, h long, bands array<long>")
    per = rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"), F.first("bands", True).alias("bands"))
    t = per.groupBy("key").agg(F.min(F.struct("last", "did", "h", "n")).alias("low"), F.sum("n").alias("copies"), F.first("bands", True).alias("bands"))
    return materialize(t.select(F.monotonically_increasing_id().alias("id"), "key", "low.last", "low.did", "low.h", F.col("low.n").alias("n_first"), "copies", "bands"))


def rows_of(docs: DataFrame, texts: DataFrame, unique: str) -> DataFrame:
    """`unique` and _row of the one document in the first place of each of `texts`; rows that
    are repeated in one place count once per `unique`."""
    # merged at every size: documents are not a side to broadcast to, nor are all texts one to broadcast
    pick = lambda part: identified(docs).join(part.select(*PLACE, unique).hint("merge"), PLACE).select(unique, "_row")
    again = texts.where("n_first > 1")
    if again.isEmpty():
        return pick(texts)
    return pick(texts.where("n_first = 1")).unionByName(pick(again).dropDuplicates([unique]))


def bags_table(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """id, bag of the given texts."""
    def run(batches):
        for big in batches:
            for pdf in by_size(big):
                yield pd.DataFrame({"id": pdf.id, "bag": [b.tobytes() for b in bags_of(pdf.text)]})
    return rows_of(docs, texts, "id").select("id", F.col("_row.text").alias("text")).mapInPandas(run, "id long, bag binary")


def beside_centers(pairs: DataFrame, bags: DataFrame, schema: str, make) -> DataFrame:
    """a, b and make(bag of a, bag of b) of different pairs (a, b) by the bags (id, bag). The
    members' bags go to their center, whose own bag comes first."""
    cols = ["a", "b", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches):
        center, mine = None, None
        for pdf in batches:
            keep = []
            for i, (a, b, s, x) in enumerate(zip(pdf.a, pdf.b, pdf.deal, pdf.bag)):
                if a == b:
                    center, mine = np.frombuffer(x, np.uint64), (a, s)
                elif mine == (a, s):
                    keep.append((a, b, *make(center, np.frombuffer(x, np.uint64))))
                else:
                    raise ValueError("a center is missing")
            yield pd.DataFrame(keep, columns=cols)

    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / DEAL).alias("deals"))
    member = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("deals")).alias("deal"))
    both = member.unionByName(n.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal")))
    rows = both.join(bags, both.b == bags.id).select("a", "b", "deal", "bag")
    rows = rows.repartition("a", "deal").sortWithinPartitions("a", "deal", F.col("a") != F.col("b"))
    return rows.mapInPandas(run, f"a long, b long, {schema}")


def with_likeness(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """a, b, sim of different pairs (a, b)."""
    return beside_centers(pairs, bags, "sim double", lambda a, b: (similarity(a, b),))


def popular(members: DataFrame) -> DataFrame:
    """band, id, pop of the buckets of members (band, id) with two texts or more; pop is the
    number of texts met in all of them."""
    busy = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(members.join(busy, "band"))
    out = materialize(met.join(met.groupBy("id").agg(F.sum("n").alias("pop")), "id").drop("n"))
    release(met)
    return out


def starred(members: DataFrame) -> DataFrame:
    """a, b: members (band, id, pop) of buckets with two or more against their most popular one.
    In a group of edits of one text, that text meets most of the others."""
    top = members.groupBy("band").agg(F.max(F.struct("pop", -F.col("id"))).alias("top"))
    return materialize(members.join(top.select("band", (-F.col("top.col2")).alias("a")), "band").where("id <> a").select("a", F.col("id").alias("b")).distinct())


def with_root(df: DataFrame, root: DataFrame, col: str) -> DataFrame:
    """df with {col}_root, the class of that id so far."""
    r = root.select(F.col("node").alias(col), F.col("root").alias("_r"))
    return df.join(r, col, "left").withColumn(f"{col}_root", F.coalesce("_r", col)).drop("_r")


def links(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b), a < b, between ids of different texts, and their components (node, root)."""
    members = popular(signed.select("id", F.explode("bands").alias("band")))
    pairs = starred(members)
    if pairs.isEmpty():
        return pairs, components(pairs)
    bags = materialize(bags_table(docs, signed.join(members.select("id").distinct(), "id", "left_semi")))
    star = materialize(with_likeness(pairs, bags))
    root = components(star.where(F.col("sim") >= SIMILARITY))
    met = materialize(with_root(star, root, "b"))
    # members of one class have no more to find among them
    mixed = met.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b_root").alias("low"), F.max("b_root").alias("high")).where("low <> high").select("a", "n")
    left = materialize(met.join(mixed, "a"))
    known = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialize(few_pairs(left.where(F.col("n") <= FEW)).unionByName(near_differences(left.where(F.col("n") > FEW), bags)).distinct().join(known, ["a", "b"], "left_anti"))
    good = materialize(with_likeness(more, bags).where(F.col("sim") >= SIMILARITY).select("a", "b"))
    edges = materialize(star.where(F.col("sim") >= SIMILARITY).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(good).distinct())
    root = joined(root, good)
    release(members, pairs, bags, star, met, left, more)
    return edges, root


def few_pairs(left: DataFrame) -> DataFrame:
    """a, b, a < b: pairs of two classes among the members of one center that may be near."""
    x, y = left.select("a", F.col("b").alias("x"), F.col("b_root").alias("xr"), F.col("sim").alias("xs")), left.select("a", "b", "b_root", "sim")
    # d(x, b) >= |d(a, x) - d(a, b)|
    return x.join(y, "a").where((F.col("x") < F.col("b")) & (F.col("xr") != F.col("b_root")) & (F.abs(F.col("xs") - F.col("sim")) <= 1 - SIMILARITY + 1e-9)).select(F.col("x").alias("a"), "b")


def near_differences(left: DataFrame, bags: DataFrame) -> DataFrame:
    """The same for centers of many members, by a join of the members' differences from them.

    Let x, y be near, of n and m shingles, with differences X, Y from a center of k. Their
    differences share at least o = (|X| + |Y| - JOIN (n + m)) / 2 elements. One of them, say
    x, is rejected by the center: |X| > JOIN (n + k), so o > 0. As |Y| >= |m - k|, o is at
    least (|X| - JOIN (n + k)) / 2; for a matched y it is more than (|Y| + JOIN (k - m)) / 2.
    As m <= n / SIMILARITY, o >= |X| - T for the larger difference X and >= |X| - T / 2
    for the smaller, T being JOIN (n + n / SIMILARITY). So the first |X| - o + 1 elements of
    both in one order share one, and after the first shared one o - 1 more must follow."""
    def make(a, b):
        return len(a), len(b), difference(a, b)

    diff = materialize(beside_centers(left.select("a", "b"), bags, "k long, n long, diff array<long>", make))
    each = diff.select("a", "b", F.explode("diff").alias("e"))
    shared = each.groupBy("a", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # elements of one member come first and meet no other
    lists = each.join(shared, ["a", "e"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    k, n, size = F.col("k"), F.col("n"), F.col("size")
    bound = F.when(F.col("sim") >= SIMILARITY, size + JOIN * (k - n)).otherwise(size - JOIN * (n + k)) / 2
    widest = JOIN * (n + n / SIMILARITY)
    first = lambda o: size - F.greatest(F.lit(1), F.ceil(o - 1e-6)) + 1
    mine = lists.join(diff.select("a", "b", "k", "n", F.size("diff").alias("size")), ["a", "b"]).join(left.select("a", "b", "sim", "b_root"), ["a", "b"])
    mine = mine.withColumn("as_large", first(F.greatest(bound, size - widest))).withColumn("as_small", first(F.greatest(bound, size - widest / 2)))
    mine = mine.withColumn("skip", size - F.size("es"))
    front = F.slice("es", 1, F.greatest(F.lit(0), F.least(F.size("es"), F.greatest("as_large", "as_small") - F.col("skip"))).cast("int"))
    flat = mine.select("a", "b", "n", "size", "b_root", "skip", "as_large", "as_small", F.posexplode(front).alias("at", "s"))
    flat = materialize(flat.select("a", "b", "n", "size", "b_root", "as_large", "as_small", (F.col("at") + F.col("skip")).alias("at"), F.col("s.e").alias("e")))
    x = flat.where("at < as_large").select("a", "e", *[F.col(c).alias(f"x_{c}") for c in ("b", "n", "size", "b_root", "at")])
    y = flat.where("at < as_small").select("a", "e", *[F.col(c).alias(f"y_{c}") for c in ("b", "n", "size", "b_root", "at")])
    met = x.join(y, ["a", "e"]).where("x_b_root <> y_b_root and (x_size > y_size or (x_size = y_size and x_b > y_b))").where(
        F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at")) >= (F.col("x_size") + F.col("y_size") - JOIN * (F.col("x_n") + F.col("y_n"))) / 2 - 1e-6)
    return met.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node but the roots: alternating large and small stars until every
    node has one edge, to a node that has none."""
    cur = materialize(edges.select("a", "b"))
    if cur.isEmpty():
        return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def star(e, large):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        j = both.join(m, "a")
        if large:  # an edge makes one edge at most, so repeats can wait for the small star
            return j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def ended(e):
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()

    while True:
        old, mid = cur, materialize(star(cur, True))
        cur = materialize(star(mid, False))
        release(old, mid)
        if ended(cur):
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))


def joined(root: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components (node, root) of what `root` has joined and of `edges`. Only classes that an
    edge joins are gone through again."""
    if root is None:
        return components(edges)
    e = with_root(with_root(edges, root, "a"), root, "b").where("a_root <> b_root")
    top = components(e.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
    if top.isEmpty():
        return root
    moved = root.join(top.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
    return materialize(moved.select("node", F.coalesce("up", "root").alias("root")).unionByName(top))


def near_classes(docs: DataFrame) -> DataFrame:
    """Per different text: key, the place of its first row, n_first, copies, class (the id of
    its class), n_links, class_id (the class's smallest doc_id) and leads: whether it holds the
    class's first row."""
    signed = signed_texts(docs)
    e, root = links(docs, signed)
    degree = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    m = signed.drop("bands").join(root.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
    m = materialize(m.select(*PLACE, "n_first", "copies", F.coalesce("root", "id").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    release(signed)
    low = m.groupBy("class").agg(F.min(F.struct("last", "did", "key")).alias("low"))
    return materialize(m.join(low, "class").select(*m.columns, F.when(~F.col("low.last"), F.col("low.did")).alias("class_id"), (F.col("low.key") == F.col("key")).alias("leads")))


def with_class(docs: DataFrame) -> DataFrame:
    """_row (the whole row), class_id (the class's smallest doc_id), n_links of every document."""
    m = near_classes(docs).select("key", "class_id", "n_links")
    return docs.select(whole_row(docs).alias("_row"), text_key().alias("key")).join(m, "key").drop("key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first row of each class: smallest doc_id, then text key, then hash of the row."""
    return rows_of(docs, near_classes(docs).where("leads"), "class").select("_row.*")


def op3_bagminhash(spark, sf_dir):
    return with_class(documents(spark, sf_dir)).select("_row.doc_id", "class_id", "n_links")
