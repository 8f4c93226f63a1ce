"""Repeated-window removal over words (op7) and bytes (op10).

Every window of the full length holds an anchor: of its short windows the one with the
smallest hash, which depends on the window's content alone. A run is the windows in a row
that share an anchor; its text is a region. Two equal windows have equal anchors at equal
places, so windows need to be compared within the group of their anchor's content alone.
Equal texts are handled once with their number of copies. A region that repeats as a whole
has no window that does not, and is not looked into.

Words, by level-wise doubling: the anchors have about a quarter of the length (9 of 35).
Those that occur once are dropped; those that repeat are extended to twice their length, to
the right or, for windows that end too early for that, to the left; extensions that occur
once are dropped in turn; the windows of the others, twice as long again, are counted.

Bytes, by suffix order: the anchors have half of the length. All different regions of an
anchor that repeats are put in one block, whose suffixes are sorted by Lyndon groups
(lyndon.py); neighbours in suffix order whose common prefix, compared byte by byte, reaches
the window's length are repeats, and nothing else is. A group of more than LIMIT regions is
split by the bytes next to the anchor, to groups of about ten windows and, where these differ,
of one window each, which need no order.

Hashes of windows have 128 bits where they decide; others only select candidates.

Defined cases: null is the empty text; texts shorter than the window lose nothing; exact
copies of a text at least one window long lose everything; repeated rows count as copies;
other columns are ignored; an empty table gives an empty result.
"""
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import by_size, distinct_texts, documents, materialize, release, text_key
from .lyndon import suffix_order

GOLD, DOUBLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOW = np.uint64(0xFFFFFFFF)
#: Bytes of a block of small groups, regions sorted at a time, regions of a group in one block.
BLOCK, SLICE, LIMIT = 2048, 4_000, 32
CHARS = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def step(a: np.ndarray, factor: np.uint64, b: np.ndarray) -> np.ndarray:
    x = a * factor
    x += b
    x ^= x >> np.uint64(29)
    return x


def windows(sym: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of `length` symbols, by doubling shorter hashes."""
    return windows_of(sym, length)[0]


def windows_of(sym: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """The same for several lengths, which share the doubled hashes."""
    done = [None] * len(lengths)
    off = [0] * len(lengths)
    h, size, longest = sym, 1, max(lengths)
    with np.errstate(over="ignore"):
        while size <= longest:
            for i, length in enumerate(lengths):
                n = max(0, len(sym) - length + 1)
                if length & size:
                    part = h[off[i]:off[i] + n] if n else np.empty(0, np.uint64)
                    done[i] = part if done[i] is None else step(done[i], GOLD, part)
                    off[i] += size
            if size * 2 <= longest:
                m = max(0, len(h) - size)
                h = step(h[:m], DOUBLE, h[size:] if m else h[:0])
            size *= 2
        return [mix(x) for x in done]


def argmins(h: np.ndarray, w: int) -> np.ndarray:
    """Position in each run of w hashes of the smallest upper half, the leftmost if several."""
    x = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    n = len(h) - w + 1
    k = 1
    while k * 2 <= w:
        x = np.minimum(x[:len(x) - k], x[k:])
        k *= 2
    return (np.minimum(x[:n], x[w - k:w - k + n]) & LOW).astype(np.int64)


def words(text: str) -> list[str]:
    for space in "\t\n\v\f\r":
        if space in text:
            text = text.replace(space, " ")
    return [x for x in text.split(" ") if x]


KEYS = ("0123456789abcdef", "fedcba9876543210")


def symbols_of(ws: list[str], *keys: str):
    """64-bit hash of each word; with keys, one array per key."""
    if not ws:
        out = [np.empty(0, np.uint64) for _ in keys or KEYS[:1]]
    else:
        codes, uniq = pd.factorize(np.array(ws, dtype=object))
        out = [pd.util.hash_array(uniq, hash_key=k, categorize=False)[codes] for k in keys or KEYS[:1]]
    return out if keys else out[0]


with np.errstate(over="ignore"):
    BYTES = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


def symbols(texts, unit: str, hashes: int = 2):
    """Symbols of all texts in a row, in one array per hash (bytes have one), their number by
    text, and the parts."""
    if unit == "word":
        parts = [words(t) for t in texts]
        return symbols_of([w for p in parts for w in p], *KEYS[:hashes]), np.array([len(p) for p in parts], np.int64), parts
    parts = [t.encode("utf-8") for t in texts]
    return [BYTES[np.frombuffer(b"".join(parts), np.uint8)]], np.array([len(p) for p in parts], np.int64), parts


def short_of(length: int, unit: str) -> int:
    return -(-length // 4) if unit == "word" else length // 2


def runs(sym: np.ndarray, sizes: np.ndarray, length: int, short: int) -> tuple:
    """first and last window start, anchor and text of every run, and the short windows' hashes."""
    n = len(sym) - length + 1
    if n <= 0:
        z = np.empty(0, np.int64)
        return z, z, z, z, np.empty(0, np.uint64)
    h = windows(sym, short)
    at = argmins(h, length - short + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:n]
    p = np.flatnonzero(np.arange(n) + length <= np.cumsum(sizes)[owner])
    at, owner = at[p], owner[p]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(owner) != 0)) + 1
    a, b = np.concatenate([[0], cut])[:len(p)], np.concatenate([cut, [len(p)]])[:len(p)] - 1
    return p[a], p[b], at[a], owner[a], h


def ranges(length: int, unit: str, level: int) -> list[tuple[int, int]]:
    """Ranges [low, high] of the anchor's place in the window that a run is split by."""
    top = length - short_of(length, unit)
    if level == 0:
        return [(0, top)]
    twice = 2 * short_of(length, unit)
    return [(0, length - twice), (length - twice + 1, top)]


def split(syms: list, sizes: np.ndarray, length: int, unit: str, level: int, whole: bool = True, groups: bool = True) -> tuple:
    """Per part of a run: first and last window start, text, group (hash of what all windows
    of the part share, if `groups`), regions (hashes of its text, one per symbol array) and the
    windows' hashes, both if `whole`."""
    first, last, anchor, owner, h = runs(syms[0], sizes, length, short_of(length, unit))
    if not len(first):
        z = np.empty(0, np.int64)
        return z, z, z, z, [z for _ in syms], [z for _ in syms]
    w = [windows(s, length) for s in syms] if whole else []
    out, short = [], short_of(length, unit)
    twice = windows(syms[0], 2 * short) if groups and level else h
    for lo, hi in ranges(length, unit, level):
        a, b = np.maximum(first, anchor - hi), np.minimum(last, anchor - lo)
        k = np.flatnonzero(a <= b)
        # the anchor's second half lies to its right, or its left
        g = twice[anchor[k] - (short if level and groups and lo else 0)]
        out.append((a[k], b[k], owner[k], g, np.full(len(k), lo * 4096 + hi + 1, np.uint64)))
    a, b, owner, g, tag = (np.concatenate(x) for x in zip(*out))
    with np.errstate(over="ignore"):  # two full windows cover the run's text
        g = mix(g + mix(tag)) if level else g
        regions = [mix(x[a] * GOLD + x[b] + mix((b - a + 1).astype(np.uint64) + (tag << np.uint64(32)))).view(np.int64) for x in w]
    return a, b, owner, g.view(np.int64), regions, [x.view(np.int64) for x in w]


def _counted(*cols, n=None):
    """Distinct rows of the columns with their number, or with the sum of n."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    head = np.ones(len(order), bool)
    if len(order):
        head[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    at = np.flatnonzero(head)
    n = np.diff(np.append(at, len(order))) if n is None else np.add.reduceat(n[order], at) if len(at) else n
    return [c[at] for c in cols], n


def rows_by_level(texts: DataFrame, length: int, unit: str, level: int) -> DataFrame:
    """id, g, r1, r2, n of the parts of all runs of (id, text, copies), of those in gs alone if
    there is such a column of groups of the level before. Words have no regions at level 0."""
    wanted, whole = "gs" in texts.columns, unit == "byte" or level > 0

    def run(batches):
        for big in batches:
            for pdf in by_size(big, chars=CHARS):
                syms, sizes, _ = symbols(pdf.text, unit, 1 + whole)
                a, b, owner, g, r, _ = split(syms, sizes, length, unit, level, whole)
                if wanted and len(a):
                    fa, fb, _, fg, _, _ = split(syms, sizes, length, unit, level - 1, False)
                    ask = np.unique(np.concatenate([np.asarray(x, np.int64) for x in pdf.gs]))
                    on = np.isin(fg, ask)
                    live = np.zeros(int(sizes.sum()) + 1, np.int64)  # window starts of the asked groups
                    np.add.at(live, fa[on], 1)
                    np.add.at(live, fb[on] + 1, -1)
                    k = np.flatnonzero(np.cumsum(live)[a] > 0)
                    owner, g, r = owner[k], g[k], [x[k] for x in r]
                if len(g):
                    (o, *c), n = _counted(owner, g, *r)
                    out = {"id": pdf.id.to_numpy()[o], "g": c[0], "n": n * pdf.copies.to_numpy()[o]}
                    yield pd.DataFrame({**out, "r1": c[1] if r else 0, "r2": c[2] if len(r) > 1 else 0})
    cols = ["id", "text", "copies", *(["gs"] if wanted else [])]
    return texts.select(*cols).mapInPandas(run, "id long, g long, n long, r1 long, r2 long")


def repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of groups with more than one occurrence."""
    return rows.join(rows.groupBy(*by).agg(F.sum("n").alias("t")).where("t > 1").select(*by), by, "left_semi")


def with_texts(texts: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
    """id, text, copies of the texts in rows, with the values of its cols as arrays; a text
    has no more of them than windows."""
    return texts.join(rows.groupBy("id").agg(*[F.collect_list(c).alias(f"{c}s") for c in cols]), "id")


def counted_windows(texts: DataFrame, reg: DataFrame, length: int) -> DataFrame:
    """r1, r2, offs: the repeated windows of word regions that occur once, from the hashes of
    all windows of regions that share their group with another."""
    asked = with_texts(texts, reg.where("more"), "r1", "n")

    def run(batches):
        for big in batches:
            for pdf in by_size(big, chars=CHARS):
                syms, sizes, _ = symbols(pdf.text, "word")
                a, b, _, _, r, w = split(syms, sizes, length, "word", 1)
                ask, at = np.unique(np.concatenate([np.asarray(x, np.int64) for x in pdf.r1s]), return_index=True)
                ns = np.concatenate([np.asarray(x, np.int64) for x in pdf.ns])[at]
                _, k = np.unique(r[0], return_index=True)
                k = k[np.isin(r[0][k], ask)]
                if not len(k):
                    continue
                m = b[k] - a[k] + 1
                n = np.repeat(ns[np.searchsorted(ask, r[0][k])], m)
                off = np.arange(len(n)) - np.repeat(np.cumsum(m) - m, m)
                p = np.repeat(a[k], m) + off
                yield pd.DataFrame({"r1": np.repeat(r[0][k], m), "r2": np.repeat(r[1][k], m), "off": np.where(n == 1, off, -1), "w1": w[0][p], "w2": w[1][p], "n": n})

    level = materialize(asked.mapInPandas(run, "r1 long, r2 long, off long, w1 long, w2 long, n long"))
    again = level.groupBy("w1", "w2").agg(F.sum("n").alias("t")).where("t > 1").select("w1", "w2")
    out = materialize(level.where("off >= 0").join(again, ["w1", "w2"], "left_semi").groupBy("r1", "r2").agg(F.collect_set("off").alias("offs")))
    release(level)
    return out


def same_prefix(sym: np.ndarray, p: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    """Whether `length` bytes from p and from q are the same, compared byte by byte."""
    out = np.zeros(len(p), bool)
    view = np.lib.stride_tricks.sliding_window_view(sym, length) if len(sym) >= length else np.empty((0, length), sym.dtype)
    for i in range(0, len(p), 50_000):
        out[i:i + 50_000] = (view[p[i:i + 50_000]] == view[q[i:i + 50_000]]).all(1)
    return out


def sorted_repeats(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """r1, offs of the regions (g, r1, n, body) that occur once and hold repeated windows. All
    regions of a group are in pdf, one after the other; blocks hold whole groups."""
    size = pdf.body.map(len).to_numpy() + 1
    stop = np.cumsum(size)
    g = pdf.g.to_numpy()
    ends = np.append(g[1:] != g[:-1], True)  # regions that end a group
    group_stop = np.where(ends, stop, 0)
    last = np.zeros(len(g), bool)
    begun = 0
    for i in np.flatnonzero(ends):
        if group_stop[i] - begun >= BLOCK or i == len(g) - 1:
            last[i], begun = True, group_stop[i]
    raw = np.frombuffer(b"\0".join([*pdf.body, b""]), np.uint8)
    sym = raw.astype(np.int64) + 2
    sym[stop - 1] = 1 - last
    hard = np.flatnonzero(last)
    order = suffix_order(sym, np.diff(np.append(0, stop[hard])))
    row = np.repeat(np.arange(len(size)), size)
    off = np.arange(len(sym)) - (stop - size)[row]
    order = order[off[order] < (size - length)[row[order]]]
    row, off = row[order], off[order]
    block = np.searchsorted(hard, row)
    head = np.ones(len(order), bool)
    head[1:] = (block[1:] != block[:-1]) | ~same_prefix(raw, order[1:], order[:-1], length)
    n = pdf.n.to_numpy()[row]
    total = np.add.reduceat(n, np.flatnonzero(head))[np.cumsum(head) - 1]
    hit = np.flatnonzero((total > 1) & (n == 1))
    hit = hit[np.argsort(row[hit], kind="stable")]
    at = np.flatnonzero(np.append(True, np.diff(row[hit]) != 0)) if len(hit) else hit
    return pd.DataFrame({"r1": pdf.r1.to_numpy()[row[hit[at]]], "offs": pd.Series(np.split(off[hit], at[1:]) if len(hit) else [], dtype=object)})


def sorted_windows(texts: DataFrame, reg: DataFrame, length: int) -> DataFrame:
    """r1, r2, offs: the repeated windows of byte regions that occur once: by suffix order, and
    in groups of more than LIMIT regions by blocks of windows and the windows themselves."""
    asked = with_texts(texts, reg.where("more").withColumn("hot", F.col("m") > LIMIT), "r1", "n", "hot")

    def bodies(batches):
        for big in batches:
            for pdf in by_size(big, chars=CHARS):
                syms, sizes, parts = symbols(pdf.text, "byte")
                a, b, _, g, r, _ = split(syms, sizes, length, "byte", 0)
                ask, at = np.unique(np.concatenate([np.asarray(x, np.int64) for x in pdf.r1s]), return_index=True)
                ns, hots = (np.concatenate([np.asarray(x) for x in pdf[c]])[at] for c in ("ns", "hots"))
                _, k = np.unique(r[0], return_index=True)
                k = k[np.isin(r[0][k], ask)]
                if not len(k):
                    continue
                i = np.searchsorted(ask, r[0][k])
                data = b"".join(parts)
                yield pd.DataFrame({"g": g[k], "r1": r[0][k], "n": ns[i], "body": [data[x:y + length] for x, y in zip(a[k], b[k])], "hot": hots[i].astype(bool)})

    def classes(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            # the last group may go on in the next batch
            g = pdf.g.to_numpy()
            whole = int(np.flatnonzero(g != g[-1])[-1]) + 1 if len(g) and (g != g[-1]).any() else 0
            held = pdf.iloc[whole:]
            yield from sliced(pdf.iloc[:whole])
        if held is not None:
            yield from sliced(held)

    def sliced(pdf):
        """Slices of whole groups, those of small groups first: the largest block sets the steps."""
        g = pdf.g.to_numpy()
        group = np.cumsum(np.append(True, g[1:] != g[:-1])[:len(g)]) - 1
        size = np.bincount(group, weights=pdf.body.map(len).to_numpy()) if len(g) else g
        order = np.lexsort((group, size[group]))
        pdf, g = pdf.iloc[order], g[order]
        ends = np.flatnonzero(np.append(g[1:] != g[:-1], True)) + 1
        done = 0
        while done < len(g):
            k = int(ends[np.searchsorted(ends, min(done + SLICE, len(g)))])
            yield sorted_repeats(pdf.iloc[done:k], length)
            done = k

    dealt = materialize(asked.mapInPandas(bodies, "g long, r1 long, n long, body binary, hot boolean"))
    in_order = dealt.where("not hot").select("g", "r1", "n", "body").repartition("g").sortWithinPartitions("g", "r1")
    cold = in_order.mapInPandas(classes, "r1 long, offs array<long>")
    out = materialize(cold.unionByName(hot_repeats(dealt.where("hot"), length)).select("r1", F.lit(0).cast("long").alias("r2"), "offs"))
    release(dealt)
    return out


def cut(bodies, length: int):
    """Hashes of all windows (two of each), and per block of the regions `bodies`: its region,
    its number, core, first and last window. A block is a range of places of the anchor in the
    window, the same for all regions; the core is what all windows of the whole block share."""
    top = length - short_of(length, "byte")
    wide = max(1, math.isqrt(top + 1))
    sym, sizes = BYTES[np.frombuffer(b"".join(bodies), np.uint8)], np.array([len(x) for x in bodies], np.int64)
    first, last, anchor, owner, _ = runs(sym, sizes, length, short_of(length, "byte"))  # one per region
    core, out = windows(sym, length - wide + 1), []
    for lo in range(0, top + 1, wide):
        x, y = np.maximum(first, anchor - min(lo + wide - 1, top)), np.minimum(last, anchor - lo)
        k = np.flatnonzero(x <= y)
        out.append((owner[k], np.full(len(k), lo), core[anchor[k] - lo].view(np.int64), x[k], y[k]))
    return [windows(sym, length), windows(mix(sym ^ GOLD), length)], np.cumsum(sizes) - sizes, [np.concatenate(c) for c in zip(*out)]


def hot_repeats(dealt: DataFrame, length: int) -> DataFrame:
    """r1, offs of the regions (g, r1, n, body) of large groups that occur once. A block that
    repeats as a whole has no window that does not, one whose core occurs in no other block has
    none that does; only the others are split into windows, one row per different block."""
    def blocks(batches):
        for big in batches:
            for pdf in by_size(big, "body", CHARS, 4096):
                w, begin, (who, lo, core, x, y) = cut(pdf.body, length)
                with np.errstate(over="ignore"):  # two windows cover the block's text
                    p = [mix(h[x] * GOLD + h[y] + mix((y - x + 1).astype(np.uint64))).view(np.int64) for h in w]
                yield pd.DataFrame({**{c: pdf[c].to_numpy()[who] for c in ("g", "r1", "n")}, "lo": lo, "core": core, "p1": p[0], "p2": p[1], "off": x - begin[who], "m": y - x + 1})

    def singles(batches):
        for big in batches:
            for pdf in by_size(big, "body", CHARS, 4096):
                w, begin, (who, lo, _, x, y) = cut(pdf.body, length)
                ask = [{b["lo"]: b["t"] for b in bs} for bs in pdf.blocks]
                t = np.array([ask[i].get(b, 0) for i, b in zip(who.tolist(), lo.tolist())], np.int64)
                k = np.flatnonzero(t)
                m = y[k] - x[k] + 1
                p = np.repeat(x[k], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                n, of = np.repeat(t[k], m), np.repeat(who[k], m)
                yield pd.DataFrame({"r1": pdf.r1.to_numpy()[of], "n": n, "off": np.where(n == 1, p - begin[of], -1), "w1": w[0][p].view(np.int64), "w2": w[1][p].view(np.int64)})

    group, part = ["g", "lo", "core"], ["g", "lo", "core", "p1", "p2"]
    level = materialize(dealt.drop("hot").mapInPandas(blocks, "g long, r1 long, n long, lo long, core long, p1 long, p2 long, off long, m long"))
    parts = materialize(level.groupBy(*part).agg(F.sum("n").alias("t"), F.min("r1").alias("r1")))
    whole = level.where("n = 1").join(parts.where("t > 1").select(*part), part, "left_semi").select("r1", F.expr("sequence(off, off + m - 1)").alias("offs"))
    mixed = parts.join(parts.groupBy(*group).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*group), group, "left_semi")
    # a region has no more blocks than places of the anchor
    asked = mixed.groupBy("r1").agg(F.collect_list(F.struct("lo", "t")).alias("blocks"))
    one = materialize(dealt.select("r1", "body").join(asked, "r1").mapInPandas(singles, "r1 long, n long, off long, w1 long, w2 long"))
    again = one.groupBy("w1", "w2").agg(F.sum("n").alias("t")).where("t > 1").select("w1", "w2")
    some = one.where("off >= 0").join(again, ["w1", "w2"], "left_semi").groupBy("r1").agg(F.collect_list("off").alias("offs"))
    out = materialize(whole.unionByName(some).groupBy("r1").agg(F.array_distinct(F.flatten(F.collect_list("offs"))).alias("offs")))
    release(level, parts, one)
    return out


def regions_of(live: DataFrame) -> DataFrame:
    """g, r1, r2, n, id (a text that has it), m (regions of the group), more (m > 1)."""
    reg = live.groupBy("g", "r1", "r2").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    m = reg.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return materialize(reg.join(m, "g", "left").withColumn("more", F.col("m").isNotNull()))


def hits(texts: DataFrame, length: int, unit: str) -> DataFrame:
    """id, r1, offs of every region with repeated windows; offs is null where all are."""
    live = materialize(rows_by_level(texts, length, unit, 0))
    was, live = live, materialize(repeated(live, ["g"]))
    release(was)
    if unit == "word":
        was, live = live, materialize(rows_by_level(with_texts(texts, live, "g"), length, unit, 1))
        release(was)
        was, live = live, materialize(repeated(live, ["g"]))
        release(was)
    reg = regions_of(live)
    some = counted_windows(texts, reg, length) if unit == "word" else sorted_windows(texts, reg, length)
    hit = reg.where("n > 1").select("g", "r1", "r2", F.lit(None).cast("array<long>").alias("offs")).unionByName(
        reg.where("n = 1").select("g", "r1", "r2").join(some, ["r1", "r2"]))
    out = materialize(live.select("id", "g", "r1", "r2").join(hit, ["g", "r1", "r2"]).select("id", "r1", "offs"))
    release(live, reg, some)
    return out


def remove_repeats(docs: DataFrame, length: int, unit: str, kept: bool = True) -> DataFrame:
    """key, n_units, n_removed, n_spans, kept binary (null unless asked for), kept_sha256: per
    different text."""
    texts = materialize(distinct_texts(docs).withColumn("id", F.monotonically_increasing_id()))
    h = hits(texts, length, unit)
    # a text has no more hits than windows
    per = materialize(h.groupBy("id").agg(F.collect_list(F.struct("r1", F.coalesce("offs", F.array().cast("array<long>")).alias("offs"))).alias("hs"))
                      .select("id", F.col("hs.r1").alias("rs"), F.col("hs.offs").alias("os")))

    def covered(pdf) -> list[np.ndarray]:
        """Which positions are covered, by text; all of them have hits."""
        syms, sizes, _ = symbols(pdf.text, unit, 1)
        begin = np.cumsum(sizes) - sizes
        d = np.zeros(int(sizes.sum()) + 1, np.int64)
        offs = {r: o for rs, os in zip(pdf.rs, pdf.os) for r, o in zip(rs, os)}
        a, b, _, _, r, _ = split(syms, sizes, length, unit, int(unit == "word"), groups=False)
        k = np.flatnonzero(np.isin(r[0], np.fromiter(offs, np.int64, len(offs))))
        a, b, r = a[k], b[k], r[0][k].tolist()
        partly = np.array([len(offs[x]) > 0 for x in r], bool)
        np.add.at(d, a[~partly], 1)
        np.add.at(d, b[~partly] + length, -1)
        if partly.any():
            o = [np.asarray(offs[x]) for x, y in zip(r, partly.tolist()) if y]
            p = np.repeat(a[partly], [len(x) for x in o]) + np.concatenate(o)
            np.add.at(d, p, 1)
            np.add.at(d, p + length, -1)
        gone = (np.cumsum(d) > 0).astype(np.int8)
        return [gone[x:x + n] for x, n in zip(begin, sizes)]

    def make(batches):
        for big in batches:
            for pdf in by_size(big, chars=CHARS):
                some = pdf.rs.notna().to_numpy()
                gone = iter(covered(pdf[some])) if some.any() else iter(())
                out = []
                for text, hit in zip(pdf.text, some.tolist()):
                    parts = words(text) if unit == "word" else text.encode("utf-8")
                    spans = []
                    if hit:
                        e = np.diff(np.concatenate([[0], next(gone), [0]]))
                        spans = np.stack([np.flatnonzero(e == 1), np.flatnonzero(e == -1)], 1).tolist()
                    out.append((len(parts), *_kept(parts, spans, unit)))
                yield pd.DataFrame({"key": pdf.key, "n_units": [x[0] for x in out], "n_removed": [x[1] for x in out], "n_spans": [x[2] for x in out],
                                    "kept": [x[3] if kept else None for x in out], "kept_sha256": [hashlib.sha256(x[3]).hexdigest() for x in out]})

    return texts.join(per, "id", "left").select("key", "text", "rs", "os").mapInPandas(make, "key binary, n_units long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def _kept(parts, spans, unit: str) -> tuple:
    keep, last = [], 0
    for a, b in spans:
        keep.append(parts[last:a])
        last = b
    keep.append(parts[last:])
    data = " ".join(x for p in keep for x in p).encode("utf-8") if unit == "word" else b"".join(keep)
    return sum(b - a for a, b in spans), len(spans), data


def as_text(col: str):
    """Bytes as text; bytes that are no whole character any more are left out."""
    @F.pandas_udf("string")
    def decode(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))
    return decode(col)


def op7_substring_dedup(spark, sf_dir):
    d = documents(spark, sf_dir)
    r = remove_repeats(d, 35, "word", False).drop("kept", "n_spans").withColumnRenamed("n_units", "n_words")
    return d.select("doc_id", text_key().alias("key")).join(r, "key").drop("key")


def op10_suffix_array_dedup(spark, sf_dir):
    d = documents(spark, sf_dir)
    r = remove_repeats(d, 200, "byte", False).drop("kept").withColumnRenamed("n_units", "n_bytes")
    return d.select("doc_id", text_key().alias("key")).join(r, "key").drop("key")
