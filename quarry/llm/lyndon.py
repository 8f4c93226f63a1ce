"""Suffix sorting by grouping on Lyndon prefixes, for many short blocks side by side (op10).

Suffixes start in groups by first symbol. Groups are taken in descending order; every
member finds the nearest earlier suffix of a smaller group (its previous-smaller
pointer), and the suffixes pointed at move to new groups above their own, the more
members point at them the higher. When all are taken, a group holds the suffixes that
share their longest Lyndon prefix. One ascending pass then follows the pointers and
fills each group in order; no suffix is renamed or compared again.

All blocks take a step at a time, so that a step is a few array operations over them.
Every block must end in a symbol that is smaller than its others and occurs once in it.
"""
import numpy as np


def lyndon_groups(sym: np.ndarray, sizes: np.ndarray):
    """group start and previous-smaller pointer of every position, both counted from 1."""
    n = len(sym)
    ends = np.cumsum(sizes) + 1
    begins = ends - sizes
    block = np.repeat(np.arange(len(sizes)), sizes)
    sa = np.zeros(n + 1, np.int64)
    sa[1:] = np.lexsort((sym, block)) + 1
    isa = np.zeros(n + 1, np.int64)
    isa[sa] = np.arange(n + 1)
    key = np.concatenate([[-1], block * 1024 + sym])[sa]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.zeros(n + 1, np.int64)
    group[sa] = np.repeat(heads, np.diff(np.append(heads, n + 1)))
    count = np.zeros(n + 1, np.int64)
    count[heads] = np.diff(np.append(heads, n + 1))
    prev, moving = np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
    todo, cursor = begins, ends.copy()
    while len(todo):
        start = group[sa[cursor - 1]]
        size = cursor - start
        g = np.repeat(start, size)
        s = sa[g + np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)]
        floor = np.repeat(todo, size)
        live = start > todo
        todo, cursor = todo[live], start[live]
        p = s - 1
        up = np.flatnonzero(group[p] > g)
        while len(up):
            p[up] = prev[p[up]]
            up = up[group[p[up]] > g[up]]
        prev[s] = p
        same = np.flatnonzero(group[p] == g)
        while len(same):  # runs of one Lyndon word share the pointer of their first
            prev[s[same]] = prev[prev[s[same]]]
            same = same[group[prev[s[same]]] == g[same]]
        p = prev[s]
        p = np.sort(p[p >= floor])
        if not len(p):
            continue
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        times = np.diff(np.append(first, len(p)))
        p = p[first]
        own = group[p]
        o = np.lexsort((times, own))
        p, own, times = p[o], own[o], times[o]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        many = np.diff(np.append(first, len(p)))
        base = own[first] + count[own[first]] - many
        at = np.repeat(base - first, many) + np.arange(len(p))
        old = isa[p]
        moving[old] = True
        out = at[~moving[at]]
        moving[old] = False
        holes = np.sort(old[old < np.repeat(base, many)])
        x = sa[out]
        sa[holes], isa[x] = x, holes
        sa[at], isa[p] = p, at
        count[own[first]] -= many
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (times[1:] != times[:-1])]))
        many = np.diff(np.append(first, len(p)))
        group[p] = np.repeat(at[first], many)
        count[at[first]] = many
    return group, prev, begins, ends


def suffix_order(sym: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of `sym` in suffix order, block after block."""
    if not len(sym):
        return np.empty(0, np.int64)
    group, prev, begins, ends = lyndon_groups(sym, sizes)
    slot = np.arange(len(sym) + 1)
    out = np.zeros(len(sym) + 1, np.int64)
    done = np.zeros(len(sym) + 1, bool)
    out[begins] = ends - 1
    done[ends - 1] = done[0] = True
    i, begin, end = begins.copy(), begins, ends
    while len(i):
        s = out[i] - 1
        on = s >= begin
        s, b = s[on], begin[on]
        while len(s):
            on = ~done[s] & (s >= b)
            s, b = s[on], b[on]
            g = group[s]
            out[slot[g]] = s
            slot[g] += 1
            done[s] = True
            s = prev[s]
        i = i + 1
        on = i < end
        i, begin, end = i[on], begin[on], end[on]
    return out[1:] - 1
