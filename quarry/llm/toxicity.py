"""Toxicity by a weighted finite-state pattern grammar (op4).

Tokens are read as classes (insult, threat, target, negation, report, other). Each kind of
context is a small transducer, a table of (state, class) -> (state, output, weight): it
says whether its class was read within the last REACH tokens. The matcher is another: it
opens a match at an insult or threat, keeps it open for REACH tokens, so that context on
either side counts, and closes it with a weight. Their product, built once by `compose`,
is one table, which runs over each clause that has an insult or threat. Weights multiply:
a target raises a match, negation and reported speech lower it, and a threat without a
target is none.

Scores come from matched clauses alone, through a logistic model whose coefficients are
not negative, so that a lowered match never raises a score.

Insult terms are fixed values plus terms (words and word beginnings) whose log odds in
the training rows reach MIN_ODDS. The training sample is at most SAMPLE rows, taken in
the order of a hash of doc_id; only the texts of those rows are read by the fit.

Defined cases: null and empty texts have no clause and get the model's base score;
repeated rows score alike; other columns are carried whole and may have any name; an empty
table gives no rows; without training rows the fixed values alone give the model.
"""
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import documents, whole_row

SAMPLE, MIN_ODDS, MIN_DOCS, REACH, THRESHOLD = 6_000, 3.0, 6, 4, 0.3
INSULTS = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()
THREATS = "kill hurt destroy attack beat shoot punch".split()
TARGETS = "you your he she they him her them people everyone".split()
NEGATIONS = "not never no isn't aren't wasn't nicht nie pas ne".split()
REPORTS = "said says wrote claimed called quoted reported".split()
CLAUSE, TOKEN = re.compile(r"[.!?;\n|]+"), re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
STEMS = (4, 5, 6, 7)
OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT = range(6)
CONTEXTS = (TARGET, NEGATION, REPORT)
#: Weight of each context on a match, and of a fixed insult or threat; least weight that counts.
FACTORS, FIXED, COUNTS = {TARGET: 1.25, NEGATION: 0.25, REPORT: 0.4}, 5.0, 1.5
HINGES = (3.0, 4.0, 5.0, 6.0)
N_FEATURES = 5 + 2 * len(HINGES)


def recency(cls: int) -> dict:
    """(state, class) -> (state, whether `cls` was read within REACH tokens before this one)."""
    return {(s, c): (REACH if c == cls else max(0, s - 1), s > 0) for s in range(REACH + 1) for c in range(6)}


def closing(core: int, seen: frozenset) -> tuple:
    """kind and weight of a match of this core with these contexts."""
    if core == THREAT and TARGET not in seen:
        return None, 0.0
    kind = "negated" if NEGATION in seen else "reported" if REPORT in seen else "threat" if core == THREAT else "targeted" if TARGET in seen else "plain"
    return kind, math.prod(FACTORS[c] for c in seen)


def matcher() -> dict:
    """(state, (class, contexts before)) -> (state, closed match or None, whether one opens).
    A state is None or the open match: its core, contexts and tokens left."""
    subsets = [frozenset(c for i, c in enumerate(CONTEXTS) if k >> i & 1) for k in range(8)]
    table = {}
    for state in [None, *((core, seen, left) for core in (INSULT, THREAT) for seen in subsets for left in range(1, REACH + 1))]:
        for c in range(6):
            for before in subsets:
                if c in (INSULT, THREAT):
                    move = ((c, before, REACH), closing(*state[:2]) if state else None, True)
                elif state is None:
                    move = (None, None, False)
                else:
                    seen, left = state[1] | ({c} & set(CONTEXTS)), state[2] - 1
                    move = ((state[0], seen, left), None, False) if left else (None, closing(state[0], seen), False)
                table[state, (c, before)] = move
    return table


@lru_cache(maxsize=1)
def compose() -> tuple[list, list]:
    """The product: per state a row of (state, closed match, opens) by class, and per state the
    match that the clause's end closes. State 0 is the start."""
    parts, core = {c: recency(c) for c in CONTEXTS}, matcher()
    number, states, rows, ends = {((0, 0, 0), None): 0}, [((0, 0, 0), None)], [], []
    while len(rows) < len(states):
        past, open_ = states[len(rows)]
        row = []
        for c in range(6):
            steps = [parts[x][s, c] for x, s in zip(CONTEXTS, past)]
            before = frozenset(x for x, (_, on) in zip(CONTEXTS, steps) if on)
            after, closed, opens = core[open_, (c, before)]
            to = (tuple(s for s, _ in steps), after)
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append((number[to], closed, opens))
        rows.append(row)
        ends.append(closing(*open_[:2]) if open_ else None)
    return rows, ends


def terms(word: str):
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Lexicon(dict):
    """word -> (class, weight), filled as words come."""
    FIXED_CLASSES = {w: c for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}

    def __init__(self, weights: dict):
        self.weights = weights

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        c, w = self.FIXED_CLASSES.get(word), 0.0
        if c is None:
            w = max(self.weights.get(t, 0.0) for t in terms(word))
            c = INSULT if w > 0 else OTHER
        elif c == THREAT:
            w = FIXED
        self[word] = out = (c, w)
        return out


def clause_matches(tokens: list[str], lexicon: Lexicon) -> list[tuple[str, float]]:
    """(kind, weight) of every match of a clause."""
    read = [lexicon[t] for t in tokens]
    if not any(c >= INSULT for c, _ in read):
        return []
    rows, ends = compose()
    state, weight, out = 0, 0.0, []
    for c, w in read:
        state, closed, opens = rows[state][c]
        if closed and closed[0]:
            out.append((closed[0], weight * closed[1]))
        if opens:
            weight = w
    if ends[state] and ends[state][0]:
        out.append((ends[state][0], weight * ends[state][1]))
    return out


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    """The best clause's weight and what of it and of the second best exceeds each of HINGES,
    log of the sum of all, and whether one, two, three clauses count."""
    ws = []
    for clause in CLAUSE.split((text or "").lower()):
        m = clause_matches(TOKEN.findall(clause), lexicon)
        if m:
            ws.append(max(w for _, w in m))
    ws.sort(reverse=True)
    n = sum(w >= COUNTS for w in ws)
    first, second = [*ws, 0.0, 0.0][:2]
    return np.array([first, *(max(0.0, w - h) for w in (first, second) for h in HINGES), math.log1p(sum(ws)), float(n > 0), float(n > 1), float(n > 2)])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Coefficients, none negative, and the intercept: columns that would be negative are left out."""
    on = np.ones(x.shape[1], bool)
    while True:
        z = np.c_[x[:, on], np.ones(len(x))]
        b, ridge = np.zeros(z.shape[1]), np.r_[[l2] * int(on.sum()), 1e-3]
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            h = z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge)
            b += np.linalg.solve(h, z.T @ (y - p) - ridge * b)
        out = np.zeros(x.shape[1] + 1)
        out[np.append(on, True)] = b
        if (b[:-1] >= 0).all():
            return out
        on[int(np.argmin(out[:-1]))] = False


def learn_terms(texts, y) -> dict:
    pos, neg = Counter(), Counter()
    for t, v in zip(texts, y):
        (pos if v else neg).update({s for w in set(TOKEN.findall((t or "").lower())) for s in terms(w)})
    p, n = sum(y) + 1, len(y) - sum(y) + 1
    out = dict.fromkeys(INSULTS, FIXED)
    if sum(y):
        for t, c in pos.items():
            odds = math.log((c + .5) / p) - math.log((neg[t] + .5) / n)
            if c >= MIN_DOCS and odds >= MIN_ODDS:
                out[t] = max(out.get(t, 0.0), odds)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict, np.ndarray]:
    train = labels.where("toxic is not null and doc_id is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2").select("doc_id", "toxic")
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)  # bounded: SAMPLE rows
    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").orderBy("doc_id", "text", "toxic").limit(sample).toPandas()
    y = [int(v > 0) for v in rows.toxic]
    if not 0 < sum(y) < len(y):
        return dict.fromkeys(INSULTS, FIXED), np.array([0.4] + [0.0] * (N_FEATURES - 4) + [1.0, 1.0, 1.0, -3.0])
    # terms of one half weigh the other half's clauses, so that the model sees honest matches
    half, x = np.arange(len(rows)) % 2 == 0, np.zeros((len(rows), N_FEATURES))
    for side in (half, ~half):
        lexicon = Lexicon(learn_terms(rows.text[~side], [v for v, s in zip(y, ~side) if s]))
        x[side] = np.array([features(t, lexicon) for t in rows.text[side]]).reshape(-1, N_FEATURES)
    return learn_terms(rows.text, y), logistic(x, np.array(y, float))


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """_row (the whole row) and score of every document."""
    weights, coef = model

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(weights)
        for texts in batches:
            z = np.array([float(features(t, lexicon) @ coef[:-1] + coef[-1]) for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.select(whole_row(docs).alias("_row"), run("text").alias("score"))


def op4_toxicity(spark, sf_dir):
    d, l = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    s = score(d, fit(d, l)).select("_row.doc_id", "score")
    return s.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
