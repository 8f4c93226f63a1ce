import hashlib
import itertools
import random

import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from quarry.llm import imatch, toxicity as X


def plainly(classes, weights):
    """The matches of a clause by their definition, without transducers."""
    out = []
    for i, c in enumerate(classes):
        if c not in (X.INSULT, X.THREAT):
            continue
        after = next((j for j in range(i + 1, len(classes)) if classes[j] in (X.INSULT, X.THREAT)), len(classes))
        seen = {classes[j] for j in range(max(0, i - X.REACH), min(after, i + X.REACH + 1)) if classes[j] in X.CONTEXTS}
        if c == X.THREAT and X.TARGET not in seen:
            continue
        kind = "negated" if X.NEGATION in seen else "reported" if X.REPORT in seen else "threat" if c == X.THREAT else "targeted" if X.TARGET in seen else "plain"
        w = weights[i]
        for s in seen:
            w *= X.FACTORS[s]
        out.append((kind, round(w, 9)))
    return out


def test_composed_table_against_all_paths():
    word = {X.OTHER: "sun", X.TARGET: "you", X.NEGATION: "not", X.REPORT: "said", X.INSULT: "idiot", X.THREAT: "hurt"}
    lex = X.Lexicon(dict.fromkeys(X.INSULTS, 5.0))
    run = lambda cs: [(k, round(w, 9)) for k, w in X.clause_matches([word[c] for c in cs], lex)]
    for n in range(1, 6):
        for cs in itertools.product(range(6), repeat=n):
            assert run(cs) == plainly(cs, [5.0] * n), cs
    rnd = random.Random(2)
    for _ in range(3000):
        cs = [rnd.choice([0, 0, 0, 1, 2, 3, 4, 5]) for _ in range(rnd.randrange(6, 30))]
        assert run(cs) == plainly(cs, [5.0] * len(cs)), cs


def test_clauses():
    lex = X.Lexicon(dict.fromkeys(X.INSULTS, 5.0))
    run = lambda s: X.clause_matches(s.split(), lex)
    kind = lambda s: [k for k, _ in run(s)]
    assert kind("you are an idiot") == ["targeted"] and kind("that idiot") == ["plain"] and kind("idiots all of you") == []
    assert kind("you are not an idiot") == ["negated"] and kind("she said idiot") == ["reported"] and kind("idiot they said") == ["reported"]
    assert kind("i will hurt you") == ["threat"] and kind("kill them") == ["threat"] and kind("you i will hurt") == ["threat"] and kind("it may hurt") == [] and kind("the sun") == []
    assert run("you are not an idiot")[0][1] < run("an idiot")[0][1] < run("you idiot")[0][1]


def test_context_lowers_the_score(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = X.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert (model[1][:-1] >= 0).all()
    df = spark.createDataFrame(enumerate(["you idiot", "you are not an idiot", "she said idiot", "", "i will hurt you", "the sun"]), "doc_id int, text string")
    s = [r.score for r in X.score(df, model).orderBy("_row.doc_id").collect()]
    assert s[0] > s[1] >= s[3] and s[0] > s[2] >= s[3] and s[4] > s[5] == s[3]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    r = X.op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    tp = ((r.predicted == 1) & (r.toxic == 1)).sum()
    print(len(r), tp, r.predicted.sum(), r.toxic.sum())
    assert tp / r.predicted.sum() >= 0.92 and tp / r.toxic.sum() >= 0.85


def test_empty_and_null(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "you idiot. stupid moron! trash", 0), (3, "you idiot. stupid moron! trash", 0), (None, "word " * 50_000 + "you idiot", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("_score", F.lit("x")).withColumn("_row", F.lit(1))
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    got = X.score(df, X.fit(df, lab)).select("_row.*", F.col("score").alias("s")).collect()
    assert len(got) == 5 and all(x._score == "x" and x.score == 0 for x in got)
    r = {x.doc_id: x.s for x in got}
    assert r[1] == r[2] < 0.3 < r[3] <= 1 and r[None] > r[1]
    assert X.score(df.limit(0), X.fit(df, lab)).count() == 0


def lexicon_parts(terms, g, lexicon):
    """Parts of one grade, from the term hashes."""
    out = []
    for j in range(imatch.PARTS):
        mine = sorted(t for t in terms if t in lexicon and hashed(t, 8) & ((1 << g) - 1) == j)
        out.append(chained(mine) & 0x7FFFFFFF if mine else 0)
    return out


def chained(values):
    h = 42
    for v in values:
        h = hashed(v, h, seeded=True) & (2 ** 64 - 1)
    return h


def hashed(value, first, seeded=False):
    """xxhash64 of a long, with the seed or after a first int column."""
    if not seeded:
        first = xxhash.xxh64_intdigest(struct.pack("<i", first), 42)
    return xxhash.xxh64_intdigest(struct.pack("<q", value), first)


def test_imatch_against_brute_force(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 40, 300, 900]))) for _ in range(50)] + [None, "", "?!", "w1 w1", "zzz", "zzz"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(4)
    texts = [t or "" for t in texts]
    n = len(texts)
    signed = lambda x: x - 2 ** 64 if x >= 2 ** 63 else x
    terms = lambda t: {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\W_]+", t.lower())}
    df_count = Counter(t for x in texts for t in terms(x))
    lexicon = {t for t, c in df_count.items() if max(2, int(imatch.LOW * n)) <= c <= max(2, int(imatch.HIGH * n))}

    def prints(t):
        d = terms(t)
        g = len(d).bit_length() - 1 if d else 0
        both = {g: lexicon_parts(d, g, lexicon), g + 1: lexicon_parts(d, g + 1, lexicon)}
        return both, tuple(sorted(d))

    def like(p, q):
        pairs = [(a, b) for g in p[0].keys() & q[0].keys() for a, b in zip(p[0][g], q[0][g])]
        if not pairs:
            return 0.0
        used = sum(a != 0 or b != 0 for a, b in pairs)
        return sum(a == b != 0 for a, b in pairs) / used if used else float(p[1] == q[1])

    r = {x.doc_id: x for x in imatch.fingerprints(df).collect()}
    assert len(r) == n
    for i, t in enumerate(texts):
        k = len(t) // 4
        e = t[:len(t) - k] + texts[(i + 1) % n][:k]
        assert abs(r[i].near_edited - like(prints(t), prints(e))) < 1e-9 and abs(r[i].near_next - like(prints(t), prints(texts[(i + 1) % n]))) < 1e-9
        for p, s in ((prints(t), r[i].fingerprint), (prints(e), r[i].edited_fingerprint)):
            g = min(p[0])
            if any(any(x) for x in p[0].values()):
                assert s == ":".join([str(g), *("-".join("%x" % x if x else "" for x in p[0][h]) for h in (g, g + 1))])
            else:
                assert s.startswith("all:")


def test_imatch_repeated_rows(spark):
    rows = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "delta"), (None, "alpha")]
    r = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    edited = sorted((x.doc_id or 0, x.edited_sha256) for x in r)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert edited == sorted([(0, sha("alph" + "a")), (1, sha("alpha beta galph")), (1, sha("alpha beta galph")), (1, sha("alpha beta gdelt")), (2, sha("delt" + "a"))])


def test_imatch(spark):
    texts = [f"alpha beta{i % 3} word{i % 5} tail{i} common é" * (i % 4 + 1) for i in range(60)] + [None, "", "same text here", "same text here"]
    df = spark.createDataFrame([(i * 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, part string").repartition(5)
    r = {x.doc_id: x for x in imatch.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        e = t[:len(t) - k] + nxt[:k]
        assert r[i * 2].n_chars == len(t) and r[i * 2].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= r[i * 2].near_edited <= 1
    assert r[124].fingerprint == r[126].fingerprint and r[124].near_next == 1
    assert imatch.fingerprints(df.limit(0)).count() == 0


def test_imatch_long_and_unlike_texts(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rnd.sample(words, 300)) for _ in range(60)] + [f"only{i}" for i in range(4)] + [None, ""]
    r = {x.doc_id: x for x in imatch.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    edited = [r[i].near_edited for i in range(59)]
    assert min(edited) > 0.1 and sum(edited) / 59 > 0.4
    assert sum(r[i].near_next for i in range(59)) / 59 < 0.2
    assert [r[i].near_next for i in (60, 61, 62, 63)] == [0] * 4 and r[64].near_next == 1
