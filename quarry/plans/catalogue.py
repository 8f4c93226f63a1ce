"""Queries of routing, filters, fusion details, configurations, ingest and question sets."""
import uuid

from pyspark.sql import Window, functions as F

from quarry.functions import text as T
from quarry.operators import benchmark as B, chunks as C, filings as G, models as M, retrieval as R
from quarry.plans.registry import (BM25, CUT, DENSE, FUSE, ORACLES, QUERIES, TFIDF, TOKENS, TRUTH, _dense, _docs, _lexical, _queries, by_label, c1_tfidf_search, c2_bm25_search,
                                   c3_dense_search, c4_hybrid_search, few, index, query, reranked)
from quarry.sources.tables import load_index, save_index, shared_folder, table

__all__ = ["ORACLES", "QUERIES"]

# Questions that trigger every rule, and near misses.
QUESTIONS = ["What were Apple capital expenditures in 2023?", "How much CAPEX did Tesla spend in 2022 and 2023 and 2022", "net income and revenue of MSFT", "the revenues of pineapple farms",
             "Google or Alphabet in 2024, goog", "nvda net incomes 20235", "capexes of amazonia in 1999", "Net  income", "", "Compare TSLA and Nvidia revenue, 2021 to 2024"]
ASKED = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ") AS t(query_id, text))"


def _questions(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, text string")


@query(rf"""SELECT query_id, concat_ws(' ', text, CASE WHEN regexp_matches(lower(text), '\b(capital expenditures|capex)\b') THEN 'purchases of property and equipment acquisition of property plant and equipment capital spending' END,
CASE WHEN regexp_matches(lower(text), '\bnet income\b') THEN 'net earnings net loss' END, CASE WHEN regexp_matches(lower(text), '\brevenue\b') THEN 'net sales operating revenue revenues' END) AS expanded FROM {ASKED}""")
def d1_expand_query(spark, d):
    return _questions(spark).select("query_id", T.expand(F.col("text")).alias("expanded"))


@query(f"""SELECT query_id, concat_ws(' ', text, CASE WHEN contains(lower(text), 'capital expenditures') THEN 'purchases of property and equipment capex' WHEN contains(lower(text), 'net sales') THEN 'revenue sales'
WHEN contains(lower(text), 'net income') THEN 'profit net earnings' END) AS expanded FROM {ASKED}""")
def d2_expand_first(spark, d):
    return _questions(spark).select("query_id", T.expand_first(F.col("text")).alias("expanded"))


_ROUTE = "array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in ks.split()) + f" THEN '{t}' END" for t, ks in (
    ("AAPL", "apple aapl"), ("MSFT", "microsoft msft"), ("AMZN", "amazon amzn"), ("NVDA", "nvidia nvda"), ("TSLA", "tesla tsla"), ("GOOGL", "google googl goog alphabet"))) + "], lambda x: x IS NOT NULL), ',')"
_YEARS = r"array_to_string(regexp_extract_all(text, '\b(2022|2023|2024)\b', 1), ',')"


@query(f"SELECT query_id, {_ROUTE} AS tickers, {_YEARS} AS years FROM {ASKED}")
def d3_d4_route(spark, d):
    return _questions(spark).select("query_id", F.array_join(T.route_companies(F.col("text")), ",").alias("tickers"), F.array_join(T.route_years(F.col("text")).cast("array<string>"), ",").alias("years"))


@query(f"SELECT query_id, coalesce(nullif({_ROUTE}, ''), 'MSFT,IBM') AS tickers, coalesce(nullif({_YEARS}, ''), '2022') AS years FROM {ASKED}")
def d3_routed_or_requested(spark, d):
    t = T.routed(T.route_companies(F.col("text")), F.array(F.lit("MSFT"), F.lit("IBM")))
    y = T.routed(T.route_years(F.col("text")), F.array(F.lit(2022))).cast("array<string>")
    return _questions(spark).select("query_id", F.array_join(t, ",").alias("tickers"), F.array_join(y, ",").alias("years"))


_YEAR = r"nullif(regexp_extract(text, '\b(20[0-9]{2})\b', 1), '')"


@query(f"SELECT query_id, CAST({_YEAR} AS INTEGER) AS year FROM {ASKED}")
def d5_first_year(spark, d):
    return _questions(spark).select("query_id", T.first_year(F.col("text")).alias("year"))


@query(f"SELECT query_id, count(doc_id) AS n FROM (SELECT query_id, {_YEAR} AS year FROM {ASKED}) LEFT JOIN documents d ON year IS NULL OR contains(d.text, year) GROUP BY 1")
def p10_year_filter(spark, d):
    q = _questions(spark).select("query_id", T.first_year(F.col("text")).cast("string").alias("year"))
    years = q.where("year is not null").select("year").distinct()  # at most a hundred
    n = _docs(spark, d).join(F.broadcast(years), F.contains("text", F.col("year"))).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    total = _docs(spark, d).agg(F.count(F.lit(1)).alias("total"))
    return q.join(n, "year", "left").join(F.broadcast(total), how="cross").select("query_id", F.when(F.col("year").isNull(), F.col("total")).otherwise(F.coalesce("n", F.lit(0))).alias("n"))


@query(f"WITH {TOKENS} SELECT id AS doc_id, dl, round(dl / avgdl, 6) AS ratio FROM len, st")
def a4_a18_length_ratio(spark, d):
    i = index(spark, d)
    return i["postings"].join(F.broadcast(i["stats"]), how="cross").select(F.col("id").alias("doc_id"), F.col("dl").cast("long").alias("dl"), F.round(F.col("dl") / F.col("avgdl"), 6).alias("ratio"))


@query(f"WITH {TOKENS} SELECT term, round(ln(n - df + 0.5) - ln(df + 0.5), 6) AS okapi, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS plus_one, round(ln((1 + n) / (1 + df)) + 1, 6) AS smooth, round(ln(n / (1 + df)), 6) AS notebook FROM df, st")
def w12_idf_variants(spark, d):
    return R.with_stats(index(spark, d)).select("term", *[F.round(R.idf(F.col("df"), F.col("n"), m), 6).alias(m) for m in ("okapi", "plus_one", "smooth", "notebook")])


@query(f"WITH {TOKENS} SELECT id, term, round(tf / dl, 6) AS share, round(tf / dl * ln(n / (1 + df)), 6) AS weight FROM post JOIN len USING (id) JOIN df USING (term), st")
def a2_a19_weights(spark, d):
    share = F.col("tf") / F.col("dl")
    return R.weighted(index(spark, d), "notebook").select("id", "term", F.round(share, 6).alias("share"), F.round(share * F.col("idf"), 6).alias("weight"))


@query(f"""WITH {TOKENS}, i AS (SELECT term, ln(n / (1 + df)) idf FROM df, st), d AS (SELECT id, term, tf / dl * idf w FROM post JOIN len USING (id) JOIN i USING (term)), dn AS (SELECT id, sqrt(sum(w * w)) dn FROM d GROUP BY id),
ql AS (SELECT query_id, sum(qtf) ql FROM q GROUP BY 1), qq AS (SELECT query_id, term, qtf / ql * idf qw FROM q JOIN ql USING (query_id) JOIN i USING (term)), qn AS (SELECT query_id, sqrt(sum(qw * qw)) qn FROM qq GROUP BY 1),
s AS (SELECT query_id, id, round(sum(qw * w) / any_value(dn) / any_value(qn), 6) score FROM qq JOIN d USING (term) JOIN dn USING (id) JOIN qn USING (query_id) WHERE qw > 0 AND w > 0 GROUP BY ALL) {CUT.format(k=5)}""")
def a6_tfidf_lengths(spark, d):
    return R.tfidf_lengths(_queries(spark, d), index(spark, d))


#: The index's column of each list that filters.
META = {"tickers": "lang", "years": "source"}


def _filters(spark, d):
    """English texts of three sources; every third query has one of the lists empty, or the other."""
    q, none = F.col("query_id") % 3, F.array().cast("array<string>")
    return _queries(spark, d).select("query_id", F.when(q == 0, none).otherwise(F.array(F.lit("en"))).alias("tickers"), F.when(q == 1, none).otherwise(F.array(*map(F.lit, ("src0", "src1", "src2")))).alias("years"))


@query(f"WITH {BM25.replace('s AS (', 'all_ AS (')}, s AS (SELECT query_id, id, score FROM all_ JOIN documents ON doc_id = id WHERE (query_id % 3 = 0 OR lang = 'en') AND (query_id % 3 = 1 OR source IN ('src0', 'src1', 'src2'))) {CUT.format(k=5)}")
def c2_bm25_filtered(spark, d):
    return R.bm25(_queries(spark, d), index(spark, d), columns=META, filters=_filters(spark, d))


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v.join(_queries(spark, d).select(F.col("query_id").alias("id")), "id", "left_semi").withColumnRenamed("id", "query_id"), v


def _labelled(spark, d):
    return table(spark, d, "embeddings").where("label IN (0, 2)").select(F.col("vec_id").alias("id"))


TOP = "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {f} QUALIFY rank <= {k}"


@query(f"WITH {DENSE}, v2 AS (SELECT vs.* FROM vs JOIN embeddings ON vec_id = id WHERE label IN (0, 2)) {TOP.format(f='v2', k=5)}")
def c3_knn_filtered(spark, d):
    return R.dense(*_vectors(spark, d), 5, _labelled(spark, d))


@query(f"WITH {DENSE}, o AS ({TOP.format(f='vs', k=200)}), v2 AS (SELECT o.query_id, o.id, o.score FROM o JOIN embeddings ON vec_id = id WHERE label IN (0, 2)) {TOP.format(f='v2', k=5)}")
def w3_knn_overfetch(spark, d):
    return R.dense(*_vectors(spark, d), 5, _labelled(spark, d), overfetch=True)


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id < 10 AND b.vec_id < 10")
def j13_cosine_matrix(spark, d):
    v = _vectors(spark, d)[1].where("id < 10").select("id", R.unit(F.col("embedding")).alias("v"))  # a display of ten
    w = v.select(F.col("id").alias("b"), F.col("v").alias("w"))
    return v.join(F.broadcast(w), how="cross").select(F.col("id").alias("a"), "b", F.round(R.dot("v", "w"), 6).alias("cosine"))


@query(f"WITH vs AS (SELECT q.vec_id query_id, v.vec_id id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) {TOP.format(f='vs', k=16)}")
def m8_knn_graph(spark, d):
    """Edges of the stated query set, ids divisible by 20, to their 16 nearest others."""
    v = _vectors(spark, d)[1]
    g = R.dense(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 17).where("query_id <> id").drop("rank")
    return R.top_k(g, 16)


@query("SELECT vec_id, " + ", ".join(f"round(embedding[{i}]::DOUBLE, 6) AS d{i}" for i in range(1, 6)) + " FROM embeddings")
def p18_first_dims(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *[F.round(F.col("embedding")[i].cast("double"), 6).alias(f"d{i + 1}") for i in range(5)])


@query(f"""{FUSE}, ids AS (SELECT query_id, id FROM lex UNION SELECT query_id, id FROM vec)
SELECT query_id, ids.id, coalesce(CAST(lex.rank AS VARCHAR), 'N/A') AS bm25_rank, round(coalesce(1 / (60 + lex.rank), 0), 9) AS bm25_score, coalesce(CAST(vec.rank AS VARCHAR), 'N/A') AS vector_rank,
round(coalesce(1 / (60 + vec.rank), 0), 9) AS vector_score, round(coalesce(1 / (60 + lex.rank), 0) + coalesce(1 / (60 + vec.rank), 0), 9) AS total_score FROM ids LEFT JOIN lex USING (query_id, id) LEFT JOIN vec USING (query_id, id)""")
def p8_rrf_details(spark, d):
    return R.rrf_details(_lexical(spark, d, 20), _dense(spark, d, 20))


def config_e(spark, d, pool=20, k=5, dense=None):
    """Expansion and routing, filtered lexical search of the expanded and dense search of the
    original query, fusion of a pool, reranking."""
    q = _queries(spark, d)
    routes = q.select("query_id", T.route_companies(F.col("text")).alias("tickers"), T.route_years(F.col("text")).cast("array<string>").alias("years"))
    lex = R.bm25(q.withColumn("text", T.expand(F.col("text"))), index(spark, d), 20, columns=META, filters=routes)
    return reranked(spark, d, R.rrf(lex, _dense(spark, d, 20) if dense is None else dense, k=pool), k)


#: Configurations by name; any other mode of `answer` is the last.
CONFIGS = {"A": c1_tfidf_search, "B": c2_bm25_search, "C": c3_dense_search, "D": c4_hybrid_search, "E": config_e}
MODES = {"baseline_1_lexical": c2_bm25_search, "baseline_2_semantic": c3_dense_search}


def answer(spark, d, mode: str):
    return MODES.get(mode, config_e)(spark, d)


_T = r"regexp_extract_all(lower({}.text), '[\p{{L}}\p{{N}}]+')".format
_E = f"""({FUSE.replace('rank <= 5)', 'rank <= 20)')}, rs AS (SELECT query_id, id, round(len(list_intersect(list_distinct({_T('b')}), {_T('t')})) / greatest(len(list_distinct({_T('b')})), 1), 6) score
FROM fused JOIN benchmark b ON b.item_id = query_id JOIN documents t ON t.doc_id = id) {TOP.format(f='rs', k=5)})"""


@query(f"SELECT * FROM {_E}")
def c8_mode_enhanced(spark, d):
    return answer(spark, d, "anything else")


_ALL = f"""r AS (SELECT 'A' AS config, * FROM (WITH {TFIDF} {CUT.format(k=5)}) UNION ALL SELECT 'B', * FROM (WITH {BM25} {CUT.format(k=5)}) UNION ALL SELECT 'C', * FROM (WITH {DENSE} {TOP.format(f='vs', k=5)})
UNION ALL SELECT 'D', * FROM ({FUSE} SELECT * FROM fused) UNION ALL SELECT 'E', * FROM {_E}), {TRUTH},
c AS (SELECT * FROM (SELECT query_id, count(*) n FROM gt GROUP BY 1), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(config)),
m AS (SELECT c.config, c.query_id, coalesce(hits / n, 0) AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(dcg / list_sum(list_transform(range(1, least(n, n_ret) + 1), lambda x: 1 / log2(x + 1))), 0) AS ndcg FROM c
LEFT JOIN (SELECT r.config, r.query_id, count(*) n_ret, count(gt.id) hits, min(CASE WHEN gt.id IS NOT NULL THEN rank END) first, sum(CASE WHEN gt.id IS NOT NULL THEN 1 / log2(rank + 1) END) dcg
FROM r LEFT JOIN gt ON gt.query_id = r.query_id AND gt.id = r.id GROUP BY ALL) h USING (config, query_id))"""


def ablation(spark, d):
    """config, query_id, category, recall, mrr, ndcg of all configurations. Each search runs once:
    the best 20 of the lexical and of the dense one are saved, and B, C, D and E use them."""
    path = f"{shared_folder(spark)}/ranked/{uuid.uuid4().hex}"
    save_index({"lexical": _lexical(spark, d, 20), "dense": _dense(spark, d, 20)}, path)
    saved = load_index(spark, path, ("lexical", "dense"))
    lex, vec = saved["lexical"], saved["dense"]
    ranked = {"A": CONFIGS["A"](spark, d), "B": lex.where("rank <= 5"), "C": vec.where("rank <= 5"), "D": R.rrf(lex, vec), "E": config_e(spark, d, dense=vec)}
    out = None
    for name, r in ranked.items():
        m = R.metrics(*by_label(spark, d, r)).withColumn("config", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.withColumn("category", F.concat(F.lit("c"), F.col("query_id") % 4))


@query(f"""WITH {_ALL} SELECT config, CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category, count(*) AS n, round(avg(round(recall, 6)), 4) AS recall, round(avg(round(mrr, 6)), 4) AS mrr, round(avg(round(ndcg, 6)), 4) AS ndcg
FROM (SELECT *, concat('c', query_id % 4) AS category FROM m) GROUP BY GROUPING SETS ((config), (config, category))""")
def a11_a12_ablation_summary(spark, d):
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    m = ablation(spark, d).rollup("config", "category").agg(F.count(F.lit(1)).alias("n"), mean("recall"), mean("mrr"), mean("ndcg"), F.grouping("config").alias("g"), F.grouping("category").alias("h"))
    return m.where("g = 0").select("config", F.when(F.col("h") == 1, "overall").otherwise(F.col("category")).alias("category"), "n", "recall", "mrr", "ndcg")


@query(f"WITH {_ALL} SELECT concat('c', query_id % 4) AS category, " + ", ".join(f"round(avg(CASE WHEN config = '{c}' THEN round(ndcg, 6) END), 4) AS {c}" for c in "ABCDE") + " FROM m GROUP BY 1")
def a16_metric_pivot(spark, d):
    return ablation(spark, d).groupBy("category").pivot("config", list(CONFIGS)).agg(F.round(F.avg("ndcg"), 4))


@query(f"{FUSE} SELECT query_id, count(DISTINCT id) AS active FROM (SELECT query_id, id FROM lex UNION ALL SELECT query_id, id FROM vec) GROUP BY 1")
def a17_active_keys(spark, d):
    both = _lexical(spark, d, 20).select("query_id", "id").unionByName(_dense(spark, d, 20).select("query_id", "id"))
    return both.groupBy("query_id").agg(F.countDistinct("id").alias("active"))


@query(f"{FUSE} SELECT query_id, id FROM lex INTERSECT SELECT query_id, id FROM vec")
def u2_candidate_intersect(spark, d):
    return _lexical(spark, d, 20).select("query_id", "id").intersect(_dense(spark, d, 20).select("query_id", "id"))


@query(f"{FUSE} SELECT query_id, id FROM lex EXCEPT SELECT query_id, id FROM vec")
def u3_candidate_difference(spark, d):
    return _lexical(spark, d, 20).select("query_id", "id").subtract(_dense(spark, d, 20).select("query_id", "id"))


_CONTEXT = """string_agg(concat(repeat('-', 70), chr(10), 'Source label: ', id, chr(10), 'Company: ', lang, ' | Year: ', n_chars, ' | Section: ', source, chr(10), 'Document Content:', chr(10), documents.text, chr(10)), chr(10) ORDER BY rank) AS context
FROM fused JOIN documents ON doc_id = id GROUP BY query_id"""


def _ranked_texts(spark, d):
    t = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("ticker"), F.col("n_chars").alias("year"), F.col("source").alias("section"), "text")
    return t.join(few(spark, d, c4_hybrid_search(spark, d)), "id")


@query(f"{FUSE} SELECT query_id, {_CONTEXT}")
def d6_format_context(spark, d):
    return M.contexts(_ranked_texts(spark, d))


@query(f"{FUSE}, c AS (SELECT query_id, {_CONTEXT}) SELECT query_id, concat('Context documents:', chr(10), context, chr(10), 'Question: ', text, chr(10), chr(10), 'Answer:') AS prompt FROM c JOIN benchmark ON item_id = query_id")
def d7_prompt(spark, d):
    return M.prompts(_ranked_texts(spark, d), _queries(spark, d))


@query(f"{FUSE} SELECT query_id, string_agg(concat(chr(10), '[', rank, '] Chunk ID: ', id, chr(10), 'Text: ', text, chr(10)), '' ORDER BY rank) AS listing FROM fused JOIN documents ON doc_id = id GROUP BY query_id")
def d8_judge_listing(spark, d):
    return M.listings(_ranked_texts(spark, d))


_KEYS = ("the", "tion", "de", "en")  # words that these texts have


@query(f"""WITH b AS (SELECT doc_id, lang, len(regexp_extract_all(text, '[0-9]')) AS digits, length(text) AS n, {" + ".join(f"CAST((length(lower(text)) - length(replace(lower(text), '{k}', ''))) / {len(k)} AS BIGINT)" for k in _KEYS)} AS keywords FROM documents),
k AS (SELECT *, round(keywords + 10 * digits / n, 6) AS score FROM b WHERE n >= 200 AND digits >= 20 AND digits / n >= 0.02 AND keywords > 0)
SELECT doc_id, lang, digits, keywords, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS pos FROM k""")
def p6_selection(spark, d):
    s = B.scored_sources(_docs(spark, d), _KEYS).select("doc_id", "lang", "digits", "keywords", "score")
    return s.withColumn("pos", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id")))


@query(r"""WITH s AS (SELECT doc_id, lang, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) ws FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) + len(b.ws) AS n FROM s a JOIN s b ON a.lang = b.lang AND a.doc_id < b.doc_id AND 2 * least(len(a.ws), len(b.ws)) > greatest(len(a.ws), len(b.ws)))
SELECT a, b, round(i / (n - i), 6) AS jaccard FROM p WHERE 2 * i > n - i""")
def j10_similar_pairs(spark, d):
    return B.similar_pairs(_docs(spark, d), "lang")


CHECKED = [(0, "What was the net income of Apple?", "AAPL", 2023, "factual"), (1, "Apple revenue?", "AAPL", 2023, "factual"), (2, "How did pineapple sales change then", "AAPL", 2023, "lexical_gap"), (3, "What did Alphabet spend on research", "GOOGL", 2022, "temporal_routing"),
           (4, "What did Google spend in 2022 on research", "GOOGL", 2022, "temporal_routing"), (5, "", "MSFT", 2024, "factual"), (6, "total assets of the company in 2024", "MSFT", 2024, "factual"), (7, "aapl  and  more of the same", "AAPL", 2024, "factual")]
_NAMES = "CASE ticker " + " ".join(f"WHEN '{t}' THEN regexp_matches(lower(text), '{'|'.join([t.lower(), *ns.split()])}')" for t, ns in (("AAPL", "apple"), ("MSFT", "microsoft"), ("GOOGL", "google alphabet"))) + " END"


@query(r"SELECT id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 5 AND " + _NAMES + " AND (category <> 'temporal_routing' OR contains(text, CAST(year AS VARCHAR))) AS valid FROM (VALUES "
       + ", ".join(f"({i}, '{t}', '{k}', {y}, '{c}')" for i, t, k, y, c in CHECKED) + ") AS t(id, text, ticker, year, category)")
def p7_valid_questions(spark, d):
    q = spark.createDataFrame(CHECKED, "id int, text string, ticker string, year int, category string")
    return q.select("id", B.valid_question(F.col("text"), F.col("ticker"), F.col("year"), F.col("category")).alias("valid"))


REPLIES = ['{"answerability": 5, "hallucination": false}', '{"answerability": 4, "hallucination": true}', '{"answerability": 3, "hallucination": false}', '{"answerability": 0}', '{"hallucination": false}', "no json", '{"answerability": 4, "hallucination": false, "x": 1}', None]


@query("SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, false), (4, false), (5, false), (6, true), (7, false)) AS t(id, accepted)")
def p12_critic(spark, d):
    return spark.createDataFrame(list(enumerate(REPLIES)), "id int, reply string").select("id", B.accepted(F.col("reply")).alias("accepted"))


@query("SELECT * FROM (VALUES (1, 'b,a', ''), (2, 'd', 'zz'), (3, 'e', ''), (4, 'g', '')) AS t(query_id, truth, invented)")
def j7_j8_judge_merge(spark, d):
    c = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "d", 2), (3, "e", 1), (3, "f", 2), (4, "g", 1)], "query_id int, id string, rank int")
    r = spark.createDataFrame([(1, '{"relevant_chunk_ids": ["b", "a"], "reasoning": "x"}'), (2, '{"relevant_chunk_ids": ["zz", "d"]}'), (3, "failed")], "query_id int, reply string")
    return B.judged(c, r).select("query_id", F.array_join("truth", ",").alias("truth"), F.array_join("invented", ",").alias("invented"))


@query("SELECT * FROM (VALUES ('a1', 'x', 'comparison'), ('q_03', 'plain text', 'factual'), ('q_04', '{broken}', 'factual')) AS t(query_id, query, category)")
def s7_tolerant_scan(spark, d):
    lines = ['{"query_id": "a1", "query": "x", "category": "comparison"}', "  ", " plain text ", "{broken}"]
    return B.tolerant(spark.createDataFrame(list(enumerate(lines)), "n int, value string"))


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM labels WHERE quality = 1)
SELECT concat('sq_', CASE WHEN n < 10 THEN '0' ELSE '' END, n) AS query_id, doc_id, CASE WHEN n <= 20 THEN 'factual' WHEN n <= 40 THEN 'comparison' WHEN n <= 60 THEN 'lexical_gap' ELSE 'temporal_routing' END AS category FROM n WHERE n <= 80""")
def q3_w13_schedule(spark, d):
    return B.scheduled(table(spark, d, "labels").where("quality = 1").select("doc_id"), ["doc_id"], ["factual", "comparison", "lexical_gap", "temporal_routing"], 20)


FILINGS = [("AAPL", 0, ["8-K", "10-K", "10-K"], ["2023-01-01", "2022-09-24", "2021-09-25"], ["2023-01-02", "2022-10-28", "2021-10-29"], ["a0", "a1", "a2"], ["d0", "d1", "d2"]),
           ("AAPL", 1, ["10-K"], ["2019-09-28"], ["2019-10-31"], ["a3"], ["d3"]), ("NVDA", 0, ["10-K", "10-K"], ["2023-01-29", "2022-01-30"], ["2023-02-24", "2022-03-18"], ["n0", "n1"], ["e0", "e1"])]


@query("SELECT * FROM (VALUES ('AAPL', 2022, 'a1', 'd1', '2022-09-24'), ('AAPL', 2020, 'a2', 'd2', '2021-09-25'), ('AAPL', 2019, 'a3', 'd3', '2019-09-28'), ('NVDA', 2021, 'n1', 'e1', '2022-01-30')) AS t(ticker, year, accession, document, report_date)")
def p1_filing_pick(spark, d):
    i = spark.createDataFrame(FILINGS, "ticker string, page int, form array<string>, report_date array<string>, filing_date array<string>, accession array<string>, document array<string>")
    return G.pick_filing(i, spark.createDataFrame([("AAPL", 2022), ("AAPL", 2020), ("AAPL", 2019), ("NVDA", 2021), ("NVDA", 2018)], "ticker string, year int"))


FILING = "\n".join(["Item 1. Business", "toc"] + ["cover"] * 8 + ["Item 1. Business", "we sell", "item 1a - Risk Factors", "risky", "Item 7: Management’s Discussion and Analysis", "grew", "Item 7. Management's Discussion and Analysis",
                   "Item 8. Financial Statements", "see part IV", "Item 9. Changes", "none", "Item 15. Exhibits", "balance sheet"])


def _filing(spark):
    return spark.createDataFrame([(1, FILING)], "id int, text string")


@query("SELECT * FROM (VALUES ('Item 1', 10, 12), ('Item 1A', 12, 14), ('Item 7', 14, 17), ('Item 8', 17, 19)) AS t(section, start, stop)")
def t2_t3_section_ranges(spark, d):
    return G.section_ranges(_filing(spark)).drop("id")


_NL = " || chr(10) || "


@query(f"SELECT * FROM (VALUES ('Item 1', 'Item 1. Business'{_NL}'we sell'), ('Item 1A', 'item 1a - Risk Factors'{_NL}'risky'), ('Item 7', 'Item 7: Management’s Discussion and Analysis'{_NL}'grew'{_NL}'Item 7. Management''s Discussion and Analysis'), "
       f"('Item 8', 'Item 8. Financial Statements'{_NL}'see part IV'{_NL}''{_NL}'=== CONSOLIDATED FINANCIAL STATEMENTS (PART IV) ==='{_NL}''{_NL}'Item 15. Exhibits'{_NL}'balance sheet')) AS t(section, text)")
def t4_sections(spark, d):
    return G.sections(_filing(spark)).drop("id")


@query(f"SELECT * FROM (VALUES ('Item 1A', 'item 1a. Risk Factors'{_NL}'risky'), ('Item 7', 'ITEM 7. Management''s Discussion'{_NL}'grew'), ('Item 8', 'Item 8. Financial Statements'{_NL}'balance')) AS t(section, text)")
def t16_section_positions(spark, d):
    text = "cover\nitem 1a. Risk Factors\nrisky\n\nITEM 7. Management's Discussion\ngrew\n Item 8. Financial Statements\nbalance\n"
    return G.section_positions(spark.createDataFrame([(1, text)], "id int, text string")).select("section", "text")


@query("SELECT doc_id, concat(upper(lang), '_', 2020 + doc_id % 5, '_10K_', replace(s, ' ', ''), '_c', lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0')) AS chunk_id, CASE s WHEN 'Item 1A' THEN 256 ELSE 512 END AS size, CASE s WHEN 'Item 1A' THEN 32 ELSE 64 END AS overlap "
       "FROM (SELECT *, CASE doc_id % 2 WHEN 0 THEN 'Item 1A' ELSE 'Item 7' END AS s FROM documents)")
def t9_chunk_ids(spark, d):
    s = F.when(F.col("doc_id") % 2 == 0, "Item 1A").otherwise("Item 7")
    return _docs(spark, d).select("doc_id", G.chunk_id(F.upper("lang"), 2020 + F.col("doc_id") % 5, s, F.col("doc_id") % 1000).alias("chunk_id"), G.chunk_size(s).alias("p")).select("doc_id", "chunk_id", "p.size", "p.overlap")


@query("SELECT a.conv_id, a.turn, coalesce(list_max(list_filter(range(0, greatest(length(b.text), 1)), lambda i: starts_with(b.text, right(a.text, i)))), 0) AS n FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def t15_overlap(spark, d):
    t = table(spark, d, "conversations")
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return t.select("conv_id", "turn", "text").join(b, ["conv_id", "turn"]).select("conv_id", "turn", C.overlap_length(F.col("text"), F.col("next")).cast("long").alias("n"))
