"""Construction of a question set: selection, near repeats (`pairs`), validation, judged truth."""
from pyspark.sql import DataFrame, Window, functions as F

from quarry.operators.pairs import similar_pairs as similar_pairs

# Keywords of the selection score and names by ticker.
KEYWORDS = ("revenue", "sales", "net income", "operating income", "operating expense", "capital expenditures", "capex", "research and development", "r&d",
            "cash and cash equivalents", "total assets", "operating activities")
NAMES = {"AAPL": ["apple"], "MSFT": ["microsoft"], "TSLA": ["tesla"], "NVDA": ["nvidia"], "AMZN": ["amazon"], "GOOGL": ["google", "alphabet"]}


def keyword_count(text, keywords=KEYWORDS):
    """Occurrences of the keywords that do not overlap with themselves."""
    low = F.lower(text)
    return sum((((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("long") for k in keywords), F.lit(0).cast("long"))


def scored_sources(docs: DataFrame, keywords=KEYWORDS, least: int = 200, digits: int = 20, share: float = 0.02) -> DataFrame:
    """docs that are long, numeric and to the point enough, with digits, keywords and score."""
    n = F.regexp_count("text", F.lit("[0-9]"))
    d = docs.withColumns({"digits": n.cast("long"), "keywords": keyword_count(F.col("text"), keywords)})
    d = d.where((F.length("text") >= least) & (F.col("digits") >= digits) & (F.col("digits") / F.length("text") >= share) & (F.col("keywords") > 0))
    return d.withColumn("score", F.round(F.col("keywords") + 10 * F.col("digits") / F.length("text"), 6))


def valid_question(query, ticker, year, category):
    """Five words or more, the company named, and the year if the category is about time."""
    names = F.create_map(*[x for t, ns in NAMES.items() for x in (F.lit(t), F.array(*map(F.lit, ns)))])
    known = F.concat(F.array(F.lower(ticker)), F.coalesce(F.try_element_at(names, ticker), F.array().cast("array<string>")))
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    dated = (category != "temporal_routing") | F.contains(query, year.cast("string"))
    return F.coalesce((words >= 5) & F.exists(known, lambda n: (n != "") & F.contains(F.lower(query), n)) & dated, F.lit(False))


def accepted(reply):
    """Whether a critic's JSON reply gives an answerability of 4 or more and no hallucination;
    what is missing rejects."""
    r = F.from_json(reply, "answerability double, hallucination boolean")
    return (F.coalesce(r["answerability"], F.lit(1.0)) >= 4) & ~F.coalesce(r["hallucination"], F.lit(True))


def scheduled(rows: DataFrame, order: list, categories: list[str], target: int) -> DataFrame:
    """query_id and category of accepted rows in order: categories fill one after the other."""
    n = F.row_number().over(Window.orderBy(*order))
    out = rows.withColumn("n", n).where(F.col("n") <= target * len(categories))  # bounded by the targets
    return out.withColumns({"query_id": F.format_string("sq_%02d", "n"), "category": F.element_at(F.array(*map(F.lit, categories)), (F.floor((F.col("n") - 1) / target) + 1).cast("int"))}).drop("n")


def judged(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """query_id, truth (ids the judge named that are candidates, in its order, or else the first
    candidate), invented (ids it named that are none)."""
    reply = F.from_json("reply", "relevant_chunk_ids array<string>, reasoning string")["relevant_chunk_ids"]
    c = candidates.groupBy("query_id").agg(F.collect_set("id").alias("ids"), F.min_by("id", "rank").alias("first"))  # a few candidates each
    j = c.join(replies.select("query_id", F.coalesce(reply, F.array().cast("array<string>")).alias("named")), "query_id", "left")
    named = F.coalesce("named", F.array().cast("array<string>"))
    good = F.filter(named, lambda x: F.array_contains("ids", x))
    return j.select("query_id", F.when(F.size(good) > 0, good).otherwise(F.array("first")).alias("truth"), F.array_except(named, F.col("ids")).alias("invented"))


def tolerant(lines: DataFrame) -> DataFrame:
    """query_id, query, category of numbered lines (n from 0, value): JSON objects, or plain text
    under the number of its line; blank lines are skipped."""
    v = F.regexp_replace("value", r"^\s+|\s+$", "")
    obj = F.from_json(v, "query_id string, query string, category string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    d = lines.select("n", v.alias("v"), F.when(F.startswith(v, F.lit("{")) & F.endswith(v, F.lit("}")), obj).alias("o")).where("v <> ''")
    ok = F.col("o").isNotNull() & F.col("o._bad").isNull()
    return d.select(F.when(ok, F.col("o.query_id")).otherwise(F.format_string("q_%02d", F.col("n") + 1)).alias("query_id"), F.when(ok, F.col("o.query")).otherwise(F.col("v")).alias("query"),
                    F.when(ok, F.col("o.category")).otherwise("factual").alias("category"))
