"""Scalar text functions as column expressions."""
from pyspark.sql import functions as F

# Query expansion rules, company keywords, routed years, notebook synonyms.
EXPANSIONS = (
    (r"\b(capital expenditures|capex)\b", "purchases of property and equipment acquisition of property plant and equipment capital spending"),
    (r"\bnet income\b", "net earnings net loss"),
    (r"\brevenue\b", "net sales operating revenue revenues"),
)
COMPANIES = {
    "AAPL": ["apple", "aapl"],
    "MSFT": ["microsoft", "msft"],
    "AMZN": ["amazon", "amzn"],
    "NVDA": ["nvidia", "nvda"],
    "TSLA": ["tesla", "tsla"],
    "GOOGL": ["google", "googl", "goog", "alphabet"],
}
YEARS = r"\b(2022|2023|2024)\b"
SYNONYMS = {
    "capital expenditures": ["purchases of property and equipment", "capex"],
    "net sales": ["revenue", "sales"],
    "net income": ["profit", "net earnings"],
}


def terms(c):
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def notebook_terms(c):
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s$]", ""), r"\s+"), lambda t: t != "")


def token_count(c):
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


def expand(c):
    """The query and the texts of all rules that match it."""
    return F.concat_ws(" ", c, *[F.when(F.lower(c).rlike(p), t) for p, t in EXPANSIONS])


def expand_first(c):
    """The query and the synonyms of the first phrase in it."""
    found = F.coalesce(*[F.when(F.contains(F.lower(c), F.lit(k)), F.lit(" ".join(v))) for k, v in SYNONYMS.items()])
    return F.concat_ws(" ", c, found)


def route_companies(c):
    """Tickers in fixed order whose keywords are substrings of the query."""
    found = F.array(*[F.when(F.exists(F.array(*map(F.lit, ks)), lambda k: F.contains(F.lower(c), k)), F.lit(t)) for t, ks in COMPANIES.items()])
    return F.filter(found, lambda x: x.isNotNull())


def route_years(c):
    return F.transform(F.regexp_extract_all(c, F.lit(YEARS), F.lit(1)), lambda y: y.cast("int"))


def first_year(c):
    """The first year 20xx of the query, or null."""
    return F.nullif(F.regexp_extract(c, r"\b(20[0-9]{2})\b", 1), F.lit("")).cast("int")


def routed(detected, requested):
    """Detected values, or else the requested ones."""
    return F.when(F.size(detected) > 0, detected).otherwise(requested)


def clean_html(c):
    """Lines of the text without scripts, styles and comments; a line ends at the end of a block."""
    x = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</(script|style|noscript)>", "")
    x = F.regexp_replace(x, r"(?i)</(p|div|tr|li|h[1-6])>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    lines = F.transform(F.split(x, "\n", -1), lambda l: F.trim(F.regexp_replace(l, r"[\s\x{00A0}]+", " ")))
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")
