"""Filing lookup, section detection and chunk ids."""
from pyspark.sql import DataFrame, Window, functions as F

# Headings of the sections and of the part that completes a short Item 8.
SECTIONS = {
    "Item 1": r"(?i)^\s*Item\s*1[.\s:-]+Business",
    "Item 1A": r"(?i)^\s*Item\s*1A[.\s:-]+Risk\s*Factors",
    "Item 7": r"(?i)^\s*Item\s*7[.\s:-]+Management[\u2019's]*\s*Discussion\s*and\s*Analysis",
    "Item 8": r"(?i)^\s*Item\s*8[.\s:-]+Financial\s*Statements",
    "Item 9": r"(?i)^\s*Item\s*9[.\s:-]+Changes",
}
EXHIBITS = r"(?i)^\s*Item\s*15[.\s:-]+Exhibit"
BANNER = "\n\n=== CONSOLIDATED FINANCIAL STATEMENTS (PART IV) ===\n\n"
SHORT, SKIPPED = 2000, 0.10
POSITIONS = {
    "Item 1A": r"(?i)item\s*1a[.\s]*risk\s*factors",
    "Item 7": r"(?i)item\s*7[.\s]*management's\s*discussion",
    "Item 8": r"(?i)item\s*8[.\s]*financial\s*statements",
}


def pick_filing(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """ticker, year, accession, document, report_date: of the filing index (ticker, page, form,
    report_date, filing_date, accession, document; parallel arrays) the first annual report
    whose report year is asked for, else the first filed in that year or the next; pages in
    order, within a page the report year first."""
    rows = index.select("ticker", "page", F.posexplode(F.arrays_zip("form", "report_date", "filing_date", "accession", "document")).alias("pos", "f")).select("ticker", "page", "pos", "f.*").where("form = '10-K'")
    year = lambda c: F.split(c, "-")[0].cast("int")
    j = rows.join(F.broadcast(wanted), "ticker")  # one row per asked filing
    j = j.withColumn("prio", F.when(year(F.col("report_date")) == F.col("year"), 0).when(year(F.col("filing_date")).between(F.col("year"), F.col("year") + 1), 1)).where("prio is not null")
    first = Window.partitionBy("ticker", "year").orderBy("page", "prio", "pos")
    return j.withColumn("n", F.row_number().over(first)).where("n = 1").select("ticker", "year", "accession", "document", "report_date")


def section_ranges(texts: DataFrame) -> DataFrame:
    """id, section, start, stop of lines: the first heading of each section after the first
    tenth of the lines, up to the next heading found or the end."""
    lines = texts.select("id", F.split("text", "\n", -1).alias("ls")).select("id", F.size("ls").alias("n"), F.posexplode("ls").alias("i", "line")).where(F.col("i") >= F.floor(F.col("n") * SKIPPED))
    hit = F.array(*[F.when(F.col("line").rlike(p), F.lit(s)) for s, p in SECTIONS.items()])
    heads = lines.select("id", "n", "i", F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("section")).groupBy("id", "n", "section").agg(F.min("i").alias("start"))
    # at most one row per section name
    stop = F.coalesce(F.lead("start").over(Window.partitionBy("id").orderBy("start", "section")), F.col("n"))
    return heads.select("id", "section", "start", stop.alias("stop")).where("section <> 'Item 9'")


def sections(texts: DataFrame) -> DataFrame:
    """id, section, text; a short Item 8 goes on with all from the exhibits' heading."""
    ls = F.split("text", "\n", -1)
    part = texts.select("id", ls.alias("ls")).join(section_ranges(texts), "id")
    body = F.array_join(F.slice("ls", F.col("start") + 1, F.col("stop") - F.col("start")), "\n")
    late = F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(EXHIBITS) & (i >= F.floor(F.size("ls") * SKIPPED)), i)), lambda x: x.isNotNull())
    part = part.select("id", "section", body.alias("body"), "ls", F.try_element_at(late, F.lit(1)).alias("late"))
    rest = F.array_join(F.slice("ls", F.col("late") + 1, F.size("ls")), "\n")
    short = (F.col("section") == "Item 8") & (F.length("body") < SHORT) & (F.col("late") > 0)
    return part.select("id", "section", F.when(short, F.concat("body", F.lit(BANNER), rest)).otherwise(F.col("body")).alias("text"))


def section_positions(texts: DataFrame) -> DataFrame:
    """id, section, start, text by the first match of each heading anywhere in the text."""
    at = F.array(*[F.struct(F.regexp_instr("text", F.lit(p)).alias("start"), F.lit(s).alias("section")) for s, p in POSITIONS.items()])
    t = texts.select("id", "text", F.array_sort(F.filter(at, lambda x: x["start"] > 0)).alias("at")).select("id", "text", F.col("at"), F.posexplode("at").alias("k", "h"))
    stop = F.coalesce(F.try_element_at("at", F.col("k") + 2)["start"], F.length("text") + 1)
    return t.select("id", "h.section", "h.start", F.regexp_replace(F.substring("text", F.col("h.start"), stop - F.col("h.start")), r"^\s+|\s+$", "").alias("text"))


def chunk_size(section):
    """Token budget and overlap of a section."""
    return F.when(section == "Item 1A", F.struct(F.lit(256).alias("size"), F.lit(32).alias("overlap"))).otherwise(F.struct(F.lit(512).alias("size"), F.lit(64).alias("overlap")))


def chunk_id(ticker, year, section, index):
    return F.format_string("%s_%d_10K_%s_c%03d", ticker, year, F.replace(section, F.lit(" "), F.lit("")), index)
