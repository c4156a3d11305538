"""Deterministic inputs for the queries, made of the driver's tables the same way in Spark and in SQL.

The tables alone hold few of the lines and works that the rules are about, so some lines are replaced
by examples, and orders with their line items stand for works with their locations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.sql import text as quoted

EVERY = 71
EXAMPLES = (
    "Abstract", "", "References", "[8], [9], [15]", "13Nikhef, 14LIGO Institute of Physics", "https://example.org/paper", "DOI: 10.1234/abcd.5",
    "Page 3", "- 12 -", "G G G ••", "--------", "Licensed under a Creative Commons licence", "Downloaded from the research portal",
    "*Correspondence: Jane Roe, jane.roe@example.org", "Department of Physics, University of Somewhere", "66 Some Institute in Chile",
    "2.1 Data and methods", "startxref 1234", "(1,2);3.4",
    "Ann Smith; Bob Jones; Carl White; Dora Black; Eve Green; Finn Brown of the University Hospital School", "Introduction",
    "the treat- ment of patients went on", "Received: 1 May 2020 by the editor, contact a.b@example.com and more", "Materials", "and methods",
    "Contact: someone@example.org for details", "Nature | Vol 579 | 265", "Summary", "5G and 6G networks",
    "This work was done by Ann Smith and Carl White.", "page 3 of 10", "1Nikhef, Science Park", "Corresponding author: the first one, whose address stands in the footer of this page, where all of the others are named too, at length", "[1-3]; [7]", "ERROR: the download failed",
)
PAGE_LINES = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decorated(doc_id: Column, ord_: Column, raw: Column) -> Column:
    k = (doc_id * 31 + ord_) % EVERY
    return F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in EXAMPLES]), k.cast("int") + 1), raw)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, line: a row for each line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "raw"))
    return docs.select("doc_id", F.col("ord").cast("bigint").alias("ord"), decorated(F.col("doc_id"), F.col("ord"), F.col("raw")).alias("line"))


def line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines: the same in one row for each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n", -1), lambda x, i: decorated(F.col("doc_id"), i, x)).alias("lines"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pages: PAGE_LINES lines each under a running header."""
    rows = line_arrays(spark, sf_dir)
    last = F.floor((F.size("lines") - 1) / PAGE_LINES).cast("int")
    page = lambda p: F.concat(F.array(F.concat(F.lit("Nature | Vol 579 | "), p.cast("string"))), F.slice("lines", p * PAGE_LINES + 1, F.lit(PAGE_LINES)))
    return rows.select("doc_id", F.transform(F.sequence(F.lit(0), last), page).alias("pages"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the decorated lines joined."""
    return line_arrays(spark, sf_dir).select("doc_id", F.array_join("lines", "\n").alias("text"))


CASES = " ".join(f"WHEN {i} THEN {quoted(x)}" for i, x in enumerate(EXAMPLES))
LINES_SQL = f"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents),
lines AS (SELECT doc_id, ord, CASE (doc_id * 31 + ord) % {EVERY} {CASES} ELSE raw END AS line FROM raw)"""
TEXTS_SQL = f"{LINES_SQL}, texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ord) AS text FROM lines GROUP BY doc_id)"
PAGES_SQL = f"""{LINES_SQL},
paged AS (SELECT doc_id, ord // {PAGE_LINES} AS page_no, ord % {PAGE_LINES} + 1 AS pos, line FROM lines
  UNION ALL SELECT DISTINCT doc_id, ord // {PAGE_LINES}, 0, 'Nature | Vol 579 | ' || (ord // {PAGE_LINES})::VARCHAR FROM lines)"""

HOSTS = (
    "https://arxiv.org/pdf/", "https://onlinelibrary.wiley.com/doi/", "https://journals.plos.org/article/", "https://example.net/file/", "https://repository.uni.edu/x/",
    "https://link.springer.com/content/", "https://www.mdpi.com/", "ftp://old.example.org/", "https://zenodo.org/record/", "https://academic.oup.com/pdf/",
)
LICENSE_NAMES = ("CC-BY", " cc-by-sa ", "other", "CC0", "", "public-domain", "mit")


def _pick(values, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int") + 1)


def _pick_sql(values, k: str) -> str:
    return f"([{', '.join(map(quoted, values))}])[({k}) % {len(values)} + 1]"


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_key, loc_ord and the fields of a location: a line item each."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey") + F.col("l_linenumber")
    url = F.concat(_pick(HOSTS, k), F.col("l_partkey").cast("string"))
    return li.select(
        F.col("l_orderkey").alias("work_key"), (((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 64 + F.col("l_quantity").cast("bigint")).alias("loc_ord"), F.when(F.col("l_suppkey") % 3 != 0, url).alias("pdf_url"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(_pick(HOSTS, k + 3), F.lit("landing"))).alias("landing_page_url"), (F.col("l_returnflag") != "R").alias("is_oa"),
        F.when(F.col("l_partkey") % 5 != 0, _pick(LICENSE_NAMES, k + 1)).alias("license"), F.col("l_linestatus").alias("version"), F.when(F.col("l_partkey") % 4 == 0, "repository").otherwise("journal").alias("source_type"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as works: the columns of WORK_SCHEMA and work_key."""
    loc = F.struct("loc_ord", F.struct("pdf_url", "landing_page_url", "is_oa", "license", "version", F.struct(F.lit("a source").alias("display_name"), F.col("source_type").alias("type")).alias("source")).alias("l"))
    by = locations(spark, sf_dir).groupBy("work_key").agg(F.transform(F.array_sort(F.collect_list(loc)), lambda x: x["l"]).alias("locations"))
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        key.alias("work_key"), F.when(key % 3 == 0, F.concat(F.lit("https://works.example/W"), key.cast("string"), F.lit("/"))).when(key % 3 == 1, F.lit("")).alias("id"),
        F.when(key % 2 == 0, F.concat(F.lit("10.1/"), key.cast("string"))).alias("doi"), F.concat(F.lit("Title "), key.cast("string")).alias("title"), F.lit("article").alias("type"), F.lit("en").alias("language"),
        F.when(key % 11 != 0, F.year("o_orderdate") + 20).alias("publication_year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
        F.when(key % 13 != 0, F.floor(F.col("o_totalprice") / 10000)).cast("int").alias("cited_by_count"), (key % 17 == 0).alias("is_retracted"), F.struct((F.col("o_orderstatus") != "P").alias("is_oa")).alias("open_access"),
        F.array(F.struct(F.struct(F.concat(F.lit("Author "), F.col("o_custkey").cast("string")).alias("display_name"), F.lit("A1").alias("id")).alias("author"))).alias("authorships"),
        F.struct(F.struct(F.lit("a journal").alias("display_name"), F.lit("a publisher").alias("host_organization_name")).alias("source")).alias("primary_location"),
    )
    return o.join(by, "work_key", "left").withColumn("locations", F.coalesce("locations", F.array().cast(by.schema["locations"].dataType)))


WORKS_SQL = f"""loc AS (SELECT l_orderkey AS work_key, ((l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey) * 64 + l_quantity::BIGINT AS loc_ord, CASE WHEN l_suppkey % 3 <> 0 THEN {_pick_sql(HOSTS, 'l_partkey + l_linenumber')} || l_partkey::VARCHAR END AS pdf_url,
  CASE WHEN l_suppkey % 2 = 0 THEN {_pick_sql(HOSTS, 'l_partkey + l_linenumber + 3')} || 'landing' END AS landing_page_url, l_returnflag <> 'R' AS is_oa,
  CASE WHEN l_partkey % 5 <> 0 THEN {_pick_sql(LICENSE_NAMES, 'l_partkey + l_linenumber + 1')} END AS license, CASE WHEN l_partkey % 4 = 0 THEN 'repository' ELSE 'journal' END AS source_type FROM lineitem),
work AS (SELECT o_orderkey AS work_key, CASE WHEN o_orderkey % 3 = 0 THEN 'https://works.example/W' || o_orderkey::VARCHAR || '/' WHEN o_orderkey % 3 = 1 THEN '' END AS id,
  CASE WHEN o_orderkey % 2 = 0 THEN '10.1/' || o_orderkey::VARCHAR END AS doi, 'Title ' || o_orderkey::VARCHAR AS title, CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate) + 20 END AS publication_year,
  CASE WHEN o_orderkey % 13 <> 0 THEN floor(o_totalprice / 10000)::INT END AS cited_by_count, o_orderkey % 17 = 0 AS is_retracted, o_orderstatus <> 'P' AS is_oa, o_custkey,
  strftime(o_orderdate, '%Y-%m-%d') AS publication_date FROM orders)"""
