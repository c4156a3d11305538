"""Queries about works, what is fetched of them, and edits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import AcquireConfig
from corpusloom.functions import constants as C
from corpusloom.operators import acquire as A
from corpusloom.operators import edit as E
from corpusloom.operators import metadata as M
from corpusloom.operators.progress import numbered
from corpusloom.operators.run import select_works
from corpusloom.plans import carriers as K
from corpusloom.plans import sql as S
from corpusloom.sources.files import stem
from corpusloom.sources.manifest import compact, not_in_manifest
from corpusloom.sources.shared import scratch
from corpusloom.sources.state import append_log, latest, remaining_today, valid_ids

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CONFIG = AcquireConfig()


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_ID = "coalesce(list_extract(string_split(rtrim(nullif(id, ''), '/'), '/'), -1), substr(sha1(nullif(doi, '')), 1, 16), substr(sha1(coalesce(title, '')), 1, 16))"
_URL = "CASE WHEN regexp_matches(trim({0}), '^https?://') THEN trim({0}) END"


def _score_sql() -> str:
    pdf, page = "lower(coalesce(pdf, ''))", "lower(coalesce(page, ''))"
    parts = [f"CASE WHEN contains({pdf}, '{h}') THEN 100 WHEN contains({page}, '{h}') THEN 80 ELSE 0 END" for h in C.REPOSITORIES]
    parts += [f"CASE WHEN contains({pdf}, '{h}') THEN 50 ELSE 0 END" for h in C.OPEN_PUBLISHERS]
    parts += [f"CASE WHEN contains({pdf}, '{h}') THEN -50 ELSE 0 END" for h in C.CLOSED_PUBLISHERS]
    parts += ["CASE WHEN source_type = 'repository' THEN 80 ELSE 0 END", "CASE WHEN is_oa THEN 20 ELSE 0 END", f"CASE WHEN {pdf} <> '' THEN 30 ELSE 0 END"]
    return "(" + " + ".join(parts) + ")"


_LICENSE = f"""lic AS (SELECT work_key, list(name ORDER BY loc_ord) AS ns FROM (SELECT work_key, loc_ord, lower(trim(license)) AS name FROM loc) WHERE name <> '' GROUP BY work_key),
chosen AS (SELECT work_key, CASE {' '.join(f"WHEN list_contains(ns, '{n}') THEN '{n}'" for n in C.LICENSES)} ELSE ns[1] END AS license FROM lic)"""
_PLACES = f"""place AS (SELECT work_key, loc_ord, {_URL.format('pdf_url')} AS pdf, {_URL.format('landing_page_url')} AS page, source_type, is_oa FROM loc),
scored AS (SELECT *, {_score_sql()}::BIGINT AS score FROM place WHERE pdf IS NOT NULL OR page IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY work_key ORDER BY score DESC, loc_ord) - 1 AS place FROM scored)"""
_ELIGIBLE = f"""{_LICENSE}, {_PLACES},
eligible AS (SELECT w.*, c.license FROM work w JOIN chosen c USING (work_key) WHERE NOT is_retracted AND is_oa AND (coalesce(publication_year, 0) = 0 OR publication_year >= {CONFIG.min_year})
  AND coalesce(cited_by_count, 0) >= {CONFIG.min_citations} AND c.license IN {S.names(C.LICENSES)} AND work_key IN (SELECT work_key FROM scored))"""


@query("work_ids", f"WITH {K.WORKS_SQL} SELECT work_key, {_ID} AS id FROM work")
def work_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.works(spark, sf_dir).select("work_key", M.work_id(F.col("id"), F.col("doi"), F.col("title")).alias("id"))


@query("license_pick", f"WITH {K.WORKS_SQL}, {_LICENSE} SELECT work_key, license FROM work LEFT JOIN chosen USING (work_key)")
def license_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.works(spark, sf_dir).select("work_key", M.license_of(F.col("locations")).alias("license"))


@query("location_rank", f"WITH {K.WORKS_SQL}, {_PLACES} SELECT work_key, place::BIGINT AS place, pdf AS pdf_url, page AS landing_page_url, score FROM ranked")
def location_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = M.ranked_places(K.works(spark, sf_dir), "work_key")
    return ranked.select("work_key", F.col("place").cast("bigint").alias("place"), "pdf_url", "landing_page_url", F.col("score").cast("bigint").alias("score"))


@query("candidate_filter", f"WITH {K.WORKS_SQL}, {_ELIGIBLE} SELECT work_key, publication_year, cited_by_count, license FROM eligible")
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.works(spark, sf_dir).where(M.is_eligible()).select("work_key", "publication_year", "cited_by_count", M.license_of(F.col("locations")).alias("license"))


@query("metadata_record", f"""WITH {K.WORKS_SQL}, {_ELIGIBLE},
a_place AS (SELECT work_key, string_agg(coalesce(pdf, '-') || ' ' || coalesce(page, '-') || ' a source ' || r.source_type || ' ' || CASE WHEN coalesce(r.is_oa, false) THEN 'open' ELSE 'closed' END || ' ' || coalesce(l.license, '-') || ' ' || l.version, '; ' ORDER BY place) AS places
  FROM ranked r JOIN (SELECT work_key, loc_ord, license, version FROM (SELECT loc.*, l_linestatus AS version FROM loc JOIN lineitem ON work_key = l_orderkey AND loc_ord = ((l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey) * 64 + l_quantity::BIGINT)) l USING (work_key, loc_ord) GROUP BY work_key)
SELECT {_ID} AS id, id AS openalex_id, title, 'Author ' || o_custkey::VARCHAR || ' A1' AS authors, publication_year AS year, publication_date, doi, 'article' AS type, 'en' AS language,
  coalesce(cited_by_count, 0) AS citations, 'a journal' AS journal, 'a publisher' AS publisher, true AS open_access, license, places, 0::BIGINT AS attempted, NULL::VARCHAR AS successful_url, NULL::VARCHAR AS download_source, false AS downloaded, NULL::VARCHAR AS error FROM eligible JOIN a_place USING (work_key)""")
def metadata_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the eligible works, nested fields written out."""
    rows = M.metadata_record(K.works(spark, sf_dir).where(M.is_eligible()))
    word = lambda x: F.coalesce(x, F.lit("-"))
    place = lambda x: F.concat_ws(" ", word(x["pdf_url"]), word(x["landing_page_url"]), x["source"], x["source_type"], F.when(x["is_oa"], "open").otherwise("closed"), word(x["license"]), x["version"])
    return rows.withColumns({
        "authors": F.array_join(F.transform("authors", lambda a: F.concat_ws(" ", a["name"], a["openalex_id"])), "; "),
        "places": F.array_join(F.transform("oa_locations", place), "; "),
        "attempted": F.size("attempted_urls").cast("bigint"),
    }).drop("oa_locations", "attempted_urls")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as search hits: parts' suppliers are terms, orders are works; a work's version is its hit's quantity."""
    li = K.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").cast("bigint").alias("term_ord"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 64 + F.col("l_quantity").cast("bigint")).alias("hit_ord"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("work"), F.col("l_extendedprice").alias("price"))


_HITS = "hits AS (SELECT l_suppkey AS term_ord, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 64 + l_quantity::BIGINT AS hit_ord, l_orderkey AS id, l_quantity AS work, l_extendedprice AS price FROM lineitem)"
_DEDUP = "dedup AS (SELECT id, arg_max(work, (term_ord, hit_ord)) AS work, min((term_ord, hit_ord)) AS first_at FROM hits GROUP BY id)"


@query("term_cap", f"WITH {_HITS} SELECT term_ord, hit_ord, id FROM (SELECT *, row_number() OVER (PARTITION BY term_ord ORDER BY hit_ord) AS n FROM hits) WHERE n <= {CONFIG.max_per_term}")
def term_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cap_per_term(_hits(spark, sf_dir), CONFIG.max_per_term).select("term_ord", "hit_ord", "id")


@query("work_dedup", f"WITH {_HITS}, {_DEDUP} SELECT id, work, first_at[1]::BIGINT AS first_term, first_at[2]::BIGINT AS first_hit FROM dedup")
def work_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dedup_works(_hits(spark, sf_dir)).select("id", "work", F.col("first_at.term_ord").alias("first_term"), F.col("first_at.hit_ord").alias("first_hit"))


@query("manifest_anti", f"WITH {_HITS}, {_DEDUP} SELECT id, work FROM dedup WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def manifest_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = K.table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("id"))
    return A.not_held(A.dedup_works(_hits(spark, sf_dir)), held).select("id", "work")


@query("manifest_indexed", f"WITH {_HITS}, {_DEDUP} SELECT id, work FROM dedup WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def manifest_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index: of two runs that have logged orders one is compacted."""
    folder = scratch(spark, "manifest")
    log, index = f"{folder}/log", f"{folder}/index"
    held = K.table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 4 == 0).alias("late"))
    append_log(held.where("not late"), log, "run1")
    compact(spark, log, index)
    append_log(held.where("late"), log, "run2")
    candidates = A.dedup_works(_hits(spark, sf_dir)).select(F.col("id").cast("string").alias("id"), "work")
    return not_in_manifest(candidates, log, index).select(F.col("id").cast("bigint").alias("id"), "work")


@query("existing_pdf_anti", f"WITH {_HITS}, {_DEDUP} SELECT id, work FROM dedup WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE (o_totalprice / 10)::BIGINT >= {A.MIN_PDF_BYTES} AND o_orderkey % 2 = 0)")
def existing_pdf_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without a valid PDF: an order's file is as long as its price says and begins well if its key is even."""
    head = F.when(F.col("o_orderkey") % 2 == 0, F.lit("%PDF-1.7")).otherwise(F.lit("<html>")).cast("binary")
    files = K.table(spark, sf_dir, "orders").where(A.is_pdf(F.round(F.col("o_totalprice") / 10).cast("bigint"), head)).select(F.col("o_orderkey").alias("id"))
    return A.not_held(A.dedup_works(_hits(spark, sf_dir)), files).select("id", "work")


@query("topk_candidates", f"WITH {_HITS}, {_DEDUP} SELECT id, work AS citations FROM dedup ORDER BY work DESC, first_at LIMIT {CONFIG.max_per_day}")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.dedup_works(_hits(spark, sf_dir)).withColumnRenamed("work", "citations")
    return A.most_cited(rows, CONFIG.max_per_day).select("id", "citations")


@query("hits_union", f"""WITH {_HITS}, older AS (SELECT 1000000000 + o_custkey AS term_ord, o_orderkey AS hit_ord, o_orderkey AS id, NULL AS work, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'),
u AS (SELECT * FROM hits UNION ALL SELECT * FROM older) SELECT term_ord, count(*) AS hits, count(DISTINCT id) AS works, count(work) AS known FROM u GROUP BY term_ord""")
def hits_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all searches in one: those of the line items, and of an older search without works' versions."""
    old = K.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    older = old.select((F.lit(1000000000) + F.col("o_custkey")).cast("bigint").alias("term_ord"), F.col("o_orderkey").cast("bigint").alias("hit_ord"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    found = A.union_hits(_hits(spark, sf_dir), older)
    return found.groupBy("term_ord").agg(F.count("*").alias("hits"), F.countDistinct("id").alias("works"), F.count("work").alias("known"))


@query("term_union", """WITH d AS (SELECT p_partkey AS term_ord, p_type AS term FROM part WHERE p_partkey % 2 = 0), c AS (SELECT p_partkey AS term_ord, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE p_brand END AS term FROM part WHERE p_partkey % 2 = 1),
n AS (SELECT term_ord, term FROM (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY term_ord, term) AS k FROM c) WHERE k = 1 AND lower(term) NOT IN (SELECT lower(term) FROM d))
SELECT false AS custom, term_ord, term FROM d UNION ALL SELECT true, term_ord, term FROM n""")
def term_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = K.table(spark, sf_dir, "part").withColumn("term_ord", F.col("p_partkey"))
    custom = part.where("p_partkey % 2 = 1").select("term_ord", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).otherwise(F.col("p_brand")).alias("term"))
    return A.add_terms(part.where("p_partkey % 2 = 0").select("term_ord", F.col("p_type").alias("term")), custom)


@query("stem_join", "SELECT doc_id, label.quality FROM documents JOIN labels label USING (doc_id)")
def stem_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and texts by their stem: documents are texts, labels' rows are PDF files."""
    texts = K.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/cleaned/"), "doc_id", F.lit(".txt")).alias("path")).select("doc_id", stem().alias("stem"))
    pdfs = K.table(spark, sf_dir, "labels").select("quality", F.concat(F.lit("/papers/v1.2/"), "doc_id", F.lit(".pdf")).alias("path")).select("quality", stem().alias("stem"))
    return texts.join(pdfs, "stem").select("doc_id", "quality")


@query("manifest_ids", "SELECT DISTINCT o_custkey::VARCHAR AS id FROM orders WHERE o_orderkey % 7 > 2")
def manifest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a log some of whose lines are cut off, lack the id, or have an empty one."""
    k = F.col("o_orderkey") % 7
    good = F.concat(F.lit('{"id": "'), F.col("o_custkey").cast("string"), F.lit('", "year": 2020}'))
    line = F.when(k == 0, F.lit('{"id": "12')).when(k == 1, F.lit('{"year": 2020}')).when(k == 2, F.lit('{"id": ""}')).otherwise(good)
    return valid_ids(K.table(spark, sf_dir, "orders").select(line.alias("value")))


_FETCH = "f AS (SELECT user_id AS id, event_id % 3 AS loc_ord, event_id % 4 + 1 AS attempt, max(CASE WHEN event_id % 9 = 0 THEN NULL ELSE ([200, 404, 500, 503, 200])[event_id % 5 + 1] END) AS status, bool_or(event_id % 2 = 0) AS is_pdf FROM events GROUP BY ALL)"
_RESULT = "r AS (SELECT *, CASE WHEN status IS NULL THEN 'connection' WHEN status = 200 AND is_pdf THEN 'success' WHEN status = 200 THEN 'not_a_pdf' WHEN status >= 500 THEN 'retry' ELSE 'http_error' END AS result FROM f WHERE attempt <= 2)"
_OUTCOME = "o AS (SELECT id, loc_ord, coalesce(arg_min(result, attempt) FILTER (result NOT IN ('retry', 'connection')), arg_max(result, attempt)) AS result, coalesce(min(attempt) FILTER (result NOT IN ('retry', 'connection')), max(attempt)) AS tries FROM r GROUP BY ALL)"


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = K.table(spark, sf_dir, "events"), F.col("event_id")
    status = F.when(k % 9 != 0, F.element_at(F.array(*[F.lit(x) for x in (200, 404, 500, 503, 200)]), (k % 5).cast("int") + 1))
    return e.groupBy(F.col("user_id").alias("id"), (k % 3).alias("loc_ord"), (k % 4 + 1).alias("attempt")).agg(F.max(status).alias("status"), F.bool_or(k % 2 == 0).alias("is_pdf"))


@query("download_outcomes", f"WITH {_FETCH}, {_RESULT}, {_OUTCOME} SELECT * FROM o")
def download_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.attempt_outcome(_attempts(spark, sf_dir), CONFIG.max_retries)


@query("first_success", f"WITH {_FETCH}, {_RESULT}, {_OUTCOME} SELECT id, min(loc_ord) FILTER (result = 'success') AS won, coalesce(min(loc_ord) FILTER (result = 'success') + 1, max(loc_ord) + 1) AS tried FROM o GROUP BY id")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_success(A.attempt_outcome(_attempts(spark, sf_dir), CONFIG.max_retries))


@query("http_class", f"WITH {_FETCH} SELECT status, CASE WHEN status >= 500 THEN 'retry' ELSE 'permanent' END AS class, count(*) AS n FROM f GROUP BY ALL")
def http_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).groupBy("status", A.http_class(F.col("status")).alias("class")).agg(F.count("*").alias("n"))


def _downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = K.table(spark, sf_dir, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("value") > 20).alias("success"), (F.col("event_id") % 3 != 0).alias("new_download"))


_DOWNLOADS = "d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, value > 20 AS success, event_id % 3 <> 0 AS new_download FROM events)"


@query("daily_quota", f"WITH {_DOWNLOADS} SELECT day, count(*) FILTER (success AND new_download) AS downloads, greatest({CONFIG.max_per_day} - count(*) FILTER (success AND new_download), 0) AS remaining FROM d GROUP BY day")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_quota(_downloads(spark, sf_dir).withColumn("new", F.col("success") & F.col("new_download")), CONFIG.max_per_day)


@query("daily_state", f"WITH {_DOWNLOADS}, s AS (SELECT day, count(*) AS downloads FROM d GROUP BY day) SELECT day, greatest({CONFIG.max_per_day} - CASE WHEN day = (SELECT max(day) FROM s) THEN downloads ELSE 0 END, 0)::BIGINT AS remaining FROM s")
def daily_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day's state file would leave on the last day."""
    s = _downloads(spark, sf_dir).groupBy("day").agg(F.count("*").alias("downloads"))
    today = s.agg(F.max("day")).first()[0]
    return s.select("day", remaining_today(F.col("day"), F.col("downloads"), F.lit(today), CONFIG.max_per_day).cast("bigint").alias("remaining"))


@query("run_totals", f"WITH {_DOWNLOADS} SELECT count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM d")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_totals(_downloads(spark, sf_dir))


@query("result_routes", f"WITH {_DOWNLOADS} SELECT CASE WHEN success THEN 'manifest' ELSE 'failed' END AS log, success AND new_download AS counted, count(*) AS n FROM d GROUP BY ALL")
def result_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.route(_downloads(spark, sf_dir)).groupBy("log", "counted").agg(F.count("*").alias("n"))


@query("batch_progress", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS index, (SELECT count(*) FROM documents) AS total FROM documents")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each document in its batch."""
    return numbered(K.table(spark, sf_dir, "documents"), "doc_id")


@query("batch_progress_keys", """WITH k AS (SELECT CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 42 WHEN doc_id % 3 = 1 THEN doc_id * 4611686018427 ELSE -9000000000000000000 + doc_id END AS doc_id FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS index, (SELECT count(*) FROM k) AS total FROM k""")
def batch_progress_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with null ids, one id that many rows have, and ids spread over 64 bits."""
    d = F.col("doc_id")
    key = F.when(d % 10 == 0, None).when(d % 3 == 0, 42).when(d % 3 == 1, d * 4611686018427).otherwise(F.lit(-9000000000000000000) + d)
    return numbered(K.table(spark, sf_dir, "documents").select(key.alias("doc_id")), "doc_id")


@query("run_selection", f"""WITH {K.WORKS_SQL}, {_ELIGIBLE},
c AS (SELECT work_key, o_custkey % 50 AS term_ord, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY work_key) AS n FROM work),
s AS (SELECT {_ID} AS id, coalesce(cited_by_count, 0) AS citations, term_ord, work_key FROM eligible JOIN c USING (work_key) WHERE n <= {CONFIG.max_per_term})
SELECT id, citations FROM s WHERE work_key % 7 <> 0 AND work_key % 5 <> 0 ORDER BY citations DESC, term_ord, work_key LIMIT {CONFIG.max_per_day}""")
def run_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run would fetch, customers standing for search terms; some works are in the manifest, some have a file."""
    all_ = K.works(spark, sf_dir)
    rows = all_.join(K.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_key"), "o_custkey"), "work_key")
    names = [c for c in all_.columns if c != "work_key"]
    hits = rows.select((F.col("o_custkey") % 50).alias("term_ord"), F.col("work_key").alias("hit_ord"), F.struct(*names).alias("work"))
    ids = all_.select("work_key", M.work_id(F.col("id"), F.col("doi"), F.col("title")).alias("id"))
    return select_works(hits, ids.where("work_key % 7 = 0"), ids.where("work_key % 5 = 0"), CONFIG).select("id", "citations")


@query("latest_records", "SELECT user_id AS id, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each id the record that was written last: events are versions of their users' records."""
    e = K.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "value")
    return latest(e, "version")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.texts(spark, sf_dir)


def _edits(name: str, sql_pattern: str, sql_replacement: str, pattern: str, replacement: str, use_regex: bool, case_sensitive: bool) -> None:
    flags = "" if case_sensitive else "(?i)"
    p, r = S.text(flags + sql_pattern), S.text(sql_replacement)

    @query(name, f"WITH {K.TEXTS_SQL} SELECT doc_id, regexp_replace(text, {p}, {r}, 'g') AS text, len(regexp_extract_all(text, {p})) AS n FROM texts WHERE regexp_matches(text, {p})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.replace(_texts(spark, sf_dir), pattern, replacement, use_regex, case_sensitive).withColumn("n", F.col("n").cast("bigint"))


_edits("replace_literal", r"\[8\], \[9\]", r"$1 \\1 [8]", "[8], [9]", r"$1 \1 [8]", False, False)
_edits("replace_regex", r"(\d+)\s+(of|May)", r"\2 <\1>", r"(\d+)\s+(of|May)", r"\g<2> <\1>", True, False)
_edits("replace_case", r"Abstract", "SUMMARY", "Abstract", "SUMMARY", False, True)


@query("find_count", f"WITH {K.TEXTS_SQL} SELECT doc_id, len(regexp_extract_all(text, '(?i)nature')) AS n FROM texts")
def find_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.find(_texts(spark, sf_dir), "nature").select("doc_id", F.col("n").cast("bigint").alias("n"))


@query("find_scope", f"WITH {K.TEXTS_SQL} SELECT doc_id, len(regexp_extract_all(text, '(?i)abstract')) AS n FROM texts WHERE doc_id = 7")
def find_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document alone: the filter reaches the scan."""
    return E.find(_texts(spark, sf_dir).where("doc_id = 7"), "abstract").select("doc_id", F.col("n").cast("bigint").alias("n"))


@query("replace_totals", f"WITH {K.TEXTS_SQL}, c AS (SELECT len(regexp_extract_all(text, '(?i)abstract')) AS n FROM texts) SELECT count(*) FILTER (n > 0) AS files, sum(n)::BIGINT AS replacements FROM c")
def replace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.totals(E.find(_texts(spark, sf_dir), "abstract"))
