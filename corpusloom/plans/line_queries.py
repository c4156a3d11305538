"""Queries about lines and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import constants as C
from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.operators import lines as L
from corpusloom.operators import pages as G
from corpusloom.operators import scan, terms
from corpusloom.operators.quality import reject_reasons, statistics
from corpusloom.plans import carriers as K
from corpusloom.plans import sql as S
from corpusloom.plans.clean import clean_pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: query -> (predicate, its SQL): the lines for which it holds.
PREDICATES = {
    "license_lines": (P.is_license, S.has_any("line", C.LICENSE_PARTS)),
    "email_lines": (P.has_email, S.email("line")),
    "url_doi_lines": (P.is_url_or_doi, S.url_or_doi("line")),
    "publisher_lines": (P.is_publisher_metadata, S.has_any("line", C.PUBLISHER_PARTS)),
    "page_number_lines": (P.is_page_number, S.page_number("line")),
    "citation_clusters": (P.is_citation_cluster, S.citation_cluster("line")),
    "graphical_lines": (P.is_graphical, S.graphical("line")),
    "pdf_artifact_lines": (P.is_pdf_artifact, S.artifact("line")),
    "correspondence_starts": (P.starts_correspondence, S.correspondence("line")),
    "author_lists": (P.is_author_list, S.author_list("line")),
    "numbered_affiliations": (P.is_numbered_affiliation, S.numbered_affiliation("line")),
    "indexed_affiliations": (P.is_indexed_affiliation, S.indexed_affiliation("line")),
    "section_headings": (P.is_section_heading, S.heading("line")),
    "references_headings": (P.is_references_heading, f"{S.heading_form('line')} IN {S.names(C.REFERENCE_NAMES)}"),
    "article_anchors": (lambda x: P.is_first_anchor(x) | P.is_second_anchor(x), f"{S.heading_form('line')} IN {S.names(C.FIRST_ANCHORS + C.SECOND_ANCHORS)}"),
    "failure_lines": (T.tells_of_failure, S.has_any("line", C.FAILURE_PARTS)),
}

#: query -> (value of a line, its SQL, which lines): scores above 0, keys that aren't the line itself, else all lines.
VALUES = {
    "affiliation_score": (lambda x: P.affiliation_score(x).cast("bigint"), f"{S.affiliation('line')}::BIGINT", "value > 0"),
    "author_names": (lambda x: P.author_name_score(x).cast("bigint"), f"{S.author_names('line')}::BIGINT", "value > 0"),
    "fuzzy_keys": (T.fuzzy_key, S.fuzzy_key("line"), "value <> line"),
    "heading_forms": (T.heading_form, S.heading_form("line"), "true"),
    "section_names": (T.section_name, S.section_name("line"), "true"),
    "normalized_lines": (lambda x: T.normalize_line(F.concat(F.lit(" \t "), x, F.lit("  \t"))), S.normal_line("' ' || chr(9) || ' ' || line || '  ' || chr(9)"), "length(value) > 0"),
}


#: Lines of a block in the queries on scans by blocks: few, since their documents are short.
SCANNED = 64


def _lines_where(predicate):
    return lambda spark, sf_dir: K.lines(spark, sf_dir).where(predicate(F.col("line")))


def _values(value, keep: str):
    return lambda spark, sf_dir: K.lines(spark, sf_dir).withColumn("value", value(F.col("line"))).where(keep)


for name, (predicate, sql) in PREDICATES.items():
    QUERIES[name] = _lines_where(predicate)
    ORACLES[name] = f"WITH {K.LINES_SQL} SELECT doc_id, ord, line FROM lines WHERE {sql}"
for name, (value, sql, keep) in VALUES.items():
    QUERIES[name] = _values(value, keep)
    ORACLES[name] = f"WITH {K.LINES_SQL}, v AS (SELECT doc_id, ord, line, {sql} AS value FROM lines) SELECT * FROM v WHERE {keep}"


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_ANCHOR = f"coalesce(min(CASE WHEN {S.heading_form('line')} IN {S.names(C.FIRST_ANCHORS)} THEN ord END) OVER d, min(CASE WHEN {S.heading_form('line')} IN {S.names(C.SECOND_ANCHORS)} THEN ord END) OVER d, 0)"
_FRONT = "SELECT doc_id, ord, line, start FROM (SELECT *, {anchor} AS start FROM {source} WINDOW d AS (PARTITION BY doc_id)) WHERE ord >= start"


@query("front_matter_trim", f"WITH {K.LINES_SQL} {_FRONT.format(anchor=_ANCHOR, source='lines')}")
def front_matter_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.trim_front_matter(K.lines(spark, sf_dir))


@query("references_trim", f"WITH {K.LINES_SQL} SELECT doc_id, ord, line FROM (SELECT *, min(CASE WHEN {S.heading_form('line')} IN {S.names(C.REFERENCE_NAMES)} THEN ord END) OVER (PARTITION BY doc_id) AS e FROM lines) WHERE e IS NULL OR ord < e")
def references_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.trim_references(K.lines(spark, sf_dir))


def _noise_sql(source: str) -> str:
    """CTEs that end in `noise`: the source's lines with their category."""
    return f"""n1 AS (SELECT *, line <> '' AND {S.ends_block('line')} AS t, line <> '' AND {S.correspondence('line')} AS s, CASE WHEN line <> '' THEN {S.noise_category('line')} END AS c FROM {source}),
n2 AS (SELECT *, CASE WHEN s AND NOT t THEN 1 WHEN t AND NOT s THEN 0 END AS k FROM n1),
n3 AS (SELECT *, count(k) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS seg FROM n2),
n4 AS (SELECT *, (coalesce(max(k) OVER (PARTITION BY doc_id, seg), 0) + sum((s AND t)::INT) OVER (PARTITION BY doc_id, seg ORDER BY ord ROWS UNBOUNDED PRECEDING)) % 2 AS after FROM n3),
n5 AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY doc_id ORDER BY ord), 0) = 1 AS inside FROM n4),
noise AS (SELECT doc_id, ord, line, CASE WHEN line = '' THEN NULL WHEN inside THEN CASE WHEN NOT t THEN 'correspondence' END WHEN s THEN 'correspondence' ELSE c END AS category FROM n5)"""


@query("noise_removal", f"WITH {K.LINES_SQL}, {_noise_sql('lines')} SELECT doc_id, ord, line, coalesce(category, 'kept') AS category FROM noise")
def noise_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classify_noise(K.lines(spark, sf_dir)).withColumn("category", F.coalesce("category", F.lit("kept")))


@query("noise_removal_blocks", ORACLES["noise_removal"])
def noise_removal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by blocks of lines, for documents larger than a task."""
    found = scan.classify_noise(K.lines(spark, sf_dir), block_lines=SCANNED)
    return found.withColumn("category", F.coalesce("category", F.lit("kept")))


_WORDS = "SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 6"


@query("term_counts", f"WITH {K.LINES_SQL}, terms AS ({_WORDS}), found AS (SELECT doc_id, ord, term FROM lines JOIN terms ON contains(lower(line), term)) SELECT doc_id, ord, count(*) AS n_terms FROM found GROUP BY ALL")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with how many different terms of a long list they have: the longer words of `benchmark`."""
    words = K.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("term")).where("length(term) >= 6")
    return terms.count_terms(K.lines(spark, sf_dir), words).where("n_terms > 0").select("doc_id", "ord", "n_terms")


@query("cleanup_counts", f"WITH {K.LINES_SQL}, {_noise_sql('lines')} SELECT doc_id, " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in L.COUNTS if c not in ("front_matter", "references")) + " FROM noise GROUP BY doc_id")
def cleanup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cleanup_counts(L.classify_noise(K.lines(spark, sf_dir)))


@query("join_wrapped", f"WITH {K.LINES_SQL}, a AS (SELECT doc_id, list(line ORDER BY ord) AS ls FROM lines GROUP BY doc_id) SELECT doc_id, array_to_string({S.joined('ls')}, chr(10)) AS text FROM a")
def join_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.line_arrays(spark, sf_dir).select("doc_id", F.array_join(L.join_wrapped(F.col("lines")), "\n").alias("text"))


@query("join_wrapped_blocks", f"WITH {K.LINES_SQL}, a AS (SELECT doc_id, list(line ORDER BY ord) AS ls FROM lines GROUP BY doc_id), j AS (SELECT doc_id, unnest({S.joined('ls')}) AS line FROM a) SELECT doc_id, line, count(*) AS n FROM j GROUP BY ALL")
def join_wrapped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a document has each joined line, by blocks of lines."""
    return scan.join_wrapped(K.lines(spark, sf_dir), block_lines=SCANNED).groupBy("doc_id", "line").agg(F.count("*").alias("n"))


_REPEATED = f"""{K.PAGES_SQL},
n_pages AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM paged GROUP BY doc_id),
keyed AS (SELECT doc_id, page_no, pos, {S.normal_line('line')} AS line, {S.fuzzy_key(S.normal_line('line'))} AS key FROM paged),
repeated AS (SELECT doc_id, key, count(DISTINCT page_no) AS n_pages_with FROM keyed JOIN n_pages USING (doc_id) WHERE n >= {G.MIN_PAGES} AND length(line) >= {G.MIN_CHARS} AND NOT {S.page_number('line')}
  GROUP BY doc_id, key, n HAVING count(DISTINCT page_no) >= greatest(2, trunc(n * 0.3::DOUBLE)))"""
_FLAT = f"""{_REPEATED},
stripped AS (SELECT doc_id, page_no, list(line ORDER BY pos) AS ls FROM keyed ANTI JOIN (SELECT doc_id, key FROM repeated) r ON keyed.doc_id = r.doc_id AND keyed.key = r.key AND keyed.line <> '' GROUP BY doc_id, page_no),
flat AS (SELECT doc_id, flatten(list(CASE WHEN ls[-1] <> '' THEN list_append(ls, '') ELSE ls END ORDER BY page_no)) AS ls FROM stripped GROUP BY doc_id)"""


@query("repeated_headers", f"WITH {_REPEATED} SELECT doc_id, key, n_pages_with FROM repeated")
def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.repeated_keys(K.pages(spark, sf_dir), "doc_id", "pages")


@query("strip_headers", f"WITH {_FLAT} SELECT doc_id, array_to_string(ls, chr(10)) AS text FROM flat")
def strip_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their repeated lines, flattened."""
    return K.pages(spark, sf_dir).select("doc_id", F.array_join(G.flatten_pages(G.strip_repeated(F.col("pages"))), "\n").alias("text"))


@query("conversation_headers", f"""WITH p AS (SELECT conv_id, turn, lower(unnest(string_split('Turn | ' || turn::VARCHAR || ' | of a conversation' || chr(10) || text, chr(10)))) AS l FROM conversations),
k AS (SELECT conv_id, turn, {S.fuzzy_key(S.normal_line('l'))} AS key FROM p WHERE length({S.normal_line('l')}) >= {G.MIN_CHARS} AND NOT {S.page_number(S.normal_line('l'))}),
n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, key, count(DISTINCT turn) AS n_pages_with FROM k JOIN n USING (conv_id) WHERE n >= {G.MIN_PAGES} GROUP BY conv_id, key, n HAVING count(DISTINCT turn) >= greatest(2, trunc(n * 0.3::DOUBLE))""")
def conversation_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that turns of a conversation repeat, turns being its pages."""
    turns = K.table(spark, sf_dir, "conversations")
    page = F.split(F.concat(F.lit("Turn | "), F.col("turn").cast("string"), F.lit(" | of a conversation\n"), F.col("text")), "\n", -1)
    by = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))).alias("t"))
    return G.repeated_keys(by.select("conv_id", F.transform("t", lambda x: x["p"]).alias("pages")), "conv_id", "pages")


@query("hyphen_repair", f"WITH {K.TEXTS_SQL} SELECT doc_id, {S.hyphenation('text')} AS text FROM texts")
def hyphen_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.texts(spark, sf_dir).select("doc_id", T.repair_hyphenation(F.col("text")).alias("text"))


@query("submission_span", f"WITH {K.TEXTS_SQL} SELECT doc_id, {S.submission('text')} AS text FROM texts")
def submission_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.texts(spark, sf_dir).select("doc_id", T.strip_submission_spans(F.col("text")).alias("text"))


@query("collapse_blank", f"WITH {K.TEXTS_SQL}, wide AS (SELECT doc_id, replace(text, chr(10), '  ' || chr(10) || chr(10)) AS text FROM texts) SELECT doc_id, {S.blank_lines('text')} AS text FROM wide")
def collapse_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.replace(F.col("text"), F.lit("\n"), F.lit("  \n\n"))
    return K.texts(spark, sf_dir).select("doc_id", T.collapse_blank_lines(wide).alias("text"))


#: Put in front of a text, and what becomes of it.
ODD, EVEN = "ef\ufb01x\u200by\u0001 a\u239bb\uf8f1c \u00bd\u2026 \uff21|", "effixy a b c 1\u20442... A|"


@query("unicode_normalize", f"SELECT doc_id, {S.text(EVEN)} || text AS text FROM documents")
def unicode_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table(spark, sf_dir, "documents").select("doc_id", T.normalize_unicode(F.concat(F.lit(ODD), "text")).alias("text"))


_REASONS = "CASE WHEN characters < 1500 THEN 'too_short,' ELSE '' END || CASE WHEN words < 250 THEN 'too_few_words,' ELSE '' END || CASE WHEN garbage_ratio > 0.1 THEN 'high_garbage_ratio,' ELSE '' END"


def _gate(df: DataFrame, *more: str) -> DataFrame:
    stats = F.col("stats")
    reasons = F.concat(F.array_join(reject_reasons(stats), ","), F.when(F.size(reject_reasons(stats)) > 0, ",").otherwise(""))
    return df.select("doc_id", *more, stats["characters"].cast("bigint").alias("characters"), stats["words"].cast("bigint").alias("words"), F.round(stats["garbage_ratio"], 6).alias("garbage_ratio"), reasons.alias("reasons"))


@query("doc_stats", f"WITH {K.TEXTS_SQL} SELECT doc_id, {S.statistics('text')} FROM texts")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(K.texts(spark, sf_dir).select("doc_id", statistics(F.col("text")).alias("stats"))).drop("reasons")


@query("quality_gate", f"""WITH {K.LINES_SQL}, kept AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT {S.has_any('line', C.LICENSE_PARTS)} AND NOT {S.email('line')}), '') AS text FROM lines GROUP BY doc_id),
s AS (SELECT doc_id, {S.statistics('text')} FROM kept) SELECT *, {_REASONS} AS reasons, characters >= 1500 AND words >= 250 AND garbage_ratio <= 0.1 AS valid FROM s""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without licence and e-mail lines, gated by their statistics; one that loses all its lines is rejected as empty."""
    kept = F.filter("lines", lambda x: ~P.is_license(x) & ~P.has_email(x))
    rows = K.line_arrays(spark, sf_dir).select("doc_id", kept.alias("kept"))
    return _gate(rows.select("doc_id", statistics(F.array_join("kept", "\n")).alias("stats"))).withColumn("valid", F.col("reasons") == "")


@query("clean_corpus", f"""WITH {_FLAT}, flat_lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ord FROM flat),
front AS ({_FRONT.format(anchor=_ANCHOR, source='flat_lines')}), {_noise_sql('front')},
lists AS (SELECT doc_id, list(line ORDER BY ord) FILTER (category IS NULL) AS ls, min(ord) AS front_matter, {', '.join(f"count(*) FILTER (category = '{c}') AS {c}" for c in L.COUNTS if c not in ('front_matter', 'references'))} FROM noise GROUP BY doc_id),
cleaned AS (SELECT * EXCLUDE ls, {S.blank_lines(S.submission(S.hyphenation(f"array_to_string({S.joined('coalesce(ls, []::VARCHAR[])')}, chr(10))")))} AS text FROM lists),
s AS (SELECT *, {S.statistics('text')} FROM cleaned)
SELECT doc_id, CASE WHEN {_REASONS} = '' THEN text ELSE '' END AS text, {_REASONS} AS reasons, characters, words, garbage_ratio, front_matter, publisher_metadata, correspondence, author_blocks, graphics, other_noise FROM s""")
def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over pages of twelve lines."""
    rows = clean_pages(K.pages(spark, sf_dir))
    return _gate(rows.select("doc_id", "stats", "text", *[F.col(f"cleanup.{c}").cast("bigint").alias(c) for c in L.COUNTS if c != "references"]), "text", *[c for c in L.COUNTS if c != "references"])
