"""Lists of terms: other ones than the usual, and long ones."""

import time

import pytest
from pyspark.sql import functions as F

from corpusloom.config import CleanConfig
from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.functions.rules import RULES, Rules
from corpusloom.operators import lines, scan, terms
from corpusloom.plans import carriers
from corpusloom.plans.clean import clean_pages
from tests.helpers import DATA


def test_equal_to_the_short_form(spark):
    rows = carriers.lines(spark, DATA)
    got = terms.count_terms(rows, RULES.affiliation_terms).withColumn("want", P.affiliation_score(F.col("line")))
    assert got.where("n_terms <> want").count() == 0 and got.where("want > 1").count() > 0
    parts = terms.count_terms(rows, RULES.publisher_parts).withColumn("want", P.is_publisher_metadata(F.col("line")))
    assert parts.where("(n_terms > 0) <> want").count() == 0 and parts.where("want").count() > 0


def test_odd_lists(spark):
    rows = spark.createDataFrame([("AB abc ÉÉ", 1), (None, 2), ("", 3)], "line string, n_terms_ int")
    count = lambda x: [r.n_terms for r in terms.count_terms(rows, x).orderBy("n_terms_").collect()]
    assert count(["b", "ab", "AB", "bc ", "éé", "", None]) == [4, 0, 0] and count([]) == [0, 0, 0]
    table = spark.createDataFrame([("B",), ("Abc",), (None,), ("",), ("b",)], "term string")
    assert count(table) == [2, 0, 0]
    assert terms.count_terms(rows.limit(0), ["a"]).count() == 0
    terms.MOST_BYTES, kept = 3, terms.MOST_BYTES
    try:
        for x in (["abcd"], table):
            with pytest.raises(ValueError):
                terms.count_terms(rows, x)
    finally:
        terms.MOST_BYTES = kept


def test_time_does_not_follow_the_list(spark):
    rows = spark.range(60_000, numPartitions=4).select(F.concat_ws(" ", *[F.sha1(F.concat(F.col("id"), F.lit(i)).cast("string")) for i in range(4)]).alias("line"))

    def seconds(n):
        began = time.perf_counter()
        terms.count_terms(rows, [f"{i:x}zz{i}" for i in range(n)]).agg(F.sum("n_terms")).collect()
        return time.perf_counter() - began

    seconds(10)
    assert seconds(20_000) < 4 * seconds(20) + 2


def test_more_rules(spark):
    more = RULES.adding(license_parts=("All Rights Kept", "cc-by"), affiliation_terms=("observatory",), failure_parts=("gave up",), artifact_parts=("%%eof",), publisher_parts=("preprint of",))
    assert len(more.license_parts) == len(RULES.license_parts) + 1 and RULES == Rules()
    with pytest.raises(ValueError):
        RULES.adding(license_parts=("",))
    rows = spark.createDataFrame([(0, "all rights KEPT"), (1, "%%EOF"), (2, "Preprint of x"), (3, "the Observatory of x"), (4, "it gave up"), (5, "cc by")], "ord int, x string")
    x = F.col("x")
    flags = lambda rules: [tuple(r) for r in rows.orderBy("ord").select(P.is_license(x, rules), P.is_pdf_artifact(x, rules), P.is_publisher_metadata(x, rules), P.affiliation_score(x, rules) > 0, T.tells_of_failure(x, rules)).collect()]
    assert [[i for i, v in enumerate(r) if v] for r in flags(more)] == [[0], [1], [2], [3], [4], [0]]
    assert [[i for i, v in enumerate(r) if v] for r in flags(RULES)] == [[], [], [], [], [], [0]]
    doc = ["Abstract", "a line that stays", "All rights kept by us", "*Correspondence: x", "Observatory of Somewhere, " + "which is far away and has a long name " * 4, "and more of the text"]
    pages = spark.createDataFrame([("d", [doc])], "doc_id string, pages array<array<string>>")
    long = spark.createDataFrame([("d", i, x) for i, x in enumerate(doc)], "doc_id string, ord int, line string")
    for rules, want in ((RULES, 4), (more, 2)):
        assert clean_pages(pages, CleanConfig(0, 0, 1.0, rules=rules)).first().text.count("\n") + 1 <= want
        for f in (lines.classify_noise, scan.classify_noise):
            kept = [r.line for r in f(long, rules=rules).where("category is null").orderBy("ord").collect()]
            assert (doc[2] in kept) == (doc[4] in kept) == (rules is RULES)
