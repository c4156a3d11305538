"""Segmented scans against the scans on arrays."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lines, scan

PIECES = [
    "", "Abstract", "1", "3.2", "2.", "1 Title", "Title", "t" * 121, "materials", "Materials", "and methods", "and", "methods", "and methods.", "- and methods", "conflict", "of interest", "of", "interest:",
    "Conflicts", "supplementary", "information -", "information", "goes on", "ends here.", "x", "Future", "work", "related -", "data", "availability", "*Correspondence: a@b.cd", "Correspondence to: x",
    "a@b.cd", "Dept of Physics, University", "long line " * 12, "2 Department of B", "https://x.org", "[1], [2]", "27", ".. data", "4.1 ", " 5", "12 ", "Data  availability", "appendix", "references", "Summary", "Introduction",
]


def documents(seed, n=60):
    draw = random.Random(seed)
    some = [draw.sample(PIECES, draw.randint(1, 8)) for _ in range(6)] + [["1", "2"], ["1", "2", "materials", "and methods"], ["x"], PIECES]
    return {d: [draw.choice(draw.choice(some)) for _ in range(draw.choice([0, 1, 3, 12, 40]))] for d in range(n)}


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_equal_to_arrays(spark, block):
    docs = documents(block)
    long = spark.createDataFrame([(d, i, x, "more") for d, own in docs.items() for i, x in enumerate(own)], "doc_id bigint, ord bigint, line string, _last string").repartition(3)
    rows = {r.doc_id: r for r in spark.createDataFrame([(d, x) for d, x in docs.items() if x], "doc_id bigint, lines array<string>").select("doc_id", lines.join_wrapped(F.col("lines")).alias("joined"), lines.noise_categories(F.col("lines")).alias("kinds")).collect()}
    got = {}
    for r in sorted(scan.join_wrapped(long, block_lines=block).collect()):
        got.setdefault(r.doc_id, []).append(r.line)
    assert got == {d: r.joined for d, r in rows.items()}
    kinds = {}
    found = scan.classify_noise(long, block_lines=block)
    assert found.columns == [*long.columns, "category"]
    for r in sorted(found.select("doc_id", "ord", "category").collect(), key=lambda r: r[:2]):
        kinds.setdefault(r.doc_id, []).append(r.category or "")
    assert kinds == {d: r.kinds for d, r in rows.items()}
    for one, other in ((scan.trim_front_matter, lines.trim_front_matter), (scan.trim_references, lines.trim_references)):
        assert sorted(map(str, one(long).collect())) == sorted(map(str, other(long).select(*one(long).columns).collect()))


def test_edges(spark):
    schema = "doc_id string, ord int, line string"
    rows = [(None, 0, "a"), (None, 1, "b"), (None, 1, "*Correspondence: x"), ("d", 5, None), ("d", 7, "x"), ("d", 9, "y"), ("d", 9, "y")]
    frame = spark.createDataFrame(rows, schema)
    got = sorted(map(str, scan.join_wrapped(frame, block_lines=2).collect()))
    assert got == sorted(f"Row(doc_id={d!r}, ord={i}, line={x!r})" for d, i, x in [*rows[:3], ("d", 5, ""), ("d", 7, "x y y")])
    assert [r.category for r in scan.classify_noise(frame).collect()] == [None] * 7
    empty = spark.createDataFrame([], schema)
    for f in (scan.join_wrapped, scan.classify_noise, scan.trim_front_matter, scan.trim_references):
        assert f(empty).count() == 0


def test_state_over_many_blocks(spark):
    """Numbers and titles in turn, so that what a line is hangs on all before it, over blocks that don't divide them."""
    n = 3001
    rows = spark.range(n).select(F.lit("a").alias("doc_id"), F.col("id").alias("ord"), F.lit("7").alias("line"))
    got = scan.join_wrapped(rows, block_lines=7).orderBy("ord").collect()
    assert [r.line for r in got] == ["7 7"] * (n // 2) + ["7"]


def test_giant_document(spark):
    """A document of two million lines: several tasks fill it in, none of which has more than a few blocks."""
    n, block = 2_000_000, 50_000
    line = F.element_at(F.array(*[F.lit(x) for x in ("*Correspondence: a", "Dept of X", "Methods", "this goes on", "and ends here.")]), (F.col("id") % 5 + 1).cast("int"))
    rows = spark.range(n, numPartitions=4).select(F.lit(1).alias("doc_id"), F.col("id").alias("ord"), line.alias("line"))
    began = time.perf_counter()
    found = scan.classify_noise(rows, block_lines=block)
    counts = dict(map(tuple, found.groupBy(F.coalesce("category", F.lit("-"))).count().collect()))
    assert counts == {"correspondence": 2 * n // 5, "-": 3 * n // 5}
    assert found.groupBy(F.spark_partition_id()).count().count() == 4
    joined = scan.join_wrapped(rows, block_lines=block)
    assert joined.groupBy("line").count().where("line = 'this goes on and ends here.'").first()[1] == n // 5
    assert time.perf_counter() - began < 180
