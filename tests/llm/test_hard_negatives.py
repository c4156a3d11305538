"""The block matrix multiply against SQL and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives
from tests.helpers import DATA, same, views

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, r double, v int, block string"


def brute(rows, positives=5, negatives=5, least=80, every=100):
    kept = {}
    for i, x, label, *_ in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own = (label, [math.floor(256 * c) for c in x])
        kept[i] = min(kept.get(i, own), own)
    score = lambda a, b: sum(p * q for p, q in zip(kept[a][1], kept[b][1]))
    out = set()
    for a in kept:
        if a % every == 0:
            rest = sorted(((-score(a, b), b) for b in kept if b != a))
            for s, p in [x for x in rest if kept[x[1]][0] == kept[a][0]][:positives]:
                own = [(t, n) for t, n in rest if kept[n][0] != kept[a][0] and least * -s <= 100 * -t <= 100 * -s]
                out |= {(a, p, i, n, -s, -t) for i, (t, n) in enumerate(own[:negatives], 1)}
    return out


def run(spark, rows, every=100, **options):
    frame = spark.createDataFrame([(*r, "x", 0.5, 1, "y")[:7] for r in rows], SCHEMA)
    got = hard_negatives.hard_negatives(frame, F.col("id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_larger_table(spark):
    same(hard_negatives.op12_hard_negatives(spark, "/root/testdata/sf0.1"), views("/root/testdata/sf0.1"), hard_negatives.ORACLE)


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, monkeypatch, seed):
    """Several blocks, cells, chunks and stripes; ties, a hot label, repeated and odd rows, vectors of unequal lengths."""
    for name, value in {"ANCHOR_BLOCK": 3, "ROW_BLOCK": 7, "CHUNK": 2, "STRIPE": 2, "CELL_ANCHORS": 2, "CELL_ROWS": 3}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    draw = random.Random(seed)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.25, 0.5, 1.0]) for _ in range(draw.choice([5, 5, 5, 3, 0]))], draw.choice([1, 1, 1, 2, 3, 4])) for i in range(-20, 90)]
    rows += rows[30:40] + [(5, [1.0, 1.0], 9), (None, [1.0], 1), (200, None, 1), (201, [1.0], None), (202, [1.0, None], 1), (203, [math.nan], 1), (210, [math.inf], 2)]
    want = sorted(brute(rows, every=10))
    assert len(want) > 100
    draw.shuffle(rows)
    assert run(spark, rows, 10) == want
    assert run(spark, rows, 10, positives=2, negatives=3, least=50) == sorted(brute(rows, 2, 3, 50, 10))


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0], 1)]) == []
    assert run(spark, [(100, [1.0], 1), (101, [1.0], 1)]) == []  # no row of another label
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert run(spark, [(100, [1.0], 1), (3, [1.0], 1), (2, [1.0], 2), (4, [0.9], 2)]) == [(100, 3, 1, 2, 65536, 65536), (100, 3, 2, 4, 65536, 256 * 230)]


def test_large_components(spark):
    big = 2.0**20  # scores beyond what doubles hold exactly
    rows = [(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big, 2.0], 2), (3, [big, 1.0], 2), (4, [big, 0.0], 2)]
    assert run(spark, rows) == sorted(brute(rows)) and brute(rows)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(0, [3e38], 1), (1, [3e38], 1), (2, [1.0], 2)])


def test_product():
    draw = np.random.default_rng(1)
    for top in (10, 2**24, 2**29):
        a, b = draw.integers(-top, top, (5, 8)), draw.integers(-top, top, (7, 8))
        assert (hard_negatives.product(a, b) == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]).all()
