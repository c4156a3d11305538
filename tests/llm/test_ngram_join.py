"""Ids with several texts in the n-gram join and in the pipeline's stage."""

import hashlib
import random

import pytest

import corpus_pipeline
from corpusloom.llm import ngram_join
from tests.helpers import same, views

SCHEMA = "doc_id bigint, text string"


def several_texts():
    """Ids with two or three unlike texts each, and a near copy of every text under an id of its own."""
    draw = random.Random(31)
    rows, copies = [], []
    for i in range(40):
        for _ in range(2 + i % 2):
            words = [f"w{draw.random()}" for _ in range(60)]
            rows.append((i, " ".join(words)))
            words[30] = "edit"
            copies.append((1000 + len(copies), " ".join(words)))
    return rows + copies


def linked(rows):
    """n_links and class_id of each id by brute force, an id's words being those of its text with the least set key."""
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    chosen = {}
    for i, text in rows:
        key = hashlib.md5(ngram_join.shingles(text).tobytes()).hexdigest()
        chosen[i] = min(chosen.get(i, (key, text)), (key, text))
    sets = {i: shingles(t) for i, (_, t) in chosen.items()}
    near = {a: {b for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} for a in sets}
    return {a: (len(near[a]), min({a} | near[a])) for a in sets}  # a pair is the largest group here


def test_larger_table(spark):
    """Every link of a thousand documents is found."""
    folder = "/root/testdata/sf0.01"
    same(ngram_join.op10_ngram_join(spark, folder), views(folder), ngram_join.ORACLE)


@pytest.mark.parametrize("turn, tasks", [(0, 1), (17, 3), (60, 7)])
def test_several_texts_of_an_id(spark, turn, tasks):
    rows = several_texts()
    want = linked(rows)
    assert sum(n for n, _ in want.values()) >= 80
    rows = (rows[turn:] + rows[:turn])[:: -1 if turn else 1]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(tasks)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_links, r.class_id) for r in got} == want


def test_stage_on_several_texts(spark):
    """Rows of an id stay together; a near copy of its chosen text goes, one of another text of it stays."""
    rows = several_texts()
    want = linked(rows)
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(tuple, got.collect())) == sorted(x for x in rows if want[x[0]][1] == x[0])


def test_levels_follow_the_input():
    """Ten times the sets have one level more, and as many more runs as keep the chance of a pair at the threshold."""
    assert [ngram_join.levels_for(n) for n in (0, 1, 10**6, 10**6 + 1, 10**7, 10**9)] == [3, 3, 3, 4, 4, 6]
    for levels in range(3, 9):
        runs = ngram_join.runs_for(0.99, levels)
        assert 1 - (1 - ngram_join.survival(levels)) ** runs >= 0.99


def test_large_nodes_by_size(spark, monkeypatch):
    """Of a node beyond the limit every pair of sets near enough in size meets once in a pair of blocks, and others in none."""
    monkeypatch.setattr(ngram_join, "NODE_BLOCK", 6)
    draw = random.Random(3)
    sizes = {i: draw.choice([1, 2, 5, 40, 50, 60, 62, 63, 75, 76, 100, 1000, 1249, 1250]) for i in range(120)}
    signed = spark.createDataFrame(list(sizes.items()), "id bigint, n_shingles bigint")
    large = spark.createDataFrame([(i, i % 2) for i in sizes], "id bigint, path bigint")
    used = []
    groups = {}
    for r in ngram_join._dealt(large, signed, 0.8, used).collect():
        assert r.i <= r.j and r.block in (r.i, r.j)
        groups.setdefault((r.path, r.i, r.j), []).append((r.id, r.block))
    met = {}
    for (_, i, j), own in groups.items():
        for a, x in own:
            for b, y in own:
                if a < b and {x, y} == {i, j}:
                    met[a, b] = met.get((a, b), 0) + 1
    assert set(met.values()) == {1}
    near = {(a, b) for a in sizes for b in sizes if a < b and a % 2 == b % 2 and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b])}
    assert near <= set(met) and all(max(sizes[a], sizes[b]) < min(sizes[a], sizes[b]) / 0.8**2 + 1 for a, b in met)
    assert len(met) < 0.5 * sum(a < b and a % 2 == b % 2 for a in sizes for b in sizes)
