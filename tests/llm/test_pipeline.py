"""The pipeline, stage by stage, against brute force on each stage's own input."""

import zlib

import corpus_pipeline
from corpusloom.llm import quality_classifier
from corpusloom.llm.common import read, stage
from tests.llm.test_operators import plain_language

FOLDER = "/root/testdata/sf0.001"


def sets(rows):
    return {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in rows if (w := r.text.split())}


def test_stages(spark):
    docs = read(spark, FOLDER, "documents")
    columns, docs_schema = docs.columns, docs.schema
    seen = {}
    for name, apply in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(apply(spark, docs, FOLDER), name)
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["language_id"]
    learned = [(r.lang, r.text) for r in before if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    found = plain_language(learned, [r.text for r in before], 3)
    assert {r.doc_id for r in after} == {r.doc_id for r, (lang, score) in zip(before, found) if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert len(after) >= 0.97 * len(before)
    labels = {r.doc_id: r.quality for r in read(spark, FOLDER, "labels").collect()}
    before, after = seen["quality_classifier"]
    kept = {r.doc_id for r in after}
    assert sum(d in kept for d, q in labels.items() if q) >= 0.95 * sum(labels.values())
    input_ = spark.createDataFrame(before, docs_schema)
    scored = quality_classifier.quality_score(input_, quality_classifier.learn(input_, read(spark, FOLDER, "labels")))
    assert kept == {r.doc_id for r in scored.where("predicted = 1").collect()} and len(kept) < len(before)
    before, after = seen["ngram_join"]
    grams = sets(before)
    near = {a: {b for b in grams if b != a and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])} for a in grams}
    want = set()
    for r in before:
        reach, todo = {r.doc_id}, [r.doc_id]
        while todo:
            new = near.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        want.add(min(reach))
    assert {r.doc_id for r in after} == want
    before, after = seen["substring_dedup"]
    owner = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        w = r.text.split()
        for i in range(len(w) - 49):
            owner.setdefault(tuple(w[i : i + 50]), r.doc_id)
    for r in before:
        w = r.text.split()
        gone = {i + o for i in range(len(w) - 49) if owner[tuple(w[i : i + 50])] < r.doc_id for o in range(50)}
        text = next(x.text for x in after if x.doc_id == r.doc_id)
        assert text == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else r.text)
    before, after = seen["packing"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    assert corpus_pipeline.ORACLE_SQL is None
