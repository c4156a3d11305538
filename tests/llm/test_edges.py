"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import pytest

import corpus_pipeline
from corpusloom.llm import byte_bpe, fingerprints, language_id, lm_scoring, merge_automaton, ngram_join, packing, quality_classifier, quality_rules, substring_dedup
from corpusloom.llm.common import stage

LONG = " ".join(f"wörd{i % 997}" for i in range(30_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id bigint, kept string, _row int, path bigint, n_words string, held_out int"
ROWS = [(i, t, "en", None, None, 0.5, i, None, 1, 2, "x", 0) for i, t in ((1, "a plain little text of some words here"), (1, "a plain little text of some words here"), (2, None), (3, ""), (4, LONG), (None, "no id"), (None, None), (5, "\t\n "), (6, "🙂 İ ñ"), (7, LONG + " tail"))]


def lm(df):
    return lm_scoring.lm_score(df, lm_scoring.fit(df))


def quality(df):
    labels = df.sparkSession.createDataFrame([(1, 1), (1, 0), (4, 1), (6, None), (None, 1), (99, 0)], "doc_id bigint, quality int")
    return quality_classifier.quality_score(df, quality_classifier.learn(df, labels))


ONE_FOR_ONE = {
    "language": lambda df: language_id.language_id(df, language_id.fit(df, min_count=1)),
    "substring": substring_dedup.substring_report,
    "quality": quality,
    "fingerprint": fingerprints.edit_report,
    "rules": quality_rules.quality_rules,
    "bpe": byte_bpe.digest,
    "encode": byte_bpe.encode,
    "lm": lm,
    "join": ngram_join.jaccard_join,
    "automaton": merge_automaton.digest,
    "automaton ids": merge_automaton.encode,
}


@pytest.mark.parametrize("name", sorted(ONE_FOR_ONE))
def test_a_row_for_each_row(spark, name):
    apply = ONE_FOR_ONE[name]
    got = apply(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(r[0] or 0 for r in ROWS)
    if name != "fingerprint":  # where the first one's next row is the second
        assert len({tuple(map(str, r)) for r in got if r.doc_id == 1}) == 1
    assert apply(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing(spark):
    got = packing.pack(spark.createDataFrame(ROWS, SCHEMA), with_ids=True).collect()
    assert sum(r.doc_id == 1 for r in got) == 2 and sum(r.doc_id == 4 for r in got) > 10
    assert all(len(r.ids) == r.length for r in got)
    assert [r.ids for r in got if r.doc_id == 3] == [[0]]
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dedup_keeps_columns(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    got = substring_dedup.substring_dedup(frame)
    assert got.columns == frame.columns and got.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[4] == LONG and texts[7].endswith("tail") and len(texts[7]) < 600


def kept(rows):
    return sorted(((r[0], r[1]) for r in rows), key=str)


def test_stages_on_edges(spark, tmp_path):
    """What each stage keeps of null, empty, long and repeated rows; of no rows none, in the same columns."""
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, rows: stage(stages[name](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)), name)
    lettered = [r for r in ROWS if r[1] and any(c.isalpha() for c in r[1])]
    assert len(lettered) == 6
    # texts without a letter go; the others have the one language that there is, those without an id too
    assert kept(run("language_id", ROWS).collect()) == kept(lettered)
    # one label is not enough to tell good from bad: whatever is known of the rows, none is lost twice or doubled
    assert set(kept(run("quality_classifier", ROWS).collect())) <= set(kept(ROWS))
    # the near copy goes; rows of one id stay together, as do rows without an id, or without a word
    assert kept(run("ngram_join", ROWS).collect()) == kept([r for r in ROWS if r[0] != 7])
    # the passage that row 4 has too goes; white space stays as it is where nothing goes
    texts = {r[0]: r[1] for r in ROWS}
    found = kept(run("substring_dedup", ROWS).collect())
    tail = next(t for i, t in found if i == 7)
    assert [x for x in found if x[0] != 7] == kept([r for r in ROWS if r[0] != 7]) and texts[7].endswith(tail) and len(tail.split()) < 50
    # every row is packed, null and empty ones as the end alone
    packed = run("packing", ROWS).collect()
    assert {r.doc_id for r in packed} == set(texts) and sum(r.piece == 0 for r in packed) == len(ROWS)
    assert sorted(r.length for r in packed if r.doc_id in (2, 3, 5)) == [1, 1, 1]
    for name in stages:
        got = run(name, [])
        assert got.count() == 0 and (name == "packing" or got.columns == spark.createDataFrame([], SCHEMA).columns)


def test_stage_without_labels(spark, tmp_path):
    """Without labels the classifier's stage keeps every row."""
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.classify_quality(spark, spark.createDataFrame(ROWS, SCHEMA), str(tmp_path))
    assert kept(got.collect()) == kept(ROWS)
