"""The corpus pipeline over `documents`: each stage is written as Parquet and read again by the next.

Language ID, quality classifier, near-duplicates, repeated passages, packing. All stages but the last
return the columns of their input; the last returns pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language_id, ngram_join, packing, quality_classifier, substring_dedup
from corpusloom.llm.common import read, release, stage

#: Texts whose language is less likely than this among the learned ones are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row, so that no column's name can clash with a result's."""
    return docs.select("doc_id", "text", F.struct("*").alias("_row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a learned language; texts without a letter, or of no clear language, go."""
    found = language_id.language_id(_carried(docs), language_id.learn(docs), keep=("_row",))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("_row.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learned from `labels`, predicts to be good; without labels all stay."""
    model = quality_classifier.learn(docs, read(spark, sf_dir, "labels"))
    if model is None:
        return docs
    return quality_classifier.quality_score(_carried(docs), model, keep=("_row",)).where("predicted = 1").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least doc_id; rows of one id stay or go together, those without an id stay."""
    gone = ngram_join.jaccard_join(docs).where(F.col("class_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without passages of 50 words or more that a row of a smaller id has; n_chars follows the text."""
    found = substring_dedup.substring_dedup(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' tokens as pieces of sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: Learned stages have no SQL; tests/llm/test_pipeline.py holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        before, docs = docs, stage(apply(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
