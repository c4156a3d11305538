"""A folder of papers cleaned into a folder of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import CleanConfig
from corpusloom.functions.text import split_lines
from corpusloom.operators.progress import Progress, Report, reporting
from corpusloom.plans.clean import clean_pages
from corpusloom.sources.files import extract_pages, extract_with_mupdf, list_pdfs, read_texts, write_text_files


def clean_folder(spark: SparkSession, source: str, out: str, staging: str, config: CleanConfig | None = None, extract: Callable[[bytes], list[list[str]]] | None = extract_with_mupdf, report: Report | None = None) -> DataFrame:
    """Clean the PDF files of a folder, or with `extract` None its text files, whose pages end in form feeds.

    doc_id, status (OK, REJECT, ERROR) and detail of each file: the characters, why it was rejected, or what
    went wrong, which stops no other. Texts of valid files are written to `<doc_id>.txt`; of others nothing is.
    An empty folder gives no rows. What was cleaned is kept in `staging`, so nothing is cleaned twice.
    `report` gets how many tasks of a step are done, while it runs, and with its end how many files were
    looked at and how many of them failed; these are counted as they are written, not afterwards.
    """
    if extract is None:
        texts = read_texts(spark, source)
        pages = texts.select("doc_id", F.transform(F.split("text", "\f", -1), split_lines).alias("pages"), F.lit(None).cast("string").alias("error"))
    else:
        pages = extract_pages(list_pdfs(spark, source), extract)
    pages = _kept(pages, f"{staging}/pages", "extracted", F.col("error").isNotNull(), report)
    cleaned = clean_pages(pages.where("error is null"), config)
    cleaned = cleaned.select("doc_id", "text", "valid", F.when(F.col("valid"), F.col("stats.characters").cast("string")).otherwise(F.array_join("reject_reasons", ", ")).alias("detail"))
    cleaned = _kept(cleaned, f"{staging}/cleaned", "cleaned", ~F.col("valid"), report)
    written = write_text_files(cleaned.where("valid"), out, ("detail",))
    ok = written.select("doc_id", F.when(F.col("error").isNull(), "OK").otherwise("ERROR").alias("status"), F.coalesce("error", "detail").alias("detail"))
    rejected = cleaned.where("not valid").select("doc_id", F.lit("REJECT").alias("status"), "detail")
    failed = pages.where("error is not null").select("doc_id", F.lit("ERROR").alias("status"), F.col("error").alias("detail"))
    return _kept(ok.unionByName(rejected).unionByName(failed), f"{staging}/status", "written", F.col("status") == "ERROR", report, True)


def _kept(df: DataFrame, path: str, message: str, failed: Column, report: Report | None, done: bool = False) -> DataFrame:
    """The rows written to a table and read from it, and their number reported."""
    spark, seen = df.sparkSession, Observation()
    with reporting(spark, message, report):
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed")).write.mode("overwrite").parquet(path)
    if report:
        report(Progress(f"files {message}", seen.get["n"], seen.get["n"], seen.get["failed"], done))
    return spark.read.parquet(path)
