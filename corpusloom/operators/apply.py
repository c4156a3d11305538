"""Bulk edits carried out on a folder of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import edit
from corpusloom.sources.files import read_texts, write_text_files


def replace_in_folder(spark: SparkSession, folder: str, staging: str, pattern: str, replacement: str, use_regex: bool = False, case_sensitive: bool = False, name: str = "*.txt") -> DataFrame:
    """Replace in the files of a folder that all executors share: doc_id, n, error of each file that has a match.

    Only files with a match are written, each beside the old one and then in its place. New texts are kept
    in `staging` before that, so that a task that is run again doesn't replace twice. A file that fails is a
    row with its error. A pattern that can't be read is an error before anything is touched. The rows are
    made by writing; edit_totals() sums them.
    """
    found = edit.replace(read_texts(spark, folder, name), pattern, replacement, use_regex, case_sensitive)
    found.select("doc_id", "text", "n").write.mode("overwrite").parquet(f"{staging}/texts")
    done = write_text_files(spark.read.parquet(f"{staging}/texts"), folder, ("n",))
    done.write.mode("overwrite").parquet(f"{staging}/done")
    return spark.read.parquet(f"{staging}/done")


def edit_totals(done: DataFrame) -> DataFrame:
    """Files that were changed, replacements in them, and files that failed."""
    good = F.col("error").isNull()
    return done.agg(F.count_if(good).alias("files"), F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).cast("bigint").alias("replacements"), F.count_if(~good).alias("failed"))
