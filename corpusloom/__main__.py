"""python -m corpusloom IN OUT [--texts]: clean a folder of PDF files, or of text files, into texts."""

from __future__ import annotations

import argparse
import tempfile

from pyspark.sql import SparkSession

from corpusloom.plans.folder import clean_folder
from corpusloom.sources.files import extract_with_mupdf


def main(arguments: list[str] | None = None) -> int:
    """Prints a line for each file, by name; 1 if one of them is an error."""
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("--texts", action="store_true", help="the folder has .txt files, whose pages end in form feeds")
    parser.add_argument("--staging", help="a folder that all executors share; a temporary one on a local master")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if not given.staging and not spark.sparkContext.master.startswith("local"):
        parser.error("--staging is needed on a cluster")
    with tempfile.TemporaryDirectory(prefix="corpusloom-") as own:
        rows = clean_folder(spark, given.source, given.out, given.staging or own, extract=None if given.texts else extract_with_mupdf)
        failed = False
        for r in rows.orderBy("doc_id").toLocalIterator():
            failed |= r.status == "ERROR"
            print(f"{r.status:6} {r.doc_id}: {r.detail}")
    return int(failed)


if __name__ == "__main__":
    raise SystemExit(main())
