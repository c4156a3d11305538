"""Folders of texts in versions: an edit is made whole or not at all, and can be undone.

Texts are plain files, `<root>/<version>/<doc_id>.txt`, in folders that the driver and all executors have
mounted; files right below the root are the version that was there first. Which version is current stands
in a small file, which is switched once the new one is whole. Files that an edit doesn't change are linked,
or where links can't be made copied.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import edit
from corpusloom.sources.files import put_file, read_texts, stem
from corpusloom.sources.headers import HeadersSource
from corpusloom.sources.state import read_text, write_text

POINTER = "current.json"


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Versions from the first to the current one; the root itself is ``."""
    text = read_text(spark, f"{root}/{POINTER}")
    return json.loads(text)["versions"] if text else [""]


def current(spark: SparkSession, root: str) -> str:
    """The folder of the current version."""
    return f"{root}/{_versions(spark, root)[-1]}".rstrip("/")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path, text of a folder's files; Spark's sources pass over empty ones, which are listed here."""
    spark.dataSource.register(HeadersSource)
    empty = spark.read.format("headers").options(path=folder, suffix=".txt", bytes="0", least="1").load().where("length = 0")
    return read_texts(spark, folder).unionByName(empty.select(stem().alias("doc_id"), "path", F.lit("").alias("text")))


def _place(old: str, new: str) -> None:
    os.makedirs(os.path.dirname(new), exist_ok=True)
    part = f"{new}.{uuid.uuid4().hex}.part"
    try:
        os.link(old, part)
    except OSError:
        shutil.copyfile(old, part)
    os.replace(part, new)


def replace_all(spark: SparkSession, root: str, pattern: str, replacement: str, use_regex: bool = False, case_sensitive: bool = False) -> dict:
    """Replace in the current version's texts, as a new version: files changed and replacements in them.

    Without a match nothing is written. A file that can't be read or written stops the edit with an error, and
    the current version stays; so does it if the edit is broken off, and what that has written is removed by
    the next edit. A pattern that can't be read is an error before anything is touched.
    """
    versions = _versions(spark, root)
    source, version = current(spark, root), uuid.uuid4().hex
    _clear(root, versions)
    texts = edit.changed(_texts(spark, source), pattern, replacement, use_regex, case_sensitive)
    target = f"{root}/{version}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text, n in zip(batch["doc_id"], batch["text"], batch["n"]):
                path = f"{target}/{doc_id}.txt"
                if n:
                    put_file(lambda f, text=text: f.write(text.encode()), path)
                else:
                    _place(f"{source}/{doc_id}.txt", path)
            yield pd.DataFrame({"n": batch["n"]})

    if not texts.where("n > 0").select("n").head(1):
        return {"files": 0, "replacements": 0}
    done = texts.select("doc_id", "text", "n").mapInPandas(run, "n bigint")
    found = done.agg(F.count_if(F.col("n") > 0).alias("files"), F.sum("n").alias("replacements")).first().asDict()
    write_text(spark, f"{root}/{POINTER}", json.dumps({"versions": [*versions, version]}))
    return found


def undo(spark: SparkSession, root: str) -> bool:
    """Make the version before the current one current again; false if there is none."""
    versions = _versions(spark, root)
    if len(versions) < 2:
        return False
    write_text(spark, f"{root}/{POINTER}", json.dumps({"versions": versions[:-1]}))
    return True


def read(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, path, text of the current version."""
    return _texts(spark, current(spark, root))


def _clear(root: str, versions: list[str]) -> None:
    """Remove folders of versions that never became current, or were undone."""
    for name in os.listdir(root):
        if len(name) == 32 and name not in versions and os.path.isdir(f"{root}/{name}"):
            shutil.rmtree(f"{root}/{name}")
