"""Folders of PDF and text files.

Files aren't sorted: their contents would be shuffled for it. in_order() numbers them by path, which moves
paths alone. An empty folder gives no rows.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.acquire import is_pdf
from corpusloom.operators.progress import numbered_texts


def stem(path_col: str = "path"):
    """A file's name without folders and its last extension, by which PDF and text belong together."""
    return F.regexp_replace(F.regexp_extract(F.col(path_col), r"([^/]+)\z", 1), r"\.[^.]*\z", "")


def list_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of a folder's PDF files, not of its subfolders; `valid` tells real ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.withColumn("valid", is_pdf(F.col("length"), F.col("content"))).withColumn("doc_id", stem())


def in_order(files: DataFrame) -> DataFrame:
    """path, index (from 1, by path), total."""
    return numbered_texts(files.select("path"), "path")


def extract_with_mupdf(content: bytes) -> list[list[str]]:
    """Pages of lines, by an optional library."""
    try:
        import pymupdf
    except ImportError:
        raise RuntimeError("extracting PDF pages needs pymupdf") from None
    with pymupdf.open(stream=content, filetype="pdf") as doc:
        return [page.get_text("text").splitlines() for page in doc]


def extract_pages(files: DataFrame, extract: Callable[[bytes], list[list[str]]] = extract_with_mupdf) -> DataFrame:
    """doc_id, pages, error of files (doc_id, content). A file that fails is a row with its error, and stops no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages, errors = [], []
            for content in batch["content"]:
                found, error = None, None
                try:
                    found = extract(bytes(content))
                    if not found:
                        found, error = None, "no pages"
                except Exception as e:  # noqa: BLE001  any library's error belongs to the row
                    error = f"{type(e).__name__}: {e}"
                pages.append(found)
                errors.append(error)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "pages": pages, "error": errors})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, pages array<array<string>>, error string")


def read_texts(spark: SparkSession, folder: str, name: str = "*.txt") -> DataFrame:
    """doc_id, path, text of cleaned files that aren't empty; `name` may be one file's. Bytes that are no UTF-8 are U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder)  # the text source has names encoded as in URLs
    return files.select(stem().alias("doc_id"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_texts(cleaned: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Valid documents (doc_id, text, valid) as a table; a rejected one leaves nothing."""
    cleaned.where("valid").select("doc_id", "text").write.mode(mode).parquet(folder)


def put_file(write: Callable[[BinaryIO], None], path: str, check: Callable[[str], bool] = lambda _: True, label: str = "", before: Callable[[str], None] = lambda part: None) -> bool:
    """Write a file under a name of its own, check it, and put it in its place; what fails the check leaves nothing.

    The name has `label`, and is no other writer's: of several writers of one file one wins, with a whole
    file. `before` is called with the file under that name, just before it takes its place.
    """
    part = f"{path}.{label}-{uuid.uuid4().hex}.part"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    try:
        with open(part, "wb") as f:
            write(f)
        if not check(part):
            return False
        before(part)
        os.replace(part, path)
        return True
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(part)


def write_text_files(texts: DataFrame, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Write each text to `<doc_id>.txt` (UTF-8) of a folder that all executors share; doc_id, `keep`, and error, null if it went well.

    Files are written by plain calls, so a store that isn't mounted can't be written to; write_texts() writes
    a table to any. The returned rows are made by writing: the caller runs them once. A repeated doc_id is written again;
    a null or one that isn't a plain file name is an error, as is a file that can't be written; no other
    file is touched by it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                error = None
                try:
                    if not doc_id or os.path.basename(doc_id) != doc_id:
                        raise ValueError("no file name")
                    put_file(lambda f, text=text: f.write((text or "").encode()), f"{folder}/{doc_id}.txt")
                except Exception as e:  # noqa: BLE001  one file's error stops no other
                    error = f"{type(e).__name__}: {e}"
                errors.append(error)
            yield batch[["doc_id", *keep]].assign(error=errors)

    kept = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in keep)
    return texts.select("doc_id", "text", *keep).mapInPandas(run, f"doc_id string, {kept}error string")
