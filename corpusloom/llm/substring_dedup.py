"""Substring deduplication by level-wise doubling.

At the first level windows of `seed` words are looked at, of which each window of twice that length
contributes the one with the least hash, so that equal longer windows contribute equal shorter ones.
Windows that occur in two documents or more alone are extended to twice the length, level by level, until
the length asked for is reached or no candidate survives. Documents of the same words are judged by one
of them, the one with the smallest id. A window is known by two 64-bit hashes, each by doubling from hashes
of its words, which have 64 bits of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import prepare, read, reduced, release, stage

WINDOW = 50
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def word_values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hashes of all windows of n values, from those of half the length: h_2n[i] = h_n[i] * base**n + h_n[i+n]."""
    h, size, mask = values, 1, (1 << 64) - 1
    for bit in bin(n)[3:]:
        if len(h) <= size:
            return values[:0]
        h = h[:-size] * np.uint64(pow(base, size, 1 << 64) & mask) + h[size:]
        size *= 2
        if bit == "1":
            if len(values) <= size:
                return values[:0]
            h = h[: len(values) - size] * np.uint64(base) + values[size:]
            size += 1
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(values: np.ndarray, seed: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seed windows; of each window of `window` words the place of its seed window of least hash, the first of equals."""
    h = mixed(windows(values, seed, BASES[0]))
    span = window - seed + 1
    if len(h) < span:
        return h, np.zeros(0, np.int64)
    return h, np.lib.stride_tricks.sliding_window_view(h, span).argmin(1) + np.arange(len(h) - span + 1)


def levels(window: int) -> list[int]:
    """Lengths that double up to `window`, halved from it while that gives whole numbers of 25 or more; its half, rounded up, and itself if that gives no other."""
    found = [window]
    while found[0] % 2 == 0 and found[0] // 2 >= 25:
        found.insert(0, found[0] // 2)
    return found if len(found) > 1 else [-(-window // 2), window]


def _scan(df: DataFrame, id_col: str, text_col: str, seed: int, window: int) -> DataFrame:
    """Of each row id, n_words, full_sha256 (of its words joined by a space) and the seed windows that it contributes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas, found = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()
                sizes.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                own = []
                if len(words) >= window:
                    h, at = anchors(word_values(words), seed, window)
                    own = np.unique(h[at]).view(np.int64)
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=[id_col, "n_words", "full_sha256", "anchors"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` bigint, n_words bigint, full_sha256 string, anchors array<bigint>")


def _candidates(texts: DataFrame, seed: int, first: int, length: int) -> DataFrame:
    """The windows of `length` words that are candidates: id, _row, pos, h1, h2.

    At the first extension those whose contributed seed window is in `marks`; later those of which both
    halves are: marks then are places.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, places, one, two = [], [], [], [], []
            for i, (text, marks) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                values = word_values(text.encode().split())
                marks = np.sort(np.array(marks, np.int64))
                if length == first:
                    h, at = anchors(values, seed, length)
                    at = np.flatnonzero(np.isin(h.view(np.int64)[at], marks, assume_unique=False))
                else:
                    at = np.intersect1d(marks, marks - length // 2, assume_unique=True)
                    at = at[at + length <= len(values)]
                h1, h2 = windows(values, length, BASES[0]), windows(mixed(values), length, BASES[1])
                ids.append(np.full(len(at), i))
                rows.append(at)
                one.append(h1[at].view(np.int64))
                two.append(h2[at].view(np.int64))
            take = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            for a in range(0, len(take), 100_000):  # batches of a bounded size
                b = slice(a, a + 100_000)
                at = pa.array(take[b])
                columns = [pa.array(np.concatenate(x)[b]) for x in (rows, one, two)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), columns[0].cast(pa.int32()), *columns[1:]], names=["id", "_row", "pos", "h1", "h2"])

    return texts.select("id", "_row", "text", "marks").mapInArrow(run, "id bigint, _row bigint, pos int, h1 bigint, h2 bigint")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What there is to remove, as two staged tables.

    The first has id, n_words, full_sha256 and `copy` of each row: whether a row of a smaller id has the
    same words, at least `window` of them, so that all of it goes. The second has of other rows from which
    something goes id, text and `places`, where the windows to remove start, counted in words.
    """
    prepare(df.sparkSession)
    lengths = levels(window)
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    scanned = stage(_scan(docs, "id", "text", lengths[0], lengths[1]), "scanned")
    long = scanned.where((F.col("n_words") >= lengths[1]) & F.col("id").isNotNull())
    # staged, as are `repeated` and `owners` below, so that a join's two sides are plain shuffles, of which Spark splits hot keys
    firsts = stage(long.groupBy("full_sha256").agg(F.min("id").alias("_first")), "firsts")
    every = stage(scanned.drop("anchors").join(firsts, "full_sha256", "left").select("id", "n_words", "full_sha256", F.coalesce((F.col("n_words") >= window) & (F.col("id") > F.col("_first")), F.lit(False)).alias("copy")), "every")
    judged = long.join(firsts, "full_sha256").where(F.col("id") == F.col("_first")).select("id", F.explode("anchors").alias("anchor"))
    repeated = stage(judged.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"), "repeated")
    marks = stage(judged.join(repeated, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("marks")), "marks")
    texts = reduced(docs.where(F.col("text").isNotNull()), marks, "id").join(marks, "id")
    texts = stage(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
    release(scanned, firsts, repeated, marks)
    for length in lengths[1:]:
        # staged: the windows are hashed once, though they are grouped and joined
        at = stage(_candidates(texts, lengths[0], lengths[1], length), f"windows-{length}")
        owners = stage(at.groupBy("h1", "h2").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b"), f"owners-{length}")
        kept = at.join(owners, ["h1", "h2"])
        if length == window:
            kept = kept.where(F.col("id") > F.col("a"))
        places = kept.groupBy("_row").agg(F.collect_list("pos").alias("marks"))
        before = texts
        texts = texts.drop("marks").join(places, "_row")
        if length < window:
            texts = stage(texts, f"at-{length}")
            release(before, at, owners)
            if texts.isEmpty():
                break
    return every, texts.select("id", "text", F.col("marks").alias("places"))


def remaining(text: str, places: list[int], window: int) -> tuple[list[bytes], int]:
    """The words outside the windows; how many are inside."""
    words = text.encode().split()
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.array(places, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, x in zip(words, gone.tolist()) if not x], int(gone.sum())


def _trim(found: DataFrame, window: int, with_text: bool) -> DataFrame:
    """id, full_sha256, n_removed, kept_sha256 (and kept) of the rows from which windows go."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left, n = remaining(text, places, window)
                kept = b" ".join(left)
                out.append((hashlib.sha256(b" ".join(text.encode().split())).hexdigest(), n, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "full_sha256", "n_removed", "kept_sha256", "kept"])

    done = found.select("id", "text", "places").mapInArrow(run, "id bigint, full_sha256 string, n_removed bigint, kept_sha256 string, kept string")
    return done.dropDuplicates(["id", "full_sha256"])


def substring_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of each row.

    A word goes if a window that covers it also starts in a row of a smaller id. Windows are judged on the
    input. A null text has no words; a row of a null id loses nothing and costs no other anything; rows of
    one id don't count against each other. Ids are whole numbers. Other columns are not read.
    """
    every, found = find(df, id_col, text_col, window)
    trimmed = _trim(found, window, False).drop("kept")
    out = every.join(trimmed, ["id", "full_sha256"], "left")
    n_removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("copy"), EMPTY_SHA).otherwise(F.coalesce("kept_sha256", "full_sha256"))
    return out.select(F.col("id").alias(id_col), "n_words", n_removed.alias("n_removed"), kept.alias("kept_sha256"))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """df without the repeated words, its columns as they were.

    A text that loses nothing stays as it is; of others the words left stand joined by one space. Rows as
    in substring_report(); all of them stay, if with an empty text.
    """
    every, found = find(df, id_col, text_col, window)
    trimmed = _trim(found, window, True).select("id", "full_sha256", "kept")
    gone = every.where("copy").select("id", "full_sha256", F.lit("").alias("kept")).dropDuplicates(["id", "full_sha256"])
    changed = gone.unionByName(trimmed)
    joined_sha = F.sha2(F.array_join(F.filter(F.split(F.col(f"d.{text_col}"), r"[\x20\x09-\x0D]+"), lambda x: x != ""), " ").cast("binary"), 256)
    out = df.alias("d").join(changed.alias("c"), (F.col(f"d.{id_col}") == F.col("c.id")) & (joined_sha == F.col("c.full_sha256")), "left")
    return out.select(*[F.coalesce("c.kept", f"d.{text_col}").alias(c) if c == text_col else F.col(f"d.`{c}`") for c in df.columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(read(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+{WINDOW - 1}], ' ')) AS h FROM t, unnest(range(1, len(ws) - {WINDOW - 2})) AS r(i)),
f AS (SELECT h, min(doc_id) AS owner FROM w GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM w JOIN f USING (h), unnest(range(0, {WINDOW})) AS r(o) WHERE doc_id > owner),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(coalesce(ps, []), i)), lambda i: ws[i]) AS kept FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {"op2_substring_dedup": ORACLE}
