"""Repetition coverage: quality rules from rolling hashes of several n-gram lengths.

A document's words are hashed to 64 bits; the hash of an n-gram follows from that of the (n-1)-gram at
the same place, h_n[i] = B * h_{n-1}[i] + v[i+n-1] mod 2**64, for all places at once in numpy. Places
that share a hash hold the same n-gram. A document is kept if little of it lies inside repeated
n-grams and lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import prepare, read

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Repeated n-grams of these lengths are measured; the first is also the window of n_repeat_words.
LENGTHS = (5, 6, 7, 8, 9, 10)


@dataclass(frozen=True)
class RuleLimits:
    """Documents beyond one of these are dropped. Shares are of word_chars, in percent."""

    min_words: int = 10
    max_repeat_words: int = 20
    #: characters inside n-grams that were seen before, by n-gram length
    max_ngram_chars: dict = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    #: characters inside lines that were seen before
    max_line_chars: int = 20


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
COLUMNS += [f"dup_chars_{n}" for n in LENGTHS]


def _seen(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash occurs twice or more, and those of them that aren't the first."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    later = np.zeros(len(hashes), bool)
    later[order[1:][same]] = True
    repeated = later.copy()
    repeated[order[:-1][same]] = True
    return repeated, later


def _cover(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """The words inside windows of n words at the given places."""
    edge = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> list[int]:
    """COLUMNS of one text; null counts as empty."""
    data = (text or "").encode()
    words = data.split()
    n_words = len(words)
    word_chars = len(text or "") - (len(data) - len(data.translate(None, SPACES)))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_dup_lines = dup_line_chars = 0
    if len(lines) > len(set(lines)):
        known: set[bytes] = set()
        for x in lines:
            if x in known:
                n_dup_lines += 1
                dup_line_chars += len(x.translate(None, SPACES).decode())
            known.add(x)
    dup_chars = [0] * len(LENGTHS)
    n_repeat_words = 0
    if n_words > LENGTHS[0]:
        v = np.fromiter(map(hash, words), np.int64, n_words).view(np.uint64)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        base = np.uint64(0x9E3779B97F4A7C15)
        h, at, sizes = v, 1, None
        for k, n in enumerate(LENGTHS):
            if n_words < n:
                break
            while at < n:
                h = h[:-1] * base + v[at:]
                at += 1
            repeated, later = _seen(h)
            if not later.any():  # then longer n-grams don't repeat either
                break
            if k == 0:
                n_repeat_words = int(_cover(repeated, n, n_words).sum())
                sizes = np.fromiter((len(w.decode()) for w in words), np.int64, n_words)
            dup_chars[k] = int(sizes[_cover(later, n, n_words)].sum())
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, *dup_chars]


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: RuleLimits | None = None) -> DataFrame:
    """Measures and verdict of each row: id, COLUMNS (long), base_failed, kept.

    One row in, one row out, ids as they are (null and repeated ones too); other columns are not read.
    A null text counts as empty: all measures are 0, base_failed is true and kept is false.
    """
    limits = limits or RuleLimits()
    prepare(df.sparkSession)

    def run(batches):
        for batch in batches:
            got = [measure(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in (zip(*got) if got else [[]] * len(COLUMNS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *COLUMNS])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COLUMNS)
    found = df.select(id_col, text_col).mapInArrow(run, schema)
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_words * F.col("n_words"))
    good = 100 * F.col("dup_line_chars") <= limits.max_line_chars * F.col("word_chars")
    for n, most in limits.max_ngram_chars.items():
        good &= 100 * F.col(f"dup_chars_{n}") <= most * F.col("word_chars")
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    grams = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, g) AS c"
        f" FROM (SELECT doc_id, i, ws[i:i+{n - 1}] AS g FROM t, unnest(range(1, len(ws) - {n - 2})) AS r(i))"
        for n in LENGTHS
    )
    picks = ", ".join(f"coalesce(sum(len(ws[p])) FILTER (n = {n} AND later), 0)::BIGINT AS dup_chars_{n}" for n in LENGTHS)
    limits = RuleLimits()
    good = " AND ".join(f"100 * dup_chars_{n} <= {m} * word_chars" for n, m in limits.max_ngram_chars.items())
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS ({grams}),
covered AS (SELECT DISTINCT g.doc_id, g.n, g.i + o AS p, g.k > 1 AS later FROM grams g, unnest(range(0, g.n)) AS r(o) WHERE g.c > 1),
marks AS (SELECT c.doc_id, count(DISTINCT p) FILTER (n = {LENGTHS[0]})::BIGINT AS n_repeat_words, {picks} FROM covered c JOIN t USING (doc_id) GROUP BY c.doc_id),
line AS (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
lines AS (SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines, sum((c - 1) * len(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS dup_line_chars FROM line GROUP BY doc_id),
measures AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in LENGTHS)}
  FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN marks USING (doc_id))
SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_words} * n_words AS base_failed,
  NOT (n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_words} * n_words) AND 100 * dup_line_chars <= {limits.max_line_chars} * word_chars AND {good} AS kept
FROM measures"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": _oracle()}
