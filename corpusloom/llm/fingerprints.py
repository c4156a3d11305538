"""Threshold-scaled document fingerprints, in DataFrame operations only.

A fingerprint keeps every five-word shingle whose hash lies below a fixed share of the hash range. So
its size follows the document's, a union of fingerprints is the fingerprint of the union, and the share
of a small document's hashes found in a large one's estimates its containment.

A sketch is a struct of `low`, the least hash of all shingles (null without any), and `kept`, the sorted
distinct hashes below the threshold, of 16 hexadecimal digits: of the shingles of a large collection no two
are likely to share one.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import parts, read

WORDS = 5
SHARE = 0.25
#: Hexadecimal digits of a hash.
DIGITS = 16
SPACES = r"[\x20\x09-\x0D]+"


def _below(share: float) -> str:
    """The first hash that isn't kept."""
    return f"{int(share * 16**DIGITS):0{DIGITS}x}"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def sketch(text: Column, k: int = WORDS, share: float = SHARE) -> Column:
    """The sketch of a text. Of 1 to k-1 words all are one shingle; of none there is none; null counts as empty."""
    below = _below(share)
    shingle = lambda ws, i: F.left(F.md5(F.array_join(F.slice(ws, i, k), " ").cast("binary")), F.lit(DIGITS))
    hashes = lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(1))), lambda i: shingle(ws, i))
    )
    made = lambda hs: F.struct(F.array_min(hs).alias("low"), F.array_sort(F.array_distinct(F.filter(hs, lambda h: h < below))).alias("kept"))
    return _let(_let(words(F.coalesce(text, F.lit(""))), hashes), made)


def as_text(s: Column) -> Column:
    """The sketch as a string: equal sketches give equal strings."""
    return F.concat(F.coalesce(s["low"], F.lit("")), F.lit(":"), F.array_join(s["kept"], ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, 0 to 1. If neither kept a hash, their least hashes decide; two sketches of no shingle are alike."""
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    either = F.size(a["kept"]) + F.size(b["kept"]) - both
    return F.when(either == 0, F.when(a["low"].eqNullSafe(b["low"]), 1.0).otherwise(0.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if a kept none."""
    return F.when(F.size(a["kept"]) > 0, F.size(F.array_intersect(a["kept"], b["kept"])) / F.size(a["kept"]))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    return F.struct(F.least(a["low"], b["low"]).alias("low"), F.array_sort(F.array_union(a["kept"], b["kept"])).alias("kept"))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sketch, fingerprint of each row; ids may be null or repeated; other columns are not read."""
    return df.select(id_col, sketch(F.col(text_col)).alias("sketch")).withColumn("fingerprint", as_text(F.col("sketch")))


def _numbers(values: list) -> Column:
    """An array of whole numbers as one literal, however many there are."""
    return F.split(F.lit(",".join("" if x is None else str(x) for x in values)), ",").try_cast("array<bigint>")


def _place(value: Column, splits: list[int]) -> Column:
    """How many splits are at most the value, by bisection."""
    if not splits:
        return F.lit(0)
    table = _numbers(splits)
    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(splits) + 1))))

    def halve(acc, _):
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        low = F.element_at(table, mid + 1) <= value
        done = acc["lo"] >= acc["hi"]
        return F.struct(F.when(~done & low, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(done | low, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi")), halve, lambda acc: acc["lo"])


def _buckets(key: Column, tie: Column, quantiles: list[int], null_parts: int) -> tuple[Column, int]:
    """The bucket of a row, in the order of (key, tie), nulls first, and how many there are.

    An id that is two quantiles or more holds that share of the rows, and is split by its rows' `tie`, a
    64-bit hash; so are nulls, into `null_parts`.
    """
    spread = lambda n: F.least(F.floor((tie.cast("double") / 2.0**64 + 0.5) * n), n - 1)
    times = Counter(quantiles)
    splits = sorted(times)
    # values below the first split; then of each split its own buckets, if it is hot, and one for what follows
    first, own, n = [null_parts], [0], null_parts + 1
    for x in splits:
        first.append(n)
        own.append(times[x] + 1 if times[x] > 1 else 0)
        n += own[-1] + 1
    at = _place(key, splits) + 1
    first_of, own_of = F.element_at(_numbers(first), at), F.element_at(_numbers(own), at)
    hot = (own_of > 0) & (key == F.element_at(_numbers([0, *splits]), at))
    found = F.when(hot, first_of + spread(own_of)).otherwise(first_of + own_of)
    if null_parts:
        found = F.when(key.isNull(), spread(F.lit(null_parts))).otherwise(found)
    return found.cast("int"), n


def with_next(df: DataFrame, id_col: str, columns: dict[str, Column], tie: Column, buckets: int | None = None) -> DataFrame:
    """df and, as next_<name>, the given columns of the row with the next higher id; the last row's next is the first.

    Ids are dealt by range to buckets, each of which also gets a copy of the first row of the bucket after
    it. So the table is shuffled once, and no task sees more than a bucket. Ids are whole numbers. Null ids
    come first; rows of one id, and of null, are in the order of a hash of `tie`, by which they are split
    if they are many, and then of `tie`.
    """
    n = buckets or parts(df)
    key = F.col(id_col).cast("bigint")
    rows, known = df.agg(F.count("*"), F.count(key)).first()
    quantiles = [int(x) for x in df.where(key.isNotNull()).approxQuantile(id_col, [i / n for i in range(1, n)], 0.25 / n)] if n > 1 and known else []
    bucket, total = _buckets(key, F.col("_tie"), quantiles, math.ceil((rows - known) * n / max(rows, 1)))
    dealt = df.withColumn("_tie", F.xxhash64(tie)).withColumn("_b", bucket)
    least = F.min(F.struct(key.isNotNull().alias("known"), key.alias("id"), F.col("_tie").alias("tie")))
    firsts = {r[0]: r[1] for r in dealt.groupBy("_b").agg(least.alias("first")).collect()}  # a row for each bucket
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    of = lambda values: F.element_at(_numbers(values), F.col("_b") + 1)
    is_first = key.eqNullSafe(of([firsts[b]["id"] if b in firsts else None for b in range(total)])) & (F.col("_tie") == of([firsts[b]["tie"] if b in firsts else None for b in range(total)]))
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy"))
    copy = F.struct(of([before.get(b, 0) for b in range(total)]).cast("int").alias("b"), F.lit(True).alias("copy"))
    dealt = dealt.withColumn("_to", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.select("*", F.col("_to.b").alias("_bucket"), F.col("_to.copy").alias("_copy")).drop("_b", "_to")
    dealt = dealt.repartitionById(total, "_bucket").withColumns({f"_{name}": c for name, c in columns.items()})
    w = Window.partitionBy("_bucket").orderBy("_copy", F.col(id_col).asc_nulls_first(), "_tie", tie)
    found = dealt.withColumns({f"next_{name}": F.lead(f"_{name}").over(w) for name in columns})
    return found.where(~F.col("_copy")).withColumnsRenamed({f"_{name}": name for name in columns}).drop("_bucket", "_copy", "_tie")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by as many (or all) of the following text's first."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def edit_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row its fingerprint, its edited text's, and the likeness of the first to that and to the next row's.

    A null text counts as empty. The only row's next is itself. Rows of one id, or of null, follow each
    other in an order of their texts' hashes. Ids are whole numbers. Other columns are not read. No row, no result.
    """
    docs = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    both = with_next(docs, id_col, {"text": F.col("_text"), "sketch": sketch(F.col("_text"))}, F.col("_text")).drop("_text") if not docs.isEmpty() else docs.selectExpr(f"`{id_col}`", "_text AS text", "_text AS next_text").withColumns({c: sketch(F.col("text")) for c in ("sketch", "next_sketch")})
    both = both.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_sketch", sketch(F.col("edited")))
    return both.select(
        id_col,
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(read(spark, sf_dir, "documents"))


def _oracle_sketch(ws: str) -> str:
    hashes = f"CASE WHEN len({ws}) = 0 THEN [] ELSE list_transform(range(1, greatest(len({ws}) - {WORDS - 2}, 2)), lambda i: left(md5(array_to_string({ws}[i:i+{WORDS - 1}], ' ')), {DIGITS})) END"
    return hashes


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text FROM d),
e AS (SELECT *, left(text, (length(text) - length(text) // 4)::INT) || left(next_text, (length(text) // 4)::INT) AS edited FROM n),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w1, regexp_extract_all(edited, '[^\x20\x09-\x0D]+') AS w2, regexp_extract_all(next_text, '[^\x20\x09-\x0D]+') AS w3 FROM e),
h AS (SELECT doc_id, text, edited, {_oracle_sketch('w1')} AS h1, {_oracle_sketch('w2')} AS h2, {_oracle_sketch('w3')} AS h3 FROM w),
k AS (SELECT *, list_sort(list_distinct(list_filter(h1, lambda h: h < '{_below(SHARE)}'))) AS k1, list_sort(list_distinct(list_filter(h2, lambda h: h < '{_below(SHARE)}'))) AS k2,
  list_sort(list_distinct(list_filter(h3, lambda h: h < '{_below(SHARE)}'))) AS k3, coalesce(list_min(h1), '') AS l1, coalesce(list_min(h2), '') AS l2, coalesce(list_min(h3), '') AS l3 FROM h)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, l1 || ':' || array_to_string(k1, '') AS fingerprint, l2 || ':' || array_to_string(k2, '') AS edited_fingerprint,
  CASE WHEN len(k1) + len(k2) = 0 THEN CASE WHEN l1 = l2 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(k1, k2)) / (len(k1) + len(k2) - len(list_intersect(k1, k2))) END::DOUBLE AS near_edited,
  CASE WHEN len(k1) + len(k3) = 0 THEN CASE WHEN l1 = l3 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(k1, k3)) / (len(k1) + len(k3) - len(list_intersect(k1, k3))) END::DOUBLE AS near_next
FROM k"""

QUERIES = {"op5_fingerprints": op5_fingerprints}
ORACLES = {"op5_fingerprints": ORACLE}
