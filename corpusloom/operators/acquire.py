"""From search hits to what is fetched next, and what became of it.

Tables without rows give tables without rows (totals of 0). Hits of equal place are in any order. Null ids
are one id to dedup_works and held by nobody; a null success is a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_PDF_BYTES = 10_000
#: A server's failure, after which trying again makes sense, has this status or a higher one; others are for good.
RETRY_FROM = 500


def union_hits(*searches: DataFrame) -> DataFrame:
    """The hits of several searches in one; a column that a search lacks is null in its rows. Repeated rows stay."""
    first, *more = searches
    for x in more:
        first = first.unionByName(x, allowMissingColumns=True)
    return first


def cap_per_term(hits: DataFrame, n: int) -> DataFrame:
    """The first n hits of each term, in the order of the search."""
    w = Window.partitionBy("term_ord").orderBy("hit_ord")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def dedup_works(hits: DataFrame, id_col: str = "id", value: str = "work") -> DataFrame:
    """A row an id: the value of its last hit at the place of its first. Partial aggregation, no window."""
    at = F.struct("term_ord", "hit_ord")
    return hits.groupBy(id_col).agg(F.min(at).alias("first_at"), F.max_by(value, at).alias(value))


def not_held(candidates: DataFrame, held: DataFrame, id_col: str = "id") -> DataFrame:
    """Candidates whose id isn't among those held."""
    return candidates.join(held.select(id_col), id_col, "left_anti")


def most_cited(candidates: DataFrame, k: int, citations: str = "citations", order: str = "first_at") -> DataFrame:
    """The k most cited; equal ones in the order they were found. A top-k, not a full sort."""
    return candidates.orderBy(F.desc(citations), order).limit(max(k, 0))


def add_terms(defaults: DataFrame, custom: DataFrame) -> DataFrame:
    """Default terms as they are, then custom ones that aren't there yet, whatever their case; the first of equals."""
    low = F.lower("term")
    new = custom.withColumn("_low", low).groupBy("_low").agg(F.min(F.struct("term_ord", "term")).alias("t"))
    new = new.join(defaults.select(low.alias("_low")), "_low", "left_anti").select("t.term_ord", "t.term")
    return defaults.select(F.lit(False).alias("custom"), "term_ord", "term").unionAll(new.select(F.lit(True).alias("custom"), "term_ord", "term"))


def is_pdf(length: Column, content: Column) -> Column:
    """At least MIN_PDF_BYTES bytes that begin as a PDF file does."""
    return F.coalesce((length >= MIN_PDF_BYTES) & (F.substring(content, 1, 5) == F.lit("%PDF-").cast("binary")), F.lit(False))


def http_class(status: Column) -> Column:
    """Whether trying again makes sense."""
    return F.when(status >= RETRY_FROM, "retry").otherwise("permanent")


def attempt_outcome(attempts: DataFrame, max_retries: int = 2) -> DataFrame:
    """What came of each location, from its attempts (id, loc_ord, attempt, status, is_pdf).

    The first attempt, of max_retries, that succeeds or fails for good decides; `status` null is a lost
    connection, which is tried again. No attempt at all is an unknown failure.
    """
    result = F.when(F.col("status").isNull(), "connection").when((F.col("status") == 200) & F.col("is_pdf"), "success").when(F.col("status") == 200, "not_a_pdf").when(http_class(F.col("status")) == "retry", "retry").otherwise("http_error")
    rows = attempts.where(F.col("attempt") <= max_retries).withColumn("result", result)
    final = F.when(~F.col("result").isin("retry", "connection"), F.struct("attempt", "result"))
    out = rows.groupBy("id", "loc_ord").agg(F.min(final).alias("final"), F.max(F.struct("attempt", "result")).alias("last"))
    return out.select("id", "loc_ord", F.coalesce("final.result", "last.result").alias("result"), F.coalesce("final.attempt", "last.attempt").alias("tries"))


def first_success(outcomes: DataFrame) -> DataFrame:
    """Of each id the first location that succeeded, null if none did, and how many were tried until then."""
    won = F.min(F.when(F.col("result") == "success", F.col("loc_ord")))
    return outcomes.groupBy("id").agg(won.alias("won"), F.coalesce(won + 1, F.max("loc_ord") + 1).alias("tried"))


def daily_quota(events: DataFrame, per_day: int) -> DataFrame:
    """Of each day how many new downloads there were and how many are left."""
    counted = events.groupBy("day").agg(F.count(F.when(F.col("new"), 1)).alias("downloads"))
    return counted.withColumn("remaining", F.greatest(F.lit(per_day) - F.col("downloads"), F.lit(0)))


def route(results: DataFrame) -> DataFrame:
    """results (success, new_download) and the log each goes to: the manifest counts new ones, failures are tried again next time."""
    return results.withColumn("log", F.when(F.col("success"), "manifest").otherwise("failed")).withColumn("counted", F.coalesce(F.col("success") & F.col("new_download"), F.lit(False)))


def run_totals(results: DataFrame) -> DataFrame:
    """How many succeeded and how many failed; a null success is a failure."""
    done = F.coalesce(F.col("success"), F.lit(False))
    return results.agg(F.count_if(done).alias("successful"), F.count_if(~done).alias("failed"))
