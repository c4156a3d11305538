"""The place of each row in its batch, and how far a run has come."""

from __future__ import annotations

import contextlib
import math
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Progress:
    """What a run is at: `index` of `total` records are done, `failed` of them in vain; `done` with the last one."""

    message: str
    index: int = 0
    total: int = 0
    failed: int = 0
    done: bool = False


Report = Callable[[Progress], None]

#: Seconds between two looks at how many tasks are done.
LOOK = 1.0


@contextlib.contextmanager
def reporting(spark: SparkSession, message: str, report: Report | None) -> Iterator[None]:
    """Report, while the jobs of the block run, how many of their tasks are done and how many failed."""
    if report is None:
        yield
        return
    context, group, over, said = spark.sparkContext, uuid.uuid4().hex, threading.Event(), set()
    tracker = context.statusTracker()

    def look() -> None:
        stages = {x for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for x in job.stageIds}
        known = [x for x in map(tracker.getStageInfo, stages) if x]
        at = Progress(message, sum(x.numCompletedTasks for x in known), sum(x.numTasks for x in known), sum(x.numFailedTasks for x in known))
        if known and at not in said:
            said.add(at)
            report(at)

    def watch() -> None:
        while not over.wait(LOOK):
            look()

    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, message)
    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        context.setLocalProperty("spark.jobGroup.id", before)
    look()

#: Rows of a range that one task numbers, about.
RANGE_ROWS = 200_000


def _place(value: Column, splits: list, kind: str = "bigint") -> Column:
    """How many of the sorted splits are at most the value, by bisection on one literal."""
    table = F.split(F.lit("\0".join(map(str, splits))), "\0").cast(f"array<{kind}>")

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        done, low = acc["lo"] >= acc["hi"], F.element_at(table, mid + 1) <= value
        return F.struct(F.when(~done & low, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(done | low, acc["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(splits) + 1))))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi")), halve, lambda acc: acc["lo"])


def numbered(df: DataFrame, key_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """key, index (from 1, by key, nulls last), total of each row.

    Keys are whole numbers. Rows are dealt into ranges between quantiles, each of which is numbered by
    itself; the rows of one key, or of null, are interchangeable and are numbered by their count alone, so
    that a key that many rows have is no one task's. No rows give no rows.
    """
    key = F.col(key_col).cast("bigint")
    counts = df.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"))
    total, distinct = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    n = math.ceil(distinct / range_rows)
    splits = sorted({int(x) for x in df.where(key.isNotNull()).approxQuantile(key_col, [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    counts = counts.withColumn("_range", F.when(F.col("_key").isNull(), len(splits) + 1).otherwise(_place(F.col("_key"), splits) if splits else 0))
    inside = Window.partitionBy("_range").orderBy(F.col("_key").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("_range").agg(F.sum("_n").alias("_size"))  # a row for each range
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    placed = counts.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(before, "_range")
    # a key's rows in parts, so that no row of the plan stands for too many
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / range_rows)))
    parts = placed.withColumn("_part", part).repartition("_key", "_part").withColumn("_rows", F.least(F.lit(range_rows), F.col("_n") - F.col("_part") * range_rows))
    one = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows").cast("bigint")))
    return parts.withColumn("_i", one).select(
        F.col("_key").alias(key_col), (F.col("_before") + F.col("_first") + F.col("_part") * range_rows + F.col("_i")).cast("bigint").alias("index"), F.lit(total).cast("bigint").alias("total")
    )


#: Keys looked at for each range of texts, about.
PER_RANGE = 20


def numbered_texts(df: DataFrame, key_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """key, index (from 1, by key), total of each row; keys are texts, and those of equal ones in any order.

    Rows are dealt into ranges between some of the keys, chosen by their hash, so that the same rows are
    dealt alike however often they are looked at, and each range is numbered by itself. No rows give no rows.
    """
    keys, key = df.select(key_col), F.col(key_col)
    total = keys.count()
    n = math.ceil(total / range_rows)
    splits = []
    if n > 1:
        share = max(1, total // (n * PER_RANGE))  # the driver gets about PER_RANGE keys a range
        some = sorted((r[0] for r in keys.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).distinct().collect() if r[0] is not None), key=lambda x: x.encode())
        splits = some[PER_RANGE::PER_RANGE]
    dealt = keys.withColumn("_range", _place(key, splits, "string") if splits else F.lit(0))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return dealt.withColumn("_i", place).join(before, "_range").select(key_col, (F.col("_before") + F.col("_i")).cast("bigint").alias("index"), F.lit(total).cast("bigint").alias("total"))
