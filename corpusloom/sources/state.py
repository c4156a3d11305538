"""Logs of what was fetched: append-only tables of JSON lines, from which ids and quotas follow.

A log or a state that isn't there is one without rows. Lines that can't be read are passed over. What a run
appends is a folder of the run's name, so that appending it again changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or a folder, in whatever store Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def valid_ids(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Distinct non-empty ids of JSON lines; lines that are no JSON object or have no id are passed over."""
    found = F.get_json_object(line_col, "$.id")
    return lines.select(found.alias("id")).where("id is not null and id <> ''").distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a log; none if it isn't there."""
    return valid_ids(read_log(spark, path)) if exists(spark, path) else spark.createDataFrame([], "id string")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log, of all runs."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def _append(rows: DataFrame, path: str, run: str | None):
    return (rows.write.mode("append"), path) if run is None else (rows.write.mode("overwrite"), f"{path}/{run}")


def append_log(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Append rows as JSON lines, null fields and all; Spark's commit makes it all or nothing. A run's rows replace those that it has appended before."""
    writer, where = _append(rows, path, run)
    writer.option("ignoreNullFields", "false").json(where)


def write_records(rows: DataFrame, path: str, version: Column | None = None, run: str | None = None) -> None:
    """Add records (with `id`) to a table, each stamped with its version: the time, unless one is given.

    Nothing else is rewritten, so a reader never sees half a record; read_records() has the last of each id.
    A run's records replace those that it has added before.
    """
    writer, where = _append(rows.withColumn("_version", (F.current_timestamp() if version is None else version).cast("timestamp")), path, run)
    writer.parquet(where)


def latest(records: DataFrame, version_col: str) -> DataFrame:
    """Of each id the record of the highest version; of equal ones any. Aggregated before rows are shuffled."""
    return records.groupBy("id").agg(F.max_by(F.struct(*[c for c in records.columns if c != "id"]), version_col).alias("_r")).select("id", "_r.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Of each id the record that was written last."""
    return latest(spark.read.option("recursiveFileLookup", "true").parquet(path), "_version").drop("_version")


def remaining_today(state_date: Column, downloads: Column, today: Column, per_day: int) -> Column:
    """How many downloads a day's state leaves; another day's, or a null one, counts for nothing."""
    return F.greatest(F.lit(per_day) - F.when(state_date == today, F.coalesce(downloads, F.lit(0))).otherwise(0), F.lit(0))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, null if it isn't there.

    Where a store can't replace a file at once, a writer that was stopped has left the whole new one beside it.
    """
    for name in (path, path + ".part"):
        if exists(spark, name):
            line = spark.read.text(name, wholetext=True).first()
            return line[0] if line else ""
    return None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside the old one, then put it in its place, at once where the store can: read_text() finds either."""
    context = spark.sparkContext
    fs = context._jvm.org.apache.hadoop.fs
    part, where = fs.Path(path + ".part"), fs.Path(path)
    conf = context._jsc.hadoopConfiguration()
    out = where.getFileSystem(conf).create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = context._gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    files = fs.FileContext.getFileContext(where.toUri(), conf) if where.toUri().getScheme() else fs.FileContext.getFileContext(conf)
    files.rename(part, where, overwrite)


def load_state(spark: SparkSession, path: str, today: str) -> dict:
    """The day's counter (date, downloads), and a run that was begun and not ended (run, reserved), of whatever day.

    Missing, unreadable or another day's state is a new one, which is saved; an unreadable one is left for
    a human to see.
    """
    fresh = {"date": today, "downloads": 0}
    text = read_text(spark, path)
    if text is not None:
        try:
            found = json.loads(text)
            begun = {"run": str(found["run"]), "reserved": int(found["reserved"])} if found.get("run") else {}
            if found.get("date") == today:
                return fresh | {"downloads": int(found.get("downloads") or 0)} | begun
            fresh |= begun
        except (AttributeError, KeyError, TypeError, ValueError):
            return fresh
    save_state(spark, path, fresh)
    return fresh


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """The counter, as write_text() writes it."""
    write_text(spark, path, json.dumps(state))
