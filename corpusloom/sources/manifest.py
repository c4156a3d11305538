"""An index of the ids of a log: compacted, in parts by hash, with Bloom filters, so that few files tell which ids are held.

The log stays what is written to. compact() takes the runs that it has been given since into a new version of
the index, which readers find by a pointer that is switched last; so a reader sees one whole version. What
has not been compacted yet is read from the log.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.acquire import not_held
from corpusloom.sources.state import exists, read_text, valid_ids, write_text

#: Ids of a part, about, and the fewest and most parts.
PART_IDS, LEAST_PARTS, MOST_PARTS = 50_000, 16, 1 << 16
#: Candidates whose parts alone are read, of more all are; those whose hashes are looked up in Bloom filters.
LITERALS, LOOKED_UP = 20_000, 64
POINTER = "current.json"


def _hash(id_: Column) -> Column:
    return F.xxhash64(id_)


def _part(hash_: Column, parts: int) -> Column:
    return F.pmod(hash_, F.lit(parts)).cast("int")


def log_files(spark: SparkSession, log: str) -> list[str]:
    """The log's runs (their folders) and files that are no run's, by name; those still being written aren't among them."""
    if not exists(spark, log):
        return []
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(x.getPath().getName() for x in found if not x.getPath().getName().startswith(("_", ".")))


def _pointer(spark: SparkSession, index: str) -> dict:
    """The current version, how many ids and parts it has, and which files of the log it holds."""
    text = read_text(spark, f"{index}/{POINTER}")
    return json.loads(text) if text else {"version": None, "files": [], "ids": 0, "parts": LEAST_PARTS}


def _log_ids(spark: SparkSession, log: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], "id string")
    return valid_ids(spark.read.option("recursiveFileLookup", "true").text([f"{log}/{x}" for x in names]))


def _index_ids(spark: SparkSession, index: str, at: dict) -> DataFrame:
    """id, hash, part of the index."""
    if at["version"] is None:
        return spark.createDataFrame([], "id string, hash bigint, part int")
    return spark.read.schema("id string, hash bigint, part int").parquet(f"{index}/{at['version']}")


def compact(spark: SparkSession, log: str, index: str) -> int:
    """Take what is new in the log into the index; how many ids it has then. Without anything new nothing is written.

    A compaction that is broken off leaves the version before it; two at a time leave that of one, and the
    other's runs are still read from the log. The version before is kept for those that read it, older ones go.
    """
    at = _pointer(spark, index)
    names = log_files(spark, log)
    new = [x for x in names if x not in set(at["files"])]
    if not new and at["version"] is not None:
        return at["ids"]
    recent = _log_ids(spark, log, new)
    n = at["ids"] + recent.count()
    parts = min(MOST_PARTS, max(LEAST_PARTS, 1 << (n // PART_IDS).bit_length()))
    ids = _index_ids(spark, index, at).select("id").unionAll(recent).distinct()
    rows = ids.withColumn("hash", _hash(F.col("id"))).withColumn("part", _part(F.col("hash"), parts))
    version = uuid.uuid4().hex
    writer = rows.repartition("part").sortWithinPartitions("part", "hash").write.partitionBy("part")
    for column in ("hash", "id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(max(1000, 2 * n // parts)))
    writer.parquet(f"{index}/{version}")
    held = spark.read.parquet(f"{index}/{version}").count()
    write_text(spark, f"{index}/{POINTER}", json.dumps({"version": version, "before": at["version"], "files": names, "ids": held, "parts": parts}))
    if at.get("before"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{index}/{at['before']}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return held


def held_ids(spark: SparkSession, log: str, index: str, candidates: DataFrame, id_col: str = "id") -> DataFrame:
    """The ids of the log that candidates may have: of the index the parts that their hashes lead to, and what isn't compacted.

    The hashes of up to LITERALS different candidates are collected for that; few ones also go to the readers, which
    skip the row groups whose Bloom filters don't know them. For more candidates all of the index is given.
    """
    at = _pointer(spark, index)
    recent = _log_ids(spark, log, [x for x in log_files(spark, log) if x not in set(at["files"])])
    known = _index_ids(spark, index, at)
    hashes = [r[0] for r in candidates.where(F.col(id_col).isNotNull()).select(_hash(F.col(id_col).cast("string"))).distinct().limit(LITERALS + 1).collect()]
    if len(hashes) <= LITERALS:
        known = known.where(F.col("part").isin(sorted({x % at["parts"] for x in hashes})))
    if len(hashes) <= LOOKED_UP:
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LOOKED_UP))
        known = known.where(F.col("hash").isin(hashes))
    return known.select("id").unionAll(recent)


def not_in_manifest(candidates: DataFrame, log: str, index: str, id_col: str = "id") -> DataFrame:
    """Candidates whose id the log doesn't have, by its index. Null ids are held by nobody; a log or index that isn't there holds nothing."""
    held = held_ids(candidates.sparkSession, log, index, candidates, id_col)
    return not_held(candidates, held.select(F.col("id").alias(id_col)), id_col)
