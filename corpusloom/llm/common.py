"""What the operators share: reading, held-out splits, staging in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python, so that a batch of long texts stays small.
BATCH_ROWS = 256

#: ASCII white space, which separates words; bytes.split() without arguments splits at the same.
WORD_RE = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, by any path that Spark can read."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column, n: int, left: int) -> Column:
    """True where the remainder is `left`, or the id is null: such rows are never learned from."""
    return F.coalesce(remainder(doc_id, n) == left, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's `spark.checkpoint.dir`.

    Where it is unset, a temporary folder on a local master, whose executors are this process; on any
    other master an error, because executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get("path")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = _own_dir["path"] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


#: The folder made where the session names none.
_own_dir: dict[str, str] = {}
#: Staged tables that are still there: path -> what deletes it.
_staged: dict = {}


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, executors may be lost.

    The table goes with release(), or at the end of the driver's Python.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{uuid.uuid4().hex}/{label}"
    if not _staged:
        atexit.register(lambda: [_delete(x) for x in list(_staged)])
    _staged[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_path = path
    return found


def _delete(path: str) -> None:
    jvm, conf = _staged.pop(path)
    with contextlib.suppress(Exception):  # what can't be deleted is left over, no more
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no result needs any more: all that read them is staged itself."""
    for x in tables:
        if getattr(x, "_staged_path", None) in _staged:
            _delete(x._staged_path)


def parts(df: DataFrame) -> int:
    """Partitions for a shuffle of about the input's size: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keep_first(kept: dict, share: int = 4) -> None:
    """Make room in a cache: the first that came stay, which the frequent ones are in."""
    first = list(itertools.islice(kept.items(), len(kept) // share))
    kept.clear()
    kept.update(first)


#: Bits of the reducer below: 1 MB, whatever the data.
REDUCER_BITS = 1 << 23


def reduced(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df that may have a key of `keys`, found without a shuffle of df.

    A bitmap of REDUCER_BITS hashed keys is broadcast, as at most REDUCER_BITS / 64 rows. Rows that it
    lets pass by chance are harmless before a join; with very many keys it lets all pass.
    """
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(REDUCER_BITS))
    words = keys.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("b") % 64).cast("int"))).alias("_bits"))
    marked = df.withColumn("_word", F.floor(bit / 64)).join(F.broadcast(words), "_word")
    return marked.where(F.call_function("shiftrightunsigned", F.col("_bits"), (bit % 64).cast("int")) % 2 != 0).drop("_word", "_bits")
