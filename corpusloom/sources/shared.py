"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: The folder made where the session names none.
_own: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new place below the session's `spark.checkpoint.dir`, for tables that a query makes on its way.

    Where the session names none, it is below a temporary folder on a local master, whose executors are this
    process, and an error on any other. It goes at the end of the driver's Python.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get("path")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {spark.sparkContext.master} share")
        folder = _own["path"] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder.rstrip('/')}/corpusloom/{label}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def gone() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended; what is left is no harm
            pass

    atexit.register(gone)
    return path
