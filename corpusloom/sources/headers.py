"""Folders of files listed by their first bytes: what is read grows with the number of files, not with their size."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.operators.acquire import MIN_PDF_BYTES
from corpusloom.sources.files import stem

#: Fixed value: how a PDF file begins.
MAGIC = b"%PDF-"
#: Files of a partition.
SLICE = 2000


class HeadersSource(DataSource):
    """spark.read.format("headers").option("path", a folder).load(): path, length, modified and head, the first `bytes` bytes, of its files.

    Other options: suffix (of names), least (files of fewer bytes aren't opened, and have a null head),
    slice (files of a partition). The folder is a path, or a URI of a store that pyarrow reads; its
    subfolders aren't looked into. A file that can't be read has a null head. A missing folder has no files.
    """

    @classmethod
    def name(cls) -> str:
        return "headers"

    def schema(self) -> str:
        return "path string, length bigint, modified timestamp, head binary"

    def reader(self, schema) -> DataSourceReader:
        return HeadersReader(dict(self.options))


class HeadersReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.suffix, self.bytes = options.get("suffix", ""), int(options.get("bytes", len(MAGIC)))
        self.least, self.slice = int(options.get("least", 0)), int(options.get("slice", SLICE))

    def _store(self):
        from pyarrow.fs import FileSystem, LocalFileSystem

        return FileSystem.from_uri(self.folder) if "://" in self.folder else (LocalFileSystem(), self.folder.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        """Slices of the listing, by name; made once, on the driver."""
        from pyarrow.fs import FileSelector, FileType

        store, folder = self._store()
        found = store.get_file_info(FileSelector(folder, allow_not_found=True))
        files = sorted((x.path, x.size, x.mtime_ns) for x in found if x.type == FileType.File and x.base_name.endswith(self.suffix) and not x.base_name.startswith((".", "_")))
        return [InputPartition(files[i : i + self.slice]) for i in range(0, len(files), self.slice)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = self._store()
        for path, length, modified in partition.value:
            head = None
            if length >= self.least:
                try:
                    with store.open_input_file(path) as f:
                        head = f.read_at(min(self.bytes, length), 0)
                except OSError:
                    pass
            yield path, length, datetime.fromtimestamp(modified / 1e9), head


def list_headers(spark: SparkSession, folder: str, suffix: str = ".pdf", slice_: int = SLICE) -> DataFrame:
    """path, length, modified, doc_id, valid of a folder's files; of each at most five bytes are read, of those too short for a PDF none."""
    spark.dataSource.register(HeadersSource)
    files = spark.read.format("headers").options(path=folder, suffix=suffix, least=str(MIN_PDF_BYTES), slice=str(slice_)).load()
    return files.select("path", "length", "modified", stem().alias("doc_id"), F.coalesce(F.col("head") == F.lit(MAGIC), F.lit(False)).alias("valid"))
