"""Search hits of a bibliographic service: from a dump, by a search that is given, or over HTTP.

A term without hits, or whose first page fails, gives no row; rows that are no JSON are null works.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

from corpusloom.operators.metadata import WORK_SCHEMA
from corpusloom.sources.files import put_file

#: Fixed value: works of a page.
PAGE = 100
#: fetch(term, cursor) -> (works as JSON strings, next cursor or None); raises on failure.
Fetch = Callable[[str, str], tuple[list[str], str | None]]


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Works from JSON lines; what isn't in the schema is left out."""
    return spark.read.schema(WORK_SCHEMA).json(path)


def parse_works(df: DataFrame, json_col: str = "json") -> DataFrame:
    return df.withColumn("work", F.from_json(json_col, WORK_SCHEMA, {"mode": "PERMISSIVE"})).drop(json_col)


def hits_of(term: str, fetch: Fetch, cap: int) -> list[str]:
    """A term's first `cap` hits: pages until the cap, an empty page, no cursor or a failure. What came before a failure stays."""
    found: list[str] = []
    cursor: str | None = "*"
    while cursor and len(found) < cap:
        try:
            page, cursor = fetch(term, cursor)
        except Exception:  # noqa: BLE001
            break
        if not page:
            break
        found += page
    return found[:cap]


def search(terms: DataFrame, fetch: Fetch, cap: int = 100) -> DataFrame:
    """term_ord, hit_ord, json of each term's first `cap` hits, by a function that fetches a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for term_ord, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = hits_of(term, fetch, cap)
                columns = [pa.array([term_ord] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["term_ord", "hit_ord", "json"])

    # a term a task: searching waits for the service
    rows = terms.select(F.col("term_ord").cast("int").alias("term_ord"), "term").repartition("term_ord")
    return rows.mapInArrow(run, "term_ord int, hit_ord int, json string")


class WorksSource(DataSource):
    """The hits of terms, a partition for each: by hits(), or as a stream that goes on from page to page by search_on().

    Options: url, terms (a JSON list), cap (hits of a term), contact, key, per_page, timeout, and `pages`, a
    folder that all executors have mounted, where every page is kept once it has come, so that none is asked
    for twice. The cursors of all terms are the stream's offset.
    """

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return "term_ord int, hit_ord int, json string, term string"

    def reader(self, schema) -> DataSourceReader:
        return WorksReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return WorksStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known, and let filters come down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorksSource)


def hits(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """term_ord, hit_ord, json, term of the hits of terms. A filter on `term` or `term_ord` asks for those terms alone."""
    register(spark)
    # Spark 4.1 keeps the filters that came down to a loaded source until others come: so that none of an earlier
    # query is left, each has one
    return spark.read.format("works").options(**options).load().where("term_ord >= 0")


def fetch_of(options: dict[str, str]) -> Fetch:
    """fetch(term, cursor) by the source's options."""
    get = options.get
    fetch = http_fetch(options["url"], get("contact"), get("key"), int(get("per_page", PAGE)), float(get("timeout", 60)))
    return keeping(fetch, options["pages"]) if get("pages") else fetch


def keeping(fetch: Fetch, folder: str) -> Fetch:
    """The same pages, each kept as a file of the folder and read from it from then on; failures aren't kept."""

    def kept(term: str, cursor: str) -> tuple[list[str], str | None]:
        path = f"{folder}/{hashlib.sha1(json.dumps([term, cursor]).encode()).hexdigest()}.json"
        try:
            with open(path, encoding="utf-8") as f:
                works, after = json.load(f)
        except (OSError, ValueError):
            works, after = fetch(term, cursor)
            put_file(lambda f: f.write(json.dumps([works, after]).encode()), path)
        return works, after

    return kept


class WorksReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.terms = list(enumerate(json.loads(options["terms"])))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Terms that a filter leaves out are never asked for; Spark judges the rows by all other filters."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute not in (("term",), ("term_ord",)):
                yield f
            else:
                at = 1 if f.attribute == ("term",) else 0
                self.terms = [x for x in self.terms if x[at] in wanted]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in self.terms] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, int, str, str]]:
        if partition.value is None:
            return
        term_ord, term = partition.value
        for hit_ord, hit in enumerate(hits_of(term, fetch_of(self.options), int(self.options.get("cap", 100)))):
            yield term_ord, hit_ord, hit, term


#: Terms that a stream asks for at a time.
AT_ONCE = 6


class WorksStream(SimpleDataSourceStreamReader):
    """A page of each term that isn't at its end, batch by batch.

    The offset has of each term the next cursor (empty at the end), and how many hits there were. A term whose
    page fails stays where it is until the stream is started again.
    """

    def __init__(self, options: dict[str, str]):
        self.terms: list[str] = json.loads(options["terms"])
        self.fetch, self.cap = fetch_of(options), int(options.get("cap", 100))
        self.failed: set[int] = set()

    def initialOffset(self) -> dict:
        return {"cursors": ["*"] * len(self.terms), "hits": [0] * len(self.terms)} | {"version": 1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        todo = [i for i, cursor in enumerate(start["cursors"]) if cursor and i not in self.failed]
        end = {"cursors": list(start["cursors"]), "hits": list(start["hits"]), "version": 1}
        rows: list[tuple] = []
        with ThreadPoolExecutor(AT_ONCE) as threads:
            for i, page in zip(todo, threads.map(lambda i: self._page(i, start["cursors"][i]), todo)):
                if page is None:
                    self.failed.add(i)
                    continue
                works, after = page
                works = works[: self.cap - start["hits"][i]]
                rows += [(i, start["hits"][i] + k, x, self.terms[i]) for k, x in enumerate(works)]
                end["hits"][i] += len(works)
                end["cursors"][i] = after if works and after and end["hits"][i] < self.cap else ""
        return iter(rows), end

    def _page(self, i: int, cursor: str) -> tuple[list[str], str | None] | None:
        try:
            return self.fetch(self.terms[i], cursor)
        except Exception:  # noqa: BLE001  as in hits_of
            return None

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages of a batch once more, after a failure; with `pages` they are read from there."""
        for i, cursor in enumerate(start["cursors"]):
            if n := end["hits"][i] - start["hits"][i]:
                works, _ = self.fetch(self.terms[i], cursor)
                for k, x in enumerate(works[:n]):
                    yield i, start["hits"][i] + k, x, self.terms[i]


def search_on(spark: SparkSession, options: dict[str, str], out: str, checkpoint: str) -> DataFrame:
    """Search until every term is at its end or has failed, and append the hits to a table; gives the table.

    A search that was stopped goes on at the cursors of its checkpoint; one that is done asks for nothing.
    """
    register(spark)
    query = spark.readStream.format("works").options(**options).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(WorksSource({}).schema()).parquet(out)


def http_fetch(base_url: str, contact: str | None = None, key: str | None = None, per_page: int = PAGE, timeout: float = 60.0) -> Fetch:
    """fetch(term, cursor) over HTTP: a page of works and the cursor of the next. Whatever isn't a 200 is raised, which ends the term."""

    def fetch(term: str, cursor: str) -> tuple[list[str], str | None]:
        from urllib.parse import urlencode  # here, as the function is sent to workers without its module
        from urllib.request import Request, urlopen

        ask = {"search": term, "per_page": per_page, "cursor": cursor} | ({"api_key": key} if key else {})
        request = Request(f"{base_url}?{urlencode(ask)}", headers=session_headers(contact))
        with urlopen(request, timeout=timeout) as answer:  # noqa: S310
            if answer.status != 200:
                raise OSError(f"HTTP {answer.status}")
            page = json.load(answer)
        return [json.dumps(x, ensure_ascii=False) for x in page.get("results") or []], (page.get("meta") or {}).get("next_cursor")

    return fetch


def session_headers(contact: str | None = None) -> dict[str, str]:
    """Headers of a polite client."""
    agent = "corpusloom/1.0" + (f" (mailto:{contact})" if contact else "")
    return {"User-Agent": agent, "Accept": "application/json"}
