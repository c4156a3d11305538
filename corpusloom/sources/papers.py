"""Fetching into a folder of papers as a Spark sink, with an outcome kept for each record.

Executors write (they fetch), the driver commits. What became of a record in a run is a file of its own, put in
place before the paper is, so that a task that is run again finds it: the record's paper isn't fetched twice
in a run, nor are its places asked twice, and its rows are the same. Papers and outcomes are written under names
of their own attempt and then renamed, so that two attempts on one record leave a whole file of one of them.

Folders are ones that all executors have mounted: papers are written with plain file calls.
"""

from __future__ import annotations

import contextlib
import glob
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from corpusloom.operators.acquire import MIN_PDF_BYTES, RETRY_FROM
from corpusloom.sources.files import put_file

#: get(url, timeout) -> (status, or None for a lost connection, chunks of the body)
Get = Callable[[str, float], tuple[int | None, Iterator[bytes]]]
#: What is kept of a record's fetching.
OUTCOME = "id string, attempted array<string>, url string, source string, landing_page string, success boolean, fresh boolean, error string, file string, file_size bigint"
#: Fixed value: what a fetch accepts.
ACCEPT = "application/pdf,application/octet-stream,*/*"


def http_get(url: str, timeout: float, headers: dict[str, str] | None = None) -> tuple[int | None, Iterator[bytes]]:
    """A GET whose body comes in chunks of a megabyte."""
    import urllib.error
    import urllib.request

    try:
        answer = urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout)  # noqa: S310
    except urllib.error.HTTPError as e:
        return e.code, iter(())
    except OSError:
        return None, iter(())

    def chunks() -> Iterator[bytes]:
        with answer:
            while chunk := answer.read(1 << 20):
                yield chunk

    return answer.status, chunks()


def is_pdf_file(path: str) -> bool:
    """Whether a file is there, long enough, and begins as a PDF does; any error is a no."""
    try:
        with open(path, "rb") as f:
            return os.path.getsize(path) >= MIN_PDF_BYTES and f.read(5) == b"%PDF-"
    except OSError:
        return False


def try_place(url: str | None, path: str, get: Get, retries: int, timeout: float, wait: Callable[[float], None] = time.sleep, label: str = "", before: Callable[[str], None] = lambda part: None) -> str:
    """What comes of one place: success, no_pdf_url, not_a_pdf, http_<status>, connection, unknown_failure, or an error's name.

    A server's failure, or a lost connection, is tried again, each time after two seconds more; what was
    fetched takes its place only if it is a PDF, after `before` has had it under its other name.
    """
    if not url:
        return "no_pdf_url"
    last = "unknown_failure"
    for attempt in range(1, retries + 1):
        try:
            status, body = get(url, timeout)
            if status == 200:
                return "success" if put_file(lambda f: f.writelines(body), path, is_pdf_file, label, before) else "not_a_pdf"
        except OSError:  # lost on the way
            status = None
        except Exception as e:  # noqa: BLE001  belongs to the place
            return type(e).__name__
        last = "connection" if status is None else f"http_{status}"
        if status is not None and status < RETRY_FROM:
            return last
        if attempt < retries:
            wait(2.0 * attempt)
    return last


@dataclass(frozen=True)
class Fetching:
    """How the records of a run are fetched, and where to."""

    folder: str
    outcomes: str
    run: str
    get: Get
    retries: int
    timeout: float
    wait: Callable[[float], None] = time.sleep

    def outcome_path(self, id_: str, success: bool) -> str:
        return f"{self.outcomes}/{id_}.{'ok' if success else 'failed'}.json"

    def known(self, id_: str) -> dict | None:
        """What became of the record in this run; a success counts if its paper is there."""
        for success in (True, False):
            try:
                with open(self.outcome_path(id_, success), encoding="utf-8") as f:
                    found = json.load(f)
            except (OSError, ValueError):
                continue
            if not success or is_pdf_file(found["file"]):
                return found
        return None

    def keep(self, outcome: dict) -> dict:
        """Put the outcome in its place; a failure takes that of a success whose paper never came into place."""
        id_, success = outcome["id"], outcome["success"]
        if not success and not is_pdf_file(f"{self.folder}/{id_}.pdf"):
            with contextlib.suppress(FileNotFoundError):
                os.remove(self.outcome_path(id_, True))
        put_file(lambda f: f.write(json.dumps(outcome, ensure_ascii=False).encode()), self.outcome_path(id_, success), label=self.run)
        return outcome

    def fetch(self, id_: str, places: list) -> dict:
        """The outcome of a record: of this run, if there is one; else a valid paper that is there, or the first place that gives one."""
        if found := self.known(id_):
            return found
        path = f"{self.folder}/{id_}.pdf"
        out = {"id": id_, "attempted": [], "url": None, "source": None, "landing_page": None, "success": True, "fresh": False, "error": None, "file": path}
        if is_pdf_file(path):
            return self.keep(out | {"file_size": os.path.getsize(path)})
        result = "no_locations"
        for place in places:
            url = place["pdf_url"]
            if url:
                out["attempted"].append(url)
            won = out | {"url": url, "source": place["source"], "landing_page": place["landing_page"], "fresh": True}
            result = try_place(url, path, self.get, self.retries, self.timeout, self.wait, self.run, lambda part, won=won: self.keep(won | {"file_size": os.path.getsize(part)}))
            if result == "success":
                return won
        return self.keep(out | {"success": False, "error": result, "file": None, "file_size": None})


@dataclass
class Fetched(WriterCommitMessage):
    records: int


class PapersWriter(DataSourceWriter):
    """Fetches rows (id, places); ids that are no plain file names are left out."""

    def __init__(self, fetching: Fetching):
        self.fetching = fetching

    def write(self, iterator: Iterator[Row]) -> Fetched:
        n = 0
        for row in iterator:
            if row.id and os.path.basename(row.id) == row.id:
                self.fetching.fetch(row.id, row.places or [])
                n += 1
        return Fetched(n)

    def commit(self, messages: list) -> None:
        """On the driver, once all tasks have succeeded."""
        self._clear()
        put_file(lambda f: f.write(str(sum(x.records for x in messages if x)).encode()), f"{self.fetching.outcomes}/_COMMITTED")

    def abort(self, messages: list) -> None:
        """Outcomes stay, and the papers that were fetched: the run can go on from them."""
        self._clear()

    def _clear(self) -> None:
        """Remove what attempts of this run that were lost have left half written."""
        for folder in (self.fetching.folder, self.fetching.outcomes):
            for part in glob.glob(f"{glob.escape(folder)}/*.{glob.escape(self.fetching.run)}-*.part"):
                os.remove(part)


def papers_sink(fetching: Fetching) -> type[DataSource]:
    """A data source to register and write to: df.write.format("papers").mode("append").save()."""

    class PapersSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "papers"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return PapersWriter(fetching)

    return PapersSink
