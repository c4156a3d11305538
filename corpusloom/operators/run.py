"""An acquisition run: quota, search hits, selection, fetching, logs.

Selection is a plan of relational steps. Fetching waits for servers, and goes by record on executors, as a
write to the sink of sources/papers.py. A run is on record from before its first fetch: the day's counter
has it reserved, its records are staged, and each outcome is kept. So a run that was broken off, wherever, is
finished by the next call, without fetching anything twice, and the quota holds.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import AcquireConfig
from corpusloom.operators import acquire, metadata
from corpusloom.operators.progress import Progress, Report
from corpusloom.sources.headers import list_headers
from corpusloom.sources.manifest import compact, held_ids
from corpusloom.sources.papers import ACCEPT, OUTCOME, Fetching, Get, http_get, papers_sink
from corpusloom.sources.state import append_log, exists, load_state, read_ids, save_state, write_records
from corpusloom.sources.works import session_headers


def select_works(hits: DataFrame, manifest_ids: DataFrame | Callable[[DataFrame], DataFrame], pdf_ids: DataFrame, config: AcquireConfig | None = None, remaining: int | None = None) -> DataFrame:
    """Records of the works to fetch: eligible hits (term_ord, hit_ord, work), once each, not held yet, the most cited.

    `manifest_ids` are the ids held, or give those that candidates (id) may have.
    """
    config = config or AcquireConfig()
    rows = acquire.cap_per_term(hits, config.max_per_term)
    keep = rows.select("term_ord", "hit_ord", "work.*").where(metadata.is_eligible(config))
    keep = keep.withColumn("key", metadata.work_id(F.col("id"), F.col("doi"), F.col("title"))).withColumn("work", F.struct(*[c for c in keep.columns if c not in ("term_ord", "hit_ord")]))
    once = acquire.dedup_works(keep.select("term_ord", "hit_ord", F.col("key").alias("id"), "work"))
    held = manifest_ids(once.select("id")) if callable(manifest_ids) else manifest_ids
    new = acquire.not_held(acquire.not_held(once, held), pdf_ids)
    top = acquire.most_cited(new.withColumn("citations", F.coalesce("work.cited_by_count", F.lit(0))), config.max_per_day if remaining is None else remaining)
    return metadata.metadata_record(top.select("work.*"))


#: Fields of a record that fetching fills in.
FILLED = ("attempted_urls", "successful_url", "download_source", "downloaded", "error", "file", "file_size", "landing_page")


def outcomes_of(folder: str, run: str) -> str:
    """Where a run keeps what became of its records, hidden from those that list papers."""
    return f"{folder}/_outcomes/{run}"


def polite_get(contact: str | None) -> Get:
    """http_get with the headers of a polite client."""
    headers = session_headers(contact) | {"Accept": ACCEPT}
    return lambda url, timeout: http_get(url, timeout, headers)


def fetch_records(records: DataFrame, folder: str, get: Get | None = None, config: AcquireConfig | None = None, wait: Callable[[float], None] = time.sleep, tasks: int | None = None, outcomes: str | None = None, run: str | None = None, report: Report | None = None) -> DataFrame:
    """The records with what came of them: attempted_urls, successful_url, download_source, downloaded, error, file, file_size, landing_page; and success, new_download.

    A valid file of the id is a success that isn't new. Else places are tried in order until one succeeds;
    without any the error is `no_locations`. An id that is null or no plain file name is a `bad_id`. Files are
    `<id>.pdf` of `folder`, and what became of each record is kept in `outcomes`, by default a hidden folder
    in it, of the run's name; all executors share both. Records are fetched by this call; a call with the
    outcomes of an earlier one fetches nothing again and gives the same rows.
    """
    config, run = config or AcquireConfig(), run or uuid.uuid4().hex
    outcomes = outcomes or outcomes_of(folder, run)
    os.makedirs(outcomes, exist_ok=True)
    spark = records.sparkSession
    spark.dataSource.register(papers_sink(Fetching(folder, outcomes, run, get or polite_get(config.contact), config.max_retries, config.timeout, wait)))
    has_page = "landing_page_url" in records.schema["oa_locations"].dataType.elementType.names
    place = lambda x: F.struct(x["pdf_url"].alias("pdf_url"), x["source"].alias("source"), (x["landing_page_url"] if has_page else F.lit(None).cast("string")).alias("landing_page"))
    asked = records.select("id", F.transform("oa_locations", place).alias("places"))
    with _watched(outcomes, records, report):
        asked.repartition(tasks or 6, "id").write.format("papers").mode("append").save()
    # of two attempts on a record one may have failed: the success counts
    done = spark.read.schema(OUTCOME).json(outcomes).groupBy("id").agg(F.max_by(F.struct("*"), "success").alias("o"))
    out = records.drop(*FILLED).join(done, "id", "left")
    success = F.coalesce("o.success", F.lit(False))
    return out.select(
        *[c for c in records.columns if c not in FILLED],
        F.coalesce("o.attempted", F.array().cast("array<string>")).alias("attempted_urls"), F.col("o.url").alias("successful_url"), F.col("o.source").alias("download_source"), success.alias("downloaded"),
        F.when(F.col("o").isNull(), "bad_id").otherwise(F.col("o.error")).alias("error"), F.col("o.file").alias("file"), F.col("o.file_size").alias("file_size"), F.col("o.landing_page").alias("landing_page"),
        success.alias("success"), F.coalesce("o.fresh", F.lit(False)).alias("new_download"),
    )


#: Seconds between two looks at how far fetching has come.
LOOK = 1.0


@contextlib.contextmanager
def _watched(outcomes: str, records: DataFrame, report: Report | None) -> Iterator[None]:
    """Report, while records are fetched, how many of them are done and how many of these failed."""
    if report is None:
        yield
        return
    total, over, said = records.count(), threading.Event(), [-1]

    def look() -> None:
        names = [x for x in os.listdir(outcomes) if x.endswith(".json")]
        if len(names) > said[0]:
            said[0] = len(names)
            report(Progress("fetched", len(names), total, sum(x.endswith(".failed.json") for x in names)))

    def watch() -> None:
        while not over.wait(LOOK):
            look()

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
    look()


@dataclass(frozen=True)
class Folders:
    """Where a run keeps its files, in a store that all executors share."""

    papers: str
    metadata: str
    manifest: str
    failed: str
    state: str
    staging: str
    #: of the manifest's ids, if one is kept; see sources/manifest.py
    index: str | None = None


def log_results(results: DataFrame, folders: Folders, run: str | None = None) -> None:
    """Successes go to the manifest and their records are kept; failures go to the failed log, and are tried again by the next run.

    The manifest, whose ids count as held, comes last; with a run's name all may be done again.
    """
    routed = acquire.route(results).drop("counted", "new_download", "success")
    tried = routed.where("error is null or error <> 'no_locations'")
    write_records(tried.drop("log"), folders.metadata, run=run)
    for name, path in (("failed", folders.failed), ("manifest", folders.manifest)):
        append_log(routed.where(F.col("log") == name).drop("log"), path, run)


def _finish(spark: SparkSession, folders: Folders, state: dict, get: Get | None, config: AcquireConfig, wait: Callable[[float], None], report: Report | None) -> dict:
    """Fetch and log the records of the run that the state has reserved, and count what was new. All of it may be done again."""
    run, settled = state["run"], {"date": state["date"], "downloads": state["downloads"]}
    staged = f"{folders.staging}/{run}"
    if not exists(spark, f"{staged}/selected"):  # its staging is gone: nobody knows what it has fetched, so all of it counts
        save_state(spark, folders.state, settled | {"downloads": state["downloads"] + state["reserved"]})
        return {}
    results = f"{staged}/results"
    fetch_records(spark.read.parquet(f"{staged}/selected"), folders.papers, get, config, wait, run=run, report=report).write.mode("overwrite").parquet(results)
    found = spark.read.parquet(results)
    log_results(found, folders, run)
    counted = found.agg(F.count("*").alias("selected"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.count_if("new_download").alias("new")).first().asDict()
    save_state(spark, folders.state, settled | {"downloads": state["downloads"] + counted["new"]})
    shutil.rmtree(outcomes_of(folders.papers, run), ignore_errors=True)  # the run is on record in logs and staging
    return counted


def acquire_run(spark: SparkSession, hits: Callable[[], DataFrame], folders: Folders, today: str, get: Get | None = None, config: AcquireConfig | None = None, wait: Callable[[float], None] = time.sleep, report: Report | None = None) -> dict:
    """One run: what the day's quota leaves is searched for, selected, fetched and logged. Gives the totals of this call.

    `hits` makes the rows to choose from (term_ord, hit_ord, work), and isn't asked if nothing is left of
    the quota. Ids of the manifest, and those with a valid file, aren't fetched. The quota is reserved for
    what is selected before anything is fetched, and what wasn't needed is given back at the end. A run that was
    broken off is finished first; what it fetches counts for the day that it is finished on. `report` gets
    how far it has come, while it runs.
    """
    config, say = config or AcquireConfig(), report or (lambda progress: None)
    state = load_state(spark, folders.state, today)
    totals = {"selected": 0, "successful": 0, "failed": 0, "new": 0}
    if "run" in state:
        say(Progress("finishing a run that was broken off", 0, state["reserved"]))
        totals |= _finish(spark, folders, state, get, config, wait, report)
        state = load_state(spark, folders.state, today)
    remaining = max(config.max_per_day - state["downloads"], 0)
    if not remaining:
        say(Progress("nothing is left of the day's quota", done=True))
        return totals | {"remaining": 0}
    held = list_headers(spark, folders.papers).where("valid").select(F.col("doc_id").alias("id"))
    run = uuid.uuid4().hex
    found, selected = f"{folders.staging}/{run}/hits", f"{folders.staging}/{run}/selected"
    hits().write.parquet(found)  # staged: a second look is no second search
    known = partial(held_ids, spark, folders.manifest, folders.index) if folders.index else read_ids(spark, folders.manifest)
    select_works(spark.read.parquet(found), known, held, config, remaining).write.parquet(selected)
    n = spark.read.parquet(selected).count()
    say(Progress("selected", 0, n))
    if n:
        save_state(spark, folders.state, state | {"run": run, "reserved": n})
        counted = _finish(spark, folders, state | {"run": run, "reserved": n}, get, config, wait, report)
        totals = {k: v + counted[k] for k, v in totals.items()}
        remaining -= counted["new"]
    if folders.index:
        compact(spark, folders.manifest, folders.index)
    say(Progress("done", n, n, totals["failed"], True))
    return totals | {"remaining": remaining}
