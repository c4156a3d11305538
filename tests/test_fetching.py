"""Runs that are broken off, tasks that are run again, several writers of one file."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.config import AcquireConfig
from corpusloom.operators import run
from corpusloom.sources import papers, state, works
from tests.test_runs import PDF, Server, work

SCHEMA = "id string, oa_locations array<struct<pdf_url: string, landing_page_url: string, source: string>>, more int"
DAY = "2024-01-01"


class Dying(Server):
    """Takes its process with it at the first request for one URL."""

    def __init__(self, log, answers, at):
        super().__init__(log, answers)
        self.at = at

    def __call__(self, url, timeout):
        gone = Path(self.log, "gone")
        found = super().__call__(url, timeout)
        if url == self.at and not gone.exists():
            gone.touch()
            os._exit(1)
        return found


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def place(name):
    return (f"https://x.org/{name}", f"https://x.org/{name}.html", "host")


def test_run_again(spark, tmp_path):
    """The fetch of a run, made twice: equal rows, and nobody is asked twice."""
    records = spark.createDataFrame([("a", [place("no"), place("a")], 1), ("b", [place("b")], 2), ("c", [place("lost")], 3), ("d", None, 4), ("../e", [place("e")], 5), (None, [], 6), ("here", [place("h")], 7)], SCHEMA)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "here.pdf").write_bytes(PDF)
    server = Server(tmp_path / "calls", {"https://x.org/no": [404], "https://x.org/lost": ["lost"]})
    fetch = lambda run_: run.fetch_records(records, str(tmp_path / "p"), server, wait=lambda s: None, run=run_)
    first = fetch("r1")
    got = {r.id: r for r in first.collect()}
    assert got["a"].attempted_urls == ["https://x.org/no", "https://x.org/a"] and got["a"].new_download and got["a"].successful_url == "https://x.org/a"
    assert (got["a"].file, got["a"].file_size, got["a"].landing_page, got["a"].download_source) == (str(tmp_path / "p" / "a.pdf"), len(PDF), "https://x.org/a.html", "host")
    assert (got["here"].success, got["here"].new_download, got["here"].file_size, got["here"].landing_page) == (True, False, len(PDF), None)
    assert [got[x].error for x in ("c", "d", "../e", None)] == ["connection", "no_locations", "bad_id", "bad_id"] and got["c"].file is None
    assert rows_of(fetch("r1")) == rows_of(first)
    assert [server.calls(x) for x in ("a", "b", "no", "lost")] == [1, 1, 1, 2]
    again = {r.id: r for r in fetch("r2").collect()}  # another run: what is there isn't new, failures are tried again
    assert again["a"].success and not again["a"].new_download and server.calls("a") == 1 and server.calls("lost") == 4
    assert (tmp_path / "p" / "_outcomes" / "r2" / "_COMMITTED").read_text() == "5"


def test_lost_worker(spark, tmp_path):
    """A worker that dies in the middle: what it had fetched counts as new when the run goes on; no half-written file stays."""
    records = spark.createDataFrame([(x, [place(x)], 1) for x in "abcd"], SCHEMA).coalesce(1)
    server = Dying(tmp_path / "calls", {}, "https://x.org/c")
    fetch = lambda: run.fetch_records(records, str(tmp_path / "p"), server, tasks=1, run="r")
    with pytest.raises(Exception):
        fetch()
    (tmp_path / "p" / "d.pdf.r-0.part").write_bytes(b"half")  # of an attempt that was killed while it wrote
    assert not list((tmp_path / "p" / "_outcomes" / "r").glob("_COMMITTED"))
    done = {x: server.calls(x) for x in "abcd"}
    got = fetch().collect()
    assert all(r.new_download and r.successful_url == f"https://x.org/{r.id}" for r in got)
    assert all(server.calls(x) == 1 for x in "abd" if done[x]) and server.calls("c") == 2
    assert sorted(x.name for x in (tmp_path / "p").glob("*.*")) == ["a.pdf", "b.pdf", "c.pdf", "d.pdf"]


def test_several_writers(tmp_path):
    """Attempts on one record at the same time leave a whole file and a whole outcome."""
    body = [bytes([i]) * 40_000 for i in range(4)]

    def slow(k):
        def get(url, timeout):
            def chunks():
                yield b"%PDF-" + body[k][:5000]
                time.sleep(0.05)
                yield body[k][5000:]

            return 200, chunks()

        return get

    of = lambda k: papers.Fetching(str(tmp_path), str(tmp_path / "o"), "r", slow(k), 1, 1.0)
    threads = [threading.Thread(target=of(k).fetch, args=("a", [{"pdf_url": f"u{k}", "source": None, "landing_page": None}])) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert (tmp_path / "a.pdf").read_bytes() in [b"%PDF-" + x for x in body]
    assert [x.name for x in (tmp_path / "o").iterdir()] == ["a.ok.json"] and json.loads((tmp_path / "o" / "a.ok.json").read_text())["success"]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.pdf", "o"]


def test_success_without_its_paper(tmp_path):
    """An outcome that was kept just before its writer was stopped is no success."""
    answers = Server(tmp_path / "calls", {"https://x.org/a": [404]})
    fetching = papers.Fetching(str(tmp_path / "p"), str(tmp_path / "o"), "r", answers, 1, 1.0)
    fetching.keep({"id": "a", "success": True, "fresh": True, "file": str(tmp_path / "p" / "a.pdf")})
    assert fetching.fetch("a", [{"pdf_url": "https://x.org/a", "source": None, "landing_page": None}])["error"] == "http_404"
    assert [x.name for x in (tmp_path / "o").iterdir()] == ["a.failed.json"]


class Stop(Exception):
    pass


STEPS = ["fetch_records", "write_records", "failed", "manifest", "first save_state", "last save_state"]


@pytest.mark.parametrize("step", STEPS)
def test_broken_off(spark, tmp_path, monkeypatch, step):
    """A run stopped before or after each of its steps, then finished: quota, logs and records are those of one run."""
    folders = run.Folders(*(str(tmp_path / x) for x in ("papers", "metadata", "manifest", "failed", "state.json", "staging")))
    data = [work(1, 90), work(2, 80), work(3, 70), work(4, 60)]
    hits = lambda: works.parse_works(spark.createDataFrame([(0, h, json.dumps(w)) for h, w in enumerate(data)], "term_ord int, hit_ord int, json string"))
    server = Server(tmp_path / "calls", {"https://arxiv.org/pdf/3": [404]})
    go = lambda day=DAY: run.acquire_run(spark, hits, folders, day, server, AcquireConfig(max_per_day=3), lambda s: None)
    with monkeypatch.context() as m:
        calls = []

        def stopping(name, when):
            real = getattr(run, name)

            def stopped(*a, **b):
                calls.append(a)
                if when(*a, **b):
                    if name == "fetch_records" or step == "manifest":
                        real(*a, **b)  # stopped after it
                    raise Stop
                return real(*a, **b)

            m.setattr(run, name, stopped)

        if step in ("failed", "manifest"):
            stopping("append_log", lambda rows, path, *_: path == getattr(folders, step))
        elif step.endswith("save_state"):
            stopping("save_state", lambda *_: len(calls) == (1 if step[0] == "f" else 2))
        else:
            stopping(step, lambda *a, **b: True)
        with pytest.raises(Stop):
            go()
    fetched = [server.calls(x) for x in "123"]
    if step != "first save_state":
        assert fetched == [1, 1, 1] and state.load_state(spark, folders.state, DAY)["reserved"] == 3
    got = go()
    # of the quota one is left once the run is finished, for the one that failed: it is tried again
    assert [server.calls(x) for x in "1234"] == [1, 1, 1 if step == "first save_state" else 2, 0]
    assert state.load_state(spark, folders.state, DAY) == {"date": DAY, "downloads": 2} and got["new"] == 2 and got["remaining"] == 1
    ids = sorted(r.id for r in state.read_log(spark, folders.manifest).select(F.get_json_object("value", "$.id").alias("id")).collect())
    assert ids == ["W1", "W2"]  # once each
    kept = {r.id: r for r in state.read_records(spark, folders.metadata).collect()}
    assert kept["W1"].successful_url == "https://arxiv.org/pdf/1" and kept["W1"].file_size == len(PDF) and kept["W3"].error == "http_404"
    assert not list((tmp_path / "papers" / "_outcomes").iterdir())


def test_run_by_index(spark, tmp_path):
    """With an index of the manifest runs choose the same, and search once."""
    folders = run.Folders(*(str(tmp_path / x) for x in ("papers", "metadata", "manifest", "failed", "state.json", "staging", "index")))
    asked = []

    def hits():
        asked.append(1)
        return works.parse_works(spark.createDataFrame([(0, h, json.dumps(work(h, 90 - h))) for h in range(5)], "term_ord int, hit_ord int, json string"))

    server = Server(tmp_path / "calls", {})
    for day, want in ((1, ["W0", "W1"]), (2, ["W0", "W1", "W2", "W3"]), (3, ["W0", "W1", "W2", "W3", "W4"])):
        (tmp_path / "papers" / "W0.pdf").unlink(missing_ok=True)  # held by the manifest alone
        run.acquire_run(spark, hits, folders, f"2024-01-0{day}", server, AcquireConfig(max_per_day=2))
        assert sorted(r.id for r in state.read_ids(spark, folders.manifest).collect()) == want
    assert len(asked) == 3 and server.calls("0") == 1 and (tmp_path / "index" / "current.json").exists()


def test_another_day(spark, tmp_path):
    """A run that was broken off yesterday is finished today and counts today; one whose staging is gone counts whole."""
    folders = run.Folders(*(str(tmp_path / x) for x in ("papers", "metadata", "manifest", "failed", "state.json", "staging")))
    hits = lambda: works.parse_works(spark.createDataFrame([(0, 1, json.dumps(work(1)))], "term_ord int, hit_ord int, json string"))
    config = AcquireConfig(max_per_day=2)
    chosen = run.select_works(hits(), spark.createDataFrame([], "id string"), spark.createDataFrame([], "id string"), config)
    chosen.write.parquet(f"{folders.staging}/r1/selected")
    state.save_state(spark, folders.state, {"date": DAY, "downloads": 2, "run": "r1", "reserved": 1})
    server = Server(tmp_path / "calls", {})
    assert run.acquire_run(spark, lambda: hits().limit(0), folders, "2024-01-02", server, config) == {"selected": 1, "successful": 1, "failed": 0, "new": 1, "remaining": 1}
    state.save_state(spark, folders.state, {"date": DAY, "downloads": 0, "run": "gone", "reserved": 2})
    assert run.acquire_run(spark, lambda: 1 / 0, folders, DAY, server, config)["remaining"] == 0
    assert state.load_state(spark, folders.state, DAY) == {"date": DAY, "downloads": 2}


def test_state_between_files(spark, tmp_path):
    """A writer stopped between the old state and the new leaves one of them to be read."""
    path = tmp_path / "s.json"
    state.save_state(spark, str(path), {"date": DAY, "downloads": 4})
    (tmp_path / "s.json.part").write_text('{"date": "2024-0')  # stopped while it wrote
    assert state.load_state(spark, str(path), DAY)["downloads"] == 4
    path.unlink()
    (tmp_path / ".s.json.crc").unlink(missing_ok=True)
    (tmp_path / ".s.json.part.crc").unlink(missing_ok=True)
    (tmp_path / "s.json.part").write_text(json.dumps({"date": DAY, "downloads": 5}))  # where a store deletes before it renames
    assert state.load_state(spark, str(path), DAY)["downloads"] == 5
    state.save_state(spark, str(path), {"date": DAY, "downloads": 6})
    assert json.loads(path.read_text())["downloads"] == 6 and not (tmp_path / "s.json.part").exists()


def test_headers_and_progress(spark, tmp_path, monkeypatch):
    """Fetching sends the headers of a polite client; how far it has come is told while it runs."""
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.headers["User-Agent"], self.headers["Accept"]))
            time.sleep(0.3)
            self.send_response(404 if "no" in self.path else 200)
            self.end_headers()
            self.wfile.write(PDF)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(run, "LOOK", 0.1)
    said = []
    try:
        rows = [(f"{x}{i}", [(f"http://127.0.0.1:{server.server_port}/{x}{i}", None, "s")], 0) for i in range(4) for x in ("a", "no")]
        got = run.fetch_records(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "p"), config=AcquireConfig(contact="me@x.org"), tasks=1, report=said.append)
        assert {r.id: r.error for r in got.collect()} == {x: "http_404" if x.startswith("no") else None for x, *_ in rows}
    finally:
        server.shutdown()
    assert len(seen) == 8 and set(seen) == {("corpusloom/1.0 (mailto:me@x.org)", "application/pdf,application/octet-stream,*/*")}
    assert (said[-1].index, said[-1].total, said[-1].failed) == (8, 8, 4)
    assert len({p.index for p in said}) >= 4 and [p.index for p in said] == sorted(p.index for p in said)
