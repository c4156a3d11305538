"""Folders, logs and runs, with temporary folders and a fake service."""

import json
import re
import urllib.request
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.config import AcquireConfig, CleanConfig
from corpusloom.operators import acquire, apply, edit, run
from corpusloom.operators.metadata import WORK_SCHEMA
from corpusloom.operators.progress import numbered, numbered_texts
from corpusloom.plans.clean import clean_pages
from corpusloom.plans.folder import clean_folder
from corpusloom.sources import files, papers, state, works

PDF = b"%PDF-1.7" + b"x" * 10_000


def work(i, cited=50, urls=("https://arxiv.org/pdf/{}",), **more):
    places = [{"pdf_url": u.format(i), "landing_page_url": None, "is_oa": True, "license": "cc-by", "version": "v", "source": {"display_name": f"host{k}", "type": "repository" if k == 0 else "journal"}} for k, u in enumerate(urls)]
    return {"id": f"https://w.org/W{i}", "doi": None, "title": f"T{i}", "publication_year": 2020, "cited_by_count": cited, "is_retracted": False, "open_access": {"is_oa": True}, "authorships": [], "locations": places} | more


class Server:
    """get(url, timeout) by what each URL answers in turn; counts calls in a folder, since it runs in other processes."""

    def __init__(self, log, answers):
        self.log, self.answers = str(log), answers

    def __call__(self, url, timeout):
        calls = Path(self.log)
        calls.mkdir(exist_ok=True)
        n = len(list(calls.glob(url.rsplit("/", 1)[1] + ".*")))
        (calls / f"{url.rsplit('/', 1)[1]}.{n}").write_text(str(timeout))
        kind = self.answers.get(url, [200])
        status = kind[min(n, len(kind) - 1)]
        if status == "lost":
            return None, iter(())
        if status == "page":
            return 200, iter([b"<html>"])
        return status, iter([PDF[:5000], PDF[5000:]] if status == 200 else [])

    def calls(self, name):
        return len(list(Path(self.log).glob(name + ".*")))


def test_try_place(tmp_path):
    waits = []
    place = lambda kinds, retries=2: papers.try_place("https://x.org/a", str(tmp_path / "d" / "a.pdf"), Server(tmp_path / str(len(list(tmp_path.iterdir()))), {"https://x.org/a": kinds}), retries, 1.0, waits.append)
    assert papers.try_place(None, "", None, 2, 1.0) == "no_pdf_url"
    assert place([404]) == "http_404" and place([429, 200]) == "http_429" and waits == []
    assert place([500, 200]) == "success" and waits == [2.0]
    assert place([503, 503]) == "http_503" and place(["lost", "lost", "lost"], 3) == "connection" and waits == [2.0, 2.0, 2.0, 4.0]
    assert place([200], 0) == "unknown_failure"
    (tmp_path / "d" / "a.pdf").unlink()
    assert place(["page"]) == "not_a_pdf" and list((tmp_path / "d").iterdir()) == []  # nothing is left of it


def test_acquire_run(spark, tmp_path):
    folders = run.Folders(*(str(tmp_path / x) for x in ("papers", "metadata", "manifest", "failed", "state.json", "staging")))
    data = [
        work(1, 90), work(2, 80, ("https://a.org/no{}", "https://b.org/yes{}")), work(3, 70), work(4, 60), work(5, 9), work(6, 500, is_retracted=True), work(7, 55, ()),
        work(8, 50),
    ]
    rows = [(t, h, json.dumps(w)) for t in range(2) for h, w in enumerate(data)] + [(2, 0, "{cut")]
    hits = lambda: works.parse_works(spark.createDataFrame(rows, "term_ord int, hit_ord int, json string"))
    server = Server(tmp_path / "calls", {"https://a.org/no2": [404], "https://arxiv.org/pdf/3": [500], "https://arxiv.org/pdf/8": ["page"]})
    (tmp_path / "papers").mkdir()
    (tmp_path / "papers" / "W4.pdf").write_bytes(PDF)  # there already
    (tmp_path / "papers" / "W1.pdf").write_bytes(b"short")  # there, but none
    config = AcquireConfig(max_per_day=3)
    got = run.acquire_run(spark, hits, folders, "2024-01-01", server, config, lambda s: None)
    assert got == {"selected": 3, "successful": 2, "failed": 1, "new": 2, "remaining": 1}
    assert json.loads((tmp_path / "state.json").read_text()) == {"date": "2024-01-01", "downloads": 2}
    assert (tmp_path / "papers" / "W1.pdf").read_bytes() == PDF == (tmp_path / "papers" / "W2.pdf").read_bytes()
    kept = {r.id: r for r in state.read_records(spark, folders.metadata).collect()}
    assert kept["W2"].attempted_urls == ["https://a.org/no2", "https://b.org/yes2"] and kept["W2"].successful_url == "https://b.org/yes2" and kept["W2"].download_source == "host1" and kept["W2"].downloaded
    assert not kept["W3"].downloaded and kept["W3"].error == "http_500" and server.calls("3") == 2
    assert {r.id for r in state.read_ids(spark, folders.manifest).collect()} == {"W1", "W2"}
    assert {r.id for r in state.read_ids(spark, folders.failed).collect()} == {"W3"}
    # the same day again: one is left of the quota; the one that failed is tried again
    got = run.acquire_run(spark, hits, folders, "2024-01-01", server, config, lambda s: None)
    assert got["selected"] == 1 and got["failed"] == 1 and got["remaining"] == 1 and server.calls("3") == 4 and server.calls("1") == 1
    # nothing is left: nobody is asked
    state.save_state(spark, folders.state, {"date": "2024-01-01", "downloads": 3})
    assert run.acquire_run(spark, lambda: 1 / 0, folders, "2024-01-01", server, config) == {"selected": 0, "successful": 0, "failed": 0, "new": 0, "remaining": 0}
    # another day
    got = run.acquire_run(spark, hits, folders, "2024-01-02", server, config, lambda s: None)
    assert got["selected"] == 2 and got["failed"] == 2 and {r.id for r in state.read_ids(spark, folders.failed).collect()} == {"W3", "W8"}


def test_fetch_records(spark, tmp_path):
    schema = "id string, oa_locations array<struct<pdf_url: string, source: string>>, attempted_urls array<string>, successful_url string, download_source string, downloaded boolean, error string, more int"
    rows = [("a", [("https://x.org/a", "s")], [], None, None, False, None, 7), ("b", [], [], None, None, False, None, 8), ("c", None, [], None, None, False, None, 9), ("d", [(None, "s")], [], None, None, False, None, 0)]
    server = Server(tmp_path / "calls", {})
    for fresh in (True, False):
        got = {r.id: r for r in run.fetch_records(spark.createDataFrame(rows, schema), str(tmp_path / "p"), server).collect()}
        assert got["a"].success and got["a"].new_download == fresh and got["a"].more == 7 and got["a"].error is None
        assert (got["b"].error, got["c"].error, got["d"].error) == ("no_locations", "no_locations", "no_pdf_url")
    assert server.calls("a") == 1
    assert run.fetch_records(spark.createDataFrame([], schema), str(tmp_path / "p"), server).count() == 0


def test_state(spark, tmp_path):
    path = str(tmp_path / "s.json")
    assert state.load_state(spark, path, "d1") == {"date": "d1", "downloads": 0} and json.loads(Path(path).read_text())["date"] == "d1"
    state.save_state(spark, path, {"date": "d1", "downloads": 4})
    assert state.load_state(spark, path, "d1")["downloads"] == 4
    assert state.load_state(spark, path, "d2") == {"date": "d2", "downloads": 0} and json.loads(Path(path).read_text()) == {"date": "d2", "downloads": 0}
    for broken in ("{cut", "", "[1]", '{"date": "d1", "downloads": "x"}'):
        Path(path).write_text(broken)
        (tmp_path / ".s.json.crc").unlink(missing_ok=True)
        assert state.load_state(spark, path, "d1") == {"date": "d1", "downloads": 0}
    assert state.read_ids(spark, str(tmp_path / "none")).count() == 0
    days = spark.createDataFrame([("d1", 3), ("d2", 3), (None, 3), ("d1", None), ("d1", 30)], "day string, n int")
    assert [r[0] for r in days.select(state.remaining_today(F.col("day"), F.col("n"), F.lit("d1"), 10)).collect()] == [7, 10, 10, 10, 0]


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("é", 1)], "id string, n int")
    for _ in range(2):
        state.append_log(rows, str(tmp_path / "log"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert sorted(lines) == sorted(['{"id":"a","n":null}', '{"id":"é","n":1}'] * 2)
    for n, day in ((1, "2024-01-01"), (2, "2024-01-03"), (3, "2024-01-02")):
        state.write_records(spark.createDataFrame([("a", n), (f"b{n}", n)], "id string, n int"), str(tmp_path / "r"), F.lit(day))
    assert {r.id: r.n for r in state.read_records(spark, str(tmp_path / "r")).collect()} == {"a": 2, "b1": 1, "b2": 2, "b3": 3}


def test_search(spark):
    def fetch(term, cursor):
        at = 0 if cursor == "*" else int(cursor)
        if term == "fails" and at:
            raise OSError
        if term == "none":
            return [], "1"
        return [json.dumps({"id": f"{term}{at}{i}"}) for i in range(3)], None if term == "ends" and at else str(at + 1)

    terms = spark.createDataFrame(list(enumerate(["more", "fails", "none", "ends"])), "term_ord int, term string")
    got = {}
    for r in works.parse_works(works.search(terms, fetch, 7)).orderBy("term_ord", "hit_ord").collect():
        got.setdefault(r.term_ord, []).append(r.work.id)
    assert {k: len(v) for k, v in got.items()} == {0: 7, 1: 3, 3: 6} and got[0][3] == "more10"
    assert works.parse_works(spark.createDataFrame([("{cut",), (None,)], "json string")).where("work.id is not null").count() == 0


def test_http_fetch(monkeypatch):
    asked = []

    class Answer:
        status = 200

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, *_):
            return json.dumps({"results": [{"id": "é"}], "meta": {"next_cursor": "c2"}}).encode()

    monkeypatch.setattr(urllib.request, "urlopen", lambda request, timeout: asked.append(request) or Answer())
    assert works.http_fetch("https://api.test/works", "me@x.org", "k")("a b", "*") == (['{"id": "é"}'], "c2")
    assert asked[0].full_url == "https://api.test/works?search=a+b&per_page=100&cursor=%2A&api_key=k" and "mailto:me@x.org" in asked[0].get_header("User-agent")
    Answer.status = 204
    with pytest.raises(OSError):
        works.http_fetch("https://api.test/works")("a", "*")


def test_works_source(spark):
    """Pages over HTTP, from a server on this machine: cursors, the cap, an empty page, a failure."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            ask = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            at = 0 if ask["cursor"] == "*" else int(ask["cursor"])
            failed = (ask["search"] == "fails" and at == 1) or "mailto:me@x.org" not in self.headers["User-Agent"]
            self.send_response(500 if failed else 200)
            self.end_headers()
            if not failed:
                hits = [] if ask["search"] == "none" else [{"id": f"{ask['search']}{at}{i}"} for i in range(int(ask["per_page"]))]
                self.wfile.write(json.dumps({"results": hits, "meta": {"next_cursor": None if at == 2 else str(at + 1)}}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = works.hits(spark, {"url": f"http://127.0.0.1:{server.server_port}/works", "terms": json.dumps(["a b", "fails", "none"]), "cap": "5", "per_page": "2", "contact": "me@x.org"})
        got = {}
        for r in works.parse_works(rows).orderBy("term_ord", "hit_ord").collect():
            got.setdefault(r.term_ord, []).append(r.work.id)
    finally:
        server.shutdown()
    assert got == {0: ["a b00", "a b01", "a b10", "a b11", "a b20"], 1: ["fails00", "fails01"]}


def test_dump(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text(json.dumps(work(1, extra=1)) + "\n")
    assert works.read_dump(spark, str(tmp_path / "w.jsonl")).select("id", "cited_by_count").collect() == [("https://w.org/W1", 50)]


def test_folder_of_pdfs(spark, tmp_path):
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    for name in ("b.v2.pdf", "a.pdf", "bad.pdf", "empty.pdf", "sub/no.pdf"):
        (source / name).write_bytes(PDF + name.encode())
    (source / "c.txt").write_text("no")

    def extract(content):
        if b"bad" in content:
            raise ValueError("broken")
        return [] if b"empty" in content else [["Abstract", "This is a sentence with words in it."], ["More text ends here."]] if b"a.pdf" in content else [["27"]]

    listed = files.list_pdfs(spark, str(source))
    assert {(r.doc_id, r.valid) for r in listed.collect()} == {("a", True), ("b.v2", True), ("bad", True), ("empty", True)}
    assert [(r.path.rsplit("/", 1)[1], r["index"], r.total) for r in files.in_order(listed).orderBy("index").collect()] == [("a.pdf", 1, 4), ("b.v2.pdf", 2, 4), ("bad.pdf", 3, 4), ("empty.pdf", 4, 4)]
    said = []
    got = clean_folder(spark, str(source), str(tmp_path / "out"), str(tmp_path / "staging"), CleanConfig(20, 3, 1.0), extract, said.append)
    assert [(p.message, p.index, p.total, p.failed, p.done) for p in said if p.message.startswith("files")] == [("files extracted", 4, 4, 2, False), ("files cleaned", 2, 2, 1, False), ("files written", 4, 4, 2, True)]
    steps = [[p for p in said if p.message == x] for x in ("extracted", "cleaned", "written")]
    assert all(x and x[-1].index == x[-1].total > 0 == x[-1].failed for x in steps)
    assert {(r.doc_id, r.status): r.detail for r in got.collect()} == {("a", "OK"): "67", ("b.v2", "REJECT"): "too_short, too_few_words", ("bad", "ERROR"): "ValueError: broken", ("empty", "ERROR"): "no pages"}
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.txt"]
    assert {r.doc_id: r.text for r in files.read_texts(spark, str(tmp_path / "out")).collect()} == {"a": "Abstract\nThis is a sentence with words in it.\n\nMore text ends here."}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Abstract\n" + "This is a sentence of the paper, and it is a good one.\n" * 60)
    (tmp_path / "in" / "b.txt").write_text("short")
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "--texts"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert [x[:9].strip() for x in lines if x.startswith(("OK", "REJECT"))] == ["OK     a:", "REJECT b:"]
    assert (tmp_path / "out" / "a.txt").exists() and not (tmp_path / "out" / "b.txt").exists()


def test_write_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", True), ("b", "", False)], "doc_id string, text string, valid boolean")
    files.write_texts(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).collect() == [("a", "x")]
    odd = spark.createDataFrame([("../up", "x"), (None, "x"), ("ok", None), ("dir", "x")], "doc_id string, text string")
    (tmp_path / "f" / "dir.txt").mkdir(parents=True)
    got = {r.doc_id: r.error for r in files.write_text_files(odd, str(tmp_path / "f")).collect()}
    assert got["ok"] is None and got["../up"] and got[None] and got["dir"]
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == ["dir.txt", "ok.txt"]


def test_replace_in_folder(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    for name, text in (("a", "one two one"), ("b", "nothing"), ("c", "One")):
        (folder / f"{name}.txt").write_text(text)
    (folder / "é +%41 x.txt").write_bytes(b"two\xff")
    before = (folder / "b.txt").stat().st_mtime_ns
    done = apply.replace_in_folder(spark, str(folder), str(tmp_path / "staging"), r"(?P<a_b>one)", r"\g<a_b>one", use_regex=True)
    for _ in range(2):  # looking at the result twice replaces once
        assert {(r.doc_id, r.n, r.error) for r in done.collect()} == {("a", 2, None), ("c", 1, None)}
    assert [(folder / f"{x}.txt").read_text() for x in "abc"] == ["oneone two oneone", "nothing", "Oneone"]
    assert (folder / "b.txt").stat().st_mtime_ns == before
    assert apply.edit_totals(done).first().asDict() == {"files": 2, "replacements": 3, "failed": 0}
    assert apply.replace_in_folder(spark, str(folder), str(tmp_path / "more"), "two", "2", name="é*.txt").count() == 1
    assert (folder / "é +%41 x.txt").read_text() == "2\ufffd" and len(list(folder.iterdir())) == 4
    with pytest.raises(ValueError):
        apply.replace_in_folder(spark, str(folder), str(tmp_path / "staging"), "(", "", use_regex=True)


def test_named_groups(spark):
    frame = spark.createDataFrame([("ab ab", "x"), (None, "x"), ("cd", "x")], "text string, n string")
    got = edit.replace(frame.drop("n"), r"(?P<x>a)(?P<y_1>b) (?P=x)(?P=y_1)", r"\g<y_1>\g<x>$", use_regex=True).collect()
    assert [tuple(r) for r in got] == [("ba$", 1)]
    assert edit.java_regex(r"\(?P<x>a) \\(?P<x>a)") == r"\(?P<x>a) \\(?<gx>a)"  # an escaped bracket is none
    assert edit.java_regex(r"[(?P<x>]+[]a[b&&c\]]\[(?P<x>a)") == r"[(?P<x>]+[]a\[b\&&c\]]\[(?<gx>a)"  # nor is one in a class
    odd = spark.createDataFrame([("12a aaa (?P<x>", "x"), ("a[b]&c", "x")], "text string, n string").drop("n")
    for pattern in (r"[(?P<x>]", r"[[\]]", r"[a&&c]", r"[]a]", r"[^]a]", r"\[b"):
        assert [r.n for r in edit.find(odd, pattern, True, True).collect()] == [len(re.findall(pattern, t)) for t in ("12a aaa (?P<x>", "a[b]&c")]
    with pytest.raises(ValueError):  # Python reads it, Java doesn't
        edit.compile_pattern(r"(?P<x>a)(?(x)b|c)", use_regex=True)
    assert [(r.text, r.n) for r in edit.changed(frame.drop("n"), "c", "X").collect()] == [("ab ab", 0), (None, 0), ("Xd", 1)]


def test_numbered(spark):
    keys = [None, 5, None, 5, 5, -(1 << 62), 1 << 62, *range(100, 140), None]
    got = numbered(spark.createDataFrame([(k, 1) for k in keys], "k bigint, index int"), "k", range_rows=7).collect()
    assert sorted(r["index"] for r in got) == list(range(1, len(keys) + 1)) and {r.total for r in got} == {len(keys)}
    order = sorted(keys, key=lambda k: (k is None, k or 0))
    assert {(r["index"], r.k) for r in got} == {(i + 1, k) for i, k in enumerate(order)}
    assert numbered(spark.createDataFrame([], "k bigint"), "k").count() == 0


def test_numbered_texts(spark):
    keys = [f"f/{i * 7919 % 1000:03}é" for i in range(1000)] + ["f/500é"] * 50 + ["é", "z", "\U0001f600", "\uffee"]
    got = numbered_texts(spark.createDataFrame([(k, 1) for k in keys], "k string, index int"), "k", range_rows=60).collect()
    order = sorted(keys, key=lambda x: x.encode())
    assert sorted((r["index"], r.k, r.total) for r in got) == [(i, k, len(keys)) for i, k in enumerate(order, 1)]
    assert numbered_texts(spark.createDataFrame([], "k string"), "k").count() == 0


def test_acquire_edges(spark):
    none = spark.createDataFrame([], "term_ord int, hit_ord int, id string, work string")
    assert acquire.dedup_works(none).count() == acquire.cap_per_term(none, 3).count() == 0
    results = spark.createDataFrame([(True, True), (True, False), (False, False), (None, None)], "success boolean, new_download boolean")
    assert acquire.run_totals(results).first().asDict() == {"successful": 2, "failed": 2}
    assert sorted((r.log, r.counted) for r in acquire.route(results).collect()) == [("failed", False), ("failed", False), ("manifest", False), ("manifest", True)]
    assert acquire.run_totals(results.limit(0)).first().asDict() == {"successful": 0, "failed": 0}
    old = spark.createDataFrame([(9, "a")], "term_ord int, id string")
    assert acquire.union_hits(none, old, old).count() == 2


def test_long_document(spark):
    """A hundred thousand lines: time grows with them, not with their square."""
    import time

    page = lambda i: [f"Head | {i} | x", f"This line {i} goes on and on until the next", f"*Correspondence: a{i}@b.cd", f"Dept {i} of X", f"closed {i}" + "." * 100, ""]
    doc = [[*page(i), *[f"line {i} {k} of the text goes on" for k in range(44)]] for i in range(2000)]
    frame = spark.createDataFrame([("a", doc), ("b", [["a\x1db", "c\x1e", "d\x1b1e"], ["f"]])], "doc_id string, pages array<array<string>>")
    began = time.perf_counter()
    got = {r.doc_id: r for r in clean_pages(frame, CleanConfig(0, 0, 1.0)).collect()}
    assert time.perf_counter() - began < 90
    assert got["a"].cleanup.correspondence == 2000 * 2
    assert "Head" not in got["a"].text and got["b"].text == "ab c d1e\n\nf"
    assert clean_pages(frame.limit(0)).count() == 0


def test_work_schema(spark):
    assert spark.createDataFrame([], WORK_SCHEMA).columns[0] == "id"
