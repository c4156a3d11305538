"""Examples of both outcomes for each rule, and folds against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.config import AcquireConfig, CleanConfig
from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.operators import acquire, edit, lines, metadata, pages
from corpusloom.operators.quality import reject_reasons, statistics
from corpusloom.plans.clean import clean_pages
from corpusloom.sources.state import valid_ids
from corpusloom.streaming.clean_stream import clean_folder


def values(spark, inputs, *functions):
    """Of each function its results over the inputs."""
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    got = frame.select("i", *[f(F.col("x")).alias(f"f{k}") for k, f in enumerate(functions)]).orderBy("i").collect()
    return [[r[k + 1] for r in got] for k in range(len(functions))]


CASES = [
    (P.is_page_number, ["27", "Page 3", "- 12 -", "page 3 of 10"], ["12345", "p. 3", "3.2"]),
    (P.is_pdf_artifact, ["startxref", "the trailer was", "(1,2);3.4", "OPEN"], ["1,2", "open"]),
    (P.is_graphical, ["G G G •", "|||||||||", "----", "."], ["G G", "Gene G x y"]),
    (P.is_citation_cluster, ["[8], [9], [15]", "[1-3]; [7]"], ["[8]", "SGD [181] and Adam [182] work"]),
    (P.is_url_or_doi, ["https://a.b/c", "www.x.org", "DOI: 10.1234/ab"], ["see https://a.b", "HTTPS://A.B"]),
    (P.is_license, ["Licensed under X", "CC BY 4.0"], ["Released under the MIT License."]),
    (P.is_publisher_metadata, ["Downloaded from x", "data are available in Table 2"], ["data are shown"]),
    (P.starts_correspondence, ["SURVEY PAPER *Correspondence: a@b.cd", "Corresponding author:"], ["in correspondence with theory"]),
    (P.is_author_list, ["Ann Smith; Bob Jones; Carl White; Dora Black; Eve Green; Finn Brown"], ["Ann Smith"]),
    (P.is_numbered_affiliation, ["13Nikhef, Science Park", "1Institute of A 2Department of B"], ["5G and 6G", "16O and 56Ni", "18KK0090", "2Sum ∆x, (97)"]),
    (P.is_indexed_affiliation, ["66 Some Institute in Chile"], ["1 Introduction", "84 See https://x.org/schools"]),
    (P.is_section_heading, ["Abstract", "2.1 Data", "12 patients were enrolled", "- Results -"], ["Abstract-We show", "1 " + "x" * 121]),
    (P.is_references_heading, ["References:", "bibliography"], ["7. References"]),
]


def test_predicates(spark):
    for rule, yes, no in CASES:
        assert values(spark, yes + no, rule) == [[True] * len(yes) + [False] * len(no)], rule.__name__


def test_scores(spark):
    assert values(spark, ["Department of X, University of Y", "plain text", "laboratories", "a research center for b"], P.affiliation_score) == [[2, 0, 1, 2]]


def test_text_rules(spark):
    assert values(spark, ["ef\ufb01x\u200by\u0001", "a\u239bb\uf8f1c", "\u00bd\u2026"], T.normalize_unicode) == [["effixy", "a b c", "1⁄2..."]]
    assert values(spark, ["treat-\nment", "treat- ment", "treat-\n\nment", "pre- trained"], T.repair_hyphenation) == [["treatment"] * 3 + ["pre- trained"]]
    span = "Received: 1 May 2020 x a@b.cd"
    assert values(spark, [f"a {span} b {span} c"], T.strip_submission_spans) == [["a   b   c"]]
    assert values(spark, ["a  \n\n\n\nb\n"], T.collapse_blank_lines) == [["a\n\nb"]]
    assert values(spark, ["Nature | Vol 579 | 265"], T.fuzzy_key) == [["nature|vol 579|#"]]
    assert values(spark, ["a\r\nb\x0bc\x85d\u2028e\n", ""], T.split_lines) == [[["a", "b", "c", "d", "e"], []]]


def test_pages(spark):
    def strip(p):
        frame = spark.createDataFrame([(p,)], "pages array<array<string>>")
        return frame.select(pages.strip_repeated(F.col("pages"))).first()[0]

    assert strip([["Head", "a"], ["Head", "b"], ["c"]]) == [["a"], ["b"], ["c"]]
    assert strip([["Head", "a"], ["Head", "b"]]) == [["Head", "a"], ["Head", "b"]]
    assert strip([["Head", "a"], ["Head", "b"], *[["x" * 9 + str(i)] for i in range(6)], [], []])[0] == ["Head", "a"]
    flat = spark.createDataFrame([([["a"], [], ["b", ""]],)], "p array<array<string>>").select(pages.flatten_pages(F.col("p"))).first()[0]
    assert flat == ["a", "", "b", ""]


POOL = ["", "Abstract", "*Correspondence: a", "Dept short", "Methods", "a@b.cd", "2 Department of B", "x" * 120, "Materials", "and methods", "ends.", "goes on", "27", "www.x.org", "Corresponding author: " + "y" * 120]


def is_heading(x):
    from corpusloom.functions.constants import SECTION_NAMES

    return x.strip().lower().strip(" .:-") in SECTION_NAMES or bool(re.match(r"^\d+(?:\.\d+)*\.?\s+\S.{0,119}$", x.strip()))


def loop_noise(doc):
    """The block rule as a loop, with the categories of POOL's lines."""
    mail = lambda x: "@" in x
    inside, out = False, []
    for x in doc:
        if x == "":
            out.append("")
            continue
        if inside:
            if is_heading(x):
                inside = False
            elif mail(x) or "department" in x.lower() or x.startswith("www.") or len(x) < 100:
                out.append("correspondence")
                continue
            else:
                inside = False
            out.append("")
            continue
        if "correspond" in x.lower():
            inside = True
            out.append("correspondence")
        else:
            out.append({"27": "other_noise", "www.x.org": "publisher_metadata", "2 Department of B": "author_blocks"}.get(x, ""))
    return out


def loop_join(doc):
    out = []
    for x in doc:
        if not out or x == "" or out[-1] == "" or is_heading(x) or is_heading(out[-1]) or out[-1][-1] in ".:;?!)]}":
            out.append(x)
        else:
            out[-1] += " " + x
    return out


def test_scans_equal_loops(spark):
    draw = random.Random(4)
    docs = [[draw.choice(POOL) for _ in range(draw.randint(0, 30))] for _ in range(60)]
    arrays = spark.createDataFrame(list(enumerate(docs)), "doc_id int, lines array<string>")
    got = {r[0]: (r[1], r[2]) for r in arrays.select("doc_id", lines.noise_categories(F.col("lines")), lines.join_wrapped(F.col("lines"))).collect()}
    long = lines.classify_noise(arrays.select("doc_id", F.posexplode("lines").alias("ord", "line")))
    by = {}
    for r in long.orderBy("doc_id", "ord").collect():
        by.setdefault(r.doc_id, []).append(r.category or "")
    for i, doc in enumerate(docs):
        assert got[i][0] == loop_noise(doc) == by.get(i, [])
        assert got[i][1] == loop_join(doc)


def test_lines_of_no_document(spark):
    """Rows without a document, null lines, no rows, columns of clashing names."""
    rows = [(1, 0, "x", 5), (1, 1, "Abstract", 5), (1, 2, "*Correspondence: a", 5), (1, 3, "Dept", 5), (1, 4, None, 5), (1, 5, "References", 5), (None, 0, "Abstract", 5), (None, 7, "References", 5), (None, 8, "27", 5)]
    frame = spark.createDataFrame(rows, "doc_id int, ord int, line string, start int")
    found = {(r.doc_id, r.ord): r.category for r in lines.classify_noise(frame).collect()}
    assert found == {(1, 0): None, (1, 1): None, (1, 2): "correspondence", (1, 3): "correspondence", (1, 4): None, (1, 5): None, (None, 0): None, (None, 7): None, (None, 8): None}
    assert {(r.doc_id, r.ord) for r in lines.trim_front_matter(frame).collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (None, 0), (None, 7), (None, 8)}
    assert {(r.doc_id, r.ord) for r in lines.trim_references(frame).collect()} == {(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (None, 0), (None, 7), (None, 8)}
    for apply in (lines.classify_noise, lines.trim_front_matter, lines.trim_references):
        assert apply(frame.limit(0)).count() == 0
    many = spark.createDataFrame([([],), (None,), ([""],), (["", ""],)], "lines array<string>")
    assert [tuple(r) for r in many.select(lines.noise_categories(F.col("lines")), lines.join_wrapped(F.col("lines"))).collect()] == [([], []), (None, None), ([""], [""]), (["", ""], ["", ""])]


def test_joined_headings(spark):
    """Lines that become a heading by being joined, at every place of a run, against the loop."""
    draw = random.Random(8)
    bits = ["Materials", "and", "and methods", "methods", "12", "1.2", "a", "-", "Future", "work", "Future work", "x" * 118, "x" * 120, " ", "Results", "12 b", "- conflict of", "interest", "of interest", "٣", ""]
    docs = [[draw.choice(bits) for _ in range(draw.randint(0, 12))] for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(docs)), "i int, lines array<string>").select("i", lines.join_wrapped(F.col("lines")).alias("j")).collect()
    for r in got:
        assert r.j == loop_join(docs[r.i]), docs[r.i]


def test_quality_bounds(spark):
    frame = spark.createDataFrame([(1499, 249, 0.11), (1500, 250, 0.10)], "characters int, words int, garbage_ratio double")
    got = [r[0] for r in frame.select(reject_reasons(F.struct("*"))).collect()]
    assert got == [["too_short", "too_few_words", "high_garbage_ratio"], []]
    stats = spark.createDataFrame([("héllo wörld don't\n----\n\n",)], "x string").select(statistics(F.col("x")).alias("s")).first().s
    assert (stats.words, stats.garbage_ratio) == (3, 0.5)


def test_clean_pages(spark):
    body = "This sentence is long enough to count as prose and it ends here."
    doc = [["Head | Vol 1 | %d" % i, *([f"Abstract", body] if i == 0 else [body + str(i)])] for i in range(4)]
    frame = spark.createDataFrame([("a", doc), ("b", []), ("c", None)], "doc_id string, pages array<array<string>>")
    got = {r.doc_id: r for r in clean_pages(frame, CleanConfig(min_characters=10, min_words=5)).collect()}
    assert got["a"].valid and "Head" not in got["a"].text and got["a"].text.startswith("Abstract")
    assert not got["b"].valid and not got["c"].valid and got["b"].stats.words == 0
    cut = clean_pages(spark.createDataFrame([("a", [["x", "References", "[1] y"]])], frame.schema), CleanConfig(0, 0, 1.0, True)).first()
    assert (cut.text, cut.cleanup.references) == ("x", 3)  # the page ends in an empty line


def test_metadata(spark):
    ids = spark.createDataFrame([("https://x.org/W12/", None, "t"), (None, "d", "t"), ("", None, "t")], "i string, d string, t string")
    import hashlib

    assert [r[0] for r in ids.select(metadata.work_id(F.col("i"), F.col("d"), F.col("t"))).collect()] == ["W12", hashlib.sha1(b"d").hexdigest()[:16], hashlib.sha1(b"t").hexdigest()[:16]]
    score = lambda *x: spark.createDataFrame([x], "p string, l string, t string, o boolean").select(metadata.location_score(*map(F.col, "plto"))).first()[0]
    assert score("https://onlinelibrary.wiley.com/x", None, None, True) == -50
    assert score("https://arxiv.org/x", None, "repository", True) == 230


def test_acquire(spark):
    hits = spark.createDataFrame([(0, 0, "A", "v1"), (0, 1, "B", "v1"), (1, 0, "A", "v2")], "term_ord int, hit_ord int, id string, work string")
    assert [(r.id, r.work) for r in acquire.dedup_works(hits).orderBy("first_at").collect()] == [("A", "v2"), ("B", "v1")]
    works = spark.createDataFrame([("a", 5, 0), ("b", 9, 1), ("c", 9, 2)], "id string, citations int, first_at int")
    assert [r.id for r in acquire.most_cited(works, 2).collect()] == ["b", "c"]
    codes = spark.createDataFrame([(x,) for x in (404, 429, 500, 503, 302)], "s int").select(acquire.http_class(F.col("s"))).collect()
    assert [r[0] for r in codes] == ["permanent", "permanent", "retry", "retry", "permanent"]
    log = spark.createDataFrame([('{"id": "x"}',), ('{"id',), ('{"y": 1}',), ('{"id": "x"}',)], "value string")
    assert [r.id for r in valid_ids(log).collect()] == ["x"]


def test_edit(spark):
    frame = spark.createDataFrame([("abc a.c",), ("nothing",)], "text string")
    assert [tuple(r) for r in edit.replace(frame, "a.c", r"\1$").collect()] == [(r"abc \1$", 1)]
    two = spark.createDataFrame([("AB ab",)], "text string")
    assert [tuple(r) for r in edit.replace(two, "(a)b", r"\1", use_regex=True).collect()] == [("A a", 2)]
    with pytest.raises(ValueError):
        edit.find(frame, "(", use_regex=True)


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "Abstract\nSome text here.\f27"), ("b", "x")], "doc_id string, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        clean_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), CleanConfig(0, 0, 1.0)).awaitTermination(60)
    got = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": "Abstract\nSome text here.", "b": "x"}


def test_ranked_places(spark):
    """The long form ranks as the one on arrays does; eligibility by any list of licences is that of the licence chosen."""
    draw = random.Random(6)
    hosts = ["https://arxiv.org/x", " https://www.mdpi.com/y ", "http://onlinelibrary.wiley.com/", "ftp://no", None, "", "https://uni.edu/z"]
    rows = []
    for i in range(300):
        places = [(draw.choice(hosts), draw.choice(hosts), draw.choice([True, False, None]), draw.choice(["CC-BY", " cc0 ", "mit", "", None, "other"]), "v", ("s", draw.choice(["repository", "journal", None]))) for _ in range(draw.choice([0, 1, 2, 6]))]
        rows.append((i, 2020, 50, False, (True,), draw.choice([places, places, None])))
    kind = "array<struct<pdf_url: string, landing_page_url: string, is_oa: boolean, license: string, version: string, source: struct<display_name: string, type: string>>>"
    frame = spark.createDataFrame(rows, f"k int, publication_year int, cited_by_count int, is_retracted boolean, open_access struct<is_oa: boolean>, locations {kind}")
    array = frame.select("k", F.posexplode(metadata.scored_locations(metadata.fetchable(F.col("locations")))).alias("place", "z")).select("k", "place", "z.score", "z.x.*")
    long = metadata.ranked_places(frame, "k").select(array.columns)
    assert sorted(map(str, long.collect())) == sorted(map(str, array.collect())) and long.count() > 300
    for licenses in ((), ("cc-by", "cc-by-sa", "cc0", "public-domain"), ("cc-by", "cc-by-sa", "cc0", "public-domain", "mit"), ("cc0",), ("mit", "other")):
        chosen = metadata.license_of(F.col("locations")).isin(*licenses) if licenses else F.lit(True)
        want = F.coalesce((F.size(metadata.fetchable(F.col("locations"))) >= 1) & chosen, F.lit(False))
        got = metadata.is_eligible(AcquireConfig(licenses=licenses))
        assert frame.where(got != want).count() == 0 and frame.where(got).count() > 0
