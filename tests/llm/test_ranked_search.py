"""Score-at-a-time search against SQL and brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import ranked_search
from tests.helpers import same, views

DOCS = "doc_id bigint, text string, score string, rank int"
ITEMS = "item_id bigint, text string, doc_id bigint"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    docs = [(d, Counter(x)) for d, t in docs if (x := plain_terms(t))]
    n_docs, n_terms = len(docs), sum(x.total() for _, x in docs)
    df = Counter(t for _, x in docs for t in x)
    chosen = {}
    for i, text in items:
        if i is not None and text is not None:
            chosen[i] = min(chosen.get(i, text), text, key=lambda x: x.encode())
    out = []
    for i, text in chosen.items():
        found = []
        for d, x in docs:
            m = 75 + 25 * x.total() * n_docs // n_terms
            score = sum(ranked_search.weight(n_docs, df[t]) * (1000000000 * x[t] // (1000 * x[t] + 12 * m)) for t in plain_terms(text) if t in x)
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def run(spark, docs, items, tasks=3, **options):
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(tasks)
    got = ranked_search.search(frame, spark.createDataFrame([(*i, 5) for i in items], ITEMS), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()))


def texts(draw, n, words=60):
    names = [f"W{i}" for i in range(words)] + ["Ärger", "ärger", "中文", "x1", "a\x7fb", "ÀB"]
    return [draw.choice([" ", "-", ". ", "\x00"]).join(draw.choice(names[: draw.choice([3, 20, len(names)])]) for _ in range(draw.choice([1, 5, 30, 80]))) for _ in range(n)]


def test_larger_table(spark):
    folder = "/root/testdata/sf0.01"
    same(ranked_search.op11_ranked_search(spark, folder), views(folder), ranked_search.ORACLE)


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, monkeypatch, seed):
    """Shards and blocks of items of a few rows each; ties, copies, repeated ids, odd rows."""
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 15)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 30)
    draw = random.Random(seed)
    docs = list(enumerate(texts(draw, 120), -5))
    docs += docs[10:40] + [(500 + i, docs[0][1]) for i in range(30)] + [(None, docs[1][1]), (None, None), (900, None), (901, ""), (902, " .\t-"), (903, "solo")]
    items = [(i, t) for i, t in enumerate(texts(draw, 12))] + [(20, docs[0][1]), (21, None), (22, "?!"), (23, "unknown"), (24, "solo SOLO"), (24, "zz"), (None, "solo"), (20, docs[0][1])]
    for k in (1, 4, 20):
        assert run(spark, docs, items, k=k) == brute(docs, items, k)


def test_terms():
    draw = random.Random(2)
    for _ in range(2000):
        text = "".join(chr(draw.choice([draw.randrange(0x80), draw.randrange(0x300), draw.randrange(0x3000)])) for _ in range(30))
        assert [x.decode() for x in ranked_search.terms_of(text)] == plain_terms(text)
    assert ranked_search.terms_of(None) == []


def test_stops_early(monkeypatch):
    """Processing stops before the postings end, and never with another best k; scores are whole."""
    monkeypatch.setattr(ranked_search, "FEW", 2)
    draw = random.Random(7)
    block = ranked_search.Block([(0, {b"rare": 1, b"common": 2, b"some": 1})])
    stopped = 0
    for trial in range(60):
        shard = ranked_search.Shard()
        n = 400
        for d in range(n):
            words = ["common"] * draw.choice([0, 1, 1, 2]) + ["some"] * draw.choice([0, 0, 0, 1]) + ["rare"] * (draw.random() < 0.02 * (trial % 4)) * 3 + ["other"] * draw.randint(1, 60)
            shard.add(d, " ".join(words), block.vocabulary)
        df = Counter(shard.terms)
        index = ranked_search.Index(shard, block.counted(50 * n, 50 * sum(shard.n_terms), {t: df[t] * (1 if t == block.vocabulary[b"rare"] else 20) for t in df}))
        (_, terms, repeats), seen = block.items[0], []
        least = draw.choice([1, 1, 1, 500_000])
        best, score = index.search(terms, repeats, block.weights, 5, least, seen)
        whole = np.zeros(n, np.int64)
        for t, r in zip(terms, repeats):
            for g in range(index.first[t], index.first[t + 1]):
                assert len(set(index.docs[index.begin[g] : index.begin[g + 1]])) == index.begin[g + 1] - index.begin[g]
                whole[index.docs[index.begin[g] : index.begin[g + 1]]] += block.weights[t] * r * index.impact[g]
            own = index.impact[index.first[t] : index.first[t + 1]]
            assert (np.diff(own) < 0).all()  # a group for each impact, from the highest
        want = sorted(((-s, d) for d, s in enumerate(whole.tolist()) if s >= least))[:5]
        assert [(-s, d) for d, s in zip(best.tolist(), score.tolist())] == want
        stopped += seen[0][0] < seen[0][1]
    assert stopped >= 10


def test_few_rows(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a b")], []) == []
    assert run(spark, [(1, "a b"), (2, "b")], [(7, "A a c")]) == brute([(1, "a b"), (2, "b")], [(7, "A a c")]) != []


def test_long_text(spark):
    docs = [(1, "long words " * 300_000), (2, "words"), (3, "other")]
    items = [(1, "words " * 50_000 + "long")]
    assert run(spark, docs, items) == brute(docs, items)
