"""Operators against SQL, brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom import llm
from corpusloom.llm import byte_bpe, chat_format, components, fingerprints, hard_negatives, language_id, lm_scoring, merge_automaton, ngram_join, packing, quality_classifier, quality_rules, ranked_search, substring_dedup
from tests.helpers import DATA, same, views


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    same(llm.queries()[name](spark, DATA), views(), llm.oracle_sql()[name])


def documents():
    return views().execute("SELECT doc_id, text, lang, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY doc_id").fetchall()


def test_language_held_out(spark):
    got = {r.doc_id: r for r in language_id.op1_language_id(spark, DATA).collect()}
    truth = {d: lang for d, _, lang, _ in documents()}
    held = [d for d in got if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(got) == len(truth) and all(got[d].held_out == (d in held) for d in got)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_language(rows, texts, min_count):
    """The same method on dicts of strings: rows (lang, text) to learn from, texts to score."""
    langs = sorted({lang for lang, _ in rows})
    grams = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)] if n else [w]
    counts = [defaultdict(lambda: [0] * len(langs)) for _ in range(6)]
    for lang, text in rows:
        for w in language_id.words_of(text):
            for n in range(6):
                for g in grams(w, n):
                    counts[n][g][langs.index(lang)] += 1
    logs, floor = [], []
    for c in counts:
        c = {g: x for g, x in c.items() if sum(x) >= min_count}
        totals = [sum(x[i] for x in c.values()) + 0.5 * (len(c) + 1) for i in range(len(langs))]
        logs.append({g: [math.log((x[i] + 0.5) / totals[i]) for i in range(len(langs))] for g, x in c.items()})
        floor.append([math.log(0.5 / t) for t in totals])

    def word(w):
        for n in (0, 5, 4, 3, 2, 1):
            if found := [logs[n][g] for g in grams(w, n) if g in logs[n]]:
                return [sum(x) / len(found) for x in zip(*found)]
        return floor[0]

    out = []
    for text in texts:
        words = language_id.words_of(text)
        if not words:
            out.append(("und", 0.0))
            continue
        total = [sum(x) / len(words) * min(len(words), 16) for x in zip(*map(word, words))]
        best = max(range(len(langs)), key=total.__getitem__)
        out.append((langs[best], 1 / sum(math.exp(x - total[best]) for x in total)))
    return out


def test_language_brute_force(spark):
    """Every prediction and score of the query's table, from a model on dicts."""
    docs = documents()
    learned = [(lang, t) for d, t, lang, _ in docs if lang is not None and t is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    got = {r.doc_id: r for r in language_id.op1_language_id(spark, DATA).collect()}
    for (d, *_), (lang, score) in zip(docs, plain_language(learned, [t for _, t, *_ in docs], 3)):
        assert got[d].lang_pred == lang and abs(got[d].score - score) < 1e-4, d


def test_language_rare_and_repeated(spark):
    """A rare language keeps its words, however many others have more; rows of one id and language count once."""
    draw = random.Random(4)
    rows = [(i, " ".join("".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(60)), "many") for i in range(400)]
    rows += [(1000 + i, "zyx yzx xyz vuw", "rare") for i in range(4)] + [(2000, "wvu wuv uvw", "hot")] * 500
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(frame, max_docs=3000, min_count=1)
    score = language_id.Scorer(model)
    assert model.langs == ["hot", "many", "rare"] and score("zyx vuw")[0] == "rare" and score("wuv")[0] == "hot"
    at = np.searchsorted(model.hashes, language_id.hash_of("wvu", 0))
    assert model.hashes[at] == language_id.hash_of("wvu", 0)
    distinct = len({w for _, t, _ in rows for w in t.split()})
    assert abs(math.exp(model.logs[at][0]) - 1.5 / (3 + 0.5 * (distinct + 1))) < 1e-6


def test_language_backoff():
    plain = {("the", 0): [-1.0, -9.0], ("xyz", 3): [-9.0, -2.0], ("x", 1): [-3.0, -3.0]}
    hashes = np.array([language_id.hash_of(g, k) for g, k in plain])
    model = language_id.LanguageModel(["a", "b"], hashes, np.array(list(plain.values()), np.float32), np.full((6, 2), -9.0))
    score = language_id.Scorer(model)
    assert score.word("wxyzw").tolist() == [-9.0, -2.0]  # the longest n-gram that is known
    assert score.word("qxq").tolist() == [-3.0, -3.0]
    assert score.word("qq").tolist() == [-9.0, -9.0]
    assert score("THE the")[0] == "a"
    assert score("123 --") == ("und", 0.0)


def test_substring_brute_force(spark):
    draw = random.Random(7)
    passages = [[draw.choice("abcdefgh") + str(draw.randint(0, 9)) for _ in range(30)] for _ in range(4)]
    docs = []
    for i in range(40):
        words = [draw.choice("abcd") + str(draw.randint(0, 99)) for _ in range(draw.randint(0, 40))]
        for p in draw.sample(passages, draw.randint(0, 2)):
            a = draw.randint(0, 10)
            at = draw.randint(0, len(words))
            words[at:at] = p[a : a + draw.randint(5, 30)]
        docs.append((draw.randint(0, 10**6), " ".join(words)))
    docs += [(10**7 + i, docs[0][1] + " tail") for i in range(5)] + [(10**8, docs[1][1])]
    n = 8
    starts = defaultdict(set)
    for d, t in docs:
        w = t.split()
        for p in range(len(w) - n + 1):
            starts[tuple(w[p : p + n])].add(d)
    want = {}
    for d, t in docs:
        w = t.split()
        gone = {p + o for p in range(len(w) - n + 1) if min(starts[tuple(w[p : p + n])]) < d for o in range(n)}
        want[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_report(frame, window=n).collect()}
    assert got == want
    texts = {r.doc_id: r.text for r in substring_dedup.substring_dedup(frame, window=n).collect()}
    assert all(hashlib.sha256(" ".join(texts[d].split()).encode()).hexdigest() == want[d][2] for d in want)
    # three levels: 25, 50, 100
    assert substring_dedup.levels(100) == [25, 50, 100] and substring_dedup.levels(50) == [25, 50]


def test_substring_three_levels(spark):
    words = [f"w{i}" for i in range(150)]
    docs = [(1, " ".join(words)), (2, "x " + " ".join(words[:120])), (3, " ".join(words[:99]) + " y")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_report(spark.createDataFrame(docs, "doc_id bigint, text string"), window=100).collect()}
    assert got == {1: 0, 2: 120, 3: 0}


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality_classifier.op3_quality_classifier(spark, folder).collect()}
    rows = views(folder).execute("SELECT doc_id, quality FROM labels").fetchall()
    held = [(got[d].score, q) for d, q in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.9
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())


def test_packing_plan():
    draw = random.Random(5)
    for _ in range(400):
        capacity = draw.choice([5, 12, 30])
        counts = {n: draw.randint(0, 6) for n in range(1, capacity + 1)}
        plan, placed, rank = packing.Plan(counts, capacity), defaultdict(list), Counter()
        for length, first_rank, count, first, each, offset in plan.runs:
            assert first_rank == rank[length]
            rank[length] += count
            for j in range(count):
                placed[first + j // each].append((offset + j % each * length, length))
        assert rank == Counter({n: c for n, c in counts.items() if c})
        assert sorted(placed) == list(range(plan.sequences))
        for pieces in placed.values():
            assert sum(3 * n > capacity for _, n in pieces) <= 2
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity


def test_quality_brute_force(spark):
    """Word vectors, features and scores, written out; one text and label of an id count, however often it is there."""
    draw = random.Random(6)
    texts = [(i, " ".join(draw.choice(["alpha", "Beta", "gamma", "42", "!!", "x_y", "DELTA"]) for _ in range(draw.randint(0, 25))) + draw.choice(["", "\n", "."])) for i in range(80)]
    labels = [(i, i % 2) for i, _ in texts] + [(3, 1), (3, 0)]
    hot = [(3, "zz zz zz")] * 30 + [(7, None)]
    frame = spark.createDataFrame(texts + hot, "doc_id bigint, text string")
    model = quality_classifier.fit(frame, spark.createDataFrame(labels, "doc_id bigint, quality int"), "doc_id", "text", "quality")
    used = [min(t, "zz zz zz") if i == 3 else t for i, t in texts]
    tokens = [re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", t) for t in used]
    counts = Counter(w.lower() for t in tokens for w in t)
    names = [quality_classifier.shape_name(k) for k in range(7)] + sorted(w for w, c in counts.items() if c >= 3)
    assert model["vocabulary"] == {w: i for i, w in enumerate(names)}
    own = lambda w: w.lower() if w.lower() in model["vocabulary"] else quality_classifier.shape_name(quality_classifier.shape_of(w))
    index = {w: quality_classifier.index_vector(w).astype(np.float64) for w in names}
    near = {w: np.zeros(quality_classifier.DIM) for w in names}
    for t in tokens:
        for i, w in enumerate(t):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(t):
                    near[own(w)] += index[own(t[j])]
    vector = {w: near[w] / (np.linalg.norm(near[w]) + 1e-6) + index[w] / 2 for w in names}
    assert all(np.abs(vector[w] - model["vectors"][i]).max() < 1e-4 for i, w in enumerate(names))
    mean, scale, a, b, c, d = model["weights"]
    got = {(r.doc_id, i): r for i, r in enumerate(quality_classifier.quality_score(frame.coalesce(1), model).collect())}
    for i, (doc, text) in enumerate(texts + hot):
        t = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")
        x = np.zeros(len(mean))
        if t:
            vs = np.array([vector[own(w)] for w in t])
            shapes = Counter(quality_classifier.shape_of(w) for w in t)
            x = np.concatenate([vs.mean(0), vs.std(0), [shapes[k] / len(t) for k in range(7)], [math.log1p(len(t)) / 10, len(set(t)) / len(t), text.count("\n") / len(t), len(t) / (1 + len(text))]])
        logit = float(np.tanh((x - mean) / scale @ a + b) @ c + d[0])
        score = 1 / (1 + math.exp(-logit / model["temperature"]))
        assert abs(got[doc, i].score - score) < 2e-3 and got[doc, i].predicted == (got[doc, i].score >= 0.7), doc


def naive_packing(lengths, capacity):
    """The number of sequences by the same rule, piece by piece."""
    large, small, rooms = sorted(n for n in lengths if 3 * n > capacity), sorted((n for n in lengths if 3 * n <= capacity), reverse=True), []
    while large:
        a = large.pop()
        fit = [n for n in large if a + n <= capacity]
        if fit:
            large.remove(fit[-1])
        rooms.append(capacity - a - (fit[-1] if fit else 0))
    for n in small:
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - n)
    return len(rooms)


def fewest(lengths, capacity):
    """The least number of sequences there is, by trying all."""
    best = len(lengths)

    def put(left, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not left:
            best = len(rooms)
            return
        n = left[0]
        for r in set(rooms):
            if r >= n:
                i = rooms.index(r)
                put(left[1:], [*rooms[:i], r - n, *rooms[i + 1 :]])
        put(left[1:], [*rooms, capacity - n])

    put(sorted(lengths, reverse=True), [])
    return best


def test_quality_gradient():
    """The first step of training goes against the log loss's slope, taken by differences, in every weight; the temperature is the best there is."""
    draw = np.random.default_rng(5)
    x, y = draw.normal(size=(60, 6)), (draw.random(60) < 0.3).astype(float)
    back = np.arange(60) % 5 == 4
    network = quality_classifier.Network.train(x, y, back, epochs=1, rate=0.01, decay=1e-3, seed=3)
    at = np.flatnonzero(~back)
    mean, scale = x[at].mean(0), x[at].std(0) + 1e-3
    z, hidden = (x[at] - mean) / scale, quality_classifier.HIDDEN
    own = np.random.Generator(np.random.PCG64(3))
    start = [own.normal(0, 1 / np.sqrt(6), (6, hidden)), np.zeros(hidden), own.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    share = y[at].mean()

    def loss(w):
        logits = np.tanh(z @ w[0] + w[1]) @ w[2] + w[3]
        each = np.logaddexp(0, logits) - y[at] * logits
        return np.mean(each * np.where(y[at] > 0.5, 0.5 / share, 0.5 / (1 - share))) + 0.5e-3 * ((w[0] ** 2).sum() + (w[2] ** 2).sum())

    checked = 0
    for k, w in enumerate(start):
        for i in np.ndindex(w.shape):
            up, down = ([a.copy() for a in start] for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            if abs(slope) > 1e-5:  # Adam's first step is the rate, against the slope's sign
                assert abs(network.weights[2 + k][i] - (w[i] - 0.01 * np.sign(slope))) < 2e-5
                checked += 1
    assert checked > 0.9 * sum(w.size for w in start)
    held = np.flatnonzero(back)
    target = 0.995 * y[held] + 0.0025
    logits = network.logits(x[held])
    cost = lambda t: np.mean(np.logaddexp(0, logits / t) - target * logits / t)
    assert cost(network.temperature) <= min(cost(t) for t in np.geomspace(0.2, 20, 1000)) + 1e-3


def test_packing_plan_brute_force():
    draw = random.Random(8)
    more = 0
    for k in range(600):
        capacity = draw.choice([7, 10, 24, 60])
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 9 if k < 300 else 120))]
        found = packing.Plan(dict(Counter(lengths)), capacity).sequences
        assert found == naive_packing(lengths, capacity)
        if k < 300:
            least = fewest(lengths, capacity)
            assert least <= found <= least + 1
            more += found - least
    assert more <= 30  # of 300


def test_packing_plan_is_bounded():
    """The plan follows the capacity, not the number of pieces."""
    draw = random.Random(3)
    counts = {n: draw.randint(1, 50) for n in range(1, 2049)}
    small, large = (packing.Plan({n: k * c for n, c in counts.items()}, 2048) for k in (1, 1000))
    assert len(large.runs) <= 1.5 * len(small.runs) + 100 and len(large.runs) < 200_000


def test_packing_pieces(spark):
    got = packing.op4_best_fit_packing(spark, DATA).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, text, *_ in documents():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            want[d, k // 2048] = (k, len(own), zlib.crc32(own.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *[n for _, n in sorted(pieces)][:-1]]).tolist()
        assert sum(n for _, n in pieces) <= 2048
    assert len(by) <= math.ceil(1.02 * sum(r.length for r in got) / 2048) + 1


def test_word_tokenizer():
    """Against the plain library call, in which a special token's string is that token."""
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        own = packing.WordTokenizer(f.read())
    whole = Tokenizer.from_file(path)
    draw = random.Random(1)
    alphabet = [*"aeßÀéİΣσςＡﬁ½²ª1'.,;|-  ́ \n\tstmrel", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "中", "🙂"]
    special = 0
    for _ in range(4000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 14)))
        want = whole.encode(text, add_special_tokens=False).ids
        special += bool({49406, 49407} & set(want))
        assert own.ids(text).tolist() == want, repr(text)
    assert special > 500


def test_packing_special_tokens(spark):
    """Texts with the strings of special tokens are packed as the plain call encodes them."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|> c", "plain words", "ü<|endoftext|>" * 1500]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), with_ids=True).collect()
    for d, text in enumerate(texts):
        ids = [i for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece) for i in r.ids]
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert sum(49407 in r.ids for r in got) >= 3


def test_sketch_merges(spark):
    frame = spark.createDataFrame([("a b c d e f g h", "x y z u v w")], "a string, b string")
    a, b = (fingerprints.sketch(F.col(c), share=0.99) for c in "ab")
    both = frame.select(fingerprints.merged(a, b).alias("m"), a.alias("a"), b.alias("b"))
    row = both.select(fingerprints.containment(F.col("a"), F.col("m")), fingerprints.likeness(F.col("a"), F.col("m")), fingerprints.likeness(F.col("a"), F.col("b"))).first()
    assert row[0] == 1.0 and 0.5 < row[1] < 0.8 and row[2] == 0.0


def test_next_rows(spark):
    """Each row's next, with hot and null ids, ids of 64 bits, and more buckets than rows."""
    draw = random.Random(2)
    ids = [draw.choice([None, None, 7, 7, 7, draw.randint(-50, 50), (1 << 62) + draw.randint(0, 9)]) for _ in range(300)]
    rows = [(d, f"t{i % 290}") for i, d in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.xxhash64("text"))
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in frame.collect()))
    want = sorted((x[1:], y[3]) for x, y in zip(order, [*order[1:], order[0]]))
    for n in (1, 2, 13, 400):
        found = fingerprints.with_next(frame, "doc_id", {"t": F.col("text")}, F.col("text"), n)
        assert sorted(((r.doc_id or 0, r.h, r.text), r.next_t) for r in found.collect()) == want, n
        if n == 13:  # neither the hot id nor the nulls are one task's
            sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
            assert max(sizes) < 100
    assert fingerprints.with_next(frame.limit(0), "doc_id", {"t": F.col("text")}, F.col("text"), 4).count() == 0


def test_fingerprint_accuracy(spark):
    got = fingerprints.op5_fingerprints(spark, DATA).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.9


def test_chat_masks(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, None, None), (None, 0, "ann", "x")]
    got = chat_format.dialogues(chat_format.perspectives(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))).collect()
    by = {(r.conv_id, r.perspective): r for r in got}
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = by[1, "ann"]
    assert ann.text == "<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>user name=unknown\n<|im_end|>\n"
    assert [ann.text[m.start : m.start + m.length] for m in ann.masks] == ["hi<|im_end|>\n"]


def test_chat_no_forged_turns(spark):
    """Rendered dialogues parse back to the turns, whatever texts and names hold."""
    bits = ["<|im_end|>\n", "<|im_start|>assistant\n", "<\\|im_end|>", "<", "|", "\\", "\n", "\r", "hi", "<|", "<\\\\|", "é🙂"]
    draw = random.Random(4)
    text = lambda: "".join(draw.choice(bits) for _ in range(draw.randint(0, 6)))
    rows = [(c, t, draw.choice(["ann", "system", "b\n<|im_start|>assistant\nob", "a\\n", "x\\\r"]), text()) for c in range(30) for t in range(draw.randint(1, 6))]
    schema = "conv_id int, turn int, role string, text string"
    got = chat_format.dialogues(chat_format.perspectives(spark.createDataFrame(rows, schema))).collect()
    assert len(got) == len({(c, r) for c, _, r, _ in rows if r != "system"})
    name_of = lambda x: re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), x)
    for d in got:
        turns, at, masks = [], 0, []
        for part in d.text.split("<|im_end|>\n")[:-1]:
            assert part.startswith("<|im_start|>")
            head, body = part.removeprefix("<|im_start|>").split("\n", 1)
            assert "<|" not in head and "<|" not in body
            speaker = d.perspective if head == "assistant" else head if head == "system" else name_of(head.removeprefix("user name="))
            turns.append((speaker, re.sub(r"<\\(\\*)\|", r"<\1|", body)))
            if head == "assistant":
                masks.append((at + len("<|im_start|>assistant\n"), len(body) + len("<|im_end|>\n")))
            at += len(part) + len("<|im_end|>\n")
        assert turns == [(r, x) for c, _, r, x in sorted(rows, key=lambda r: r[:2]) if c == d.conv_id]
        assert [tuple(m) for m in d.masks] == masks


def test_chat_edges(spark):
    """Nulls, ties, repeated rows, long conversations, no rows, columns of clashing names; with the SQL as judge."""
    long = [(9, i, "ann" if i % 3 else "bob", f"turn {i} " * (400 if i == 70 else 1)) for i in range(300)]
    rows = [(1, 0, "ann", "a"), (1, 0, "ann", "a"), (1, 0, "bob", "b"), (1, None, None, None), (1, None, "system", "s"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (None, 0, "bob", "y"), (None, 1, "system", "z"), (3, -200, "ann", ""), *long]
    for own in (rows, []):
        frame = spark.createDataFrame([(*r, 1, "x", 2) for r in own], "conv_id int, turn int, role string, text string, seq int, segment string, _key int")
        con = duckdb.connect()
        con.execute("CREATE TABLE conversations (conv_id INT, turn INT, role VARCHAR, text VARCHAR)")
        if own:
            con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", own)
        same(chat_format.perspectives(frame), con, chat_format.ORACLE)


def test_quality_rules_brute_force():
    draw = random.Random(2)
    for _ in range(300):
        text = "".join(draw.choice(["a ", "b ", "c ", "é# ", "\n", "a b c a b ", "\t"]) for _ in range(draw.randint(0, 40)))
        words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {i + o for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for o in range(5)}
        lines = [x for x in text.split("\n") if x.strip(" \t")]
        got = quality_rules.measure(text)
        assert got[:5] == [len(words), sum(map(len, words)), text.count("#"), len(lines) - len(set(lines)), len(inside)], repr(text)


def test_byte_bpe(spark):
    ranks = byte_bpe.load_ranks(byte_bpe.default_vocabulary())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(ranks)
    draw = random.Random(3)
    alphabet = "aestmdrvlEL'' '  \n\t1٣é!#., 日本 ñ½́​🙂 \x85"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 14))) for _ in range(4000)] + [d[1] for d in documents()]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        offsets = codec.offsets(ids)
        assert codec.decode(ids, offsets) == text.encode()
        if len(ids):
            at = len(ids) // 2
            assert codec.decode(ids[at:], offsets[at:]) == text.encode()[offsets[at] :]
    frame = spark.createDataFrame(list(enumerate(texts[:50])), "doc_id bigint, text string")
    back = {r.doc_id: r.text for r in byte_bpe.decode(byte_bpe.encode(frame)).collect()}
    assert back == dict(enumerate(texts[:50]))


def test_byte_bpe_query(spark):
    """The query's hashes against tiktoken's ids and the texts' bytes."""
    ranks = byte_bpe.load_ranks(byte_bpe.default_vocabulary())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.op8_byte_bpe(spark, DATA).collect()}
    docs = documents()
    assert len(got) == len(docs)
    for d, text, *_ in docs:
        ids = library.encode_ordinary(text or "")
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe_long_slices():
    """Slices without a break: the library's ids, in time that does not grow with the square."""
    ranks = byte_bpe.load_ranks(byte_bpe.default_vocabulary())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(ranks)
    draw = random.Random(5)
    for alphabet in ("ab", "a", "acgt", "abcdefghijklmnopqrstuvwxyz", "日本é", "= -"):
        for n in (1, 2, 129, 130, 700, 3000):
            text = "".join(draw.choice(alphabet) for _ in range(n))
            assert codec.encode([text])[0].tolist() == library.encode_ordinary(text), (alphabet, n)
    long = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.perf_counter()
    ids = codec.encode([long])[0]
    assert time.perf_counter() - began < 20  # the square would take minutes
    assert codec.decode(ids, codec.offsets(ids)) == long.encode()
    assert len(codec.cache) == 0 or max(map(len, codec.cache)) <= byte_bpe.LONG


def test_lm_brute_force(spark):
    got = {r.doc_id: r for r in lm_scoring.op9_lm_scoring(spark, DATA).collect()}
    held = {d for d in got if zlib.crc32(str(d).encode()) % 5 == 1}
    texts = {d: lm_scoring.tokens_of(t) for d, t, *_ in documents()}
    counts = Counter(w for d, t in texts.items() if d not in held for w in t)
    n, v = sum(counts.values()), len(counts)
    for d, t in texts.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in counts for w in t), n, d in held)
        assert abs(r.base_score - base) < 1e-6
    assert sum(got[d].score for d in held) > sum(got[d].base_score for d in held)


def test_lm_classes_from_all_texts(spark, monkeypatch):
    """Neighbours are counted in every training text, however many there are."""
    draw = random.Random(6)
    texts = [" ".join(f"w{int(draw.paretovariate(1)) % 90}" for _ in range(draw.randint(0, 12))) for _ in range(2500)]
    seen = []
    whole = lm_scoring.neighbours
    monkeypatch.setattr(lm_scoring, "neighbours", lambda df, names: seen.append((names, whole(df, names))) or seen[-1][1])
    lm_scoring.fit(spark.createDataFrame([(x,) for x in [*texts, None]], "text string"))
    (names, found), = seen
    at = {w: i for i, w in enumerate(names)}
    want: Counter = Counter()
    for words in map(lm_scoring.tokens_of, texts):
        for a, b in zip(words, words[1:]):
            if at[b] < lm_scoring.NEIGHBOURS:
                want[at[a], at[b]] += 1
            if at[a] < lm_scoring.NEIGHBOURS:
                want[at[b], at[a] + lm_scoring.NEIGHBOURS] += 1
    assert {(r.w, r.f): r.n for r in found.collect()} == want


def plain_rows(words, kinds, n_rows):
    """Of each token of a text the weight rows of its history, by whole numbers; word rows end with the class history's."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return (x >> 40) & (n_rows - 1)

    out = []
    for i in range(len(words)):
        w = [zlib.crc32(words[i - d]) + 1 if i >= d else 0 for d in (1, 2)]
        k = [kinds[i - d] if i >= d else 16 for d in (1, 2, 3)]
        pair = ((w[0] * 0x9E3779B97F4A7C15 & mask) ^ w[1]) * 5 + 3 & mask
        out.append([mix(w[0] * 5 + 1), mix(w[1] * 5 + 2), mix(pair), mix((k[0] * 17 + k[1]) * 17 + k[2] + (1 << 40))])
    return out


def plain_choices(words, leaves, n_rows):
    """(weight rows, outcome) of each token's class choice, and of its group choice."""
    kinds = [x // 16 for x in leaves]
    rows = plain_rows(words, kinds, n_rows)
    first = [(r + [2 * n_rows], k) for r, k in zip(rows, kinds)]
    second = [([(x ^ int(lm_scoring.TURNS[k])) % n_rows + n_rows for x in r] + [2 * n_rows + 1 + k], leaf % 16) for r, k, leaf in zip(rows, kinds, leaves)]
    return first, second


def plain_softmax(weights, rows):
    x = sum(weights[r].astype(np.float64) for r in rows)
    e = np.exp(x - x.max())
    return e / e.sum()


def tiny_corpus():
    draw = random.Random(11)
    names = [f"{a}{b}" for a in "pqrst" for b in ("ing", "ed", "ly", "s")]
    follow = {w: draw.sample(names, 4) for w in names}
    docs = []
    for i in range(60):
        words = [draw.choice(names)]
        while len(words) < draw.randint(1, 30):
            words.append(draw.choice(follow[words[-1]]))
        docs.append((i, " ".join(words)))
    return [*docs, (60, None), (61, "Unseen WORDS here"), (62, "ping ping")]


def test_lm_score_brute_force(spark, monkeypatch):
    """Weights, by gradient steps written out; scores, token by token; probabilities that sum to one."""
    monkeypatch.setattr(lm_scoring, "STEP_TOKENS", 100)
    docs = tiny_corpus()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    model = lm_scoring.fit(frame.where("doc_id < 61"))
    n_rows = model.rows
    texts = [lm_scoring.tokens_of(t) for d, t in docs if d < 61]
    leaf = lambda w: model.known.leaf_of(w)
    weights, squares = lm_scoring.empty_weights(n_rows).astype(np.float64), defaultdict(float)
    hashes = [r[0] for r in frame.where("doc_id < 61").select(F.pmod(F.xxhash64("text"), F.lit(lm_scoring.FIRST_ROUND))).collect()]
    for one in (True, False):
        squares.clear()
        choices = [plain_choices(t, [leaf(w) for w in t], n_rows) for t, h in zip(texts, hashes) if (h == 0) == one]
        first, second = [x for c in choices for x in c[0]], [x for c in choices for x in c[1]]
        for a in range(0, len(first), 100):
            grads, counts = defaultdict(lambda: np.zeros(16)), Counter()
            for rows, outcome in first[a : a + 100] + second[a : a + 100]:
                d = plain_softmax(weights, rows)
                d[outcome] -= 1
                for r in rows:
                    grads[r] += d
                    counts[r] += 1
            for r, g in grads.items():
                g = g / math.sqrt(counts[r])
                squares[r] += (g * g).sum() / 16
                weights[r] -= 0.5 * g / math.sqrt(1 + squares[r])
    assert np.abs(weights - model.weights).max() < 1e-3 and np.abs(weights).max() > 0.1
    got = {r.doc_id: r for r in lm_scoring.lm_score(frame, model).collect()}
    counts = Counter(w for t in texts for w in t)
    leaves = {w: leaf(w) for w in counts}
    size, distinct = Counter(), Counter()
    for w, c in counts.items():
        size[leaves[w]] += c
        distinct[leaves[w]] += 1
    share = lambda w: (counts[w] + 0.5) / (size[leaf(w)] + 0.5 * (distinct[leaf(w)] + 1))
    for d, t in docs:
        words = lm_scoring.tokens_of(t)
        want = 0.0
        for w, (r1, k), (r2, g) in zip(words, *plain_choices(words, [leaf(w) for w in words], n_rows)):
            one, two = plain_softmax(model.weights, r1), plain_softmax(model.weights, r2)
            want += math.log10(one[k] * two[g] * share(w))
        assert abs(got[d].score - want) < 1e-3, d
    # all words after one history, with a half count for those never seen in each leaf
    rows = plain_rows([b"ping", b"qed"], [leaf(b"ping") // 16, 0], n_rows)[1]
    one = plain_softmax(model.weights, rows + [2 * n_rows])
    total = 0.0
    for k in range(256):
        two = plain_softmax(model.weights, [(x ^ int(lm_scoring.TURNS[k // 16])) % n_rows + n_rows for x in rows] + [2 * n_rows + 1 + k // 16])
        rest = 0.5 / (size[k] + 0.5 * (distinct[k] + 1))
        total += one[k // 16] * two[k % 16] * (sum(share(w) for w in leaves if leaves[w] == k) + rest)
    assert abs(total - 1) < 1e-6
    # the history counts: a word that follows is likelier than one that doesn't
    assert sum(r.score for d, r in got.items() if d < 60) > sum(r.base_score for d, r in got.items() if d < 60) + 50


def test_broadcasts_need_no_module(spark, monkeypatch):
    """Broadcast values are unpickled by plain pickle, on executors that have no copy of this package."""
    import pickle

    from pyspark import SparkContext

    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or broadcast(self, value))
    frame = spark.createDataFrame([(i, f"some words of text {i}", "en") for i in range(20)], "doc_id bigint, text string, lang string")
    lm_scoring.lm_score(frame, lm_scoring.fit(frame)).collect()
    language_id.language_id(frame, language_id.fit(frame)).collect()
    quality_classifier.quality_score(frame, quality_classifier.fit(frame, frame.selectExpr("doc_id", "int(doc_id % 2) AS quality"), "doc_id", "text", "quality")).collect()
    packing.pack(frame).collect()
    byte_bpe.digest(frame).collect()
    byte_bpe.decode(byte_bpe.encode(frame)).collect()
    merge_automaton.decode(merge_automaton.encode(frame)).collect()
    assert ranked_search.search(frame, frame.select(F.col("doc_id").alias("item_id"), "text")).count() > 0
    vectors = frame.select(F.col("doc_id").alias("vec_id"), F.array("doc_id").alias("embedding"), (F.col("doc_id") % 2).alias("label"))
    hard_negatives.hard_negatives(vectors, F.col("id") % 5 == 0).collect()
    assert len(sent) >= 14 and not any(b"corpusloom" in x for x in sent)


def test_lm_histories_end_at_texts():
    draw = np.random.default_rng(1)
    hashes, kinds = draw.integers(0, 1 << 32, 50).astype(np.uint64), draw.integers(0, 16, 50).astype(np.uint8)
    rows = lm_scoring.features(hashes, kinds, np.array([0, 20, 21, 23]), 1 << 10)
    for a, b in ((0, 20), (20, 21), (21, 23), (23, 50)):
        assert (rows[:, a:b] == lm_scoring.features(hashes[a:b], kinds[a:b], np.array([0]), 1 << 10)).all()


def test_lm_sorted_order():
    draw = np.random.default_rng(1)
    for top in (100, 1 << 16, 1 << 21):
        x = draw.integers(0, top, 5000).astype(np.uint32)
        assert (lm_scoring._sorted_order(x) == np.argsort(x, kind="stable")).all()
    d = draw.normal(size=(900, 16)).astype(np.float32)
    rows = np.minimum(draw.zipf(1.4, (4, 900)), 300).astype(np.int64)
    own, sums, counts = lm_scoring.sums_by_row(d, rows)
    assert sorted(own.tolist()) == np.unique(rows).tolist() and counts.max() > lm_scoring.TOGETHER
    for r, x, c in zip(own, sums, counts):
        assert c == (rows == r).sum() and np.allclose(x, sum(d[(rows[i] == r)].sum(0) for i in range(4)), atol=1e-3)


def test_lm_head_of_flat_counts(spark, monkeypatch):
    """More words of one count than the head holds: it is filled all the same, and base scores stay exact."""
    monkeypatch.setattr(lm_scoring, "HEAD", 50)
    docs = [(i, " ".join(f"w{(i * 10 + k) % 400}" for k in range(10))) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = lm_scoring.fit(frame)
    assert 20 <= len(model.known.head) <= 80
    texts = [lm_scoring.tokens_of(t) for _, t in docs]
    counts = Counter(w for t in texts for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in lm_scoring.lm_score(frame, model).collect():
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in texts[r.doc_id])) < 1e-6
        assert r.n_known == len(texts[r.doc_id])


def test_join_brute_force(spark):
    draw = random.Random(9)
    docs = []
    for g in range(12):
        base = [f"w{draw.randint(0, 500)}" for _ in range(draw.randint(30, 200))]
        for _ in range(draw.choice([1, 2, 5])):
            words = list(base)
            for _ in range(draw.randint(0, 4)):
                words[draw.randrange(len(words))] = "edit" + str(draw.randint(0, 99))
            docs.append(words)
    docs += [docs[0], docs[0], ["one", "two"], ["one", "two"], []]
    docs = [(i * 3 + 1, " ".join(w)) for i, w in enumerate(docs)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t else set() for i, t in docs}
    near = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                near[a].add(b)
    got = {r.doc_id: r for r in ngram_join.jaccard_join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for i in sets:
        reach, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - reach
            reach |= new
            todo += new
        assert (got[i].n_links, got[i].class_id) == (len(near[i]), min(reach))
        assert got[i].rep_id == (min(j for j in sets if sets[j] == sets[i]) if sets[i] else i)


def test_join_large_group(spark, monkeypatch):
    """A group beyond the limits of nodes and blocks: all links are found."""
    monkeypatch.setattr(ngram_join, "LIMIT", 20)
    monkeypatch.setattr(ngram_join, "BLOCK", 2000)
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join([*base[:50], f"x{i}", *base[51:]])) for i in range(90)]
    got = ngram_join.jaccard_join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert all((r.class_id, r.n_links) == (0, 89) for r in got)


def test_join_mixed_node(spark, monkeypatch):
    """Of nodes beyond the limit, of documents on a common form, every pair that is near is tied, by a single run."""
    monkeypatch.setattr(ngram_join, "LIMIT", 10)
    monkeypatch.setattr(ngram_join, "NODE_BLOCK", 40, raising=False)
    draw = random.Random(4)
    form = [f"form{i}" for i in range(90)]
    docs = []
    for i in range(200):
        own = [f"x{i}_{k}" for k in range(70)]
        docs.append((2 * i, " ".join([*form, *own])))
        own[10] = own[30] = own[50] = "edit"
        docs.append((2 * i + 1, " ".join([*form, *own])))
    signatures = np.stack([ngram_join.tokens(ngram_join.shingles(t)) for _, t in docs])
    members, paths = np.arange(400), np.full(400, ngram_join._root(0))
    shared, largest = set(), 0
    for level in range(1, ngram_join.LEVELS + 1):
        row, paths = ngram_join.children(paths, signatures[members], 0.8)
        members = members[row]
        nodes = defaultdict(list)
        for m, p in zip(members.tolist(), paths.tolist()):
            nodes[p].append(m)
        leaves = [x for x in nodes.values() if len(x) <= 10 or level == ngram_join.LEVELS]
        largest = max([largest, *map(len, leaves)])
        shared |= {(a, b) for x in leaves for a in x for b in x if a // 2 == b // 2 and a < b}
        go = np.array([len(nodes[p]) > 10 for p in paths.tolist()])
        members, paths = members[go], paths[go]
    assert len(shared) > 20 and largest > 40
    sets = [ngram_join.shingles(t) for _, t in docs]
    rows = spark.createDataFrame([(i, len(h), bytearray(x.tobytes()), bytearray(ngram_join.sketch(h).tobytes())) for i, (x, h) in enumerate(zip(signatures, sets))], "id bigint, n_shingles bigint, signature binary, sketch binary")
    root = {r.id: r.root for r in components.components(ngram_join.candidates(rows, recall=0.1)).collect()}
    assert [(a, b) for a, b in sorted(shared) if a not in root or root[a] != root.get(b)] == []


def test_sketches_keep_near_pairs():
    """No pair at the threshold is lost, of sets of any size; of pairs far below it few are kept."""
    draw = np.random.default_rng(3)
    lost = kept = 0
    for n in (1, 3, 10, 30, 60, 130, 300, 1000, 5000):
        for _ in range(200):
            own = lambda share: round(n * (1 - share) / (1 + share))  # noqa: E731  each side's own shingles at a likeness
            pairs = []
            for share in (0.8, 0.45):
                k = int(own(share))
                common = draw.integers(0, 1 << 63, max(n - k, 0), np.uint64) * np.uint64(2)
                pairs.append([np.unique(np.concatenate([common, draw.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in range(2)])
            for i, (a, b) in enumerate(pairs):
                likeness = len(np.intersect1d(a, b)) / max(len(np.union1d(a, b)), 1)
                found = ngram_join.near(ngram_join.sketch(a)[None], ngram_join.sketch(b)[None], np.array([len(a)]), np.array([len(b)]), 0.8)[0, 0]
                lost += likeness >= 0.8 and not found
                kept += i == 1 and n >= 130 and found
    assert lost == 0 and kept == 0


def test_join_common_form(spark):
    """Texts that share a form are no group; each is linked with its own copy alone, and all links are found."""
    draw = random.Random(12)
    form = [f"form{i}" for i in range(124)]
    docs = []
    for i in range(1000):
        own = [f"x{draw.random()}" for _ in range(80)]
        docs.append((2 * i, " ".join([*form, *own])))
        own[40] = "edit"
        docs.append((2 * i + 1, " ".join([*form, *own])))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    reps = ngram_join._signed(frame, "doc_id", "text", 5)
    sizes = components.components(ngram_join.candidates(reps)).groupBy("root").count()
    assert sizes.agg(F.max("count")).first()[0] <= 4  # with tokens alone: hundreds
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_join(frame).collect()}
    assert sum(got[d] == (d - d % 2, 1) for d, _ in docs) >= 0.99 * len(docs)


def test_least_across():
    near = np.zeros((4, 3), bool)
    near[1, 0] = near[2, 0] = near[2, 2] = near[3, 2] = True
    left, right = ngram_join.least_across(near)
    assert left.tolist() == [0, 1, 1, 1] and right.tolist() == [1, 4, 1]
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 3, (2, 90, ngram_join.BINS)).astype(np.uint8)
    assert (ngram_join.agreement(a, b) == (a[:, None] == b).sum(2)).all() and (ngram_join.agreement(a[:5], b) == (a[:5, None] == b).sum(2)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def test_lm_sends_used_rows(spark):
    """Partitions send the rows that they have used, and the sums are those of whole tables."""
    draw = np.random.default_rng(4)
    tables = []
    for lane in range(7):
        table = np.zeros((4 * lm_scoring.CHUNK, lm_scoring.CLASSES + 1), "<f4")
        at = draw.choice(len(table) // 2, 30)
        table[at] = draw.integers(1, 9, (30, lm_scoring.CLASSES + 1))
        tables.append(table)
    sent = [b for lane, x in enumerate(tables) for b in lm_scoring.packed(x, lane % 3)]
    assert sum(len(b.column(3)[0].as_py()) for b in sent) == sum(int((x[:, -1] > 0).sum()) for x in tables) * 4 * (lm_scoring.CLASSES + 1)
    total = sum(x.astype(np.float64) for x in tables)
    means = {b.column(0)[0].as_py(): np.frombuffer(b.column(1)[0].as_py(), "<f4").reshape(lm_scoring.CHUNK, -1) for b in lm_scoring.averaged(list(lm_scoring.added(sent)))}
    assert set(means) <= {0, 1}
    for k, mean in means.items():
        own = total[k * lm_scoring.CHUNK : (k + 1) * lm_scoring.CHUNK]
        used = own[:, -1] > 0
        assert np.isnan(mean[~used]).all() and np.allclose(mean[used], own[used, :-1] / own[used, -1:], rtol=1e-6)
