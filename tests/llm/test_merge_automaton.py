"""The automaton against the tokenizer library."""

import hashlib
import json
import random
import time

import pytest
from tokenizers import Tokenizer, models

from corpusloom.llm import merge_automaton
from tests.helpers import DATA, views


def chars(x: bytes) -> str:
    return "".join(merge_automaton.BYTE_CHARS[b] for b in x)


def test_random_rules():
    """Every word's path is the library's encoding, for rules of any order, those that never apply included."""
    draw = random.Random(5)
    unused = 0
    for _ in range(300):
        letters = [b"a", b"b", b"c"][: draw.choice([1, 2, 3])]
        have, rules = list(letters), []
        for _ in range(draw.randint(0, 25)):
            u, v = draw.choice(have), draw.choice(have)
            if u + v not in have and len(u + v) <= 12:
                rules.append((u, v))
                have.append(u + v)
        automaton = merge_automaton.Automaton(rules)
        unused += sum(x < 0 for x in automaton.to)
        vocabulary = {chars(x): i for i, x in enumerate([*(bytes([b]) for b in range(256)), *have[len(letters) :]])}
        plain = models.BPE(vocab=vocabulary, merges=[(chars(u), chars(v)) for u, v in rules])
        for _ in range(40):
            word = b"".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
            assert [automaton.labels[t] for t in automaton.run(word)] == [t.value.encode() for t in plain.tokenize(word.decode())]
    assert unused > 0


def test_one_path():
    """Of the token sequences that spell a word the automaton accepts one: its states are deterministic and its gadgets complete."""
    automaton = merge_automaton.Automaton([(b"a", b"b"), (b"b", b"a"), (b"ab", b"a"), (b"a", b"a"), (b"aa", b"b"), (b"b", b"b"), (b"bb", b"ab")])

    def paths(word, state=0):
        if not word:
            yield ()
        for t, label in enumerate(automaton.labels):
            if automaton.to[t] >= 0 and word.startswith(label) and automaton.is_open(state, t):
                yield from ((t, *x) for x in paths(word[len(label) :], automaton.to[t]))

    for n in range(1, 11):
        for bits in range(1 << n):
            word = bytes(b"ab"[bits >> i & 1] for i in range(n))
            assert list(paths(word)) == [tuple(automaton.run(word))]


def test_rules_that_no_automaton_has():
    for rules in ([(b"ab", b"c"), (b"a", b"b")], [(b"a", b"b"), (b"ab", b"c"), (b"b", b"c"), (b"a", b"bc")]):
        with pytest.raises(ValueError):
            merge_automaton.Automaton(rules)


@pytest.fixture(scope="module")
def codec():
    return merge_automaton.Codec(merge_automaton.read_definition(merge_automaton.default_vocabulary()), merge_automaton.class_table())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(merge_automaton.default_vocabulary())


def test_strings(codec, library):
    """Random strings with white space, contractions, the added token, unassigned code points, emoji."""
    draw = random.Random(8)
    pool = [chr(x) for x in range(0x250)] + list("  \n\t'''strevmlld0123") * 8 + ["<|endoftext|>", "<|endoftext", "|>", "'ll", "　", "中", "é", "🙂", "\U000e0100", "ª", "Ⅷ", "͸", "​", " ", "᠎", "\x85"]
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|> \n <|endoftext|>"]
    texts += ["".join(draw.choice(pool) for _ in range(draw.randint(0, 60))) for _ in range(4000)]
    points = [x for x in (draw.randrange(draw.choice([0x110000, 0x3000, 0x20000])) for _ in range(60_000)) if not 0xD800 <= x < 0xE000]
    texts += ["".join(map(chr, points[i : i + 20])) for i in range(0, len(points), 20)]
    got = [x.tolist() for x in codec.encode(texts)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [codec.decode(x) for x in got] == texts
    cut = [x[1:] for x in got]  # whose bytes may begin inside a character
    assert [codec.decode(x) for x in cut] == [library.decode(x, skip_special_tokens=False) for x in cut]


def test_every_code_point(codec, library):
    """Each code point's class, by what it joins with."""
    table = merge_automaton.class_table()
    for k in range(0, 0x110000, 1 << 14):
        points = [x for x in range(k, k + (1 << 14)) if not 0xD800 <= x < 0xE000]
        text = "".join(f"a{chr(x)}1{chr(x)}.{chr(x)}\n" for x in points)
        pieces = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert codec.slices([text])[0] == pieces
    assert len(table) == 0x110000


def test_long_words(codec, library):
    """A word of half a million bytes takes seconds, not the square of its length."""
    word = "ab" * 100_000 + "xyz啊" * 30_000 + "-" * 100_000
    began = time.perf_counter()
    got = codec.encode([word])[0].tolist()
    assert time.perf_counter() - began < 20
    assert codec.decode(got) == word
    assert codec.encode([word[:3000]])[0].tolist() == library.encode(word[:3000], add_special_tokens=False).ids


def test_query(spark, library):
    got = {r.doc_id: r for r in merge_automaton.op13_merge_automaton(spark, DATA).collect()}
    texts = views().execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    assert len(got) == len(texts)
    for d, text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == want


def test_round_trip(spark):
    rows = [(1, "a text<|endoftext|> 🙂"), (1, "a text<|endoftext|> 🙂"), (None, "x"), (2, None), (3, "")]
    ids = merge_automaton.encode(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.text for r in merge_automaton.decode(ids).collect()} == {1: rows[0][1], None: "x", 2: "", 3: ""}
    odd = spark.createDataFrame([(1, [50256, 99999, None, 64]), (2, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in merge_automaton.decode(odd).collect()} == {1: "<|endoftext|>a", 2: None}


def test_other_tokenizers(tmp_path):
    with open(merge_automaton.default_vocabulary()) as f:
        found = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": found["model"] | {"dropout": 0.1}}):
        (tmp_path / "t.json").write_text(json.dumps(found | change))
        with pytest.raises(ValueError):
            merge_automaton.read_definition(str(tmp_path / "t.json"))
