"""BPE encoding and decoding by an automaton over tokens, compiled from the merge rules.

The automaton reads token sequences and accepts those that BPE makes. It begins as one state with an arc for
each byte. Then each rule (u, v) -> w, in order of rank, adds its gadget: the state that arcs of u lead to
is copied without its arc of v, arcs of u are redirected to the copy, and wherever an arc of u leaves, one
of w leaves too, to the state that v led to. So a state is known by the rule that made it, arcs of one
token all lead to one state, and the automaton is deterministic, with at most one state more than there
are rules.

A state has arcs for nearly every token, so none are listed: whether one is open follows from the rules that
copied the state, and answers are kept in a table by state and token. A word is run by this table from byte
to byte: of the tokens that end at a byte, just one is open after the encoding of what is before it, because
a prefix has one encoding too. A long word costs its length times the longest token's, not its square. The
path's tokens are the ids; decoding emits the labels of its arcs, which are the tokens' bytes.

Words come from the byte-level pre-tokeniser's pattern, found by the scan of byte_bpe with the classes that
the tokenizer library gives to code points.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import byte_bpe
from corpusloom.llm.common import keep_first, prepare, read
from corpusloom.llm.packing import BYTE_CHARS

#: Words, and pairs of state and token, that a Python worker keeps at most; bytes of a word that is kept.
CACHE_WORDS, CACHE_ARCS, LONG = 400_000, 1_000_000, 128
#: Characters whose words are looked for at a time.
SPAN = 1 << 20

BYTE_OF = {c: b for b, c in BYTE_CHARS.items()}


def token_bytes(token: str) -> bytes:
    """What a token of the vocabulary stands for: bytes by their characters; a string that has others stands for itself."""
    return bytes(BYTE_OF[c] for c in token) if all(c in BYTE_OF for c in token) else token.encode()


class Automaton:
    """Compiled from `rules`, pairs of byte strings by rank. Tokens are numbered: bytes first, then what the rules make.

    Each rule's parts are bytes or made by rules before it, and no two rules make the same token; other
    lists of rules are a ValueError, because their encodings aren't those of any such automaton.
    """

    def __init__(self, rules: list[tuple[bytes, bytes]]):
        self.labels = [bytes([b]) for b in range(256)]
        self.left = [-1] * 256
        #: the number of the rule that made a token; 0 for bytes
        self.born = [0] * 256
        #: the state that a token's arcs lead to, and the one that they led to when the token was made; 0 is the first state
        self.to, self.base = [0] * 256, [0] * 256
        #: of each state the token whose arcs were redirected to it
        self.owner = [-1]
        self.rules: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        number = {x: i for i, x in enumerate(self.labels)}
        for u, v in rules:
            if u not in number or v not in number or u + v in number:
                raise ValueError(f"the rule {u!r} {v!r} needs a part that no rule before it makes, or makes a token again")
            number[u + v] = len(self.labels)
            self._add(number[u], number[v])
        #: tokens by their bytes; bytes that only end a token have -1
        self.ends: dict[bytes, int] = {}
        for t, x in enumerate(self.labels):
            if self.to[t] >= 0:
                for i in range(1, len(x)):
                    self.ends.setdefault(x[i:], -1)
                self.ends[x] = t

    def _add(self, u: int, v: int) -> None:
        """The gadget of the next rule. A rule whose arcs are closed never applies: its token has none."""
        at = len(self.owner)
        works = self.to[u] >= 0 and self.to[v] >= 0 and self.is_open(self.to[u], v)
        self.owner.append(u if works else -1)
        self.labels.append(self.labels[u] + self.labels[v])
        self.left.append(u)
        self.born.append(at)
        self.to.append(self.to[v] if works else -1)
        self.base.append(self.to[v])
        if works:
            self.rules[u, v] = at
            self.to[u] = at

    def is_open(self, state: int, t: int) -> bool:
        """Whether an arc of token t leaves the state.

        A copy lacks what its rule took away and what the copied state lacked. A state that was there
        when t was made has an arc of t if it had one of t's left part then. The states that rules of one
        token made one after the other are passed in one step.
        """
        while state:
            u = self.owner[state]
            while state > self.born[u]:
                if self.born[t] >= state:
                    t = self.left[t]
                    continue
                if 0 < self.rules.get((u, t), 0) <= state:
                    return False
                state = self.born[t]
            state = self.base[u]
        return True

    def run(self, word: bytes) -> list[int]:
        """The tokens of the word's only path."""
        last, begin = [-1], [0]
        ends, arcs, to, size = self.ends, self.arcs, self.to, len(self.labels)
        for i in range(1, len(word) + 1):
            k = i
            while True:
                k -= 1
                t = ends.get(word[k:i]) if k >= 0 else None
                if t is None:
                    raise ValueError("no path")  # doesn't happen: every prefix has one
                if t < 0:
                    continue
                if not k:
                    break
                state = to[last[k]]
                key = state * size + t
                if (found := arcs.get(key)) is None:
                    if len(arcs) >= CACHE_ARCS:
                        keep_first(arcs)
                    found = arcs[key] = self.is_open(state, t)
                if found:
                    break
            last.append(t)
            begin.append(k)
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i = begin[i]
        return out[::-1]


def read_definition(path: str) -> dict:
    """What is needed of a tokenizer file: rules, ids by token, added tokens by string.

    Files of other kinds (not byte-level BPE by the pattern, or with a normal form, drop-out or unknown
    tokens, or added tokens with rules of their own) are a ValueError.
    """
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, split, added = found["model"], found["pre_tokenizer"] or {}, found["added_tokens"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if model["type"] != "BPE" or not plain or not byte_level or found["normalizer"] or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
        raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    own = {x["content"]: x["id"] for x in added}
    return {"rules": [(token_bytes(a), token_bytes(b)) for a, b in pairs], "ids": {token_bytes(t): i for t, i in model["vocab"].items() if t not in own}, "added": own}


def class_table() -> np.ndarray:
    """The class of every code point for byte_bpe's scan, as the tokenizer library's pattern sees it.

    Code points that Python and the library class alike come in one run of the library's pieces; those of
    other pieces are looked at one by one. The two may know different versions of Unicode.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    table = byte_bpe.class_table()
    known = {byte_bpe.LETTER: "a", byte_bpe.NUMBER: "1", byte_bpe.OTHER: "."}

    def kind(c: str) -> int:
        return next((k for k, x in known.items() if len(split(x + c)) == 1), byte_bpe.WHITE)

    surrogate = np.zeros(len(table), bool)
    surrogate[0xD800:0xE000] = True
    for k in (*known, byte_bpe.WHITE):
        points = np.flatnonzero((table == k) & ~surrogate)
        text = "".join(map(chr, points.tolist()))
        pieces = [p for _, p in split(text)]
        if k == byte_bpe.WHITE:
            pieces = [(i, i + 1) for i in range(len(text))]
        most = max(b - a for a, b in pieces)
        for a, b in pieces:
            if k == byte_bpe.WHITE or b - a < most:
                table[points[a:b]] = [kind(c) for c in text[a:b]]
    return table


class Codec:
    """Encodes and decodes batches of texts."""

    slices = byte_bpe.Codec.slices

    def __init__(self, definition: dict, table: np.ndarray):
        self.table, self.machine = table, byte_bpe.monoid()
        self.automaton = Automaton(definition["rules"])
        self.ids = [definition["ids"].get(x) for x in self.automaton.labels]
        if None in self.ids:
            raise ValueError(f"no id for {self.automaton.labels[self.ids.index(None)]!r}")
        self.labels = {i: x for x, i in definition["ids"].items()} | {i: token_bytes(x) for x, i in definition["added"].items()}
        self.added = {x: np.array([i], "<u4").tobytes() for x, i in definition["added"].items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = np.array([self.ids[t] for t in self.automaton.run(word.encode())], "<u4").tobytes()
            if len(word) <= LONG:
                if len(self.words) >= CACHE_WORDS:
                    keep_first(self.words)
                self.words[word] = found
        return found

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts without added tokens."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < SPAN):
                size += len(texts[to])
                to += 1
            for words in self.slices(texts[at:to]):
                yield b"".join(map(self._word, words))
            at = to

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null one has none. The string of an added token in a text is that token."""
        parts = [self.special.split(x or "") if self.special else [x or ""] for x in texts]  # every second one is an added token's
        plain = self._plain([p for x in parts for p in x[::2]])
        return [np.frombuffer(b"".join(self.added[p] if i % 2 else next(plain) for i, p in enumerate(x)), "<u4") for x in parts]

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids' arcs; U+FFFD stands for bytes that are no UTF-8, nothing for ids that aren't known."""
        label = self.labels.get
        return b"".join([label(i, b"") for i in ids]).decode(errors="replace")


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _map(df: DataFrame, id_col: str, value_col: str, fields: list[pa.Field], ddl: str, make, vocabulary: str | None) -> DataFrame:
    """id and the fields of each row, of which make(codec, values) gives a tuple for each value."""
    spark = df.sparkSession
    prepare(spark)
    # bounded by the tokenizer's file
    sent = spark.sparkContext.broadcast({"definition": read_definition(vocabulary or default_vocabulary()), "table": class_table()})

    def run(batches) -> Iterator[pa.RecordBatch]:
        kept = sent.value  # a worker keeps the automaton, with the words that it has run, between its tasks
        if "codec" not in kept:
            kept["codec"] = Codec(kept["definition"], kept["table"])
        for batch in batches:
            got = make(kept["codec"], batch.column(1).to_pylist())
            columns = [pa.array([x[i] for x in got], f.type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *(f.name for f in fields)])

    return df.select(id_col, value_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {ddl}")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, ids (array of int) of each row.

    One row in, one row out; ids of rows may be null or repeated. A null or empty text has no ids. Other
    columns are not read.
    """
    return _map(df, id_col, text_col, [pa.field("ids", pa.list_(pa.int32()))], "ids array<int>", lambda codec, texts: [(x,) for x in codec.encode(texts)], vocabulary)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """id, text of each row: the labels of its ids; a null array gives a null text, ids that are null or not known give nothing."""
    return _map(df, id_col, ids_col, [pa.field("text", pa.string())], "text string", lambda codec, rows: [(None if x is None else codec.decode(x),) for x in rows], vocabulary)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256: encoded and decoded in one pass, without moving the ids.

    Rows as in encode(): a null or empty text has no ids, and the hashes of nothing.
    """

    def make(codec: Codec, texts: list) -> list[tuple]:
        out = []
        for found in codec.encode(texts):
            ids = found.tolist()
            out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
        return out

    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return _map(df, id_col, text_col, fields, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, vocabulary)


def op13_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))


QUERIES = {"op13_merge_automaton": op13_merge_automaton}
ORACLES: dict[str, str] = {}
