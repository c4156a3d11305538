"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is a finite-state machine run as a scan. Every code point has a class, every class a
transition function on the machine's states, and the functions that classes compose to form a small
monoid. So the state after each code point comes from an associative scan over monoid elements: columns
of a block of text are composed at once for all blocks, then the blocks' products are scanned by
doubling, then the states are filled in. Token starts follow from the states of neighbouring places. The
slices between starts feed pair merging, whose results are cached by slice.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import keep_first, prepare, read

#: Classes of code points. A letter that can stand in a contraction has a class of its own.
LETTER, STMD, R, V, L, E, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, RESET = range(12)
N_CLASSES = 12
#: States: what the last code point was. A_: an apostrophe that begins a token. *_A: that and a letter. DONE: a contraction's end.
BEGIN, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, IN_WHITE, A_, R_A, V_A, L_A, DONE = range(11)
N_STATES = 11
#: What belongs to the property White_Space besides the categories Zs, Zl and Zp.
WHITE_CONTROLS = (9, 10, 11, 12, 13, 0x85)
BLOCK = 64
#: Slices of more bytes are merged by a heap, and aren't kept.
LONG = 128
CACHE_SLICES = 400_000
#: Ids that are decoded at a time.
SPAN = 1 << 16


def class_table() -> np.ndarray:
    """The class of every code point, from its general category.

    Python's tables may be of an older Unicode version than tiktoken's; what is unassigned in them is
    looked up in tiktoken's.
    """
    by = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    white = {"Zs", "Zl", "Zp"}
    kinds = [category(chr(i)) for i in range(sys.maxunicode + 1)]
    table = np.fromiter((WHITE if c in white else by.get(c[0], OTHER) for c in kinds), np.uint8, sys.maxunicode + 1)
    unassigned = "".join(chr(i) for i, c in enumerate(kinds) if c == "Cn")
    single = {bytes([i]): i for i in range(256)}
    for name, k in by.items():
        newer = tiktoken.Encoding(f"category-{name}", pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={})
        table[[ord(x) for x in bytes(newer.encode_ordinary(unassigned)).decode()]] = k
    table[list(WHITE_CONTROLS)] = WHITE
    table[ord(" ")] = SPACE
    table[ord("'")] = APOSTROPHE
    for letters, k in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(x) for x in letters]] = k
    return table


def step(state: int, kind: int) -> int:
    """The machine's transition."""
    if kind == RESET:
        return BEGIN
    if kind == APOSTROPHE:
        return IN_OTHER if state in (IN_OTHER, IN_SPACE, A_) else A_
    plain = {NUMBER: IN_NUMBER, OTHER: IN_OTHER, SPACE: IN_SPACE, WHITE: IN_WHITE}.get(kind)
    if plain is not None:
        return plain
    if state == A_:
        return {STMD: DONE, R: R_A, V: V_A, L: L_A}.get(kind, IN_LETTER)
    if (state, kind) in ((R_A, E), (V_A, E), (L_A, L)):
        return DONE
    return IN_LETTER


def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element of each class; product table (first, then second); the states of each element. 0 is the identity."""
    single = [tuple(step(s, k) for s in range(N_STATES)) for k in range(N_CLASSES)]
    at = {tuple(range(N_STATES)): 0}
    todo = list(at)
    while todo:
        f = todo.pop()
        for g in single:
            if (fg := tuple(g[s] for s in f)) not in at:
                at[fg] = len(at)
                todo.append(fg)
    elements = sorted(at, key=at.get)
    product = np.array([[at[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint8)
    return np.array([at[f] for f in single], np.uint8), product, np.array(elements, np.uint8)


def scan(kinds: np.ndarray, machine: tuple) -> np.ndarray:
    """The state after each code point, from BEGIN, by an associative scan."""
    element, product, states = machine
    n = len(kinds)
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = element[kinds]
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)  # a column of the text's blocks is contiguous
    size, flat = len(product), product.reshape(-1)
    for j in range(1, BLOCK):
        grid[j] = flat.take(grid[j - 1].astype(np.intp) * size + grid[j])
    before = np.zeros(rows, np.uint8)
    before[1:] = grid[-1][:-1]
    shift = 1
    while shift < rows:
        before[shift:] = flat.take(before[:-shift].astype(np.intp) * size + before[shift:])
        shift *= 2
    start = states[before, BEGIN]
    after = states.reshape(-1).take(grid.astype(np.intp) * N_STATES + start[None, :])
    return np.ascontiguousarray(after.T).reshape(-1)[:n]


def starts(kinds: np.ndarray, machine: tuple) -> np.ndarray:
    """Whether a token starts at each place. Places of class RESET stand between texts."""
    s = scan(kinds, machine)
    n = len(kinds)
    prev, nxt = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # BEGIN at either end
    prev[1:], nxt[:-1] = s[:-1], s[1:]
    white = lambda x: (x == IN_SPACE) | (x == IN_WHITE)
    runs = np.array([0, 1, 2, 3, 4, 4, 3, 1, 1, 1, 1], np.uint8)  # letters, numbers, others, white
    partial = (s == R_A) | (s == V_A) | (s == L_A)
    in_contraction = (s == DONE) | (partial & (nxt == DONE))
    change = (runs[prev] != runs[s]) & ~((prev == A_) & in_contraction)
    at = np.where(
        white(s),
        ~white(prev) | (~white(nxt) & (nxt != BEGIN)),  # a run's first; its last, if something follows
        np.where(white(prev), prev != IN_SPACE, change | (prev == DONE)),
    )
    at |= prev == BEGIN
    at[kinds == RESET] = False
    return at


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the adjacent pair of lowest rank is joined, the first of equals, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > LONG:
        return merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 60
    pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        pairs.pop(i)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[x] for x in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge(), by a heap of pairs over linked parts: n log n steps for n bytes."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins at i, which is also where the next one begins; 0 once it is joined to another
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push, rank_of = heapq.heappop, heapq.heappush, ranks.get
    while heap:
        _, i, to = pop(heap)
        j = end[i]
        if not j or j >= n or end[j] != to:  # a part of the pair has been joined since
            continue
        end[i], end[j] = to, 0
        if to < n:
            before[to] = i
            if (rank := rank_of(piece[i : end[to]])) is not None:
                push(heap, (rank, i, end[to]))
        h = before[i]
        if h >= 0 and (rank := rank_of(piece[h:to])) is not None:
            push(heap, (rank, h, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Cache(dict):
    """The ids of slices, as little-endian unsigned 32-bit integers; merges what it hasn't got."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        found = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= LONG:
            if len(self) > CACHE_SLICES:
                keep_first(self)
            self[piece] = found
        return found


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, ranks: dict[bytes, int], table: np.ndarray | None = None):
        size = max(ranks.values(), default=-1) + 1
        self.sizes = np.zeros(size, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        #: the bytes of all ids on end, and where each one's begin
        self.first = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(x for x, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        self.table = class_table() if table is None else table
        self.machine = monoid()
        self.cache = Cache(ranks)

    def slices(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of each text."""
        joined = "\n".join(texts) + "\n"
        kinds = self.table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        kinds[ends] = RESET
        at = np.flatnonzero(starts(kinds, self.machine))
        cut = np.searchsorted(at, np.concatenate([[0], ends + 1]))
        at = at.tolist()
        found = []
        for k, end in enumerate(ends.tolist()):
            own = at[cut[k] : cut[k + 1]]
            found.append([joined[a:b] for a, b in zip(own, [*own[1:], end])] if own else [])
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        texts = [x or "" for x in texts]
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):  # a million characters at a time, or one text
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
                size += len(texts[to])
                to += 1
            out += [np.frombuffer(b"".join(map(self.cache.__getitem__, x)), "<u4") for x in self.slices(texts[at:to])]
            at = to
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes begin in the text's UTF-8, and where the last one's end, by which any span of ids can be decoded alone."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.sizes[ids], out=out[1:])
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes that ids stand for: each goes where its offset says. Those of a span of ids begin at the span's first."""
        out = []
        for a in range(0, len(ids), SPAN):
            own, at = ids[a : a + SPAN], offsets[a : a + SPAN + 1]
            of = np.repeat(self.first[own] - at[:-1], np.diff(at))
            out.append(self.bytes[of + np.arange(at[0], at[-1])].tobytes())
        return b"".join(out)


def _broadcast(spark: SparkSession, vocabulary: str):
    """The ranks, whose size is that of the vocabulary file, and the class table."""
    return spark.sparkContext.broadcast({"ranks": load_ranks(vocabulary), "table": class_table()})


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _map(df: DataFrame, id_col: str, text_col: str, fields: list[pa.Field], ddl: str, make, vocabulary: str) -> DataFrame:
    prepare(df.sparkSession)
    sent = _broadcast(df.sparkSession, vocabulary)

    def run(batches):
        kept = sent.value  # a worker keeps the codec, with the slices that it has merged, between its tasks
        if "codec" not in kept:
            kept["codec"] = Codec(kept["ranks"], kept["table"])
        codec = kept["codec"]
        for batch in batches:
            got = [make(codec, x) for x in codec.encode(batch.column(1).to_pylist())]
            columns = [pa.array([x[i] for x in got], f.type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *(f.name for f in fields)])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {ddl}")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, ids (array of int), starts (array of int: the place of each id's bytes in the UTF-8 text).

    One row in, one row out; ids of rows may be null or repeated. A null or empty text has empty arrays.
    Other columns are not read.
    """
    make = lambda codec, ids: (ids, codec.offsets(ids)[:-1])
    return _map(df, id_col, text_col, [pa.field("ids", pa.list_(pa.int32())), pa.field("starts", pa.list_(pa.int32()))], "ids array<int>, starts array<int>", make, vocabulary or default_vocabulary())


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """id, text: what the ids stand for, with U+FFFD for bytes that are no UTF-8; a null array gives a null text."""
    spark = df.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast({i: b for b, i in load_ranks(vocabulary or default_vocabulary()).items()})

    def run(batches):
        of = sent.value
        for batch in batches:
            texts = [None if x is None else b"".join(of[i] for i in x).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encoded, and decoded by the offsets, in one pass, without moving the ids.

    Rows as in encode(): a null or empty text has no ids, and the hashes of nothing.
    """

    def make(codec, ids):
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids, codec.offsets(ids))).hexdigest()

    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return _map(df, id_col, text_col, fields, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, vocabulary or default_vocabulary())


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
