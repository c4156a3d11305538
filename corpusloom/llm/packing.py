"""Best-fit packing by large-item matching, planned on the histogram of lengths.

Texts become token ids, long ones are cut into pieces of the capacity. Lengths are whole numbers up to the
capacity, so the count of pieces by length says all that matters for packing: the plan is made from these
counts, whose number doesn't grow with the data. Pieces above a third of the capacity are matched in
pairs, each, from the longest on, with the longest that fits; at most two fit a sequence. Then smaller
pieces, from the longest on, go where they leave the least room. The plan says of each length which
ranks among its pieces go to which sequences at which offset. Tasks rank their own pieces of each length;
where a task's ranks begin among all comes from counts by length and task, so that pieces are never sorted.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import keep_first, prepare, read, stage

CAPACITY = 2048
END_ID = 0
#: Words, and parts of words, that a Python worker keeps the ids of, at most; characters looked up at a time.
CACHE_WORDS, PART_CHARS = 400_000, 1 << 20
#: What the tokenizer file takes as one pre-token, for text in lower case below U+0100, and the strings that it takes as one id each.
LATIN = "a-zªµºß-öø-ÿ"
PRE_TOKEN = re.compile(rf"[{LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0{LATIN}0-9²³¹¼½¾]+".encode("latin-1"))
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
#: Lower case of the code points below U+0100; none leaves that range.
LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
#: The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from U+0100 on.
_seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _seen} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)).difference(_seen)))}


class _Kept(dict):
    """Keeps what `make` makes of missing keys; of too many the first quarter stays, which the frequent ones are in."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            keep_first(self)
        found = self[key] = self.make(key)
        return found


class WordTokenizer:
    """Ids of texts by a tokenizer that drops case and white space and never looks across white space.

    So the ids of words between ASCII white space are kept, in lower case. A word of code points below
    U+0100, which no normal form changes, is cut into pre-tokens, whose ids are kept too: far fewer are
    different. The pair merging is the tokenizer's own. Other words, and those with a special token's
    string, are encoded by the whole tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.chars = {i: "".join(BYTE_CHARS[b] for b in chr(i).encode()) for i in range(256)}
        self.parts = _Kept(self._merge)
        self.words = _Kept(lambda word: self.parts[word] if word.isalpha() else b"".join(map(self.parts.__getitem__, PRE_TOKEN.findall(word))))
        self.whole = _Kept(lambda word: np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes())

    def _merge(self, part: bytes) -> bytes:
        """Ids of a pre-token."""
        return np.array([t.id for t in self.model.tokenize(part.decode("latin-1").translate(self.chars))], "<u4").tobytes()

    def _by_word(self, text: str) -> bytes:
        """Ids of a text with words that are encoded whole."""
        out = []
        for word in text.encode().split():
            if word.isascii() and not any(x in word for x in SPECIAL):
                out.append(self.words[word.lower()])
            else:
                out.append(self.whole[word])
        return b"".join(out)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids as of encode(add_special_tokens=False): a special token's string in the text is that token."""
        out = []
        for part in _cut(text or ""):
            try:
                raw = part.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is None or any(x in raw for x in SPECIAL):
                out.append(self._by_word(part))
            else:
                out.append(b"".join(map(self.words.__getitem__, raw.translate(LOWER).split())))
        return np.frombuffer(b"".join(out), "<u4")


def _cut(text: str) -> Iterator[str]:
    """The text in parts of about PART_CHARS characters, cut at ASCII white space."""
    at = 0
    while len(text) - at > PART_CHARS:
        end = WHITE.search(text, at + PART_CHARS)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:] if at else text


WHITE = re.compile(r"[\x20\x09-\x0D]")


def pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, with_ids: bool) -> DataFrame:
    """Of each row its pieces: id, piece, start, length, ids_crc32, _task, _at (its rank among the task's pieces of that length), and ids if asked for."""
    spark = df.sparkSession
    prepare(spark)
    with open(vocabulary, encoding="utf-8") as f:
        # a worker keeps the tokenizer, with the words that it has met, between its tasks
        sent = spark.sparkContext.broadcast({"definition": f.read()})

    def run(batches) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = sent.value
        if "tokenizer" not in kept:
            kept["tokenizer"] = WordTokenizer(kept["definition"])
        tokenizer = kept["tokenizer"]
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            at, columns = [], ([], [], [], [], [], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(tokenizer.ids(text), np.uint32(END_ID)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    at.append(i)
                    for column, x in zip(columns, (k, start, len(own), zlib.crc32(own.tobytes()), task, seen[len(own)], own if with_ids else None)):
                        column.append(x)
                    seen[len(own)] += 1
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names=names)

    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
    names = [id_col, "piece", "start", "length", "ids_crc32", "_task", "_at", *["ids"] * with_ids]
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, _task int, _at bigint" + ", ids array<int>" * with_ids
    return df.select(id_col, text_col).mapInArrow(run, schema)


class Plan:
    """Runs of (length, first rank, count, first sequence, pieces of the length in a sequence, offset).

    A run puts ranks first, first+1, ... of a length `each` by `each` into sequences first_sequence,
    first_sequence+1, ... from `offset` on, one behind the other.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.rank: dict[int, int] = defaultdict(int)
        #: room left -> ranges of sequences that have it
        self.room: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        counts = {n: c for n, c in counts.items() if c}
        self.match({n: c for n, c in counts.items() if 3 * n > capacity})
        for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
            self.fit(n, counts[n])

    def put(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], count, first, each, offset))
        self.rank[length] += count

    def leave(self, room: int, first: int, n: int) -> None:
        """n sequences from `first` on have this much room."""
        if room and n:
            if room not in self.room:
                self.room[room] = []
                bisect.insort(self.rooms, room)
            self.room[room].append((first, n))

    def match(self, left: dict[int, int]) -> None:
        """Large pieces: each, from the longest on, with the longest other that fits; at most two in a sequence."""
        lengths = sorted(left)
        while lengths:
            a = lengths[-1]
            at = bisect.bisect_right(lengths, self.capacity - a) - 1
            b = lengths[at] if at >= 0 else None
            if b == a and left[a] < 2:
                b = lengths[at - 1] if at else None
            if b is None:
                n = left[a]
                self.put(a, n, self.sequences, 1, 0)
                self.leave(self.capacity - a, self.sequences, n)
                left[a] = 0
            elif b == a:
                n = left[a] // 2
                self.put(a, 2 * n, self.sequences, 2, 0)
                self.leave(self.capacity - 2 * a, self.sequences, n)
                left[a] -= 2 * n
            else:
                n = min(left[a], left[b])
                self.put(a, n, self.sequences, 1, 0)
                self.put(b, n, self.sequences, 1, a)
                self.leave(self.capacity - a - b, self.sequences, n)
                left[a] -= n
                left[b] -= n
            self.sequences += n
            lengths = [x for x in lengths if left[x]]

    def fit(self, length: int, count: int) -> None:
        """Small pieces of a length: where the least room stays, as many as fit there; then new sequences."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, n = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room]
                    self.rooms.pop(at)
            else:
                room, first, n = self.capacity, self.sequences, -(-count // (self.capacity // length))
                self.sequences += n
            each = room // length
            full = min(n, count // each)
            if full:
                self.put(length, full * each, first, each, self.capacity - room)
                self.leave(room - each * length, first, full)
                count -= full * each
            if full < n:
                if count:  # one more sequence gets what is left
                    k = min(count, each)
                    self.put(length, k, first + full, k, self.capacity - room)
                    self.leave(room - k * length, first + full, 1)
                    count -= k
                    full += 1
                if room < self.capacity or full < n:
                    self.leave(room, first + full, n - full)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces and their places: id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    A null text counts as empty: one piece, the end id. Repeated rows and ids are packed each by itself.
    Pieces of one length are interchangeable; which goes where follows the rows' places in the staged
    table. Other columns are not read. No rows give no rows.
    """
    spark = df.sparkSession
    found = pieces(df, id_col, text_col, vocabulary or public_tokenizers.path("word_bpe_49k.json"), capacity, with_ids)
    found = stage(found, "pieces")
    # how many pieces of a length each task made, and where its ranks among all of that length begin
    tasks = found.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = stage(tasks.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))), "tasks")
    total = {r[0]: r[1] for r in tasks.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    if not total:
        return found.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).drop("_task", "_at")
    plan = Plan(total, capacity)
    # the counts grow with the tasks: never broadcast
    ranked = found.join(tasks.drop("_n").hint("merge"), ["length", "_task"]).withColumn("_rank", F.col("_base") + F.col("_at"))
    sent = spark.sparkContext.broadcast(_by_length(plan))

    def place(batches):
        runs = sent.value
        for batch in batches:
            lengths, ranks = batch.column(k).to_numpy(zero_copy_only=False), batch.column(k + 1).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                run = runs[n]
                at = run[np.searchsorted(run[:, 0], ranks[own], side="right") - 1]
                inside = ranks[own] - at[:, 0]
                sequence[own] = at[:, 1] + inside // at[:, 2]
                offset[own] = at[:, 3] + inside % at[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), batch.column(k), pa.array(sequence), pa.array(offset)], names=[*names, "length", "sequence_id", "offset"])

    names = [id_col, "piece", "start", "ids_crc32", *["ids"] * with_ids]
    k = len(names)
    schema = ", ".join(f"`{n}` {found.schema[n].dataType.simpleString()}" for n in names) + ", length bigint, sequence_id bigint, offset bigint"
    return ranked.select(*names, "length", "_rank").mapInArrow(place, schema)


def _by_length(plan: Plan) -> dict[int, np.ndarray]:
    """Of each length the runs' first rank, first sequence, pieces each and offset; the size follows the capacity."""
    by = defaultdict(list)
    for length, rank, _, first, each, offset in plan.runs:
        by[length].append((rank, first, each, offset))
    return {n: np.array(sorted(x), np.int64) for n, x in by.items()}


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
