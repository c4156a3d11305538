"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(group | class, history) * P(word | group). Both softmaxes have
hashed features of the history: the word before, the one before that (a skip), both, and the classes of
the three before; the second one's features are joined with the class. Words are sorted into a class's
groups by frequency, about as many tokens to each, so that the most frequent have groups of their own;
P(word | group) is the smoothed share, from counts over all training texts. Frequent words get their class
by clustering their neighbours, others by the longest ending that they share with those.

The weights come from gradient steps that partitions of the training texts make by themselves, averaged
after each round, every weight row by how often a partition used it. So they follow, in the last digits,
how the input is partitioned. The table of weights grows with the cube root of the training tokens. A
partition sends the rows that it has used; of partitions beyond TRAINERS several are one task's, so that
what is sent in a round is TRAINERS tables at most, whatever the input; and sums are added up in two steps.

Counts of the most frequent words are broadcast, at most HEAD of them; the other words' come by a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out, keep_first, parts, prepare, read, stage

#: The token that ends a text. Words have no space.
END = b" "
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Words whose counts are broadcast.
HEAD = 200_000
#: Classes, and groups of a class; the last group has the words that aren't broadcast.
CLASSES = GROUPS = 16
#: Words that are clustered, and the frequent words that count as their neighbours.
CLUSTERED, NEIGHBOURS = 4096, 64
#: Rows of either softmax's weights: about ROWS for each cube root of training tokens, at least and at most these.
ROWS, LEAST_ROWS, MOST_ROWS = 64, 1 << 10, 1 << 20
#: Features of a history besides the bias.
FEATURES = 4
RATE, STEP_TOKENS = 0.5, 8192
#: The share of texts that the first round sees; the second sees the others.
FIRST_ROUND = 8
#: Choices of a weight row that are added one by one, before the rest of them.
TOGETHER = 24
#: Weight rows that partitions send together.
CHUNK = 256
#: Tasks of a round, at most.
TRAINERS = 4096
CACHE_WORDS = 400_000
#: What the class does to a feature's row in the second softmax: another permutation of the rows for each.
TURNS = np.random.Generator(np.random.PCG64(9)).integers(0, 1 << 31, CLASSES, np.uint32)


def rows_for(tokens: int) -> int:
    """Rows of either softmax's weights: a power of 2."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << round(math.log2(ROWS * max(tokens, 1) ** (1 / 3)))))


def tokens_of(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, and the end."""
    return [*(text or "").encode().translate(LOWER).split(), END]


@dataclass
class Known:
    """What is known of words: counts and leaves (class * GROUPS + group) of frequent ones, classes of endings.

    It travels as its fields: a broadcast value is unpickled where this module need not be.
    """

    head: dict[bytes, int]
    counts: np.ndarray
    leaves: np.ndarray
    endings: dict[bytes, int]

    def fields(self) -> tuple:
        return self.head, self.counts, self.leaves, self.endings

    def leaf_of(self, word: bytes) -> int:
        if (at := self.head.get(word)) is not None:
            return int(self.leaves[at])
        return class_by_ending(word, self.endings) * GROUPS + GROUPS - 1


def class_by_ending(word: bytes, endings: dict[bytes, int]) -> int:
    for n in (4, 3, 2, 1):
        if (k := endings.get(word[-n:])) is not None:
            return k
    return zlib.crc32(word) % CLASSES


class Words(dict):
    """word -> place in arrays of its hash, leaf and log10(count + 0.5), nan where the count isn't at hand."""

    def __init__(self, known: Known):
        self.known = known
        self.logs = np.log10(known.counts + 0.5).tolist()
        self.leaves = known.leaves.tolist()
        self.new: list[tuple[int, int, float]] = []
        self.arrays = np.zeros(1024, np.uint64), np.zeros(1024, np.uint8), np.zeros(1024)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        i = self.known.head.get(word)
        if i is None:
            self.new.append((zlib.crc32(word), class_by_ending(word, self.known.endings) * GROUPS + GROUPS - 1, math.nan))
        else:
            self.new.append((zlib.crc32(word), self.leaves[i], self.logs[i]))
        return at

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def look_up(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arrays; what was met since the last time is written to them first."""
        if self.new:
            while len(self.arrays[0]) < len(self):
                self.arrays = tuple(np.concatenate([a, np.zeros_like(a)]) for a in self.arrays)
            at = slice(len(self) - len(self.new), len(self))
            for a, values in zip(self.arrays, zip(*self.new)):
                a[at] = values
            self.new = []
        return self.arrays

    @staticmethod
    def of(kept: dict) -> Words:
        """The one that a worker keeps between its tasks, in the broadcast's value."""
        if "words" not in kept:
            kept["words"] = Words(Known(*kept["known"]))
        return kept["words"]

    def batch(self, texts: list[str | None], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """Of the texts' tokens on end: features, leaves, logs; where texts start; the tokens."""
        if len(self) > CACHE_WORDS:
            self.look_up()
            keep_first(self)
        words = [tokens_of(x) for x in texts]
        places = [self.places(x) for x in words]
        hashes, leaves, logs = self.look_up()
        starts = np.cumsum([0, *map(len, places[:-1])])
        at = np.concatenate(places)
        own = leaves[at]
        return features(hashes[at], own // GROUPS, starts, rows), own, logs[at], starts, words


def features(hashes: np.ndarray, kinds: np.ndarray, starts: np.ndarray, rows: int) -> np.ndarray:
    """The weight rows (FEATURES, n) of each token's history, below `rows`. `starts` are the places of texts' first tokens."""
    n = len(hashes)
    mix = np.uint64(0x9E3779B97F4A7C15)
    back = []
    for d in (1, 2, 3):
        word, kind = np.zeros(n, np.uint64), np.full(n, CLASSES, np.uint64)
        if n > d:
            word[d:], kind[d:] = hashes[:-d] + np.uint64(1), kinds[:-d]
        for e in range(d):  # what stands before a text's start is another text
            at = starts[starts + e < n] + e
            word[at], kind[at] = 0, CLASSES
        back.append((word, kind))
    (w1, k1), (w2, k2), (_, k3) = back
    one = np.uint64(CLASSES + 1)
    raw = (w1 * np.uint64(5) + np.uint64(1), w2 * np.uint64(5) + np.uint64(2), (w1 * mix ^ w2) * np.uint64(5) + np.uint64(3), (k1 * one + k2) * one + k3 + np.uint64(1 << 40))
    out = np.empty((FEATURES, n), np.uint32)
    for i, x in enumerate(raw):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[i] = (x >> np.uint64(40)) & np.uint64(rows - 1)
    return out


def both_levels(rows: np.ndarray, leaves: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens' class choices and then of their group choices: weight rows (FEATURES, 2n), which bias, outcomes.

    Weights are one table: n_rows rows of the first softmax, as many of the second, a bias row for the
    first and for each class of the second.
    """
    n = len(leaves)
    kinds = leaves // GROUPS
    out = np.empty((FEATURES, 2 * n), np.int64)
    out[:, :n] = rows
    out[:, n:] = ((rows ^ TURNS[kinds]) & np.uint32(n_rows - 1)) + np.uint32(n_rows)
    bias = np.zeros(2 * n, np.int64)
    bias[n:] = kinds + 1
    return out, bias, np.concatenate([kinds, leaves % GROUPS]).astype(np.int64)


def empty_weights(n_rows: int) -> np.ndarray:
    """Weights of a uniform model, padded to whole chunks."""
    return np.zeros((-(-(2 * n_rows + 1 + CLASSES) // CHUNK) * CHUNK, CLASSES), np.float32)


def softmax(weights: np.ndarray, n_rows: int, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    # take() with an output and without bounds to check is several times faster than an index
    out = np.take(weights[2 * n_rows : 2 * n_rows + 1 + CLASSES], bias, axis=0)
    own = np.empty_like(out)
    for x in rows:
        np.take(weights, x, axis=0, out=own, mode="clip")
        out += own
    np.clip(out, -20, 20, out=out)  # squares of what is left stay normal numbers, which are fast
    np.exp(out, out=out)
    out *= (1 / np.einsum("ij->i", out))[:, None]
    return out


def _sorted_order(rows: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 to 2**32, by radix."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    return order[np.argsort((rows >> 16).astype(np.uint16)[order], kind="stable")] if rows.max(initial=0) >= 1 << 16 else order


def sums_by_row(d: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct weight rows, the most frequent first; the sums of the choices' d that have each; how many have.

    `rows` is (FEATURES, n). The k-th choices of all rows are added at once: rows with k or more are a prefix.
    """
    flat = rows.reshape(-1)
    order = _sorted_order(flat)
    own = flat[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    counts = np.diff(np.append(first, len(flat)))
    by = np.argsort((65535 - np.minimum(counts, 65535)).astype(np.uint16), kind="stable")
    first, counts = first[by], counts[by]
    choice = np.tile(np.arange(len(d)), len(rows))[order]
    g = np.take(d, choice[first], axis=0)
    more = np.empty_like(g)
    for k in range(1, TOGETHER):
        m = int(np.searchsorted(-counts, -k))
        if not m:
            break
        np.take(d, choice[first[:m] + k], axis=0, out=more[:m], mode="clip")
        g[:m] += more[:m]
    m = int(np.searchsorted(-counts, -TOGETHER))
    if m:  # what the most frequent rows have beyond that
        left = counts[:m] - TOGETHER
        begin = np.cumsum(left) - left
        at = np.repeat(first[:m] + TOGETHER - begin, left) + np.arange(left.sum())
        g[:m] += np.add.reduceat(np.take(d, choice[at], axis=0), begin, axis=0)
    return own[first], g, counts.astype(np.float32)


def step(weights: np.ndarray, squares: np.ndarray, used: np.ndarray, n_rows: int, rows: np.ndarray, bias: np.ndarray, outcomes: np.ndarray) -> None:
    """One gradient step on the log loss of some choices, each weight row at its own rate."""
    n = len(outcomes)
    d = softmax(weights, n_rows, rows, bias)
    d.reshape(-1)[np.arange(n) * CLASSES + outcomes] -= 1
    own, g, counts = sums_by_row(d, rows)
    _descend(weights, squares, used, own, g, counts)
    order = np.argsort(bias.astype(np.uint8), kind="stable")
    met, first = np.unique(bias[order], return_index=True)
    g = np.add.reduceat(np.take(d, order, axis=0), first, axis=0)
    _descend(weights, squares, used, met + 2 * n_rows, g, np.diff(np.append(first, n)).astype(np.float32))


def _descend(weights: np.ndarray, squares: np.ndarray, used: np.ndarray, own: np.ndarray, g: np.ndarray, counts: np.ndarray) -> None:
    g *= (1 / np.sqrt(counts))[:, None]
    squares[own] += np.einsum("ij,ij->i", g, g) / CLASSES
    g *= (RATE / np.sqrt(1 + squares[own]))[:, None]
    np.subtract(np.take(weights, own, axis=0), g, out=g)
    whole = f"V{4 * CLASSES}"  # a row is set at once, not number by number
    weights.reshape(-1).view(whole)[own] = g.reshape(-1).view(whole)
    used[own] += counts


@dataclass
class Model:
    """counts (word, c) is a staged table; the rest is of bounded size."""

    counts: DataFrame
    known: Known
    weights: np.ndarray
    rows: int
    tokens: int
    distinct: int
    leaf_logs: np.ndarray
    in_head: Column


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.col(text_col).alias("text"))


def count_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all rows; the end is a word too. Partitions count by themselves first."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        def out(found):
            words = list(found)
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in part], pa.string()), pa.array([found[w] for w in part], pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(tokens_of(text))
            if len(found) > 500_000:
                yield from out(found)
                found.clear()
        yield from out(found)

    return _texts(df, text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def _head(counts: DataFrame) -> tuple[list, Column]:
    """The most frequent words, about HEAD at most, in their order; whether a word is one of them.

    Of the words of the count at which HEAD is passed a share goes in, by a hash, so that as many come
    where all words have about the same count.
    """
    tier = F.floor(F.log2(F.col("c")) * 16)
    sizes = counts.groupBy(tier.alias("t")).agg(F.count("*").alias("n")).orderBy(F.desc("t")).collect()
    total, inside = 0, F.lit(True)
    for r in sizes:
        if total + r["n"] > HEAD:
            share = int((HEAD - total) / r["n"] * 1_000_000)
            inside = (tier > r["t"]) | ((tier == r["t"]) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < share))
            break
        total += r["n"]
    rows = counts.where(inside).collect()
    return sorted(((r[0].encode(), r[1]) for r in rows), key=lambda x: (-x[1], x[0])), inside


def neighbours(df: DataFrame, names: list[bytes]) -> DataFrame:
    """w, f, n: how often the name at f is after the one at w in the texts of df, or with f beyond NEIGHBOURS before it."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    def run(batches) -> Iterator[pa.RecordBatch]:
        at = sent.value
        total = np.zeros((len(at), 2 * NEIGHBOURS), np.int64)
        flat = total.reshape(-1)
        for batch in batches:
            texts = [tokens_of(x) for x in batch.column(0).to_pylist()]
            ids = np.fromiter(map(at.get, chain.from_iterable(texts), repeat(-1)), np.int64)
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            ok[np.cumsum([len(x) for x in texts], dtype=np.int64)[:-1] - 1] = False  # the next text's first word is no neighbour
            a, b = ids[:-1][ok], ids[1:][ok]
            for w, f, place in ((a, b, 0), (b, a, NEIGHBOURS)):
                near = f < NEIGHBOURS
                n = np.bincount(w[near] * (2 * NEIGHBOURS) + f[near] + place)
                flat[: len(n)] += n
        own = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.array(total[own])], names=["w", "f", "n"])

    return df.mapInArrow(run, "w bigint, f bigint, n bigint").groupBy("w", "f").agg(F.sum("n").alias("n"))


def _clusters(df: DataFrame, head: list) -> tuple[dict, dict]:
    """Classes of the most frequent words by k-means on the words next to them; classes by ending."""
    names = [w for w, _ in head[:CLUSTERED]]
    if not names:
        return {}, {}
    got = neighbours(df, names).toArrow()  # at most CLUSTERED * 2 * NEIGHBOURS rows
    x = np.zeros((len(names), 2 * NEIGHBOURS))
    x[got.column("w").to_numpy(), got.column("f").to_numpy()] = got.column("n").to_numpy()
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    weight = np.log1p([c for _, c in head[:CLUSTERED]])
    centers = [x[0]]
    while len(centers) < min(CLASSES, len(x)):  # the farthest from those there are
        far = np.min([((x - c) ** 2).sum(1) for c in centers], 0)
        centers.append(x[int((far * weight).argmax())])
    centers = np.array(centers)
    for _ in range(25):
        kind = (x @ centers.T * 2 - (centers**2).sum(1)).argmax(1)
        for k in range(len(centers)):
            if (own := kind == k).any():
                centers[k] = np.average(x[own], axis=0, weights=weight[own])
    classes = {w: int(k) for w, k in zip(names, kind)}
    votes: dict[bytes, Counter] = {}
    for (w, k), c in zip(classes.items(), weight):
        for n in range(1, min(5, len(w) + 1)):
            votes.setdefault(w[-n:], Counter())[k] += c
    return classes, {e: max(v.items(), key=lambda x: (x[1], -x[0]))[0] for e, v in votes.items()}


def grouped(head: list, classes: dict[bytes, int], endings: dict[bytes, int]) -> Known:
    """Leaves of the frequent words: a class's words, most frequent first, are dealt into its groups by tokens."""
    kinds = [classes[w] if w in classes else class_by_ending(w, endings) for w, _ in head]
    left = np.bincount(kinds, [c for _, c in head], CLASSES) if head else np.zeros(CLASSES)
    group, got, leaves = [0] * CLASSES, [0.0] * CLASSES, np.zeros(len(head), np.uint8)
    for i, ((_, c), k) in enumerate(zip(head, kinds)):
        leaves[i] = k * GROUPS + group[k]
        got[k] += c
        if group[k] < GROUPS - 1 and got[k] >= left[k] / (GROUPS - group[k]):
            left[k] -= got[k]
            group[k], got[k] = group[k] + 1, 0.0
    return Known({w: i for i, (w, _) in enumerate(head)}, np.array([c for _, c in head], np.float64), leaves, endings)


#: A chunk's rows that have been used: which of its rows, and their sums, weighted and with the weight.
SUMS = "chunk bigint, lane bigint, rows binary, sums binary"


def task_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def packed(table: np.ndarray, lane: int) -> Iterator[pa.RecordBatch]:
    """The used rows of a table, whose last column is how often they were used, by chunks; chunks without any aren't sent."""
    for k in range(len(table) // CHUNK):
        own = table[k * CHUNK : (k + 1) * CHUNK]
        at = np.flatnonzero(own[:, -1] > 0)
        if len(at):
            values = [[k], [lane], [at.astype(np.uint8).tobytes()], [own[at].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "lane", "rows", "sums"])


def _sums(batches) -> dict[tuple[int, int], np.ndarray]:
    """Whole chunks of sums by (chunk, lane)."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for k, lane, rows, sums in zip(*(c.to_pylist() for c in batch.columns)):
            if (k, lane) not in found:
                found[k, lane] = np.zeros((CHUNK, CLASSES + 1))
            found[k, lane][np.frombuffer(rows, np.uint8)] += np.frombuffer(sums, "<f4").reshape(-1, CLASSES + 1)
    return found


def added(batches) -> Iterator[pa.RecordBatch]:
    """The sums of each chunk and lane."""
    for (k, lane), x in _sums(batches).items():
        for batch in packed(x.astype("<f4"), lane):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *batch.columns[1:]], names=batch.schema.names)


def averaged(batches) -> Iterator[pa.RecordBatch]:
    """The averages of each chunk's rows; nan for those that nobody has used."""
    total: dict[int, np.ndarray] = {}
    for (k, _), x in _sums(batches).items():
        total[k] = total.get(k, 0.0) + x
    for k, x in total.items():
        mean = np.where(x[:, -1:] > 0, x[:, :-1] / np.maximum(x[:, -1:], 1e-30), np.nan).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([mean.tobytes()], pa.binary())], names=["chunk", "mean"])


def _round(df: DataFrame, sent, weights: np.ndarray, n_rows: int) -> np.ndarray:
    """The average of what partitions make of the weights by gradient steps on their texts."""
    spark = df.sparkSession
    tasks = df.rdd.getNumPartitions()
    if tasks > TRAINERS:
        df, tasks = df.coalesce(TRAINERS), TRAINERS
    begin = spark.sparkContext.broadcast(weights)

    def run(batches) -> Iterator[pa.RecordBatch]:
        index = Words.of(sent.value)
        own = begin.value.copy()
        squares, used = np.zeros(len(own), np.float32), np.zeros(len(own), np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, leaves, *_ = index.batch(batch.column(0).to_pylist(), n_rows)
            for a in range(0, len(leaves), STEP_TOKENS):
                step(own, squares, used, n_rows, *both_levels(rows[:, a : a + STEP_TOKENS], leaves[a : a + STEP_TOKENS], n_rows))
        yield from packed(np.concatenate([own * used[:, None], used[:, None]], 1).astype("<f4"), task_id())

    sums = df.mapInArrow(run, SUMS)
    lanes = max(1, math.isqrt(tasks))
    by_lane = sums.withColumn("lane", F.col("lane") % lanes).repartition(parts(df), "chunk", "lane").mapInArrow(added, SUMS)
    sums = by_lane.repartition(min(parts(df), len(weights) // CHUNK), "chunk").mapInArrow(averaged, "chunk bigint, mean binary")
    out = weights.copy()
    for k, mean in sums.collect():  # one table, of a size that is known
        mean = np.frombuffer(mean, "<f4").reshape(CHUNK, CLASSES)
        out[k * CHUNK : (k + 1) * CHUNK] = np.where(np.isnan(mean), out[k * CHUNK : (k + 1) * CHUNK], mean)
    begin.destroy()
    return out


def fit(df: DataFrame, text_col: str = "text") -> Model:
    """Learn from all rows of df: counts, classes, weights. A null text counts as empty."""
    spark = df.sparkSession
    prepare(spark)
    counts = stage(count_words(df, text_col), "counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head, in_head = _head(counts)
    texts = _texts(df, text_col)
    known = grouped(head, *_clusters(texts, head))
    sent = spark.sparkContext.broadcast({"known": known.fields()})

    def leaves(batches) -> Iterator[pa.RecordBatch]:
        known = Known(*sent.value["known"])
        for batch in batches:
            own = [known.leaf_of(w.encode()) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(1)], names=["k", "c"])

    sizes = counts.mapInArrow(leaves, "k int, c bigint").groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    leaf_logs = np.full(CLASSES * GROUPS, math.log10(0.5))
    for r in sizes:
        leaf_logs[r["k"]] = math.log10(r["n"] + 0.5 * (r["v"] + 1))
    n_rows = rows_for(tokens)
    weights = empty_weights(n_rows)
    first = F.pmod(F.xxhash64("text"), F.lit(FIRST_ROUND)) == 0
    for part in (texts.where(first), texts.where(~first)):
        weights = _round(part, sent, weights, n_rows)
    sent.destroy()
    return Model(counts, known, weights, n_rows, tokens, distinct, leaf_logs, in_head)


def log_probabilities(weights: np.ndarray, n_rows: int, rows: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """log10 P(class | history) * P(group | class, history) of tokens, a part at a time."""
    out = np.empty(len(leaves))
    for a in range(0, len(leaves), STEP_TOKENS):
        own, bias, outcomes = both_levels(rows[:, a : a + STEP_TOKENS], leaves[a : a + STEP_TOKENS], n_rows)
        p = softmax(weights, n_rows, own, bias).reshape(-1)[np.arange(len(outcomes)) * CLASSES + outcomes].astype(np.float64)
        n = len(p) // 2
        out[a : a + n] = np.log10(p[:n] * p[n:])
    return out


def lm_score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """id, the columns named in `keep`, n_tokens, n_known, train_tokens, base_score, score of each row.

    base_score is the log10 probability of the text by the training texts' smoothed word counts, score by
    the model. A null or empty text is the end token alone. One row in, one row out; ids may be null or
    repeated. Other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast({"known": model.known.fields()})
    sent_weights = spark.sparkContext.broadcast((model.weights, model.leaf_logs))
    n_rows = model.rows
    names = [id_col, *keep]
    rest = ["_row", "n_tokens", "_known", "_logs", "_model", "_words", "_counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weights, leaf_logs = sent_weights.value
        index = Words.of(sent.value)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[list] = [[] for _ in rest]
            if batch.num_rows:
                rows, leaves, logs, starts, words = index.batch(batch.column(len(names)).to_pylist(), n_rows)
                model_logs = np.add.reduceat(log_probabilities(weights, n_rows, rows, leaves) - leaf_logs[leaves], starts)
                here = ~np.isnan(logs)
                sums = np.add.reduceat(np.where(here, logs, 0), starts)
                n_here = np.add.reduceat(here.astype(np.int64), starts)
                for i, x in enumerate(words):
                    tail = Counter()
                    if n_here[i] < len(x):
                        gone = np.flatnonzero(~here[starts[i] : starts[i] + len(x)]).tolist()
                        tail = Counter(map(x.__getitem__, gone))
                    for column, value in zip(out, (row, len(x), int(n_here[i]), float(sums[i]), float(model_logs[i]), [w.decode() for w in tail], list(tail.values()))):
                        column.append(value)
                    row += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *(pa.array(c, t) for c, t in zip(out, types))], names=[*names, *rest])

    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    schema += ", _row bigint, n_tokens bigint, _known bigint, _logs double, _model double, _words array<string>, _counts array<bigint>"
    found = stage(df.select(*names, text_col).mapInArrow(run, schema), "scored")
    sent.destroy()
    sent_weights.destroy()
    tail = found.select("_row", F.explode(F.arrays_zip("_words", "_counts")).alias("x")).select("_row", F.col("x._words").alias("word"), F.col("x._counts").alias("n"))
    tail = tail.join(model.counts.where(~model.in_head), "word", "left")
    tail = tail.groupBy("_row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("_more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("_rest"))
    logs = F.col("_logs") + F.coalesce("_rest", F.lit(0.0))
    base = math.log10(model.tokens + 0.5 * (model.distinct + 1))
    return found.drop("_words", "_counts").join(tail, "_row", "left").select(
        *names,
        "n_tokens",
        (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * base).alias("base_score"),
        (logs + F.col("_model")).alias("score"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 5, 1))
    return lm_score(docs, fit(docs.where(~F.col("held_out"))), keep=("held_out",))


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
ORACLES: dict[str, str] = {}
