"""Quality scores from random-indexing word vectors and a two-layer network.

Every word has a sparse random index vector, drawn by its hash. A vocabulary word's context vector is the
sum of the index vectors of its neighbours in the training texts. A text is pooled into the mean and the
deviation of its tokens' vectors, with the shares of a few token shapes, which also stand in for words
outside the vocabulary. A network of one hidden layer, in numpy, gives a logit; a temperature fitted on
rows held back makes probabilities of logits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out, keep_first, parts, prepare, read, release, stage

#: Runs of letters, of digits, of other characters, between white space.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
DIM = 96
#: Entries of an index vector that aren't 0.
NONZERO = 4
#: Neighbours to either side.
REACH = 2
SHAPES = ("lower", "capital", "upper", "mixed", "number", "sign", "signs")
HIDDEN = 24
CACHE_TOKENS = 400_000
#: Words whose vectors partitions send together.
CHUNK = 128


def shape_of(token: str) -> int:
    """The place in SHAPES."""
    if token.isalpha():
        if token.islower():
            return 0
        if token[1:].islower() or len(token) == 1:
            return 1
        return 2 if token.isupper() else 3
    if token.isdigit():
        return 4
    return 5 if len(token) == 1 else 6


def index_vector(token: str) -> np.ndarray:
    """Sparse and random, but the same for a token everywhere."""
    draw = np.random.Generator(np.random.PCG64(zlib.crc32(token.encode())))
    v = np.zeros(DIM, np.float32)
    v[draw.choice(DIM, NONZERO, replace=False)] = draw.choice([-1, 1], NONZERO)
    return v


def shape_name(k: int) -> str:
    return f"\0{SHAPES[k]}"


class Pooler:
    """Pools texts by the vectors of their tokens."""

    def __init__(self, vocabulary: dict[str, int], vectors: np.ndarray):
        self.vocabulary, self.vectors = vocabulary, vectors
        self.shapes = [vocabulary[shape_name(k)] for k in range(len(SHAPES))]
        self.known: dict[str, tuple[int, int]] = {}

    def look_up(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the place of its vector and its shape."""
        if len(self.known) > CACHE_TOKENS:
            keep_first(self.known)
        for t in set(tokens).difference(self.known):
            k = shape_of(t)
            self.known[t] = (self.vocabulary.get(t.lower(), self.shapes[k]), k)
        pairs = np.array(list(map(self.known.__getitem__, tokens)), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def __call__(self, text: str | None) -> np.ndarray:
        """The features of a text: all 0 without a token."""
        text = text or ""
        tokens = TOKEN.findall(text)
        out = np.zeros(features(), np.float32)
        if not tokens:
            return out
        at, shape = self.look_up(tokens)
        own, count = np.unique(at, return_counts=True)
        vectors, share = self.vectors[own], (count / len(tokens)).astype(np.float32)
        mean = share @ vectors
        out[:DIM] = mean
        out[DIM : 2 * DIM] = np.sqrt(np.maximum(share @ vectors**2 - mean**2, 0))
        out[2 * DIM : 2 * DIM + len(SHAPES)] = np.bincount(shape, minlength=len(SHAPES)) / len(tokens)
        distinct = len(set(tokens)) / len(tokens)
        out[2 * DIM + len(SHAPES) :] = (np.log1p(len(tokens)) / 10, distinct, text.count("\n") / len(tokens), len(tokens) / (1 + len(text)))
        return out


def features() -> int:
    return 2 * DIM + len(SHAPES) + 4


class Network:
    """Features -> HIDDEN tanh units -> logit, on standardised features, trained by Adam on the log loss."""

    def __init__(self, weights: list[np.ndarray], temperature: float):
        self.weights, self.temperature = weights, temperature

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, back: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3, seed: int = 11) -> Network:
        """`back` marks the rows held back for the temperature."""
        draw = np.random.Generator(np.random.PCG64(seed))
        at = np.flatnonzero(~back)
        mean, scale = x[at].mean(0), x[at].std(0) + 1e-3
        z = (x - mean) / scale
        w = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        # classes count alike
        share = np.clip(y[at].mean(), 0.02, 0.98)
        for _ in range(epochs):
            for part in np.array_split(draw.permutation(at), max(1, len(at) // 128)):
                h = np.tanh(z[part] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
                d = (p - y[part]) * np.where(y[part] > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(part)
                dh = np.outer(d, w[2]) * (1 - h**2)
                grads = [z[part].T @ dh + decay * w[0], dh.sum(0), h.T @ d + decay * w[2], d.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        found = cls([mean, scale, *w], 1.0)
        held = np.flatnonzero(back) if back.any() else at
        logits = found.logits(x[held])
        # the temperature of the least log loss; some noise in the labels is taken for granted
        target = 0.995 * y[held] + 0.0025
        losses = {t: float(np.mean(np.logaddexp(0, logits / t) - target * logits / t)) for t in np.geomspace(0.2, 20, 120)}
        found.temperature = min(losses, key=losses.get)
        return found

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, a, b, c, d = self.weights
        return np.tanh((x - mean) / scale @ a + b) @ c + d[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _chosen(rows: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """About max_rows rows by a hash of the id, as many of either label as there are of its half."""
    counts = {int(r[0]): r[1] for r in rows.groupBy(label_col).count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col(label_col) == label, min(1.0, max_rows / 2 / n)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = 6000, min_count: int = 3) -> dict | None:
    """A model from labelled rows: at most about max_rows of them, half of either label.

    Labels (id_col, label_col) are 0 or 1; of an id's labels, and of its texts, the least counts. The rows
    are chosen among the labels, so that only few need be sent to the texts. Every word that they have
    min_count times gets a vector, so the model is bounded by max_rows alone. None if no row is left.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    rows = _chosen(rows.groupBy("id").agg(F.min("label").alias("label")), "label", max_rows)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(rows), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    chosen = stage(chosen.repartition(8, "id"), "labelled")

    def count(batches) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found.update(t.lower() for t in TOKEN.findall(text or ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    words = chosen.select("id", "text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("word").toArrow()
    names = [shape_name(k) for k in range(len(SHAPES))] + sorted(words.column("word").to_pylist())
    vocabulary = {w: i for i, w in enumerate(names)}
    index = np.stack([index_vector(w) for w in names])
    sent = spark.sparkContext.broadcast((vocabulary, index))

    def contexts(batches) -> Iterator[pa.RecordBatch]:
        vocabulary, index = sent.value
        pooler = Pooler(vocabulary, index)
        total = np.zeros_like(index)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                tokens = TOKEN.findall(text or "")
                at, shape = pooler.look_up(tokens)
                near = np.zeros((len(at), index.shape[1]), np.float32)
                for d in range(1, REACH + 1):
                    if len(at) > d:
                        near[d:] += index[at[:-d]]
                        near[:-d] += index[at[d:]]
                order = np.argsort(at, kind="stable")
                own, first = np.unique(at[order], return_index=True)
                if len(own):
                    total[own] += np.add.reduceat(near[order], first)
        for a in range(0, len(total), CHUNK):
            if total[a : a + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([total[a : a + CHUNK].tobytes()], pa.binary())], names=["first", "v"])

    def add(batches) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for a, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[a] = found.get(a, 0) + np.frombuffer(x, np.float32)
        for a, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["first", "v"])

    vectors = np.zeros_like(index)
    sums = chosen.select("id", "text").mapInArrow(contexts, "first bigint, v binary").repartition(parts(df), "first")
    for a, x in sums.mapInArrow(add, "first bigint, v binary").toLocalIterator():
        own = np.frombuffer(x, np.float32).reshape(-1, DIM)
        vectors[a : a + len(own)] = own
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-6
    # a word's own index vector tells it from its neighbours
    vectors = (vectors + index / np.sqrt(NONZERO)).astype(np.float32)
    pooled = spark.sparkContext.broadcast((vocabulary, vectors))

    def pool(batches) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(*pooled.value)
        for batch in batches:
            got = [pooler(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in got], pa.binary())], names=["id", "label", "x"])

    got = chosen.select(F.xxhash64("id").alias("id"), "label", "text").mapInArrow(pool, "id bigint, label int, x binary").orderBy("id").toArrow()
    for x in (sent, pooled):
        x.destroy()
    release(chosen)
    if not len(got):
        return None
    x, y = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(got), -1).astype(np.float64), got.column("label").to_numpy().astype(np.float64)
    network = Network.train(x, y, np.arange(len(got)) % 5 == 4)
    return {"vocabulary": vocabulary, "vectors": vectors, "weights": network.weights, "temperature": network.temperature}


def quality_score(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), cut: float = 0.7) -> DataFrame:
    """id, the columns named in `keep`, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= cut).

    One row in, one row out; ids may be null or repeated. A null text counts as empty, and empty texts are
    scored as texts without tokens. Without a model every score is 0.5. Other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast({"model": model})
    names = [id_col, *keep]

    def run(batches) -> Iterator[pa.RecordBatch]:
        kept = sent.value  # a worker keeps the pooler, with the tokens that it has met, between its tasks
        m = kept["model"]
        if m and "pooler" not in kept:
            kept["pooler"] = Pooler(m["vocabulary"], m["vectors"])
        pooler = kept.get("pooler")
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            score = np.full(len(texts), 0.5)
            if pooler and texts:
                score = Network(m["weights"], m["temperature"]).probabilities(np.stack([pooler(x) for x in texts]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return df.select(*names, text_col).mapInArrow(run, f"{schema}, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from the labelled documents that aren't held out."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)), "doc_id", "text", "quality")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_score(docs.withColumn("held_out", held_out(F.col("doc_id"), 4, 2)), learn(docs, read(spark, sf_dir, "labels")), keep=("held_out",))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLES: dict[str, str] = {}
