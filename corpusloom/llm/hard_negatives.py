"""Hard negatives by a two-dimensional block matrix multiply.

Vectors become whole numbers. Rows are ordered by label and id and cut into blocks, and each block into chunks
of dimensions. The product of anchors and rows is laid out as a grid of cells: blocks of anchors are dealt
to the grid's rows and sent to each of its columns, blocks of rows the other way round, for each chunk. A
cell multiplies its blocks' chunks to partial scores, in stripes of a few anchors, as int64. These are
shuffled to where a stripe's chunks meet and are added, and each stripe of the whole scores is reduced
at once to its best rows.

The multiply runs twice: with the blocks whose labels overlap, for each anchor's positives, and then with all
blocks, for the best rows in the window that each positive sets. Of each, a task keeps only `k` rows for an
anchor, or a positive, so that what meets at last is a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import parts, prepare, read, release, stage
from corpusloom.llm.ngram_join import groups_of

#: What a component is multiplied by before it is rounded down.
SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative's score is at least so many hundredths of the positive's.
LEAST = 80
#: Anchors and rows of a block, dimensions of a chunk, anchors of a stripe.
ANCHOR_BLOCK, ROW_BLOCK, CHUNK, STRIPE = 256, 1024, 32, 8
#: Blocks of anchors, and of rows, that meet in a cell of the grid.
CELL_ANCHORS, CELL_ROWS = 4, 16
#: Whole numbers up to this are exact as doubles.
EXACT = 2**53
#: The score that fills the places of an anchor with fewer positives; no score is so low.
NONE = -(2**63)


def whole(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """id, label, v of the rows that take part, v being floor(scale * x) as whole numbers.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part; of rows of one id the
    one with the least label, then vector, does.
    """
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    odd = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(~odd)
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.struct(F.col(label_col).cast("bigint").alias("label"), x.alias("v")).alias("r"))
    return rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*")


BLOCK_FIELDS = [("block", pa.int64()), ("chunk", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("windows", pa.binary()), ("m", pa.binary())]
BLOCK_DDL = "block bigint, chunk int, low bigint, high bigint, ids binary, labels binary, windows binary, m binary"


def blocks(rows: DataFrame, size: int, chunk: int, window_col: str | None = None) -> DataFrame:
    """The rows (id, label, v), ordered by label and id, as blocks of `size`: a record for each chunk of dimensions.

    A record has the block's number, its least and highest label, and with the first chunk its ids, labels
    and windows; `m` is the matrix of a vector's chunk in each row, as int64. Shorter vectors end in zeros.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0

        def record(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, labels, vectors, windows = zip(*held)
            width = max(1, max(map(len, vectors)))
            m = np.zeros((len(held), -(-width // chunk) * chunk), np.int64)
            for r, v in zip(m, vectors):
                r[: len(v)] = v
            number = (task << 32) + made
            made += 1
            for c in range(m.shape[1] // chunk):
                own = [] if windows[0] is None else windows
                first = [np.array(x, "<i8").tobytes() if not c else None for x in (ids, labels, [y for x in own for y in x])]
                values = [number, c, labels[0], labels[-1], *first, np.ascontiguousarray(m[:, c * chunk : (c + 1) * chunk]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(values, BLOCK_FIELDS)], names=[n for n, _ in BLOCK_FIELDS])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == size:
                    yield from record(held)
                    held = []
        if held:
            yield from record(held)

    window = F.col(window_col) if window_col else F.lit(None).cast("array<bigint>")
    tasks = max(1, min(parts(rows), -(-rows.count() // size)))
    ordered = rows.select("id", "label", "v", window.alias("w")).repartitionByRange(tasks, "label", "id").sortWithinPartitions("label", "id")
    return ordered.mapInArrow(run, BLOCK_DDL)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T in whole numbers; scores beyond 64 bits are an OverflowError."""
    bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if bound < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if bound >= 2**62:
        raise OverflowError("components are too large for scores of 64 bits")
    return left @ right.T


def _least_type(x: np.ndarray) -> bytes:
    """The whole numbers in 4 bytes each if they fit, else in 8; either is read back as int64."""
    small = x.astype("<i4")
    return small.tobytes() if (small == x).all() else x.astype("<i8").tobytes()


PARTIAL_FIELDS = [("anchor_block", pa.int64()), ("stripe", pa.int32()), ("row_block", pa.int64()), ("chunk", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("windows", pa.binary()), ("row_ids", pa.binary()), ("row_labels", pa.binary()), ("scores", pa.binary())]
PARTIAL_DDL = "anchor_block bigint, stripe int, row_block bigint, chunk int, ids binary, labels binary, windows binary, row_ids binary, row_labels binary, scores binary"


def partial_scores(anchors: DataFrame, rows: DataFrame, same_label: bool) -> DataFrame:
    """Partial scores of the blocks that meet, by chunk, in stripes of anchors. With `same_label`, of blocks whose labels overlap."""
    n_anchors, n_rows = (x.where("chunk = 0").count() for x in (anchors, rows))
    down, across = -(-n_anchors // CELL_ANCHORS) or 1, -(-n_rows // CELL_ROWS) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    a = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], F.col("chunk"), dealt(down).alias("cell_row"), every(across).alias("cell_column"))
    b = rows.drop("windows").withColumn("cell_column", dealt(across)).withColumn("cell_row", every(down))
    met = b.join(a, ["chunk", "cell_row", "cell_column"])
    chunk_width, stripe = CHUNK, STRIPE
    if same_label:
        met = met.where((F.col("low") <= F.col("a_high")) & (F.col("a_low") <= F.col("high")))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                scores = product(*(np.frombuffer(r[c], np.int64).reshape(-1, chunk_width) for c in ("a_m", "m")))
                width = len(r["a_windows"]) // len(r["a_ids"]) if r["a_windows"] else 1
                out: list[tuple] = []
                for at in range(0, len(scores), stripe):
                    cut = lambda x, width=1, at=at: None if x is None else x[at * 8 * width : (at + stripe) * 8 * width]
                    out.append((r["a_block"], at // stripe, r["block"], r["chunk"], cut(r["a_ids"]), cut(r["a_labels"]), cut(r["a_windows"], width), r["ids"], r["labels"], _least_type(scores[at : at + stripe])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out), PARTIAL_FIELDS)], names=[n for n, _ in PARTIAL_FIELDS])

    return met.select("a_block", "block", "chunk", "a_ids", "a_labels", "a_windows", "ids", "labels", "a_m", "m").mapInArrow(run, PARTIAL_DDL)


def whole_scores(batches) -> Iterator[tuple]:
    """(anchor block, stripe, ids, labels, windows, row ids, row labels, scores) of partial scores sorted by stripe and block of rows, added up over the chunks."""
    for group in groups_of(batches, ["anchor_block", "stripe", "row_block"]):
        total, first = None, None
        for r in group.to_pylist():
            if r["chunk"] == 0:
                first = {k: np.frombuffer(r[k] or b"", np.int64) for k in ("ids", "labels", "windows", "row_ids", "row_labels")}
        n, m = len(first["ids"]), len(first["row_ids"])
        for x in group.column("scores").to_pylist():
            scores = np.frombuffer(x, "<i4" if len(x) == 4 * n * m else "<i8").astype(np.int64)
            total = scores if total is None else total + scores
        yield group.column("anchor_block")[0].as_py(), group.column("stripe")[0].as_py(), *first.values(), total.reshape(n, m)


def _best(kept: tuple[np.ndarray, ...] | None, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of what is kept and what is new: by score from the highest, then by id."""
    if kept is not None:
        scores, ids = np.concatenate([kept[0], scores]), np.concatenate([kept[1], ids])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _stripes(partial: DataFrame, n_anchors: int, reduce, names: list[str]) -> DataFrame:
    """Add partial scores up and reduce them: `reduce` gets a dict of what it has found of a stripe, to add to, and a block of whole scores.

    A stripe's blocks of rows are dealt into several groups, each reduced by itself, where stripes alone
    are too few for the shuffle's partitions.
    """
    n = parts(partial)
    lanes = -(-4 * n * STRIPE // max(n_anchors, 1))

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, found = None, {}

        def rows() -> Iterator[pa.RecordBatch]:
            out = [key + (int(i), int(s)) for key, (scores, ids) in found.items() for s, i in zip(scores, ids)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

        for block, stripe, *tile in whole_scores(batches):
            if at != (block, stripe):
                yield from rows()
                at, found = (block, stripe), {}
            reduce(found, *tile)
        yield from rows()

    dealt = partial.withColumn("lane", F.pmod(F.xxhash64("row_block"), F.lit(lanes)).cast("int"))
    dealt = dealt.repartition(n, "anchor_block", "stripe", "lane").sortWithinPartitions("anchor_block", "stripe", "lane", "row_block", "chunk").drop("lane")
    return dealt.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def positives_of(partial: DataFrame, n_anchors: int, k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score: of each anchor the first k other rows of its label."""

    def reduce(found: dict, ids, labels, windows, row_ids, row_labels, scores) -> None:
        for i, (a, label) in enumerate(zip(ids.tolist(), labels.tolist())):
            at = np.flatnonzero((row_labels == label) & (row_ids != a))
            if len(at):
                found[a,] = _best(found.get((a,)), scores[i, at], row_ids[at], k)

    rows = _stripes(partial, n_anchors, reduce, ["anchor_id", "positive_id", "positive_score"])
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")


def negatives_of(partial: DataFrame, n_anchors: int, k: int, least: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, negative_id, negative_score: of each positive's window the first k rows of other labels."""

    def reduce(found: dict, ids, labels, windows, row_ids, row_labels, scores) -> None:
        windows = windows.reshape(len(ids), -1, 2)
        for i, (a, label) in enumerate(zip(ids.tolist(), labels.tolist())):
            at = np.flatnonzero(row_labels != label)
            if not len(at):
                continue
            at = at[np.lexsort((row_ids[at], -scores[i, at]))]
            down = -scores[i, at]
            for positive, score in windows[i].tolist():
                if score == NONE:
                    continue
                begin = int(np.searchsorted(down, -score))  # the first that is at most the positive's
                fits = [100 * s >= least * score for s in scores[i, at[begin : begin + k]].tolist()]
                own = at[begin : begin + sum(fits)]
                if len(own):
                    key = (a, positive, score)
                    found[key] = _best(found.get(key), scores[i, own], row_ids[own], k)

    rows = _stripes(partial, n_anchors, reduce, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its inner product with the anchor, in whole numbers; higher scores come first, ties by
    smaller id. `is_anchor` is a condition on `id`. An anchor's positives are its first other rows of the same
    label. To each come the first rows of other labels whose score is at most the positive's and at least
    `least` hundredths of it. Rows with a null id, label, vector or component, or one that isn't finite, take
    no part; of rows of one id one does, that with the least label, then vector. Vectors of unequal
    lengths count as if the shorter ended in zeros. Scores beyond 64 bits are an error. Other columns are
    not read. No anchors, or no rows, give no rows.
    """
    prepare(df.sparkSession)
    rows = stage(whole(df, id_col, vector_col, label_col, scale), "vectors")
    row_blocks = stage(blocks(rows, ROW_BLOCK, CHUNK), "row-blocks")
    anchors = stage(blocks(rows.where(is_anchor), ANCHOR_BLOCK, CHUNK), "anchor-blocks")
    n_anchors = rows.where(is_anchor).count()
    found = stage(positives_of(partial_scores(anchors, row_blocks, True), n_anchors, positives), "positives")
    release(anchors)
    # an anchor's windows: `positives` pairs of id and score
    pair = F.array("positive_id", "positive_score")
    windows = found.groupBy("anchor_id").agg(F.flatten(F.collect_list(pair)).alias("w"))
    filled = F.concat("w", F.flatten(F.array_repeat(F.array(F.lit(-1).cast("bigint"), F.lit(NONE).cast("bigint")), positives - (F.size("w") / 2).cast("int"))))
    ready = rows.join(windows, rows["id"] == windows["anchor_id"]).select("id", "label", "v", filled.alias("w"))
    anchors = stage(blocks(ready, ANCHOR_BLOCK, CHUNK, "w"), "anchor-blocks")
    release(rows, found)
    # the result reads both tables of blocks
    out = negatives_of(partial_scores(anchors, row_blocks, False), n_anchors, negatives, least)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


ORACLE = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": ORACLE}
