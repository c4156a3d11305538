"""N-gram Jaccard self-join by chosen paths.

A set of word shingles is stood for by `SIZE` min-hashes, its tokens. From a root, each run splits the sets
recursively: at a node some tokens are sampled by a hash of the node's path, 1 / threshold of them
expected, and every set goes to one child for each sampled token that it has. Nodes of at most LIMIT sets
are compared by brute force. Nodes still larger at the last level are dealt into blocks by the sets' sizes, and every pair of blocks
is compared whose sizes are near enough for a pair at the threshold: to split them further would lower the
chance that a pair shares a node, which the number of runs is planned by. Larger inputs have more levels. As
many runs are made as the target recall of a pair at the threshold needs.
Sets are compared by sketches of BINS bytes, the least hash of each part of the hash range, and by their
sizes; those near enough are tied into candidate groups, within which every pair's likeness is computed from
the whole sets, in blocks. A sketch's error is a quarter of what the tokens' would be, so that texts on a
common form, far below the threshold, tie no groups together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import parts, prepare, read, reduced, release, stage
from corpusloom.llm.components import components
from corpusloom.llm.substring_dedup import BASES, mixed, windows, word_values

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.99
#: Min-hashes of a set.
SIZE = 64
#: Sets of a node that are compared by brute force; levels of the tree for up to so many sets, and one more for each ten times as many.
LIMIT, LEVELS, LEVEL_SETS = 200, 3, 1_000_000
#: Sets, on average, of a block of a node that is too large at the last level.
NODE_BLOCK = 2000
#: Parts of the hash range, each of which gives a sketch a byte.
BINS = 256
#: Two sets are candidates if their sketches' likeness is so many standard deviations below the threshold, or higher.
DEVIATIONS = 5
#: Shingles, and sets, of a block of a candidate group, on average.
BLOCK, SETS = 200_000, 1000
#: Columns of shingles multiplied at a time.
CHUNK = 4096

_seeds = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 63, (2, SIZE), np.uint64)
FACTORS, SHIFTS = _seeds[0] | np.uint64(1), _seeds[1]


def survival(level: int) -> float:
    """The chance that a pair at the threshold shares a node at a level: one common token is sampled at each, on average."""
    p = 1.0
    for _ in range(level):
        p = 1 - math.exp(-p)
    return p


def levels_for(sets: int) -> int:
    """Levels of the tree: a node's sets grow with the input, and each level leaves a share of them."""
    return LEVELS + max(0, math.ceil(math.log10(max(sets, 1) / LEVEL_SETS)))


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """Runs by which a pair at the threshold shares a node at the last level with this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels)))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; 1 to k-1 words are one shingle."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(mixed(windows(word_values(words), min(k, len(words)), BASES[0])))


def tokens(hashes: np.ndarray) -> np.ndarray:
    """The set's min-hashes, of 32 bits."""
    low = np.full(SIZE, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[at : at + 4096, None] * FACTORS + SHIFTS).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


_edges = (np.arange(BINS, dtype=np.uint64) * np.uint64(2**64 // BINS)).astype(np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Of each part of the hash range a byte of the set's least hash there, 1 to 255; 0 if it has none. `hashes` are sorted."""
    at = np.searchsorted(hashes, _edges)
    out = np.zeros(BINS, np.uint8)
    own = np.diff(np.append(at, len(hashes))) > 0
    out[own] = hashes[at[own]] % np.uint64(255) + np.uint64(1)
    return out


def near(left: np.ndarray, right: np.ndarray, left_sizes: np.ndarray, right_sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets at `left` may be as near as the threshold to which at `right`, by sketches and sizes."""
    both = agreement(left, right)
    empty = (left == 0).astype(np.float32) @ (right == 0).astype(np.float32).T
    parts = BINS - empty
    least = threshold * parts - DEVIATIONS * np.sqrt(threshold * (1 - threshold) * parts)
    a, b = left_sizes[:, None], right_sizes[None, :]
    return (both - empty >= least) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-6)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def children(paths: np.ndarray, signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of every child that the rows' sets go to from the given nodes."""
    place = np.arange(SIZE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sampled = _spread(paths[:, None] + place) < np.uint64(int(2**64 / (threshold * SIZE)))
    row, at = np.nonzero(sampled)
    return row, _spread(_spread(paths[row] ^ place[at]) + signatures[row, at])


def _root(run: int) -> np.uint64:
    return _spread(np.array([run + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0]


def _signed(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, set_key (equal for equal sets, null for none), n_shingles, signature (the tokens), sketch, text_key (the text's md5)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, found, sketches, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                texts.append(hashlib.md5((text or "").encode()).hexdigest())
                hashes = shingles(text, k)
                keys.append(hashlib.md5(hashes.tobytes()).hexdigest() if len(hashes) else None)
                sizes.append(len(hashes))
                found.append(tokens(hashes).tobytes())
                sketches.append(sketch(hashes).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(sketches, pa.binary()), pa.array(texts, pa.string())], names=["id", "set_key", "n_shingles", "signature", "sketch", "text_key"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), text_col).mapInArrow(run, "id bigint, set_key string, n_shingles bigint, signature binary, sketch binary, text_key string")


def _matrix(column, kind=np.uint32, width: int = SIZE) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _expand(df: DataFrame, threshold: float, runs: int = 0) -> DataFrame:
    """id, path of the children of rows (id, signature, path), or with `runs` of the roots."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = _matrix(batch.column(1))
            if runs:
                todo = [np.full(len(signatures), _root(r)) for r in range(runs)]
            else:
                todo = [batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
            for paths in todo:
                row, path = children(paths, signatures, threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(path.view(np.int64))], names=["id", "path"])

    return df.select("id", "signature", *["path"] * (not runs)).mapInArrow(run, "id bigint, path bigint")


def groups_of(batches, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        last = tuple(c[-1] for c in columns)
        at = 0
        for cut in np.flatnonzero(change).tolist():
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches([x for x in held if x.num_rows] or held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def least_connected(near: np.ndarray) -> np.ndarray:
    """Of each node the least node that it is connected with, by a symmetric matrix."""
    n = len(near)
    label = np.arange(n)
    near = near | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many places each row of `left` agrees with each of `right`."""
    if len(left) <= 64:
        return np.stack([np.count_nonzero(right == x, axis=1) for x in left])
    out = np.zeros((len(left), len(right)), np.uint16)
    for a, b in zip(left.T.copy(), right.T.copy()):
        out += a[:, None] == b
    return out


def least_across(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node of two sides the least left node that it is connected with; the number of left nodes if there is none."""
    n, m = near.shape
    left, right = np.arange(n, dtype=np.int32), np.full(m, n, np.int32)
    while True:
        new_right = np.where(near, left[:, None], np.int32(n)).min(0)
        new_left = np.minimum(left, np.where(near, new_right, np.int32(n)).min(1))
        new_left = new_left[new_left]
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _ties(df: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that tie the connected sets of each pair of a node's blocks: a candidate, and the first it is connected with."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        for group in groups_of(batches, ["path", "i", "j"]):
            ids, block = (group.column(c).to_numpy() for c in ("id", "block"))
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            if len(ids) > 1:
                sketches, sizes = _matrix(group.column("sketch"), np.uint8, BINS), group.column("n_shingles").to_numpy()
                if i == j:
                    first = ids[least_connected(near(sketches, sketches, sizes, sizes, threshold))]
                else:
                    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                    first = ids.copy()
                    if len(left) and len(right):
                        of_left, of_right = least_across(near(sketches[left], sketches[right], sizes[left], sizes[right], threshold))
                        first[left] = ids[left[of_left]]
                        first[right] = np.append(ids[left], 0)[of_right]
                        alone = of_right == len(left)
                        first[right[alone]] = ids[right[alone]]
                other = first != ids
                out[0].extend(ids[other].tolist())
                out[1].extend(first[other].tolist())
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
                out = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return df.mapInArrow(run, "a bigint, b bigint")


def in_block_pairs(df: DataFrame) -> DataFrame:
    """Each row once for every pair (i, j) of the `blocks` that its `block` is in, i <= j."""
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    return df.withColumn("pair", F.explode(pairs)).select("*", "pair.i", "pair.j").drop("pair")


def candidates(signed: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, used: list | None = None) -> DataFrame:
    """(a, b) that tie sets (id, n_shingles, signature, sketch) into candidate groups, by chosen paths. Staged tables go to `used`."""
    n = parts(signed)
    used = [] if used is None else used
    # what the limits leave at a level: small nodes are leaves, larger ones go on
    leaves = None
    last = levels_for(signed.count())
    paths = _expand(signed, threshold, runs_for(recall, last))
    for level in range(1, last + 1):
        paths = stage(paths, f"level-{level}")
        sizes = stage(paths.groupBy("path").count().where("count > 1"), f"sizes-{level}")  # staged: see substring_dedup
        used += [paths, sizes]
        shared = paths.join(sizes, "path")
        large = shared.where(F.col("count") > LIMIT).select("id", "path")
        shared = shared.where(F.col("count") <= LIMIT).select("id", "path")
        leaves = shared if leaves is None else leaves.union(shared)
        if level < last:
            paths = _expand(large.join(signed.select("id", "signature"), "id"), threshold)
    small = leaves.select("id", "path", *[F.lit(0).cast("bigint").alias(c) for c in ("block", "i", "j")])
    rows = small.union(_dealt(large, signed, threshold, used)).join(signed.select("id", "n_shingles", "sketch"), "id")
    rows = rows.repartition(n, "path", "i", "j").sortWithinPartitions("path", "i", "j", "id").select("path", "i", "j", "block", "id", "n_shingles", "sketch")
    return _ties(rows, threshold)


#: Blocks of a class of sizes, at most; a block's number is its class's times this and its own there.
CLASS_BLOCKS = 1 << 32


def _dealt(large: DataFrame, signed: DataFrame, threshold: float, used: list) -> DataFrame:
    """id, path, block, i, j of the sets of large nodes: a row for each pair of blocks that a set's block is in.

    A class has the sizes from one power of 1 / threshold to the next, so that sets at the threshold are of
    one class or of two that follow each other. Blocks of about NODE_BLOCK sets are of one class.
    """
    size_class = F.floor(F.log("n_shingles") / math.log(1 / threshold) + 1e-9).cast("bigint")
    rows = stage(large.join(signed.select("id", size_class.alias("class")), "id").select("id", "path", "class"), "large")
    blocks = rows.groupBy("path", "class").agg(F.ceil(F.count("*") / NODE_BLOCK).alias("blocks"))  # a node's classes are few
    after, before = (blocks.select("path", (F.col("class") + d).alias("class"), F.col("blocks").alias(name)) for d, name in ((-1, "after"), (1, "before")))
    blocks = stage(blocks.join(after, ["path", "class"], "left").join(before, ["path", "class"], "left").na.fill(0, ["after", "before"]), "classes")
    used += [rows, blocks]
    found = rows.join(blocks, ["path", "class"]).withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")))
    number = lambda of, at: of * F.lit(CLASS_BLOCKS) + at
    block = number(F.col("class"), F.col("own"))

    def pairs(count: str, of: Column) -> Column:
        """The pairs of the set's block with the blocks of a class."""
        each = F.when(F.col(count) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(each, lambda k: F.struct(F.least(number(of, k), block).alias("i"), F.greatest(number(of, k), block).alias("j")))

    met = F.concat(*(pairs(name, F.col("class") + d) for name, d in (("before", -1), ("blocks", 0), ("after", 1))))
    return found.withColumn("block", block).withColumn("p", F.explode(met)).select("id", "path", "block", "p.i", "p.j")


def _likeness(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard likeness of the sets at `left` with those at `right`."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    owner, column = owner[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        a, b = np.searchsorted(column, [at, at + CHUNK])
        dense = np.zeros((len(sets), CHUNK if column[b - 1] - at >= CHUNK - 1 else int(column[b - 1]) - at + 1), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        both += dense[left] @ dense[right].T
    return both / (sizes[left][:, None] + sizes[right][None, :] - both)


def _verified(df: DataFrame, threshold: float, k: int) -> DataFrame:
    """Of each pair of blocks the links: id, links (documents linked with it), to (the least set it is connected with)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for group in groups_of(batches, ["root", "i", "j"]):
            ids, block, weight = (group.column(c).to_numpy() for c in ("id", "block", "weight"))
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            if len(ids) > 1:
                sets = [shingles(x, k) for x in group.column("text").to_pylist()]
                left = np.flatnonzero(block == i)
                right = left if i == j else np.flatnonzero(block == j)
                if len(left) and len(right):
                    linked = np.zeros((len(ids), len(ids)), bool)
                    linked[np.ix_(left, right)] = _likeness(sets, left, right) >= threshold - 1e-6
                    linked |= linked.T
                    np.fill_diagonal(linked, False)
                    links = linked @ weight
                    first = ids[least_connected(linked)]
                    out += [(a, b, c) for a, b, c in zip(ids.tolist(), links.tolist(), first.tolist()) if b]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["id", "links", "to"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["id", "links", "to"])

    return df.mapInArrow(run, "id bigint, links bigint, to bigint")


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = TARGET_RECALL, k: int = WORDS) -> DataFrame:
    """id, class_id, rep_id, n_links of each row.

    n_links counts the other rows whose shingle sets have a likeness of `threshold` or more with this row's,
    copies included; class_id is the least id among the rows that links connect it with; rep_id is the
    least id of the rows with the same set. Rows without a word, or with a null text, have no links and
    their own id as class. Ids are whole numbers; rows of one id count as one document, whose words are those
    of its text with the least set key, in whatever order the rows come, and rows of a null id stand alone
    with a null class. Other columns are not read.
    """
    prepare(df.sparkSession)
    signed = stage(_signed(df, id_col, text_col, k), "signed")
    known = signed.where(F.col("id").isNotNull() & F.col("set_key").isNotNull())
    single = known.groupBy("id").agg(F.min(F.struct("set_key", "n_shingles", "signature", "sketch", "text_key")).alias("s")).select("id", "s.*")
    reps = stage(single.groupBy("set_key").agg(F.min(F.struct("id", "n_shingles", "signature", "sketch", "text_key")).alias("r"), F.count("*").alias("weight")).select("set_key", "r.*", "weight"), "reps")
    used: list[DataFrame] = []
    groups = stage(components(candidates(reps, threshold, recall, used)), "groups")
    release(*used)
    used = [groups]
    groups = stage(groups.join(reps.select("id", "n_shingles", "weight", "text_key"), "id"), "members")
    release(*used)
    sizes = groups.groupBy("root").agg(F.greatest(F.ceil(F.sum("n_shingles") / BLOCK), F.ceil(F.count("*") / SETS)).cast("int").alias("blocks"))
    members = groups.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int"))
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # of an id's texts the one whose set was chosen above
    texts = reduced(docs, groups, "id").join(members, "id").where(F.md5(F.col("text").cast("binary")) == F.col("text_key")).dropDuplicates(["id"])
    dealt = in_block_pairs(texts).select("root", "i", "j", "id", "block", "weight", "text")
    dealt = dealt.repartition(parts(df), "root", "i", "j").sortWithinPartitions("root", "i", "j", "id")
    links = stage(_verified(dealt, threshold, k), "links")
    release(groups)
    classes = components(links.select(F.col("id").alias("a"), F.col("to").alias("b")))
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    found = reps.join(counted, "id", "left").join(classes, "id", "left").select("set_key", F.col("id").alias("rep_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("class_id"))
    found = stage(found, "found")
    release(reps, links)
    out = signed.select("id", "set_key").join(single.select("id", F.col("set_key").alias("_first")), "id", "left").join(found, F.col("_first") == found["set_key"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("rep_id", "id").alias("rep_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+{WORDS - 1}], ' ') AS g FROM t, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS r(i) WHERE len(ws) > 0),
k AS (SELECT doc_id, count(*) AS n, min(g) AS low, md5(string_agg(g, chr(10) ORDER BY g)) AS set_key FROM s GROUP BY doc_id),
rep AS (SELECT set_key, min(doc_id) AS rep_id FROM k GROUP BY set_key),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c) - 0.000001),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT a AS doc_id, least(a, min(b)) AS class_id FROM reach GROUP BY a),
n AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a)
SELECT t.doc_id, coalesce(class_id, t.doc_id) AS class_id, coalesce(rep_id, t.doc_id) AS rep_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM t LEFT JOIN k USING (doc_id) LEFT JOIN rep USING (set_key) LEFT JOIN class USING (doc_id) LEFT JOIN n USING (doc_id)"""

QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLES = {"op10_ngram_join": ORACLE}
