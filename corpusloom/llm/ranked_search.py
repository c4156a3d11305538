"""Ranked search over impact-ordered postings, score at a time.

A first pass counts documents, terms and the documents that hold each of the searched terms. In a second one
each task cuts its documents into shards and indexes every one of them: of each term the postings are grouped
by their exact impact, from the highest. Searches run on shards. Groups of all terms of an item are taken by
what they add to a score (weight times impact times the term's repeats in the item), from the largest;
documents gather scores. After each batch of groups the most that a document can still gain is the sum of
each term's next group. Once that proves that the best `k` are among a few documents, processing stops, and
the scores of these are completed from the groups that are left. What a task has found in its shards before
is a bound for the next: a document must come to the k-th score there. What leaves a shard is at most `k`
rows an item, so that no posting is ever shuffled.

Items are searched in blocks of a bounded number of terms, which are broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import prepare, read, release, stage

#: Results of an item.
TOP = 20
#: Terms of a block of items, about; an item with more is a block by itself.
BLOCK_TERMS = 200_000
#: Documents, and postings, of a shard, at most about.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 21
#: Batches that an item's postings are processed in, if nothing stops it.
STEPS = 16
#: Documents for each of the best k whose scores are completed once the others are out.
FEW = 10
#: The parameters of the impact.
UNIT, LENGTH_SHARE, SATURATION = 1_000_000_000, 25, 12
#: Letters and digits as they are or in lower case, and bytes from 0x80 on; a space for all else.
_kept = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
TABLE = bytes(i if i in _kept else 0x20 for i in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The text's terms: runs of ASCII letters, digits and all that isn't ASCII; A-Z in lower case."""
    return (text or "").encode().translate(TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """A block of items: the terms of each, and what is known of terms."""

    def __init__(self, items: list[tuple[int, dict[bytes, int]]]):
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in items for t in own}))}
        self.items = [(item, np.array([self.vocabulary[t] for t in own], np.int64), np.array(list(own.values()), np.int64)) for item, own in items]
        self.weights = np.zeros(0, np.int64)
        self.n_docs = self.n_terms = 0

    def fields(self) -> dict:
        """What it is made of: a broadcast value is unpickled where this module need not be."""
        return dict(vars(self))

    @classmethod
    def of(cls, fields: dict) -> Block:
        found = cls.__new__(cls)
        vars(found).update(fields)
        return found

    def counted(self, n_docs: int, n_terms: int, df: dict[int, int]) -> Block:
        """With the counts of all documents."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(self.vocabulary))], np.int64)
        return self


class Shard:
    """Documents with the counts of the block's terms in them."""

    def __init__(self):
        self.ids, self.sizes, self.n_terms, self.terms, self.counts = [], [], [], [], []

    def add(self, doc_id: int | None, text: str | None, vocabulary: dict[bytes, int]) -> None:
        words = terms_of(text)
        if words:
            found = Counter(map(vocabulary.get, words))
            found.pop(None, None)
            self.ids.append(doc_id)
            self.n_terms.append(len(words))
            self.sizes.append(len(found))
            self.terms.extend(found)
            self.counts.extend(found.values())

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.terms) >= SHARD_POSTINGS


class Index:
    """A shard's postings by term, and within a term by exact impact from the highest."""

    def __init__(self, shard: Shard, block: Block):
        known = np.array([x is not None for x in shard.ids], bool)
        self.ids = np.array([x or 0 for x in shard.ids], np.int64)
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * np.array(shard.n_terms, np.int64) * block.n_docs // max(block.n_terms, 1)
        doc = np.repeat(np.arange(len(known)), shard.sizes)
        term, tf = np.array(shard.terms, np.int64), np.array(shard.counts, np.int64)
        impact = UNIT * tf // (1000 * tf + SATURATION * m[doc])
        order = np.lexsort((doc, -impact, term))
        order = order[known[doc[order]]]  # a document without an id counts, but can't be found
        self.docs, term, impact = doc[order], term[order], impact[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])
        #: where each group begins, and at last where the last one ends; groups of term t are first[t] to first[t + 1]
        self.begin = np.append(np.flatnonzero(new), len(term))
        self.impact = impact[new]
        self.first = np.searchsorted(term[new], np.arange(len(block.vocabulary) + 1))

    def search(self, terms: np.ndarray, repeats: np.ndarray, weights: np.ndarray, k: int, least: int = 1, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents' places, scores) of the best k with a score of `least`, 1 or more, from the highest, ties by id.

        `seen` gets how many of how many postings were processed before the others were proved to be out.
        """
        sizes = self.first[terms + 1] - self.first[terms]
        own = np.repeat(np.arange(len(terms)), sizes)
        group = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.first[terms][own]
        adds = (weights[terms] * repeats)[own] * self.impact[group]
        order = np.argsort(-adds, kind="stable")
        order = order[adds[order] > 0]
        own, group, adds = own[order], group[order], adds[order]
        length = self.begin[group + 1] - self.begin[group]
        upto = np.cumsum(length)
        score = np.zeros(len(self.ids), np.int64)
        total, at = int(upto[-1]) if len(upto) else 0, 0

        def postings(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            n = length[a:b]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[group[a:b]], n)
            return self.docs[place], np.repeat(adds[a:b], n)

        best = None
        for step in range(1, STEPS + 1):
            to = int(np.searchsorted(upto, total * step / STEPS)) + 1 if step < STEPS else len(group)
            to = min(to, len(group))
            if to > at:
                docs, more = postings(at, to)
                np.add.at(score, docs, more)
                at = to
            if at == len(group):
                break
            # each term's next group is the most that it can still add
            after = np.zeros(len(terms), np.int64)
            np.maximum.at(after, own[at:], adds[at:])
            if (best := self._proved(score, int(after.sum()), k, least)) is not None:
                break
        if seen is not None:
            seen.append((int(upto[at - 1]) if at else 0, total))
        if best is None:
            best = np.flatnonzero(score >= least)
        elif at < len(group):  # complete the scores of the best
            docs, more = postings(at, len(group))
            of = np.zeros(len(score), bool)
            of[best] = True
            np.add.at(score, docs[of[docs]], more[of[docs]])
        best = best[np.lexsort((self.ids[best], -score[best]))][:k]
        best = best[score[best] >= least]
        return best, score[best]

    @staticmethod
    def _proved(score: np.ndarray, bound: int, k: int, least: int) -> np.ndarray | None:
        """The few documents that can still come into the best k; None as long as they are many."""
        if len(score) > k:
            least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
        able = np.flatnonzero(score + bound >= least)
        return able if len(able) <= FEW * k else None


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, text, terms (how many) of each item with a term; of rows of one id the least text, none of a null id."""
    rows = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    rows = rows.groupBy("item").agg(F.min("text").alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(set(terms_of(x))) for x in batch.column(1).to_pylist()], pa.int64())], names=["item", "text", "terms"])

    return rows.mapInArrow(run, "item bigint, text string, terms bigint").where("terms > 0")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, dict[bytes, int]]]]:
    """The items, a bounded block after the other: the driver never holds more than one, and the item after it."""
    held, size = [], 0
    for r in items.toLocalIterator():
        if held and size + r.terms > BLOCK_TERMS:
            yield held
            held, size = [], 0
        held.append((r.item, dict(Counter(terms_of(r.text)))))
        size += r.terms
    if held:
        yield held


def _counts(docs: DataFrame, block: Block) -> Block:
    """The block with the counts of all documents: a row for each of its terms and task, added up."""
    sent = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches) -> Iterator[pa.RecordBatch]:
        vocabulary, df, n_docs, n_terms = sent.value, Counter(), 0, 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                n_docs += bool(words)
                n_terms += len(words)
                df.update(set(map(vocabulary.get, words)))
        df.pop(None, None)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *df], pa.int64()), pa.array([n_docs, n_terms, *df.values()], pa.int64())], names=["term", "n"])

    found = docs.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    df = dict(zip(*(c.to_pylist() for c in found.toArrow().columns)))  # a row for each term of the block
    return block.counted(df.pop(-2, 0), df.pop(-1, 0), df)


def _search(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """item_id, doc_id, score: of each shard the best k of each item."""
    sent = docs.sparkSession.sparkContext.broadcast(block.fields())

    def run(batches) -> Iterator[pa.RecordBatch]:
        block, shard = Block.of(sent.value), Shard()
        found = [np.zeros(0, np.int64)] * len(block.items)  # the best k scores of each item so far

        def results() -> Iterator[pa.RecordBatch]:
            index = Index(shard, block)
            for at in range(0, len(block.items), 64):
                out: list[list[np.ndarray]] = [[], [], []]
                for i, (item, terms, repeats) in enumerate(block.items[at : at + 64], at):
                    best, score = index.search(terms, repeats, block.weights, k, int(found[i][-1]) if len(found[i]) == k else 1)
                    found[i] = -np.sort(-np.concatenate([found[i], score]))[:k]
                    for x, y in zip(out, (np.full(len(best), item, np.int64), index.ids[best], score)):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["item_id", "doc_id", "score"])

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                shard.add(doc_id, text, block.vocabulary)
                if shard.full():
                    yield from results()
                    shard = Shard()
        if shard.ids:
            yield from results()

    return docs.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(df: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents of the highest score above 0, equal scores by ascending id.

    Terms are runs of ASCII letters, digits and whatever isn't ASCII, with A-Z in lower case; a term's
    repeats in the item count. Each row of df is a document, ids may be repeated; rows of a null id count in
    what the corpus says of terms and lengths, and aren't found. Null texts and texts without a term are no
    documents. Of items of one id the one with the least text counts, items of a null id or without a
    term give no rows. Other columns are not read. No documents, or no items, give no rows.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    asked = stage(_items(items, item_col, item_text_col), "items")
    found: DataFrame | None = None
    staged = []
    for held in _blocks(asked):
        own = stage(_search(docs, _counts(docs, Block(held)), k), "found")
        staged.append(own)
        found = own if found is None else found.unionAll(own)
    release(asked)
    if found is None:
        found = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    # Spark keeps the first k of each item before it shuffles
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
m AS (SELECT doc_id, 75 + ((25 * n * n_docs) // n_terms) AS m FROM n, c),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}"""

QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {"op11_ranked_search": ORACLE}
