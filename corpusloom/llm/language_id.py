"""Word-first backoff language identification.

A word seen in training is scored by its log frequency in each language. A word that wasn't is scored by
its longest character n-grams that were, at first of MAX_GRAM characters and then of ever fewer. A text's
score for a language is the mean over its words. Words and n-grams are kept by their 64-bit hashes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out, keep_first, prepare, read

UNKNOWN = "und"
MAX_GRAM = 5
LETTERS = re.compile(r"[^\W\d_]+")
#: Words of which a Python worker keeps the scores, at most.
CACHE_WORDS = 400_000
#: Evidence of so many words makes a text's score.
EVIDENCE = 16


#: More languages than this are no languages.
MAX_LANGS = 1024


@dataclass(frozen=True)
class LanguageModel:
    """langs in order; sorted hashes of words and n-grams; a row of logs of shares per language for each; floors by kind.

    Kind 0 is whole words, kind n the n-grams. About 8 + 4 bytes a language for each word or n-gram.
    """

    langs: list
    hashes: np.ndarray
    logs: np.ndarray
    floors: np.ndarray


def hash_of(gram: str, kind: int) -> int:
    """64 bits; words and n-grams of the same characters differ."""
    return xxhash.xxh3_64_intdigest(gram.encode(), kind) - (1 << 63)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; none if the text has no letter at all."""
    found = LETTERS.findall((text or "").lower())
    if found and not any(map(str.isalpha, found)) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word with its two ends marked."""
    word = f"^{word}$"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", max_docs: int = 8000, min_count: int = 3) -> LanguageModel:
    """Learn from at most about `max_docs` rows that have a language, as many of each as there are.

    The sample is taken by a hash of `key_col`, each language with its own share; of the rows of one key
    and language only the least text counts. All words and n-grams that the sample has `min_count` times
    are kept, so the model is bounded by the sample alone. Rows without text or language are left out. Of
    no rows a model without languages comes; more than MAX_LANGS languages are an error.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"{lang_col} has more than {MAX_LANGS} values")
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((MAX_GRAM + 1, 0)))
    quota = max_docs / len(langs)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, quota / counts[lang]))])
    chosen = rows.where(F.pmod(F.xxhash64(F.col(key_col), F.lit(1)), F.lit(1_000_000)) < share[F.col(lang_col)] * 1_000_000)
    chosen = chosen.select(F.col(key_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).groupBy("key", "lang").agg(F.min("text").alias("text"))

    def count(batches):
        from collections import Counter

        at = {lang: i for i, lang in enumerate(langs)}
        found: list[Counter] = [Counter() for _ in langs]

        def out():
            for k, c in enumerate(found):
                grams: Counter = Counter()
                for word, n in c.items():
                    grams[hash_of(word, 0), 0] += n
                    for kind in range(1, MAX_GRAM + 1):
                        for g in grams_of(word, kind):
                            grams[hash_of(g, kind), kind] += n
                c.clear()
                items = list(grams.items())
                for a in range(0, len(items), 50_000):
                    part = items[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([h for (h, _), _ in part], pa.int64()), pa.array([x for (_, x), _ in part], pa.int32()), pa.array([k] * len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())], names=["h", "kind", "lang", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[at[lang]].update(words_of(text))
            if sum(map(len, found)) > 100_000:
                yield from out()
        yield from out()

    by = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(langs))]
    grams = chosen.select("lang", "text").mapInArrow(count, "h bigint, kind int, lang int, n bigint").groupBy("h", "kind").agg(F.sum("n").alias("total"), *by)
    kept = grams.where(F.col("total") >= min_count).select("h", F.col("kind").cast("byte").alias("kind"), *[F.col(f"n{k}").cast("float").alias(f"n{k}") for k in range(len(langs))]).toArrow()
    return _model(langs, kept.column("h").to_numpy(), kept.column("kind").to_numpy(), np.stack([kept.column(f"n{k}").to_numpy() for k in range(len(langs))], 1))


def _model(langs: list, hashes: np.ndarray, kind: np.ndarray, table: np.ndarray) -> LanguageModel:
    """From counts by hash and language: shares of what a language has of a kind, half a count more each."""
    order = np.argsort(hashes)
    hashes, kind, table = hashes[order], kind[order], table[order]
    floors, logs = np.zeros((MAX_GRAM + 1, len(langs))), np.zeros(table.shape, np.float32)
    for k in range(MAX_GRAM + 1):
        own = kind == k
        totals = table[own].sum(0, dtype=np.float64) + 0.5 * (own.sum() + 1)
        logs[own] = np.log((table[own] + 0.5) / totals)
        floors[k] = np.log(0.5 / totals)
    return LanguageModel(langs, hashes, logs, floors)


class Scorer:
    """Scores words, keeping what it has computed."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.row_of = dict(zip((model.hashes.view(np.uint64) ^ np.uint64(1 << 63)).tolist(), range(len(model.hashes))))
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs)))

    def word(self, word: str) -> np.ndarray:
        """The logs of a word: its own, or the mean over its longest n-grams that the model has, or the floor."""
        row_of, digest = self.row_of.get, xxhash.xxh3_64_intdigest
        if (row := row_of(digest(word.encode(), 0))) is not None:
            return self.model.logs[row]
        marked = f"^{word}$"
        marked = marked.encode() if marked.isascii() else marked
        for n in range(MAX_GRAM, 0, -1):
            grams = [marked[i : i + n] for i in range(len(marked) - n + 1)]
            rows = [row_of(digest(g if isinstance(g, bytes) else g.encode(), n)) for g in grams]
            if found := [r for r in rows if r is not None]:
                return self.model.logs.take(found, 0).sum(0, dtype=np.float64) / len(found)
        return self.model.floors[0]

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.at) > CACHE_WORDS:
            keep_first(self.at)
        for w in set(words).difference(self.at):
            k = len(self.at)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k] = self.word(w)
            self.at[w] = k
        return self.table.take(list(map(self.at.__getitem__, words)), 0)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        total = self.rows(words).mean(0) * min(len(words), EVIDENCE)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def language_id(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """id, the columns named in `keep`, lang_pred, score (the posterior of lang_pred over the model's languages).

    One row in, one row out; ids may be null or repeated. A null text, or one without a letter, gets
    `und` and 0, as does every text if the model was learned from no rows. Equal scores go to the first
    language in alphabetical order. Other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast({"model": (model.langs, model.hashes, model.logs, model.floors)})
    names = [id_col, *keep]

    def run(batches):
        kept = sent.value  # a worker keeps the scorer, with the words that it has met, between its tasks
        if "scorer" not in kept:
            kept["scorer"] = Scorer(LanguageModel(*kept["model"]))
        score = kept["scorer"]
        for batch in batches:
            got = [score(x) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return df.select(*names, text_col).mapInArrow(run, f"{schema}, lang_pred string, score double")


def is_held_out() -> Column:
    return held_out(F.col("doc_id"), 4, 2)


def learn(docs: DataFrame) -> LanguageModel:
    """A model from the rows of `documents` that aren't held out."""
    return fit(docs.where(~is_held_out()))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id(docs.withColumn("held_out", is_held_out()), learn(docs), keep=("held_out",))


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
