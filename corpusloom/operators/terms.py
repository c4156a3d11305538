"""Long lists of terms looked for in lines, all at once: the time doesn't follow the list's length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a list of terms, at most: it is sent to every executor.
MOST_BYTES = 64 << 20


def _listed(df: DataFrame, terms: DataFrame | Iterable[str], term_col: str) -> list[str]:
    """Different terms in lower case, without null and empty ones; too many are a ValueError, before they come to the driver."""
    if isinstance(terms, DataFrame):
        low = terms.select(F.lower(term_col).alias("t")).where("t <> ''").distinct()
        size = low.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
        if size <= MOST_BYTES:
            return [r.t for r in low.collect()]
    else:
        found = list({t.lower() for t in terms if t})
        if (size := sum(len(t.encode()) for t in found)) <= MOST_BYTES:
            return found
    raise ValueError(f"the terms have {size} bytes; {MOST_BYTES} are sent to executors at most")


def count_terms(df: DataFrame, terms: DataFrame | Iterable[str], line_col: str = "line", term_col: str = "term", to: str = "n_terms") -> DataFrame:
    """df and `to`: how many different terms each line has, whatever their case, as parts of it.

    Terms are a list, or a table's column; null and empty ones count for nothing. A null line has none. The
    terms become one automaton (Aho and Corasick's), which each Python worker builds once and reads lines with.
    """
    found = _listed(df, terms, term_col)
    sent = df.sparkSession.sparkContext.broadcast({"terms": found})
    source, low = df.withColumn("_low", F.lower(line_col)), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sent.value  # a worker keeps the automaton between its tasks
        if "automaton" not in kept:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, t in enumerate(kept["terms"]):
                automaton.add_word(t, i)
            if kept["terms"]:
                automaton.make_automaton()
            kept["automaton"] = automaton
        automaton = kept["automaton"]
        for batch in batches:
            lines = batch.column(low).to_pylist()
            counts = [len({i for _, i in automaton.iter(x)}) if x and kept["terms"] else 0 for x in lines]
            yield pa.RecordBatch.from_arrays([*batch.columns[:low], pa.array(counts, pa.int64())], names=[*batch.schema.names[:low], to])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return source.mapInArrow(run, ", ".join([*fields, f"`{to}` bigint"]))
