"""The cleaning pipeline: pages to training-ready text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import CleanConfig
from corpusloom.functions import text as T
from corpusloom.operators import lines as L
from corpusloom.operators import pages as G
from corpusloom.operators.quality import reject_reasons, statistics


def _count(kinds: str, category: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == category))


def _written_out(x: Column) -> Column:
    """A line, empty if null, without the separators and their sign."""
    x, out = F.coalesce(x, F.lit("")), F.coalesce(x, F.lit(""))
    for i, sign in enumerate("\x1b\x1d\x1e"):
        out = F.replace(out, F.lit(sign), F.lit(f"\x1b{i}"))
    return F.when(x.rlike("[\x1b\x1d\x1e]"), out).otherwise(x)


def clean_pages(df: DataFrame, config: CleanConfig | None = None, id_col: str = "doc_id", pages_col: str = "pages") -> DataFrame:
    """id, text, valid, reject_reasons, stats, cleanup of each row of pages (array of arrays of lines).

    Each step is of its own column, on the row alone: no shuffle. The text of a rejected document is
    empty, its statistics and counts stay. Null pages count as none, null lines as empty ones; ids may be
    null or repeated; other columns are not read. No rows give no rows.
    """
    config = config or CleanConfig()
    empty = F.array().cast("array<array<string>>")
    pages = F.coalesce(F.col(pages_col), empty)
    # one text for the one Python function; lines have its separators written out, which go like all control characters
    whole = T.compatibility_form(F.array_join(F.transform(pages, lambda p: F.array_join(F.transform(p, _written_out), "\x1e")), "\x1d"))
    out = df.select(id_col, pages.alias("_raw"), F.split(whole, "\x1d", -1).alias("_p0"))
    normal = F.transform("_p0", lambda p: F.transform(F.split(p, "\x1e", -1), lambda x: T.replace_marks(F.when(x.contains("\x1b"), F.regexp_replace(x, "\x1b[012]", "")).otherwise(x))))
    out = out.withColumn("_p1", F.when(F.size("_raw") == 0, F.col("_raw")).otherwise(F.zip_with(normal, "_raw", lambda p, r: F.when(F.size(r) == 0, r).otherwise(p))))
    out = out.withColumn("_lines", G.flatten_pages(G.strip_repeated(F.col("_p1"), config.repeated_line_ratio)))
    out = out.withColumn("_start", L.front_start(F.col("_lines")))
    out = out.withColumn("_body", F.slice("_lines", F.col("_start") + 1, F.size("_lines")))
    out = out.withColumn("_kinds", L.noise_categories(F.col("_body"), config.rules))
    out = out.withColumn("_kept", F.transform(F.filter(F.arrays_zip(F.col("_body").alias("x"), F.col("_kinds").alias("k")), lambda z: z["k"] == ""), lambda z: z["x"]))
    out = out.withColumn("_end", L.references_start(F.col("_kept")) if config.remove_references else F.size("_kept"))
    out = out.withColumn("_joined", L.join_wrapped(F.slice("_kept", F.lit(1), F.col("_end"))))
    out = out.withColumn("_text", T.collapse_blank_lines(T.strip_submission_spans(T.repair_hyphenation(F.array_join("_joined", "\n")))))
    out = out.withColumn("stats", statistics(F.col("_text"), config.rules)).withColumn("reject_reasons", reject_reasons(F.col("stats"), config))
    n = {c: _count("_kinds", c) for c in L.COUNTS}
    n |= {"front_matter": F.col("_start"), "references": F.size("_kept") - F.col("_end")}
    valid = F.size("reject_reasons") == 0
    return out.select(id_col, F.when(valid, F.col("_text")).otherwise("").alias("text"), valid.alias("valid"), "reject_reasons", "stats", F.struct(*[x.cast("int").alias(c) for c, x in n.items()]).alias("cleanup"))
