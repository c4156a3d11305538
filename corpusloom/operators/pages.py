"""Repeated headers and footers, and the flattening of pages, on arrays: a row a document, no shuffle.

Null pages give null, none give none; a null line is dropped with the repeated ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.predicates import is_page_number
from corpusloom.functions.text import fuzzy_key, let, normalize_line, strip

#: Documents of fewer pages have no repeated lines; shorter lines don't count.
MIN_PAGES, MIN_CHARS = 3, 4


def _countable(line: Column) -> Column:
    return (F.length(line) >= MIN_CHARS) & ~is_page_number(line)


def page_keys(pages: Column) -> Column:
    """Each page's distinct keys, of lines that may be headers."""
    return F.transform(pages, lambda p: F.array_distinct(F.transform(F.filter(F.transform(p, normalize_line), _countable), fuzzy_key)))


def repeated_keys(df: DataFrame, id_col: str, pages_col: str, ratio: float = 0.30) -> DataFrame:
    """(id, key, n_pages_with) of keys on at least max(2, int(ratio * pages)) pages; empty pages count as pages.

    Long form: keys are counted in two steps, so a key on very many documents is no burden to one task.
    """
    long = df.where(F.size(pages_col) >= MIN_PAGES).select(id_col, F.size(pages_col).alias("n"), F.explode(page_keys(F.col(pages_col))).alias("keys"))
    counts = long.select(id_col, "n", F.explode("keys").alias("key")).groupBy(id_col, "n", "key").agg(F.count("*").alias("n_pages_with"))
    return counts.where(F.col("n_pages_with") >= F.greatest(F.lit(2), (F.col("n") * float(ratio)).cast("int"))).select(id_col, "key", "n_pages_with")


def strip_repeated(pages: Column, ratio: float = 0.30) -> Column:
    """Pages without their repeated lines; other lines in their normal form, empty ones kept."""
    noted = lambda line: let(normalize_line(line), lambda x: F.struct(x.alias("x"), fuzzy_key(x).alias("key")))

    def go(own: Column) -> Column:
        need = F.greatest(F.lit(2), (F.size(own) * float(ratio)).cast("int"))
        keys = F.flatten(F.transform(own, lambda p: F.array_distinct(F.transform(F.filter(p, lambda z: _countable(z["x"])), lambda z: z["key"]))))
        # of sorted keys one is often if the one `need` - 1 places on is the same
        often = lambda all_: F.array_distinct(F.filter(all_, lambda k, i: F.try_element_at(all_, i + need).eqNullSafe(k)))
        drop = F.when(F.size(own) >= MIN_PAGES, let(F.array_sort(keys), often)).otherwise(F.array().cast("array<string>"))
        kept = lambda d: lambda z: (z["x"] == "") | (F.size(d) == 0) | ~F.array_contains(d, z["key"])
        # a key is on a share of the pages, so there are few of them, however long the document
        return let(drop, lambda d: F.transform(own, lambda p: F.transform(F.filter(p, kept(d)), lambda z: z["x"])))

    return let(F.transform(pages, lambda p: F.transform(p, noted)), go)


def flatten_pages(pages: Column) -> Column:
    """Lines of all pages; a page that doesn't end in an empty line gets one."""
    return F.flatten(F.transform(pages, lambda p: F.when((F.size(p) > 0) & (F.element_at(F.when(F.size(p) > 0, p).otherwise(F.array(F.lit(""))), -1) != ""), F.concat(p, F.array(F.lit("")))).otherwise(p)))


def is_blank(line: Column) -> Column:
    return strip(line) == ""
