r"""Bulk find and replace over texts.

A null text has no match and is never changed; an empty one may match an empty pattern. Patterns are written
as for Python's `re` as far as named groups and classes of characters go, and are what Java's engine reads
otherwise: `a{,3}` and `(?a)` are errors, and `\Z` also matches before a last line break.
"""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An escaped character, a class of characters, or a named group's beginning or reference, whichever comes first.
PIECE = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<(\w+)>|\(\?P=(\w+)\)", re.DOTALL)


def java_name(name: str) -> str:
    """A group's name as Java allows it: letters and digits alone."""
    return "g" + "".join(c if c.isascii() and c.isalnum() else f"x{ord(c):x}x" for c in name)


def _java_class(chars: str) -> str:
    """A class of characters, in which Java takes brackets and `&&` for signs of its own."""
    inside = re.sub(r"\\.|\[|&(?=&)", lambda m: m[0] if len(m[0]) > 1 else "\\" + m[0], chars[1:-1], flags=re.DOTALL)
    return f"[{inside}]"


def java_regex(pattern: str) -> str:
    """A pattern with its named groups, and signs in classes of characters, as Java writes them."""

    def piece(m: re.Match) -> str:
        if m[1] or m[2]:
            return f"(?<{java_name(m[1])}>" if m[1] else f"\\k<{java_name(m[2])}>"
        return _java_class(m[0]) if m[0][0] == "[" else m[0]

    return PIECE.sub(piece, pattern)


def compile_pattern(pattern: str, use_regex: bool = False, case_sensitive: bool = False) -> str:
    """The pattern as Java reads it; a plain string matches itself. A bad pattern is a ValueError, before any job runs."""
    if use_regex:
        pattern = java_regex(pattern)
        jvm = SparkContext._jvm
        try:  # by the engine that executors run
            if jvm is None:
                re.compile(pattern)
            else:
                jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:
            raise ValueError(f"bad pattern: {str(getattr(e, 'java_exception', e)).splitlines()[0]}") from None
    else:
        pattern = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return ("(?U)" if case_sensitive else "(?iU)") + pattern


def compile_replacement(replacement: str, use_regex: bool = False) -> str:
    r"""The replacement as Java reads it: `\1` and `\g<1>` are groups in regex mode, all else stands for itself."""
    if not use_regex:
        return replacement.replace("\\", "\\\\").replace("$", "\\$")
    parts = re.split(r"\\(\d+)|\\g<(\w+)>", replacement)
    out = []
    for plain, number, name in zip(parts[::3], [*parts[1::3], None], [*parts[2::3], None]):
        out.append(plain.replace("\\", "\\\\").replace("$", "\\$"))
        if number or name:
            out.append(f"${number}" if number else (f"${name}" if name.isdigit() else f"${{{java_name(name)}}}"))
    return "".join(out)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def find(df: DataFrame, pattern: str, use_regex: bool = False, case_sensitive: bool = False, text_col: str = "text") -> DataFrame:
    """df and `n`, its matches: the preview. Nothing is changed."""
    return df.withColumn("n", count_matches(F.col(text_col), compile_pattern(pattern, use_regex, case_sensitive)))


def replace(df: DataFrame, pattern: str, replacement: str, use_regex: bool = False, case_sensitive: bool = False, text_col: str = "text") -> DataFrame:
    """The rows with a match, their text replaced, and `n`."""
    java = compile_pattern(pattern, use_regex, case_sensitive)
    found = find(df, pattern, use_regex, case_sensitive, text_col).where("n > 0")
    return found.withColumn(text_col, F.regexp_replace(F.col(text_col), java, compile_replacement(replacement, use_regex)))


def changed(df: DataFrame, pattern: str, replacement: str, use_regex: bool = False, case_sensitive: bool = False, text_col: str = "text") -> DataFrame:
    """All rows of df with their text after the replacement and `n`: unchanged ones as they were, with 0."""
    java = compile_pattern(pattern, use_regex, case_sensitive)
    n = F.coalesce(count_matches(F.col(text_col), java), F.lit(0))
    new = F.regexp_replace(F.col(text_col), java, compile_replacement(replacement, use_regex))
    return df.withColumn("n", n).withColumn(text_col, F.when(F.col("n") > 0, new).otherwise(F.col(text_col)))


def totals(found: DataFrame) -> DataFrame:
    """Files with a match and matches in all."""
    return found.agg(F.count_if(F.col("n") > 0).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("replacements"))
