"""Scalar text rules as Columns. A null gives null, an empty text an empty one; texts of any length are read whole."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import constants as C
from corpusloom.functions.rules import RULES, Rules

#: What str.splitlines() breaks at.
LINEBREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower(x: Column) -> Column:
    """In lower case. As in SQL, a capital I with a dot becomes an i, and not an i and a dot above."""
    return F.lower(F.replace(x, F.lit("\u0130"), F.lit("i")))


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    ends = F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(x, r"(?U)\A\s+|(?<!\s)\s++\z", "")).otherwise(x)


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break begins no line."""
    parts = F.split(text, LINEBREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


@F.pandas_udf(StringType())
def _compatible(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def compatibility_form(x: Column) -> Column:
    """NFKC, which Spark has no built-in for. Not inside a lambda: join texts first."""
    return _compatible(x)


def replace_marks(x: Column) -> Column:
    """Zero-width marks go, bracket pieces become spaces, control characters go."""
    ascii_ = F.octet_length(x) == F.length(x)
    clean = ascii_ & ~x.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    return F.when(clean, x).otherwise(F.translate(x, C.SPACED_CHARS + C.REMOVED_CHARS + C.CONTROL_CHARS, " " * len(C.SPACED_CHARS)))


def normalize_unicode(x: Column) -> Column:
    return replace_marks(compatibility_form(x))


def normalize_line(x: Column) -> Column:
    """Runs of blanks become a space; stripped."""
    x = F.when(x.contains("\t"), F.translate(x, "\t", " ")).otherwise(x)
    return strip(F.when(x.contains("  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x))


def repair_hyphenation(x: Column) -> Column:
    """Words cut by a hyphen at a line's end, or by a hyphen and blanks after four letters, are rejoined."""
    x = F.regexp_replace(x, C.LINE_HYPHEN, "")
    return F.when(x.rlike(r"(?U)-\s+[a-z]{2}"), F.regexp_replace(x, C.BLANK_HYPHEN, "$1$2")).otherwise(x)


def strip_submission_spans(x: Column) -> Column:
    """Spans from `Received: <date>` to the next e-mail address within 1,500 characters become a space."""
    return F.when(x.contains("Received:"), F.regexp_replace(x, C.RECEIVED_SPAN, " ")).otherwise(x)


def collapse_blank_lines(x: Column) -> Column:
    """No blanks before a line break, no more than one empty line; stripped."""
    x = F.when(x.rlike(r"[ \t]\n"), F.regexp_replace(x, r"(?<![ \t])[ \t]++\n", "\n")).otherwise(x)
    return strip(F.when(x.contains("\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x))


def heading_form(x: Column) -> Column:
    """A line as headings are compared: lower case, without spaces and ` .:-` around."""
    return F.call_function("btrim", lower(strip(x)), F.lit(" .:-"))


def section_name(x: Column) -> Column:
    """The known section that a heading names, else a numbered heading's title as it is written, else the stripped line."""
    known = heading_form(x)
    title = F.regexp_extract(strip(x), C.NUMBERED_TITLE, 1)
    return F.when(known.isin(*C.SECTION_NAMES), known).when(title != "", strip(title)).otherwise(strip(x))


def fuzzy_key(x: Column) -> Column:
    """A running header's key: in lower case, with numbers between bars as `#`."""
    part = lambda p: F.when(strip(p).rlike(r"(?U)\A\d+\z"), F.lit("#")).otherwise(strip(p))
    low = F.lower(x)
    return F.when(low.contains("|"), F.array_join(F.transform(F.split(low, r"\|", -1), part), "|")).otherwise(low)


def tells_of_failure(message: Column, rules: Rules = RULES) -> Column:
    low = F.lower(message)
    return reduce(or_, (F.contains(low, F.lit(p)) for p in rules.failure_parts))


def word_count(x: Column) -> Column:
    """Words: letters, digits, underscores, with apostrophes and hyphens inside."""
    return F.regexp_count(x, F.lit(r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"))
