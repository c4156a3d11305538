"""Statistics of a cleaned text and the gate that rejects it.

A null text has null statistics and no reason to be rejected; an empty one has none of anything and is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import CleanConfig
from corpusloom.functions import predicates as P
from corpusloom.functions.rules import RULES, Rules
from corpusloom.functions.text import split_lines, strip, word_count


def statistics(text: Column, rules: Rules = RULES) -> Column:
    """characters, words, garbage_ratio: the share of non-empty lines that are drawings or artefacts."""

    def of(lines: Column) -> Column:
        garbage = F.size(F.filter(lines, lambda x: P.is_graphical(x) | P.is_pdf_artifact(x, rules)))
        return F.struct(F.length(text).alias("characters"), word_count(text).alias("words"), (garbage / F.greatest(F.lit(1), F.size(lines))).alias("garbage_ratio"))

    return F.element_at(F.transform(F.array(F.filter(F.transform(split_lines(text), strip), lambda x: x != "")), of), 1)


def reject_reasons(stats: Column, config: CleanConfig | None = None) -> Column:
    """Why a text is rejected, in a fixed order; empty if it is valid."""
    config = config or CleanConfig()
    reasons = (
        F.when(stats["characters"] < config.min_characters, "too_short"),
        F.when(stats["words"] < config.min_words, "too_few_words"),
        F.when(stats["garbage_ratio"] > config.max_garbage_ratio, "high_garbage_ratio"),
    )
    return F.array_compact(F.array(*reasons))
