"""Settings of the pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from corpusloom.functions.constants import LICENSES
from corpusloom.functions.rules import RULES, Rules


# The fields and what they are by default.


@dataclass(frozen=True)
class CleanConfig:
    """When a cleaned document is rejected, and what is cut."""

    min_characters: int = 1500
    min_words: int = 250
    max_garbage_ratio: float = 0.10
    remove_references: bool = False
    repeated_line_ratio: float = 0.30
    rules: Rules = RULES


@dataclass(frozen=True)
class AcquireConfig:
    """Which works are wanted, and how many."""

    min_year: int = 2015
    min_citations: int = 10
    max_per_term: int = 100
    max_per_day: int = 100
    max_retries: int = 2
    timeout: float = 60.0
    contact: str | None = None
    licenses: tuple[str, ...] = LICENSES
