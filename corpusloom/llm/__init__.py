"""Operators for training-data pipelines.

Python functions of this package are pickled by value, so that executors need neither the package
nor a shared file system for code; models travel as broadcast variables, which a reused Python worker
keeps between tasks.
"""

from __future__ import annotations

import importlib
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The modules that register queries.
MODULES = (
    "language_id",
    "substring_dedup",
    "quality_classifier",
    "packing",
    "fingerprints",
    "chat_format",
    "quality_rules",
    "byte_bpe",
    "lm_scoring",
    "ngram_join",
    "ranked_search",
    "hard_negatives",
    "merge_automaton",
)


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{name}"), attribute)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
