"""The lists that line rules go by, and how to add to them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from corpusloom.functions import constants as C


@dataclass(frozen=True)
class Rules:
    """Parts of lines, in lower case, each of which is enough for its rule; affiliation terms are counted.

    For lists of hundreds see operators/terms.py: its time doesn't follow the list's length.
    """

    artifact_parts: tuple[str, ...] = C.ARTIFACT_PARTS
    license_parts: tuple[str, ...] = C.LICENSE_PARTS
    publisher_parts: tuple[str, ...] = C.PUBLISHER_PARTS
    affiliation_terms: tuple[str, ...] = C.AFFILIATION_TERMS
    failure_parts: tuple[str, ...] = C.FAILURE_PARTS

    def __post_init__(self):
        for f in fields(self):
            if "" in getattr(self, f.name):
                raise ValueError(f"{f.name} has an empty part, which every line has")

    def adding(self, **more: tuple[str, ...]) -> Rules:
        """These rules with more parts, by the lists' names, whatever their case; those that are there already change nothing."""
        return replace(self, **{k: tuple(dict.fromkeys((*getattr(self, k), *(x.lower() for x in v)))) for k, v in more.items()})


RULES = Rules()
