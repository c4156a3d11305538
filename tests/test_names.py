"""Names whose first or last letter has an accent, in queries and against their SQL."""

import pandas as pd
import pytest

from corpusloom.functions import predicates as P
from corpusloom.plans import registry
from corpusloom.plans import sql as S
from tests.helpers import same, views
from tests.test_rules import values

#: Fifty names if an accented letter ends a word, and so an author list; none as SQL reads it.
NAMES = " ".join(["Ré"] * 150)
PROSE = " ".join(["the first of all the words that stand in it"] * 10)
#: For each query a row that it has, or hasn't, of a text whose second line is NAMES.
QUERIES = {
    "author_names": ("line", NAMES, 0),
    "author_lists": ("line", NAMES, 0),
    "noise_removal": ("category", "author_blocks", 0),
    "noise_removal_blocks": ("category", "author_blocks", 0),
    "cleanup_counts": ("author_blocks", 0, 1),
    "clean_corpus": ("reasons", "", 1),
}


@pytest.fixture
def folder(tmp_path):
    # lines 0 to 8 of document 2 are not replaced by examples
    text = "\n".join([PROSE, NAMES, PROSE, PROSE, PROSE])
    pd.DataFrame({"doc_id": [2], "text": [text]}).to_parquet(tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", QUERIES)
def test_queries_take_names_as_their_sql_does(spark, folder, name):
    column, value, n = QUERIES[name]
    frame = registry.QUERIES[name](spark, folder)
    assert [r[column] for r in frame.collect()].count(value) == n
    same(frame, views(folder), registry.ORACLES[name])


def test_words_and_blanks_of_names_are_of_ascii(spark):
    cases = {
        "Ann Smith": 1, "Ann B. Smith, Ann Smith Jones": 2, "José Pérez": 1, "Ann José": 1, "Reha Ré": 0, "Ann Ré x": 0, "Ann Ré9": 1, "éAnn Smith": 1, "9Ann Smith": 0,
        "_Ann Smith": 0, "Ann Smith9": 0, "Ann Smith Jones9": 1, "9éAnn Smith": 1, "ÉéA AéAn Smith": 1, "Ann Smith": 0, "Ann\x0bSmith": 0, "Ann\tSmith": 1, "Ann JoéBob_ Smith": 1, "": 0,
    }
    assert dict(views().execute(f"SELECT x, {S.author_names('x')} FROM (SELECT unnest(?::VARCHAR[]) AS x)", [list(cases)]).fetchall()) == cases
    assert values(spark, list(cases), P.author_name_score) == [list(cases.values())]


def test_a_long_run_of_letters_is_looked_at_once(spark):
    # if each of its capitals were a new beginning, this would take many minutes
    assert values(spark, ["éA" * 200_000, "Aé" * 200_000 + " Ann Smith"], P.author_name_score) == [[0, 1]]
