"""E-mail addresses next to accented letters, in queries and against their SQL."""

import random

import pandas as pd
import pytest

from corpusloom.functions import predicates as P
from corpusloom.plans import registry
from corpusloom.plans import sql as S
from tests.helpers import same, views
from tests.test_rules import values

#: A line that would end a correspondence block, but for its address, which begins or ends at an accented letter.
LONG = " ".join(["the first of all the words that stand in it"] * 10)
#: For each query a row that it has of a text of such lines, and how often.
QUERIES = {
    "noise_removal": ("category", "correspondence", 3),
    "noise_removal_blocks": ("category", "correspondence", 3),
    "cleanup_counts": ("correspondence", 3, 1),
}


@pytest.fixture
def folder(tmp_path):
    # lines 0 to 8 of document 2 are not replaced by examples
    text = "\n".join(["Correspondence: the first author", f"{LONG} émile@example.org", f"{LONG} a.b@example.orgé", LONG, LONG])
    pd.DataFrame({"doc_id": [2], "text": [text]}).to_parquet(tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", QUERIES)
def test_queries_take_addresses_as_their_sql_does(spark, folder, name):
    column, value, n = QUERIES[name]
    frame = registry.QUERIES[name](spark, folder)
    assert [r[column] for r in frame.collect()].count(value) == n
    same(frame, views(folder), registry.ORACLES[name])


def test_addresses_are_of_ascii(spark):
    draw = random.Random(5)
    cases = ["émile@ex.org", "é@ex.org", "a@ex.oré", "a@ex.o", "a@ex.org_", "a@ex.org9", "a@ex.or.gé", ".%+-@ex.org", "é.a@ex.org", "_@EX.ORG", "ſ@ex.org", "aſ@ex.oK", "a@ex.oKx", "a@ex.oK", "a@b@c.de", "@ex.org", "a@.de", ""]
    cases += ["".join(draw.choices("aB9_.%+-@@..éſK x", k=draw.randint(3, 14))) for _ in range(20_000)]
    want = [r[0] for r in views().execute(f"SELECT {S.email('x')} FROM (SELECT unnest(?::VARCHAR[]) AS x)", [cases]).fetchall()]
    assert values(spark, cases, P.has_email) == [want] and 0 < sum(want) < len(want)
    assert values(spark, ["a." * 200_000 + "@", ".+" * 200_000 + "@ex.org"], P.has_email) == [[False, False]]
