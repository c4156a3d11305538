"""Lines with a capital I with a dot, in lower case as SQL has it."""

import pandas as pd

from corpusloom.functions import predicates as P
from corpusloom.plans import registry
from corpusloom.plans import sql as S
from tests.helpers import same, views
from tests.test_rules import values

#: Six names and two terms of affiliations, one of them with such a letter.
LINE = "Ann Smith, Bob Jones, Carl White, Dora Black, Eve Green, Finn Brown of the UNİVERSITY and the School"


def test_author_lists(spark, tmp_path):
    pd.DataFrame({"doc_id": [2], "text": [LINE]}).to_parquet(tmp_path / "documents.parquet")
    frame = registry.QUERIES["author_lists"](spark, str(tmp_path))
    assert [r.line for r in frame.collect()] == [LINE]
    same(frame, views(tmp_path), registry.ORACLES["author_lists"])


def test_rules_that_go_by_lower_case(spark):
    cases = [LINE, "LİCENSED UNDER", "Downloaded via", "DOWNLOADED VİA", "INSTITUTE", "İNSTİTUTE", "İntroduction", "ı", "K", "Σ", ""]
    rules = {P.affiliation_score: S.affiliation, P.is_license: lambda x: S.has_any(x, P.C.LICENSE_PARTS), P.is_publisher_metadata: lambda x: S.has_any(x, P.C.PUBLISHER_PARTS), P.is_section_heading: S.heading}
    columns = zip(*views().execute(f"SELECT {', '.join(f('x') for f in rules.values())} FROM (SELECT unnest(?::VARCHAR[]) AS x)", [cases]).fetchall())
    assert values(spark, cases, *rules) == [list(c) for c in columns]
