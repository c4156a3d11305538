import pytest

import __spark_entry__ as entry_module
from corpusloom.plans import registry
from tests.helpers import DATA, same, views


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, name):
    frame = registry.QUERIES[name](spark, DATA)
    same(frame, views(), registry.ORACLES[name])


def test_every_query_has_rows(spark):
    for name in ("noise_removal", "clean_corpus", "repeated_headers", "failure_lines", "location_rank"):
        assert registry.QUERIES[name](spark, DATA).limit(1).count() == 1


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.count() > 0
    assert set(registry.QUERIES) <= set(entry_module.queries())
    assert set(registry.ORACLES) <= set(entry_module.oracle_sql())
