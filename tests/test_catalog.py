import pytest
from oracle import compare

from casemill.plans.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_same_as_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), ORACLE[name], sf) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
