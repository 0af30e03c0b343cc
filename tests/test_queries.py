"""Every registered query of the library against its oracle SQL on the smallest tables."""

import pytest

from tests.oracle import SF_DIR, compare
from tributary.plans.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, name):
    _, diff = compare(spark, SF_DIR, QUERIES[name], ORACLE[name])
    assert not diff


def test_queries_without_oracle_run(spark):
    for name in QUERIES.keys() - ORACLE.keys():
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert e.queries().keys() >= e.oracle_sql().keys()
