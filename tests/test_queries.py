"""Every registered query of the library against its SQL on the smallest tables."""

import pytest
from compare import connect, spark_rows, sql_rows

from marquee.plans import registry
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    names, rows = spark_rows(registry.QUERIES[name](spark, SMALL))
    assert rows or name in ("dedupe_removed_per_venue", "similar_pairs", "missing_time_rise")
    if name in registry.ORACLE_SQL:
        want_names, want = sql_rows(con, registry.ORACLE_SQL[name])
        assert names == want_names
        assert rows == want


def test_sql_is_of_queries():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert len(registry.QUERIES) == sum(len(m.QUERIES) for m in registry.MODULES)
