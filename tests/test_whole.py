"""Queries run over whole tables."""

import duckdb

from marquee.plans import registry
from marquee.plans.shows import shows
from tests.conftest import SMALL


def test_no_subsets_of_ids():
    for name in ("listing_pages", "plan_visits", "plan_links", "past_plans", "name_search"):
        sql = registry.ORACLE_SQL[name]
        assert not any(x in sql for x in ("o_custkey <", "c_custkey < 1", "IN ('v1', 'v2')", "substr(seq, 9, 2)::INT % 4")), name


def test_no_parts_of_tables():
    for name in ("hide_seen", "on_watchlist", "watchlist_stand", "watchlist_lines", "shared_seen", "shared_view", "request_outcome", "invitation_reason", "invitation_state", "with_whom", "alias_chain"):
        sql = registry.ORACLE_SQL[name]
        assert not any(x in sql for x in ("p_partkey % 50", "c_custkey % 10", "c_custkey % 7", "WHERE o_orderkey % 5", "o_custkey % 4 <> 0", "theaterId <> 'v2'")), name


def test_rows_of_whole_tables(spark):
    one = lambda name: registry.QUERIES[name](spark, SMALL)
    n = shows(spark, SMALL).count()
    assert one("plan_visits").count() == n
    assert one("plan_links").select("plan").distinct().count() == n
    orders, customers = (duckdb.sql(f"SELECT count(*) FROM '{SMALL}/{t}.parquet'").fetchall()[0][0] for t in ("orders", "customer"))
    assert one("request_outcome").count() == one("with_whom").count() == orders and one("shared_view").count() == customers
    # every customer whose name somebody else has is a searcher with hits
    customers = duckdb.sql(f"SELECT c_custkey FROM '{SMALL}/customer.parquet' WHERE c_custkey % 12 < 10").fetchall()
    assert {r["zoek"] for r in one("name_search").collect()} == {k for (k,) in customers}
