"""Registered queries: contract, plans, and SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from venuemill.plans import registry

SF = "/root/testdata/sf0.001"
SLOW = {"resolve_mentions", "merged_venues"}
SAMPLE = [
    "composite_score_rank", "legacy_score", "normalize_fields", "fuzzy_match_best", "slug_contested", "dedup_keeper", "open_now",
    "facet_text_price", "serving_rows", "ld_lists", "detail_pages", "place_enrichment", "until_cutoff",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_contract(spark):
    assert {name for name, (_, sql) in registry.ALL.items() if sql} == set(registry.ALL) <= set(entry.queries())
    assert "composite_score" in entry.entry(spark).columns


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, con.fetchall())


def test_no_query_joins_everything_with_everything(spark):
    for name, (query, _) in registry.ALL.items():
        if name in SLOW:
            continue
        plan = query(spark, SF)._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
