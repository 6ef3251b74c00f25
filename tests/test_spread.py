"""Rows that each become a page or record are read by many tasks, and each pattern runs once a row."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from venuemill.operators import consolidate, resolve
from venuemill.plans import pipeline, queries_match

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["detail_pages", "parsed_hours", "ld_lists", "guide_import_records", "guide_cards", "matrix_records", "ld_reviews"])
def test_one_row_group_is_read_by_several_tasks(spark, name):
    """The file of 200 rows or so has one row group, which is one task of a scan, at any number of rows."""
    out = entry.queries()[name](spark, SF)
    assert out.select(F.spark_partition_id().alias("task")).distinct().count() > 1


@pytest.mark.parametrize("name, call, most", [
    ("detail_pages", "regexp_replace", 60), ("guide_import_records", "regexp_replace", 25), ("parsed_hours", "format_string", 8), ("ld_lists", "regexp_extract_all", 1),
])
def test_patterns_are_not_repeated(spark, name, call, most):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(call) <= most


@pytest.mark.parametrize("articles", [queries_match.guide_articles_of, lambda spark, d: queries_match.nine_passes_of(spark, d)[0]])
def test_articles_of_one_row_group_come_from_several_tasks(spark, articles):
    assert articles(spark, SF).select(F.spark_partition_id().alias("task")).distinct().count() > 2  # a union of two guides has two


def test_copies_of_an_alias_fold_before_keys_are_made(spark):
    """The entry of the last copy counts, also behind a copy of another name for the same alias."""
    rows = [("One", "Nick", 1), ("Two", "nick", 2), ("One", "Nick", 3), ("Gone", "Nick", 2), ("Two", "Other", 4), ("!", "Other", 5)]
    found = resolve.alias_keys(spark.createDataFrame(rows, "canonical_name string, alias string, pos int"))
    assert [tuple(r) for r in found.collect()] == [("nick", "one")]
    assert "Aggregate [alias" in found._jdf.queryExecution().optimizedPlan().toString()


def test_merge_makes_alias_keys_once(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(pipeline, "cut_lineage", lambda df, real=pipeline.cut_lineage: cuts.append(df.columns) or real(df))
    pipeline.merge(*queries_match.nine_passes_of(spark, SF))
    assert ["key", "canonical_key"] in cuts


def test_article_refs_tasks_grow_with_rows(spark):
    """A task tells a bounded number of rows apart, also of one venue and source."""
    rows = spark.range(20_000).selectExpr("id div 100000 AS venue_ord", "concat('s', id div 100000) AS source_id", "concat('a', id % 10000) AS article_id", "id AS ord")
    refs = consolidate.article_refs(rows, task_rows=500)
    sizes = [r["n"] for r in refs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 10_000 and len(sizes) == 40 and max(sizes) <= 500
    assert refs.agg(F.sum("ord")).first()[0] == sum(range(10_000))
