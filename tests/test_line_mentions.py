"""What the merge's own queries read and carry, by their plans."""

import re

import pytest
from pyspark.sql import functions as F

from venuemill import session
from venuemill.functions import text
from venuemill.operators import consolidate, dedup, enrich
from venuemill.plans import pipeline, queries_loop, queries_match

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_made_after_the_founders_are_joined(spark):
    lines = plan(queries_match._line_mentions(spark, DATA)).split("\n")
    assert "repeat(" in lines[0] and not any("repeat(" in line for line in lines[1:])


def test_second_refine_reads_the_merged_venues_once(spark):
    assert "l_shipdate" not in plan(queries_loop.refine_again(spark, DATA))


def test_lines_are_folded_where_they_lie(spark):
    """Lines are dealt by part, to tasks whose number grows with them, and neither founders nor venues send them again."""
    mentions = queries_match._line_mentions(spark, DATA)
    venues = consolidate.consolidate(mentions, ("l_partkey",))
    sent = re.findall(r"hashpartitioning\((\w+?)#.*?, (\w+)", venues._jdf.queryExecution().sparkPlan().toString() + venues._jdf.queryExecution().executedPlan().toString())
    assert {by for by, _ in sent} <= {"l_partkey", "p_partkey"} and any("REPARTITION_BY_NUM" in line for line in physical(venues))
    apart = {tuple(r["venue_ord"]): r for r in consolidate.consolidate(mentions).collect()}
    assert {tuple(r["venue_ord"]): r for r in venues.collect()} == apart and len(apart) > 100


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_task_of_a_large_table_has_a_bounded_number_of_rows(spark):
    dealt = session.dealt(spark.range(20_000), "id", task_rows=500)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 40 and max(sizes) < 700


def test_second_refine_stores_its_wide_rows_once(spark, monkeypatch):
    wide = []
    for module in (pipeline, dedup):
        monkeypatch.setattr(module, "cut_lineage", lambda df, real=module.cut_lineage: wide.append("quotes" in df.columns) or real(df))
    monkeypatch.setattr(pipeline, "stored", lambda df, name, real=pipeline.stored: wide.append("quotes" in df.columns) or real(df, name))
    queries_loop.refine_again(spark, DATA)
    assert sum(wide) == 2  # one of each run


def test_rows_that_are_not_asked_for_keep_their_place(spark):
    venues = pipeline.with_place_columns(spark.createDataFrame([(n, "", 0.0, 0.0) for n in "abc"], "id string, city string, lat double, lng double"))
    places = queries_loop._places(venues, "new", 4.0)
    looked_up = enrich.with_todo(venues, spark.createDataFrame([("b",), ("b",)], "id string"))
    got = enrich.enrich(looked_up, places, F.col("todo")).select("id", "todo", "place_id").collect()
    assert {tuple(r) for r in got} == {("a", True, "new-a"), ("b", False, None), ("c", True, "new-c")} and len(got) == 3


@pytest.mark.parametrize("few", [0, 100_000])
def test_shared_places_fold_alike_by_either_way(spark, monkeypatch, few):
    monkeypatch.setattr(dedup, "FEW_SHARED", few)
    placed = queries_match._placed(spark, DATA).withColumn("place_id", F.when(F.col("idx") % 3 > 0, F.col("place_id")).when(F.col("idx") % 2 == 0, F.lit("")))
    kept = {r["idx"]: (r["place_id"], r["source_count"]) for r in dedup.dedup_by_place(placed).collect()}
    rows = [tuple(r) for r in placed.select("idx", "place_id", "source_count").collect()]
    best = {}
    for idx, place, count in sorted(rows, key=lambda r: (-r[2], r[0])):
        best.setdefault(place or idx, idx)
    assert set(kept) == set(best.values()) and len(kept) < len(rows)
    assert dedup.known_merges(placed).count() == len(rows) - len(kept)


def test_ends_of_plain_texts_are_stripped_alike(spark):
    edges = ["", " ", "\u00a0", "\x85", " \x85", "\n", "\r\n", "\u2028", "\ufeff\t", "x", "\x1c"]
    texts = [(a + body + b,) for a in edges for b in edges for body in ("", "a b", "\x85 a")] + [(None,)]
    out = spark.createDataFrame(texts, "t string").select(text.strip("t").alias("a"), text.strip_plain(F.col("t")).alias("b")).collect()
    assert [r.a for r in out] == [r.b for r in out]
