"""Facet filters, search, sorting and facets on four rows."""

import pytest
from pyspark.sql import functions as F

from venuemill import schemas
from venuemill.functions.display import best_numeric_rating
from venuemill.operators import serve
from venuemill.operators.serve import FilterState, Range

ROWS = [
    ("sushi-place", "Sushi Palace", "Kungsgatan 10", "Norrmalm", "Japanskt, Sushi", "mellan", (4.2, 4.5, "1_star", None, 5.0, 4.0, 20.0, None, None), 85),
    ("pizza-place", "Pizza Hörnan", "Hornsgatan 50", "Södermalm", "Italienskt, Pizza", "mellan", (3.5, 4.0, None, "recommended", None, None, 15.0, None, None), 60),
    ("fine-dining", "Gastrologik", "Artillerigatan 14", "Östermalm", "Nordiskt, Fine dining", "lyx", (None, 4.8, "2_star", "master_class", 6.0, 5.0, 24.0, None, None), 95),
    ("no-ratings", "Nystartad Krog", "Sveavägen 100", "Vasastan", "Svenskt", "budget", (None,) * 9, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    full = [(i, n, a, None, r, p, c, [([1, 2], "11:00", "14:00")], 59.0, 18.0, ratings, None, None, s) for i, n, a, r, c, p, ratings, s in ROWS]
    return spark.createDataFrame(full, schemas.SERVING)


R = lambda name, lo, hi: FilterState(ranges={name: Range(lo, hi)})
COUNTS = [
    (FilterState(), 4), (R("composite_score", 70, 100), 2), (R("composite_score", 0, 70), 1), (R("composite_score", 60, 90), 2),
    (R("composite_score", 0, 100), 4), (R("krogguiden", 4, 5), 1), (R("google", 4.5, 5), 2), (R("svd", 5, 6), 2), (R("di", 18, 22), 1), (R("dn", 4, 5), 2),
    (FilterState(michelin=["1_star", "2_star"]), 2), (FilterState(michelin=["3_star"]), 0), (FilterState(whiteguide=["recommended", "master_class"]), 2),
    (FilterState(prices=["budget", "mellan"]), 3), (FilterState(search="pizza", prices=["mellan"]), 1), (FilterState(search="pizza", prices=["lyx"]), 0),
    (FilterState(search="  KUNGS "), 1), (FilterState(search="söder"), 1), (FilterState(search="sushi"), 1), (FilterState(cuisines=["Sushi", "Pizza"]), 2), (FilterState(cuisines=["Thai"]), 0),
    (FilterState(meals=["lunch"]), 4), (FilterState(meals=["lunch", "dinner"]), 0), (FilterState(availability=["openNow"]), 4), (FilterState(availability=["opensToday", "openNow"]), 4),
]


@pytest.mark.parametrize("state,count", COUNTS)
def test_counts(rows, state, count):
    clock = F.lit("2024-01-08 12:00:00").cast("timestamp")
    assert serve.apply_filters(rows, state, clock).count() == count


def test_absent_text_is_empty(spark, rows):
    hidden = rows.withColumn("region", F.lit(None).cast("string"))
    assert serve.apply_filters(hidden, FilterState(search="undefined")).count() == 0
    assert serve.apply_filters(hidden, FilterState(search="null")).count() == 0


def test_plain_filters_reach_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    plan = serve.apply_filters(stored, FilterState(prices=["lyx"], ranges={"di": Range(5, 25)}))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "price_range" in plan.split("PushedFilters: [")[1].split("]")[0] and "ratings.di" in plan


def test_best_rating(spark):
    df = spark.createDataFrame([(4.5, 3.0), (None, 3.0), (4.5, None), (None, None), (0.0, 3.0)], "g double, k double")
    assert [r.x for r in df.select(best_numeric_rating(F.col("g"), F.col("k")).alias("x")).collect()] == [4.5, 3.0, 4.5, None, 0.0]


def test_sorts_and_ids(spark):
    df = spark.createDataFrame(
        [(1, "z", "Zeta", 2, "restaurant", 59.0, 18.0), (2, "å", "Ål", None, "bar", None, None), (3, "a", "Alfa", 1, "hotel", 57.0, 12.0), (4, "z", "Ära", 3, "bar", 55.0, 13.0)],
        "idx int, id string, name string, rank int, category string, lat double, lng double")
    ids = lambda d: [r.idx for r in d.collect()]
    assert ids(serve.sort_by_name(df)) == [3, 1, 2, 4]
    assert ids(serve.sort_by_rank(df)) == [3, 1, 4, 2]
    assert ids(serve.sort_by_distance(df, 59.33, 18.07)) == [1, 3, 4, 2]
    assert ids(serve.by_id(df, "z", "bar")) == [4] and ids(serve.by_id(df, "z", "hotel")) == [1] and ids(serve.by_id(df, "q")) == []
    split = serve.split_categories(df.withColumn("rank", F.coalesce("rank", F.lit(0))))
    assert ids(split["bar"]) == [2, 4] and ids(split["excluded"]) == []
