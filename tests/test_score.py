"""Both scoring policies against hand-checked values."""

import pytest
from pyspark.sql import functions as F

from venuemill import schemas
from venuemill.functions import score as S

FLAT = f"i int, ratings {schemas.FLAT_RATINGS.simpleString()}, google_rating_count int, links map<string,string>"
KEYS = schemas.FLAT_RATINGS.fieldNames()


def flat(spark, cases):
    rows = []
    for i, (ratings, count, link) in enumerate(cases):
        rows.append((i, tuple(ratings.get(k) for k in KEYS), count, {"krogguiden": "https://x"} if link else None))
    df = S.composite_score(spark.createDataFrame(rows, FLAT), S.LEGACY_POLICY, S.inputs_from_flat())
    return {r.i: r for r in df.collect()}


LEGACY = [
    ({}, None, False, None),
    ({"krogguiden": 1.0}, None, False, 18), ({"krogguiden": 5.0}, None, False, 80), ({"krogguiden": 4.0}, None, False, 70),
    ({"google": 5.0}, 200, False, 80), ({"svd": 6.0}, None, False, 80), ({"svd": 3.0}, None, False, 44),
    ({"di": 25.0}, None, False, 80), ({"di": 20.0}, None, False, 70), ({"di": 15.0}, None, False, 53),
    ({"dn": 5.0}, None, False, 80), ({"dn": 3.0}, None, False, 53), ({"michelin": "selected"}, None, False, 66),
    ({"michelin": "3_star", "whiteguide": "global_master_class", "krogguiden": 5.0}, None, False, 100),
    ({"krogguiden": 0.0}, None, False, None),
]


def test_legacy_values(spark):
    got = flat(spark, [c[:3] for c in LEGACY])
    assert [got[i].composite_score for i in range(len(LEGACY))] == [c[3] for c in LEGACY]


def test_legacy_relations(spark):
    got = flat(spark, [
        ({"google": 4.5}, 100, False), ({"google": 4.5}, 200, False), ({"google": 4.5}, 5, False),
        ({"google": 4.8}, 200, True), ({"google": 4.8}, 200, False),
    ])
    assert got[0].composite_score == got[1].composite_score > got[2].composite_score
    assert got[3].composite_score <= 70 < got[4].composite_score


NESTED = f"i int, ratings {schemas.RATINGS.simpleString()}, google_rating double, google_rating_count int"


def nested(spark, cases, as_of="2025-01-01 00:00:00"):
    rows = []
    for i, c in enumerate(cases):
        numeric = lambda k: None if k not in c else (c[k][0], None, None, None, c[k][1], None) if isinstance(c[k], tuple) else (c[k], None, None, None, None, None)
        ratings = (
            (c["michelin"], 0.0) if "michelin" in c else None,
            (c["whiteguide"], None, None) if "whiteguide" in c else None,
            *[numeric(k) for k in ("svd", "dn", "di", "krogguiden", "falstaff", "thatsup")],
        )
        rows.append((i, ratings, c.get("google"), c.get("count")))
    df = S.composite_score(spark.createDataFrame(rows, NESTED), S.PIPELINE_POLICY, S.inputs_from_nested(), F.lit(as_of).cast("timestamp"))
    return [r for r in df.orderBy("i").collect()]


PIPELINE = [
    ({}, 0, 0.0), ({"krogguiden": 5.0}, 75, 75.0), ({"google": 5.0, "count": 50}, 64, 63.75), ({"google": 5.0, "count": 0}, 0, 0.0),
    ({"michelin": "1_star"}, 90, 90.0), ({"michelin": "1_key"}, 90, 90.0), ({"falstaff": 100.0}, 95, 95.0), ({"michelin": "3_star", "krogguiden": 5.0}, 100, 100.0),
    ({"svd": (6.0, "2020-01-01"), "dn": 5.0}, 75, 75.0), ({"whiteguide": "God klass"}, 80, 80.0), ({"whiteguide": "Not So White Guide"}, 0, 0.0),
    # a guide that does not map still lifts the ceiling
    ({"whiteguide": "Not So White Guide", "krogguiden": 5.0}, 95, 95.0),
]


def test_pipeline_values(spark):
    got = nested(spark, [c[0] for c in PIPELINE])
    assert [r.composite_score for r in got] == [c[1] for c in PIPELINE]
    assert [r.composite_score_raw for r in got] == pytest.approx([c[2] for c in PIPELINE])


def test_hundred_needs_all_high(spark):
    # rounds to 100 but one source is below the threshold
    got = nested(spark, [{"michelin": "3_star", "google": 4.74, "count": 100}])[0]
    assert got.composite_score == 99 and got.composite_score_raw > 98.5


def test_decay(spark):
    dates = ["2024-06-01", "2022-01-02", "2021-01-01", "2019-01-01", "2001-01-01", "", "soon", None]
    df = spark.createDataFrame([(d,) for d in dates], "d string")
    got = [r.x for r in df.select(S.time_decay(F.col("d"), F.lit("2025-01-01").cast("timestamp")).alias("x")).collect()]
    assert got == pytest.approx([1, 1, 0.8498, 0.55, 0.4, 1, 1, 1], abs=1e-3)


def test_normalized_map(spark):
    row = nested(spark, [{"svd": 5.0, "google": 4.0, "count": 100}])[0]
    assert row.normalized_ratings == {"svd": 8.33, "google": 8.0}
