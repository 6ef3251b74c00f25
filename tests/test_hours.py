"""Opening-hours cases: NULL, boundary, split, overnight, midnight, weekend."""

import pytest
from pyspark.sql import functions as F

from venuemill import schemas
from venuemill.functions import hours as H

WEEKDAYS = [1, 2, 3, 4, 5]
LUNCH = [(WEEKDAYS, "11:00", "14:00")]
SPLIT = [(WEEKDAYS, "11:00", "14:00"), (WEEKDAYS, "17:00", "22:00")]
NIGHT = [([5, 6], "17:00", "02:00")]
WEEKEND = [([0, 6], "10:00", "16:00")]
MIXED = [(WEEKDAYS, "11:00", "22:00"), ([0, 6], "12:00", "20:00")]

# Sunday 2024-01-07 is day 0
CASES = [
    (None, 1, "12:00", None), ([], 1, "12:00", None),
    (LUNCH, 1, "12:00", True), (LUNCH, 2, "11:00", True), (LUNCH, 3, "14:00", False),
    (LUNCH, 4, "10:59", False), (LUNCH, 0, "12:00", False), (LUNCH, 6, "12:00", False),
    (SPLIT, 1, "12:30", True), (SPLIT, 1, "19:00", True), (SPLIT, 1, "15:00", False),
    (NIGHT, 5, "23:30", True), (NIGHT, 6, "17:00", True), (NIGHT, 0, "01:00", True),
    (NIGHT, 0, "02:30", False), (NIGHT, 5, "16:00", False), (NIGHT, 4, "01:00", False),
    (NIGHT, 5, "01:00", True),
    ([([1], "18:00", "00:00")], 1, "23:59", True), ([([6], "00:00", "06:00")], 6, "03:00", True),
    (WEEKEND, 6, "12:00", True), (WEEKEND, 0, "10:00", True), (WEEKEND, 3, "12:00", False),
    (MIXED, 3, "15:00", True), (MIXED, 6, "15:00", True), (MIXED, 0, "11:00", False),
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, h, f"2024-01-{7 + day:02d} {clock}:00", want) for i, (h, day, clock, want) in enumerate(CASES)]
    schema = f"i int, hours {schemas.HOURS.simpleString()}, clock string, want boolean"
    return spark.createDataFrame(rows, schema).withColumn("clock", F.col("clock").cast("timestamp"))


def test_is_open(frame):
    got = frame.select("i", "want", H.is_open(F.col("hours"), F.col("clock")).alias("got")).collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


def test_opens_today_is_false_without_hours(frame):
    rows = frame.where("i < 2").select(H.opens_today(F.col("hours"), F.col("clock")).alias("x")).collect()
    assert [r.x for r in rows] == [False, False]


def one(spark, hours, expr):
    df = spark.createDataFrame([(hours,)], f"hours {schemas.HOURS.simpleString()}")
    return df.select(expr.alias("x")).first().x


def test_meals(spark):
    h = F.col("hours")
    assert one(spark, [([1], "10:00", "11:00")], H.serves_meal(h, "breakfast"))
    assert not one(spark, [([1], "10:01", "11:00")], H.serves_meal(h, "breakfast"))
    assert not one(spark, [([1], "10:00", "11:00")], H.serves_meal(h, "lunch"))
    assert one(spark, [([1], "13:59", "15:00")], H.serves_meal(h, "lunch"))
    assert not one(spark, [([1], "11:00", "17:00")], H.serves_meal(h, "dinner"))
    assert one(spark, NIGHT, H.serves_meal(h, "dinner"))
    assert not one(spark, None, H.serves_meal(h, "dinner"))


def test_next_open(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    h = F.col("hours")
    assert one(spark, SPLIT, H.next_open(h, at("2024-01-08 12:00:00"))) == (1, "17:00")
    assert one(spark, SPLIT, H.next_open(h, at("2024-01-12 23:00:00"))) == (1, "11:00")
    # the first listed entry of the day, not the earliest
    late_first = [([2], "18:00", "22:00"), ([2], "09:00", "12:00")]
    assert one(spark, late_first, H.next_open(h, at("2024-01-08 12:00:00"))) == (2, "18:00")
    # the same weekday next week is out of reach
    assert one(spark, [([1], "09:00", "10:00")], H.next_open(h, at("2024-01-08 12:00:00"))) is None
    assert one(spark, [], H.next_open(h, at("2024-01-08 12:00:00"))) is None


def test_week_schedule(spark):
    week = H.week_schedule(F.col("hours"), F.lit("2024-01-12 12:00:00").cast("timestamp"), list("smtwtfs"), "closed")
    rows = one(spark, SPLIT, week)
    assert [r.day for r in rows] == [5, 6, 0, 1, 2, 3, 4]
    assert rows[0].hours == "11:00–14:00, 17:00–22:00" and rows[1].hours == "closed"
    assert one(spark, None, week) == []


def test_periods(spark):
    schema = f"p {schemas.PERIODS.simpleString()}"
    day = lambda d, o, c: ((d, o, None), c)
    periods = [
        day(3, 11, (3, 22, 0)), day(1, 11, (1, 22, 0)), day(2, 0, None), day(4, 0, (4, 0, 0)),
        ((None, 9, 0), (1, 10, 0)), day(3, 11, (3, 22, 0)),
    ]
    df = spark.createDataFrame([(periods,), (None,)], schema)
    rows = [r.h for r in df.select(H.hours_from_periods(F.col("p")).alias("h")).collect()]
    assert [(e.days, e.open, e.close) for e in rows[0]] == [([1, 3, 3], "11:00", "22:00"), ([2, 4], "00:00", "23:59")]
    assert rows[1] == []
