"""Opening hours.

Hours are ``array<struct<days:array<int>, open:string, close:string>>`` with
Sunday as day 0.  A week has few entries, so higher-order functions work
inside the row and nothing shuffles.  The clock is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.functions.text import let


def to_minutes(hhmm: Column) -> Column:
    parts = F.split(hhmm, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def day_of_week(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def has_hours(hours: Column) -> Column:
    return F.coalesce(F.size(hours) > 0, F.lit(False))


def _overnight(e: Column) -> Column:
    return to_minutes(e["close"]) <= to_minutes(e["open"])


def serves_meal(hours: Column, meal: str) -> Column:
    def breakfast(e: Column) -> Column:
        return to_minutes(e["open"]) <= V.BREAKFAST_END

    def lunch(e: Column) -> Column:
        starts_before = to_minutes(e["open"]) < V.LUNCH_END
        ends_after = to_minutes(e["close"]) > V.LUNCH_START
        return F.when(_overnight(e), starts_before | ends_after).otherwise(starts_before & ends_after)

    def dinner(e: Column) -> Column:
        return _overnight(e) | (to_minutes(e["close"]) > V.DINNER_START)

    rule = {"breakfast": breakfast, "lunch": lunch, "dinner": dinner}[meal]
    return F.coalesce(F.exists(hours, rule), F.lit(False))


def opens_on_day(hours: Column, day: Column) -> Column:
    return F.coalesce(F.exists(hours, lambda e: F.array_contains(e["days"], day)), F.lit(False))


def opens_today(hours: Column, clock: Column) -> Column:
    return opens_on_day(hours, day_of_week(clock))


def is_open(hours: Column, clock: Column) -> Column:
    """NULL without hours.  An overnight entry also covers the early hours of
    its own day and of the day after."""
    today = day_of_week(clock)
    yesterday = (today + 6) % 7
    now = minute_of_day(clock)

    def covers(e: Column) -> Column:
        opened = now >= to_minutes(e["open"])
        not_closed = now < to_minutes(e["close"])
        same_day = F.array_contains(e["days"], today) & F.when(
            _overnight(e), opened | not_closed
        ).otherwise(opened & not_closed)
        carried = F.array_contains(e["days"], yesterday) & _overnight(e) & not_closed
        return same_day | carried

    return F.when(has_hours(hours), F.exists(hours, covers))


def next_open(hours: Column, clock: Column) -> Column:
    """``struct(day, time)`` of the next opening in the next seven days.

    The nearest day wins, then the first listed entry of that day; today
    counts only for a later opening time."""
    today = day_of_week(clock)
    now = minute_of_day(clock)

    def on_offset(offset: Column) -> Column:
        day = (today + offset) % 7
        usable = F.filter(
            hours,
            lambda e: F.array_contains(e["days"], day)
            & ((offset > 0) | (to_minutes(e["open"]) > now)),
        )
        return F.transform(usable, lambda e: F.struct(day.alias("day"), e["open"].alias("time")))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(6)), on_offset))
    return F.when(has_hours(hours), F.try_element_at(found, F.lit(1)))


def week_schedule(hours: Column, clock: Column, day_names: list[str], closed_label: str) -> Column:
    """Seven ``struct(day, day_name, hours)`` from today on; empty without hours."""
    today = day_of_week(clock)
    names = F.array(*[F.lit(n) for n in day_names])

    def one_day(offset: Column) -> Column:
        day = (today + offset) % 7
        times = F.flatten(
            F.transform(
                hours,
                lambda e: F.transform(
                    F.filter(e["days"], lambda d: d == day),
                    lambda _: F.concat(e["open"], F.lit("–"), e["close"]),
                ),
            )
        )
        return F.struct(
            day.alias("day"),
            F.element_at(names, day + 1).alias("day_name"),
            F.when(F.size(times) > 0, F.array_join(times, ", "))
            .otherwise(F.lit(closed_label))
            .alias("hours"),
        )

    week = F.transform(F.sequence(F.lit(0), F.lit(6)), one_day)
    return F.when(has_hours(hours), week).otherwise(F.filter(week, lambda _: F.lit(False)))


def hours_from_periods(periods: Column) -> Column:
    """Opening periods to compact entries: one per (open, close) pair in
    first-seen order, with sorted days."""

    def clock_text(moment: Column) -> Column:
        return F.format_string(
            "%02d:%02d", moment["hour"], F.coalesce(moment["minute"], F.lit(0))
        )

    def entry(p: Column) -> Column:
        opened = clock_text(p["open"])
        closed = F.when(p["close"]["hour"].isNull(), F.lit("23:59")).otherwise(clock_text(p["close"]))
        closed = F.when((opened == "00:00") & (closed == "00:00"), F.lit("23:59")).otherwise(closed)
        return F.struct(p["open"]["day"].alias("day"), opened.alias("open"), closed.alias("close"))

    usable = F.filter(periods, lambda p: p["open"]["day"].isNotNull() & p["open"]["hour"].isNotNull())

    def compact(entries: Column) -> Column:
        pairs = F.array_distinct(
            F.transform(entries, lambda e: F.struct(e["open"].alias("open"), e["close"].alias("close")))
        )

        def with_days(pair: Column) -> Column:
            same = F.filter(
                entries, lambda e: (e["open"] == pair["open"]) & (e["close"] == pair["close"])
            )
            return F.struct(
                F.array_sort(F.transform(same, lambda e: e["day"])).alias("days"),
                pair["open"].alias("open"),
                pair["close"].alias("close"),
            )

        return F.transform(pairs, with_days)

    return F.coalesce(let(F.transform(usable, entry), compact), F.array().cast("array<struct<days:array<int>,open:string,close:string>>"))
