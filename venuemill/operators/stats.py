"""Counts and summaries that each phase reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.functions.text import present, present_number


def counts_by(df: DataFrame, key: Column, name: str, top: int | None = None) -> DataFrame:
    """Groups by size; a limit keeps the ``top`` largest (ties by key)."""
    out = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)
    return out.limit(top) if top else out


def counts_of(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(what, name, n)``: rows by each of several columns, in one pass and one shuffle."""
    cells = F.array(*[F.struct(F.lit(what).alias("what"), c.cast("string").alias("name")) for what, c in columns.items()])
    return df.select(F.inline(cells)).groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"))


def or_none(c: Column, label: str = "(none)") -> Column:
    return F.when(present(c), c).otherwise(F.lit(label))


def merge_stats(venues: DataFrame) -> DataFrame:
    """One row: venues, located venues and rated venues per source."""
    located = present_number(F.col("lat")) & present_number(F.col("lng"))
    keys = ["michelin", "whiteguide", "svd", "dn", "di", "krogguiden", "falstaff", "thatsup"]
    return venues.agg(
        F.count(F.lit(1)).alias("venues"),
        F.count_if(located).alias("with_coordinates"),
        *[F.count_if(F.col(f"ratings.{k}").isNotNull()).alias(f"rated_{k}") for k in keys],
    )


def score_summary(scored: DataFrame) -> DataFrame:
    s = F.col("composite_score")
    return scored.agg(
        F.count(F.lit(1)).alias("venues"),
        F.count_if(s > 0).alias("scored"),
        F.avg(F.when(s > 0, s)).alias("mean_score"),
        F.count_if(s == 100).alias("perfect"),
    )


def score_histogram(scored: DataFrame) -> DataFrame:
    """Ten half-open buckets; a full score is counted apart (bucket 100)."""
    s = F.col("composite_score")
    return scored.groupBy((F.floor(s / 10) * 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def region_leaderboard(scored: DataFrame, region: str = "metro_region", idx: str = "idx") -> DataFrame:
    """Rows, mean of the scored rows and the best name per region.

    Regions without a scored venue are left out.  The best row is a ``min``
    over a struct, which combines on the map side."""
    s = F.col("composite_score")
    best = F.min(F.struct((-F.col("composite_score_raw")).alias("less"), F.col(idx).alias("idx"), F.col("name").alias("name")))
    return (
        scored.groupBy(F.coalesce(F.col(region), F.lit(V.DEFAULT_METRO)).alias("region"))
        .agg(F.count(F.lit(1)).alias("venues"), F.count_if(s > 0).alias("scored"),
             F.avg(F.when(s > 0, s)).alias("mean_score"), best.alias("best"))
        .where("scored > 0")
        .select("region", "venues", "mean_score", F.col("best.name").alias("best_name"))
    )


def top_scored(scored: DataFrame, k: int = 20, idx: str = "idx") -> DataFrame:
    return scored.where("composite_score > 0").orderBy(F.desc("composite_score_raw"), idx).limit(k)


def cuisine_breakdown(serving: DataFrame, top: int = 15, other: str = "Övrigt") -> DataFrame:
    """By a row's first cuisine."""
    return counts_by(serving, or_none(F.element_at(F.split("cuisine", ", "), 1), other), "cuisine", top)


def collector_stats(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if(F.col("score") > 0).alias("with_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def collector_report(articles: DataFrame) -> DataFrame:
    """Articles by city, price, type and distinction (the first tag)."""
    return counts_of(articles, {
        "city": or_none(F.col("venue_city")), "price": or_none(F.col("price_range")), "type": or_none(F.col("venue_type")),
        "distinction": or_none(F.try_element_at("tags", F.lit(1))),
    })


def lookup_cost(todo: DataFrame, retry_factor: float = 1.3, per_call: float = 0.032) -> DataFrame:
    calls = F.ceil(F.count(F.lit(1)) * F.lit(retry_factor))
    return todo.agg(calls.alias("calls"), F.round(calls * F.lit(per_call), 2).alias("cost"))


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many rows a re-normalisation changed."""
    pair = before.select(key, F.struct(*columns).alias("b")).join(after.select(key, F.struct(*columns).alias("a")), key)
    return pair.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
