"""Place enrichment, carry-over between runs, cleanup and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill.functions import geo
from venuemill.functions.hours import hours_from_periods
from venuemill.functions.staging import settled
from venuemill.functions.text import blank_to_null, city_from_place_address, present, present_number

PLACE_COLUMNS = [
    "place_id", "google_rating", "google_rating_count", "maps_uri", "primary_type",
    "business_status", "hours", "website", "phone", "lat", "lng",
]


def needs_enrichment(
    venues: DataFrame, lookups: DataFrame, mode: str = "default",
    target_id: str | None = None, limit: int | None = None, order: str = "idx",
) -> DataFrame:
    """Rows to look up: by id, all, those lacking details, or the unseen ones."""
    if target_id is not None:
        todo = venues.where(F.col("id") == target_id)
    else:
        todo = with_todo(venues, lookups, mode).where("todo").drop("todo")
    return todo.orderBy(order).limit(limit) if limit else todo


def with_todo(venues: DataFrame, lookups: DataFrame, mode: str = "default") -> DataFrame:
    """The rows with ``todo``: whether ``mode`` asks to look them up."""
    has_place = present(F.col("place_id"))
    if mode == "force":
        return venues.withColumn("todo", F.lit(True))
    if mode == "backfill":
        lacking = (
            F.col("hours").isNull() | ~present(F.col("website")) | ~present(F.col("phone"))
        )
        return venues.withColumn("todo", F.coalesce(has_place & lacking, F.lit(False)))
    seen = lookups.select("id").distinct().withColumn("_seen", F.lit(True))
    return venues.join(seen, "id", "left").select(*venues.columns, (~has_place & F.col("_seen").isNull()).alias("todo"))


def enrich(venues: DataFrame, places: DataFrame, asked: Column | bool = True) -> DataFrame:
    """Apply place candidates to venues.

    ``places`` has ``venue_id``, ``attempt`` ('first' or 'retry'), ``position``
    and the place columns.  The first candidate of the first attempt counts;
    when it is no food place, a food retry candidate replaces it.  Candidates
    outside the country are rejected.  Rows that are not ``asked`` stay as they are.  Adds ``enriched``.
    """
    cols = [c for c in places.columns if c not in ("venue_id", "attempt", "position")]
    top = (
        places.groupBy("venue_id", "attempt")
        .agg(F.min_by(F.struct(*cols), "position").alias("place"))
        .groupBy("venue_id")
        .agg(
            F.any_value(F.when(F.col("attempt") == "first", F.col("place")), F.lit(True)).alias("first"),
            F.any_value(F.when(F.col("attempt") == "retry", F.col("place")), F.lit(True)).alias("retry"),
        )
    )
    use_retry = ~geo.is_food_type(F.col("first.primary_type")) & geo.is_food_type(F.col("retry.primary_type"))
    chosen = top.select(
        F.col("venue_id").alias("id"),
        F.when(F.col("first").isNotNull(), F.when(use_retry, F.col("retry")).otherwise(F.col("first"))).alias("p"),
    )
    lat = F.coalesce(F.col("p.lat"), F.lit(0.0))
    lng = F.coalesce(F.col("p.lng"), F.lit(0.0))
    address = F.coalesce(F.col("p.formatted_address"), F.lit(""))
    out = venues.join(chosen, "id", "left").withColumn(
        "enriched", F.coalesce((asked if isinstance(asked, Column) else F.lit(asked)) & F.col("p").isNotNull() & geo.in_country(lat, lng, address), F.lit(False))
    )
    hours = hours_from_periods(F.col("p.periods"))
    new = {
        "place_id": F.col("p.place_id"),
        "google_rating": F.col("p.rating"),
        "google_rating_count": F.coalesce(F.col("p.rating_count"), F.lit(0)),
        "maps_uri": F.coalesce(F.col("p.maps_uri"), F.lit("")),
        "primary_type": F.coalesce(F.col("p.primary_type"), F.lit("")),
        "business_status": F.coalesce(F.col("p.business_status"), F.lit("OPERATIONAL")),
        "hours": F.when(F.size(hours) > 0, hours).otherwise(F.col("hours")),
        "website": F.coalesce(blank_to_null(F.col("p.website")), F.col("website")),
        "phone": F.coalesce(blank_to_null(F.col("p.phone")), F.col("phone")),
        "lat": lat,
        "lng": lng,
        "city": F.when(present(F.col("city")), F.col("city")).otherwise(
            F.coalesce(blank_to_null(city_from_place_address(address)), F.col("city"))
        ),
    }
    keep = [c for c in venues.columns if c not in new] + ["enriched"]
    return settled(out, keep, {c: F.when(F.col("enriched"), v).otherwise(F.col(c)) for c, v in new.items()})


def carry_over(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Keep the place columns of venues that were enriched before, by id.

    The city is taken only when missing; a quote keeps the excerpt its source
    had.  Adds ``carried``."""
    keep = previous.where(present(F.col("place_id"))).select(
        "id", F.struct(*PLACE_COLUMNS, "city", "quotes").alias("_old")
    )
    found = F.col("_old").isNotNull()
    out = fresh.join(keep, "id", "left").withColumn("carried", found)
    updates = {c: F.when(found, F.col(f"_old.{c}")).otherwise(F.col(c)) for c in PLACE_COLUMNS}
    updates["city"] = F.when(found & ~present(F.col("city")) & present(F.col("_old.city")), F.col("_old.city")).otherwise(F.col("city"))
    updates["quotes"] = F.when(found & F.col("_old.quotes").isNotNull(), _with_excerpts(F.col("quotes"), F.col("_old.quotes"))).otherwise(F.col("quotes"))
    return out.withColumns(updates).drop("_old")


def _with_excerpts(quotes: Column, old: Column) -> Column:
    """Both lists have at most one quote per source, so they stay short."""

    def one(q: Column) -> Column:
        same = F.filter(old, lambda o: (o["source_id"] == q["source_id"]) & present(o["excerpt"]))
        return q.withField("excerpt", F.coalesce(F.try_element_at(same, F.lit(1))["excerpt"], q["excerpt"]))

    return F.transform(quotes, one)


def reject_reason(keep_unplaced: bool = False) -> Column:
    """Why cleanup drops a row; NULL keeps it.  Checks apply in this order."""
    unplaced = ~present(F.col("place_id"))
    located = present_number(F.col("lat")) & present_number(F.col("lng"))
    abroad = located & ~geo.in_country(F.col("lat"), F.col("lng"), F.coalesce("city", F.lit("")))
    closed = F.col("business_status").isin("CLOSED_PERMANENTLY", "CLOSED_TEMPORARILY")
    none = F.lit(None).cast("string")
    return (
        F.when(unplaced, none if keep_unplaced else F.lit("no place data"))
        .when(abroad, F.concat(F.lit("not in country ("), F.when(present(F.col("city")), F.col("city")).otherwise(F.lit("unknown")), F.lit(")")))
        .when(closed, F.replace(F.lower("business_status"), F.lit("_"), F.lit(" ")))
    )


def cleanup(venues: DataFrame, keep_unplaced: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected names with reasons)."""
    judged = venues.withColumn("reason", reject_reason(keep_unplaced))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("name", "reason")


def classify(venues: DataFrame) -> DataFrame:
    return venues.withColumns({
        "metro_region": geo.metro_region(F.col("lat"), F.col("lng")),
        "category": geo.venue_category(F.col("venue_type"), F.col("primary_type")),
    })
