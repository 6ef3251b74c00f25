"""Serving rows and the interactive queries over them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.functions import geo, hours
from venuemill.functions.text import blank_to_null, lookup, present, present_number, round_half_up, split_list, strip
from venuemill.operators.ranking import row_number_in_groups

NUMERIC_SERVED = ["krogguiden", "svd", "dn", "di", "falstaff", "thatsup"]


# --- building the serving table -------------------------------------------


def has_ratings() -> Column:
    """Counts toward serving; two sources alone do not."""
    r = F.col("ratings")
    numeric = [r[k]["score"].isNotNull() for k in ("svd", "dn", "di", "krogguiden")]
    return (
        r["michelin"].isNotNull() | present(r["whiteguide"]["classification"])
        | reduce(lambda a, b: a | b, numeric) | F.col("google_rating").isNotNull()
    )


def link_map(sources: Column, maps_uri: Column) -> Column:
    """First url per source key; the maps link goes last and overrides."""
    entries = F.transform(
        F.filter(sources, lambda s: present(s["url"])),
        lambda s: F.struct(
            F.regexp_replace(F.regexp_replace(s["source_id"], "-review", ""), "-news", "").alias("key"),
            s["url"].alias("value"),
        ),
    )
    own = F.when(present(maps_uri), F.array(F.struct(F.lit("google").alias("key"), maps_uri.alias("value")))).otherwise(
        F.array().cast("array<struct<key:string,value:string>>")
    )
    ordered = F.concat(own, entries)
    keys = F.array_distinct(F.transform(ordered, lambda e: e["key"]))
    return F.map_from_entries(
        F.transform(keys, lambda k: F.element_at(F.filter(ordered, lambda e: e["key"] == k), 1))
    )


def classification_key(label: Column) -> Column:
    return F.when(present(label), F.coalesce(lookup(V.CLASSIFICATION_KEYS, F.upper(label)), label))


def cuisine_label(place_type: Column) -> Column:
    return lookup(V.CUISINE_LABELS, place_type)


def serving_rows(scored: DataFrame) -> DataFrame:
    """Flat rows with only what a client needs; empty optionals are NULL."""
    r = F.col("ratings")
    ratings = F.struct(
        r["krogguiden"]["score"].alias("krogguiden"),
        F.col("google_rating").alias("google"),
        r["michelin"]["distinction"].alias("michelin"),
        classification_key(r["whiteguide"]["classification"]).alias("whiteguide"),
        *[r[k]["score"].alias(k) for k in NUMERIC_SERVED[1:]],
    )
    count = F.col("google_rating_count")
    reviews = r["thatsup"]["review_count"]
    return scored.where(has_ratings()).select(
        "id", "name", "address", "city", "lat", "lng",
        ratings.alias("ratings"),
        link_map(F.col("sources"), F.col("maps_uri")).alias("links"),
        "composite_score",
        round_half_up(F.col("composite_score_raw"), 1).alias("composite_score_raw"),
        F.col("rank_national").alias("rank"), "rank_region",
        F.coalesce("metro_region", F.lit(V.DEFAULT_METRO)).alias("metro_region"),
        F.coalesce("category", F.lit("restaurant")).alias("category"),
        blank_to_null(F.col("price_range")).alias("price_range"),
        cuisine_label(F.col("primary_type")).alias("cuisine"),
        F.when(F.size("hours") > 0, F.col("hours")).alias("hours"),
        blank_to_null(F.col("website")).alias("website"),
        blank_to_null(F.col("phone")).alias("phone"),
        F.when(present_number(count), count).alias("google_rating_count"),
        F.when(present_number(reviews), reviews).alias("thatsup_review_count"),
        "idx",
    )


def split_categories(serving: DataFrame) -> dict[str, DataFrame]:
    """The four public tables and the excluded rest, each sorted by rank.

    Unranked rows (rank 0) come first, as their rank is the smallest."""
    out = {c: serving.where(F.col("category") == c).orderBy("rank", "idx") for c in V.RANKED_CATEGORIES}
    out["excluded"] = serving.where(~F.col("category").isin(V.RANKED_CATEGORIES))
    return out


def located(serving: DataFrame) -> DataFrame:
    return serving.where("lat <> 0 and lng <> 0")


# --- facet filters ---------------------------------------------------------


@dataclass(frozen=True)
class Range:
    low: float
    high: float


RANGE_DEFAULTS = {
    "composite_score": Range(0, 100),
    "krogguiden": Range(0, 5),
    "google": Range(0, 5),
    "svd": Range(0, 6),
    "di": Range(0, 25),
    "falstaff": Range(0, 100),
    "thatsup": Range(0, 5),
    "dn": Range(0, 5),
}


@dataclass(frozen=True)
class FilterState:
    search: str = ""
    cuisines: Iterable[str] = ()
    prices: Iterable[str] = ()
    ranges: dict[str, Range] = field(default_factory=dict)
    michelin: Iterable[str] = ()
    whiteguide: Iterable[str] = ()
    meals: Iterable[str] = ()
    availability: Iterable[str] = ()


SERVING_COLUMNS = {
    "composite_score": "composite_score",
    **{k: f"ratings.{k}" for k in ("krogguiden", "google", "svd", "di", "falstaff", "thatsup", "dn")},
    "michelin": "ratings.michelin",
    "whiteguide": "ratings.whiteguide",
    "cuisine": "cuisine",
    "price": "price_range",
}


def is_range_active(name: str, chosen: Range) -> bool:
    default = RANGE_DEFAULTS[name]
    return chosen.low > default.low or chosen.high < default.high


def text_contains(query: str, *columns: str) -> Column:
    """Whole texts joined by spaces; a missing text counts as empty."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    return F.contains(joined, F.lit(query.lower().strip()))


def predicates(
    state: FilterState, clock: Column | None = None,
    columns: dict[str, str] = SERVING_COLUMNS,
    text_columns: tuple[str, ...] = ("name", "address", "region", "cuisine"),
) -> list[Column]:
    """One predicate per active filter; defaults add none, so the plain ones
    reach the scan."""
    out: list[Column] = []
    if state.search.strip():
        out.append(text_contains(state.search, *text_columns))
    if set(state.cuisines):
        items = split_list(F.col(columns["cuisine"]))
        out.append(F.arrays_overlap(items, F.array(*[F.lit(c) for c in sorted(set(state.cuisines))])))
    if set(state.prices):
        out.append(F.col(columns["price"]).isin(sorted(set(state.prices))))
    for name, chosen in state.ranges.items():
        if is_range_active(name, chosen):
            out.append(F.col(columns[name]).between(chosen.low, chosen.high))
    for name, chosen in (("michelin", state.michelin), ("whiteguide", state.whiteguide)):
        if set(chosen):
            out.append(F.col(columns[name]).isin(sorted(set(chosen))))
    for meal in sorted(set(state.meals)):
        out.append(hours.serves_meal(F.col("hours"), meal))
    if "openNow" in set(state.availability):
        out.append(F.coalesce(hours.is_open(F.col("hours"), clock), F.lit(False)))
    if "opensToday" in set(state.availability):
        out.append(hours.opens_today(F.col("hours"), clock))
    return out


def apply_filters(serving: DataFrame, state: FilterState, clock: Column | None = None, **kwargs) -> DataFrame:
    found = predicates(state, clock, **kwargs)
    return serving.where(reduce(lambda a, b: a & b, found)) if found else serving


def in_region(serving: DataFrame, region: str) -> DataFrame:
    return serving if region == "all" else serving.where(F.col("metro_region") == region)


def search(serving: DataFrame, query: str) -> DataFrame:
    """Search box: name, cuisine and address, best rank first."""
    hits = serving.where(text_contains(query, "name", "cuisine", "address")) if query.strip() else serving
    return hits.orderBy(F.asc_nulls_last("rank"), "idx")


def by_id(serving: DataFrame, venue_id: str, current: str = "restaurant") -> DataFrame:
    """Row with this id: the current category first, then the fixed order."""
    order = [current] + [c for c in V.RANKED_CATEGORIES if c != current]
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category"))
    return serving.where((F.col("id") == venue_id) & (place > 0)).orderBy(place).limit(1)


def detail(serving: DataFrame, venue_id: str, category: str) -> DataFrame:
    return serving.where((F.col("category") == category) & (F.col("id") == venue_id))


# --- sorting ---------------------------------------------------------------


def sort_by_name(serving: DataFrame, collation: str = "sv") -> DataFrame:
    return serving.orderBy(F.collate(F.col("name"), collation), "idx")


def name_positions(serving: DataFrame, collation: str = "sv") -> DataFrame:
    """Every row with its place in the name order, counted over the whole cluster."""
    keyed = serving.withColumn("_name", F.collate(F.col("name"), collation))
    return row_number_in_groups(keyed, [], [F.asc("_name"), F.asc("idx")], "position").drop("_name")


def sort_by_rank(serving: DataFrame) -> DataFrame:
    return serving.orderBy(F.asc_nulls_last("rank"), "idx")


def with_distance(serving: DataFrame, lat: float, lng: float) -> DataFrame:
    known = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return serving.withColumn(
        "distance", F.when(known, geo.haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")))
    )


def sort_by_distance(serving: DataFrame, lat: float, lng: float) -> DataFrame:
    return with_distance(serving, lat, lng).orderBy(F.asc_nulls_last("distance"), "idx")


# --- facets ----------------------------------------------------------------


def cuisine_facets(serving: DataFrame, column: str = "cuisine", generic: list[str] = V.GENERIC_CUISINES, at_least: int = 3) -> DataFrame:
    """Cuisines by frequency, without the generic ones and the rare ones."""
    return (
        serving.select(F.explode(split_list(F.col(column))).alias("cuisine"))
        .where(~F.col("cuisine").isin(generic))
        .groupBy("cuisine").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= at_least)
        .orderBy(F.desc("n"), "cuisine")
    )


def region_facets(serving: DataFrame, region: str = "metro_region") -> DataFrame:
    """Rows per region with the grand total as ``all``."""
    return serving.withColumn("region", F.col(region)).rollup("region").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("region").alias("_total")
    ).select(F.when(F.col("_total") == 1, F.lit("all")).otherwise(F.col("region")).alias("region"), "n")


def sitemap_rows(serving: DataFrame, base_url: str, day: str) -> DataFrame:
    """Fixed pages and one row per venue; high ranks get more priority.

    Rank 0 is at most any top-n, so unranked venues count as high."""
    spark = serving.sparkSession
    fixed = spark.createDataFrame(
        [(base_url, "1.0", "weekly")] + [(f"{base_url}/{p}", "0.8", "weekly") for p in ("b", "f", "h")],
        "loc string, priority string, changefreq string",
    )
    public = serving.where(F.col("category").isin(V.RANKED_CATEGORIES))
    prefix = lookup(V.CATEGORY_PREFIX, F.col("category"))
    top = lookup(V.SITEMAP_TOP_N, F.col("category"))
    pages = public.select(
        F.concat_ws("/", F.lit(base_url), prefix, "id").alias("loc"),
        F.when(F.col("rank") <= top, F.lit("0.8")).otherwise(F.lit("0.6")).alias("priority"),
        F.lit("monthly").alias("changefreq"),
    )
    return fixed.unionByName(pages).withColumn("lastmod", F.lit(day))


def sitemap_xml(rows: DataFrame) -> DataFrame:
    """One ``value`` line per url entry, for the text sink."""
    return rows.select(F.format_string(
        "<url><loc>%s</loc><lastmod>%s</lastmod><changefreq>%s</changefreq><priority>%s</priority></url>",
        "loc", "lastmod", "changefreq", "priority",
    ).alias("value"))
