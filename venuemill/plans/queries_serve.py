"""Serving, facet, geo and opening-hours queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuemill.functions import display, geo, hours
from venuemill.operators import serve, stats
from venuemill.operators.serve import FilterState, Range
from venuemill.plans import proxies as P
from venuemill.plans.proxies import pick, spread_table, table
from venuemill.plans.queries_score import CATEGORY_SQL, REGION_SQL, SCORED_SQL, ranked

# --- hours of users as SQL: (user_id, pos, days, open, close) --------------

HOURS_SQL = """
u AS (SELECT DISTINCT user_id FROM events),
lunch AS (SELECT user_id, [1,2,3,4,5] AS days, (9 + user_id % 4) * 60 + 30 AS o, (13 + user_id % 3) * 60 AS c FROM u),
evening AS (SELECT user_id, [3,4,5,6] AS days, (16 + user_id % 3) * 60 + 15 AS o, (22 + user_id % 6) % 24 * 60 AS c FROM u),
weekend AS (SELECT user_id, [0,6] AS days, (8 + user_id % 5) * 60 AS o, (14 + user_id % 8) * 60 + 45 AS c FROM u),
h0 AS (
  SELECT *, CASE user_id % 5 WHEN 2 THEN 2 ELSE 1 END AS pos FROM lunch WHERE user_id % 5 IN (1, 2, 4)
  UNION ALL SELECT *, CASE user_id % 5 WHEN 2 THEN 1 ELSE 2 END FROM evening WHERE user_id % 5 IN (2, 3, 4)
  UNION ALL SELECT *, CASE user_id % 5 WHEN 3 THEN 1 ELSE 3 END FROM weekend WHERE user_id % 5 IN (3, 4)
),
h AS (SELECT *, printf('%02d:%02d', o // 60, o % 60) AS ot, printf('%02d:%02d', c // 60, c % 60) AS ct FROM h0)"""


def _event_hours(spark, d):
    return table(spark, d, "events").withColumn("hours", P.hours_of(F.col("user_id")))


def open_now(spark, d):
    """Open state, opens today and meals of the user's venue at each event."""
    e = _event_hours(spark, d)
    h, clock = F.col("hours"), F.col("ts")
    return e.select(
        "event_id", hours.is_open(h, clock).alias("is_open"), hours.opens_today(h, clock).alias("opens_today"),
        hours.serves_meal(h, "breakfast").alias("breakfast"), hours.serves_meal(h, "lunch").alias("lunch"),
        hours.serves_meal(h, "dinner").alias("dinner"))


OPEN_SQL = f"""WITH {HOURS_SQL},
e AS (SELECT event_id, user_id, dayofweek(ts) AS dow, hour(ts) * 60 + minute(ts) AS m FROM events)
SELECT event_id,
  bool_or(CASE WHEN h.user_id IS NULL THEN NULL ELSE (list_contains(days, dow) AND CASE WHEN c > o THEN m >= o AND m < c ELSE m >= o OR m < c END)
    OR (list_contains(days, (dow + 6) % 7) AND c <= o AND m < c) END) AS is_open,
  coalesce(bool_or(list_contains(days, dow)), false) AS opens_today,
  coalesce(bool_or(o <= 600), false) AS breakfast,
  coalesce(bool_or(CASE WHEN c <= o THEN o < 840 OR c > 660 ELSE o < 840 AND c > 660 END), false) AS lunch,
  coalesce(bool_or(c <= o OR c > 1020), false) AS dinner
FROM e LEFT JOIN h USING (user_id) GROUP BY event_id"""


def next_open(spark, d):
    n = hours.next_open(F.col("hours"), F.col("ts"))
    return _event_hours(spark, d).select("event_id", n["day"].alias("day"), n["time"].alias("time"))


NEXT_SQL = f"""WITH {HOURS_SQL},
e AS (SELECT event_id, user_id, dayofweek(ts) AS dow, hour(ts) * 60 + minute(ts) AS m FROM events),
w AS (SELECT event_id, off, pos, (dow + off) % 7 AS day, ot FROM e JOIN h USING (user_id), range(7) t(off)
  WHERE list_contains(days, (dow + off) % 7) AND (off > 0 OR o > m)),
b AS (SELECT event_id, first(day ORDER BY off, pos) AS day, first(ot ORDER BY off, pos) AS time FROM w GROUP BY 1)
SELECT event_id, CAST(day AS INT) AS day, time FROM events LEFT JOIN b USING (event_id)"""

DAY_NAMES = ["sön", "mån", "tis", "ons", "tor", "fre", "lör"]


def week_schedule(spark, d):
    """Seven rows per event, from its day on."""
    week = hours.week_schedule(F.col("hours"), F.col("ts"), DAY_NAMES, "Stängt")
    return _event_hours(spark, d).select("event_id", F.posexplode(week).alias("offset", "w")).select(
        "event_id", "offset", "w.day", "w.day_name", "w.hours")


WEEK_SQL = f"""WITH {HOURS_SQL},
e AS (SELECT event_id, user_id, dayofweek(ts) AS dow FROM events WHERE user_id % 5 > 0),
w AS (SELECT event_id, user_id, CAST(off AS INT) AS "offset", CAST((dow + off) % 7 AS INT) AS day FROM e, range(7) t(off))
SELECT event_id, "offset", day, ['sön','mån','tis','ons','tor','fre','lör'][day + 1] AS day_name,
  coalesce(string_agg(ot || '–' || ct, ', ' ORDER BY pos) FILTER (list_contains(days, day)), 'Stängt') AS hours
FROM w JOIN h USING (user_id) GROUP BY event_id, "offset", day"""


def parsed_hours(spark, d):
    """Opening periods of every customer to compact entries, one row each."""
    k = F.col("c_custkey")
    null_moment = F.lit(None).cast("struct<day:int,hour:int,minute:int>")

    def period(day):
        opened = F.struct(F.when((k + day) % 6 > 0, F.lit(day)).alias("day"), ((10 + (k + day) % 3) % 24).cast("int").alias("hour"),
                          F.when(k % 2 == 0, F.lit(30)).alias("minute"))
        closed = F.struct(F.lit(day).alias("day"), (20 + day % 2 + k % 3).cast("int").alias("hour"), F.lit(None).cast("int").alias("minute"))
        midnight = F.struct(F.lit(day).alias("day"), F.lit(0).alias("hour"), F.lit(0).alias("minute"))
        all_day = (k % 7 == day)
        return F.struct(F.when(all_day, midnight).otherwise(opened).alias("open"),
                        F.when(all_day, midnight).when(k % 11 == day, null_moment).otherwise(closed).alias("close"))

    periods = F.array(*[period(i) for i in (6, 0, 1, 2, 3, 4, 5)])
    c = spread_table(spark, d, "customer").withColumn("h", hours.hours_from_periods(periods))
    return c.select("c_custkey", F.posexplode("h").alias("pos", "e")).select(
        "c_custkey", "pos", F.array_join(F.transform("e.days", lambda x: x.cast("string")), ",").alias("days"), "e.open", "e.close")


PERIODS_SQL = """WITH p AS (
  SELECT c_custkey AS k, i, CAST((i + 6) % 7 AS INT) AS day FROM customer, range(7) t(i)
),
t AS (
  SELECT k, i, day,
    CASE WHEN k % 7 = day THEN '00:00' ELSE printf('%02d:%02d', 10 + (k + day) % 3, CASE WHEN k % 2 = 0 THEN 30 ELSE 0 END) END AS open,
    CASE WHEN k % 7 = day OR k % 11 = day THEN '23:59' ELSE printf('%02d:00', 20 + day % 2 + k % 3) END AS close
  FROM p WHERE k % 7 = day OR (k + day) % 6 > 0
),
g AS (SELECT k, open, close, min(i) AS first, string_agg(day, ',' ORDER BY day) AS days FROM t GROUP BY 1, 2, 3)
SELECT k AS c_custkey, CAST(row_number() OVER (PARTITION BY k ORDER BY first) - 1 AS INT) AS pos, days, open, close FROM g"""


# --- geo -------------------------------------------------------------------


def _points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey", "c_mktsegment", F.when(k % 19 > 0, k * 37 % 1500 / 100 + 55).alias("lat"), F.when(k % 19 > 0, k * 53 % 1400 / 100 + 10).alias("lng"),
        k.alias("idx"))


_POINT_SQL = """pt AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 19 > 0 THEN (c_custkey * 37 % 1500) / 100e0 + 55e0 END AS lat,
  CASE WHEN c_custkey % 19 > 0 THEN (c_custkey * 53 % 1400) / 100e0 + 10e0 END AS lng FROM customer)"""


def _hav(lat1, lng1, lat2, lng2, radius):
    a = (f"sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * sin(radians({lng2} - {lng1}) / 2) * sin(radians({lng2} - {lng1}) / 2)")
    return f"{radius} * 2 * atan2(sqrt({a}), sqrt(1e0 - ({a})))"


def nearest(spark, d):
    """The fifty nearest points with printed distances."""
    out = serve.sort_by_distance(_points(spark, d), 59.33, 18.07).limit(50)
    return out.select("c_custkey", F.round("distance", 3).alias("distance"), geo.format_distance(F.col("distance")).alias("shown"))


def distances(spark, d):
    """Distance of every point, missing ones included."""
    out = serve.with_distance(_points(spark, d), 59.33, 18.07)
    return out.select("c_custkey", F.round("distance", 3).alias("distance"), geo.format_distance(F.round("distance", 3)).alias("shown"))


def metro_regions(spark, d):
    """Region, country test and centroid distance of every point."""
    address = pick(["Gatan 1", "Gatan 2, Oslo", "Gade 3, København", "Road 4, NORWAY"], F.col("c_custkey") % 5)
    city = pick(["Stockholm", " Umeå ", "nowhere", "MALMÖ"], F.col("c_custkey") % 4)
    c = geo.city_centroid(city)
    return _points(spark, d).select(
        "c_custkey", geo.metro_region(F.col("lat"), F.col("lng")).alias("region"),
        geo.in_country(F.coalesce("lat", F.lit(0.0)), F.coalesce("lng", F.lit(0.0)), F.coalesce(address, F.lit(""))).alias("in_country"),
        c["lat"].alias("city_lat"), c["lng"].alias("city_lng"))


METRO_SQL = f"""WITH {_POINT_SQL}
SELECT c_custkey, CASE WHEN lat IS NULL THEN 'sweden'
  WHEN {_hav('lat', 'lng', '59.33e0', '18.07e0', '6371e0')} <= 50 THEN 'stockholm'
  WHEN {_hav('lat', 'lng', '57.71e0', '11.97e0', '6371e0')} <= 40 THEN 'gothenburg'
  WHEN {_hav('lat', 'lng', '55.6e0', '13e0', '6371e0')} <= 50 THEN 'malmo' ELSE 'sweden' END AS region,
  c_custkey % 5 IN (0, 4) AND coalesce(lat BETWEEN 55.3e0 AND 69.1e0 AND lng BETWEEN 10.9e0 AND 24.2e0, false) AS in_country,
  CASE c_custkey % 4 WHEN 0 THEN 59.33e0 WHEN 1 THEN 63.83e0 WHEN 2 THEN 62e0 ELSE 55.6e0 END AS city_lat,
  CASE c_custkey % 4 WHEN 0 THEN 18.07e0 WHEN 1 THEN 20.26e0 WHEN 2 THEN 15e0 ELSE 13e0 END AS city_lng
FROM pt"""


def venue_categories(spark, d):
    k = F.col("p_partkey")
    place = pick(["hotel", "museum", "wine_bar", "bakery", "sushi_restaurant", "pub"], k % 8)
    venue = pick(["hotel", "bar", "cafe", "restaurant"], k % 5)
    return table(spark, d, "part").select("p_partkey", geo.venue_category(venue, place).alias("category"), geo.is_food_type(place).alias("food"))


CATEGORY_OF_SQL = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'hotel' WHEN 1 THEN 'exclude' WHEN 2 THEN 'bar' WHEN 3 THEN 'fika'
    ELSE CASE WHEN p_partkey % 8 > 5 AND p_partkey % 5 = 0 THEN 'hotel' WHEN p_partkey % 5 = 1 THEN 'bar' WHEN p_partkey % 5 = 2 THEN 'fika' ELSE 'restaurant' END END AS category,
  p_partkey % 8 IN (0, 2, 3, 4, 5) AS food FROM part"""


# --- facet filters ---------------------------------------------------------

# the serving rows of parts as SQL
SERVING_SQL = f"""s AS (
  SELECT p_partkey AS idx, p_name AS name, p_brand || ' street ' || p_size AS address, CASE WHEN p_size % 4 > 0 THEN p_type END AS region,
    CASE p_size % 4 WHEN 0 THEN 'budget' WHEN 1 THEN 'mellan' WHEN 2 THEN 'lyx' END AS price, p_size AS z,
    CASE WHEN p_size % 7 > 0 THEN upper(p_type[1:1]) || lower(p_type[2:]) END AS c1,
    CASE WHEN p_size % 7 > 0 THEN upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:] END AS c2,
    CASE WHEN p_size % 3 > 0 THEN p_size * 2 END AS score, CASE WHEN p_size % 5 > 0 THEN p_size END AS rank,
    {REGION_SQL} AS metro_region, {CATEGORY_SQL} AS category,
    CASE WHEN p_size % 9 > 0 THEN (p_partkey * 37 % 1500) / 100e0 + 55e0 END AS lat, CASE WHEN p_size % 9 > 0 THEN (p_partkey * 53 % 1400) / 100e0 + 10e0 END AS lng,
    CASE WHEN p_size % 2 = 0 THEN (10 + p_size % 41) / 10e0 END AS kg, CASE WHEN p_size % 5 > 0 THEN (30 + p_size % 21) / 10e0 END AS go,
    CASE WHEN p_size > 25 THEN CAST(p_size % 26 AS DOUBLE) END AS di, CASE WHEN p_size % 6 = 0 THEN CAST(80 + p_size % 21 AS DOUBLE) END AS fa
  FROM part
)"""
FILTERS = {
    "facet_text_price": FilterState(search=" BOLT ", prices=["budget", "mellan"]),
    "facet_cuisine": FilterState(cuisines=["Ring", "Promo"], ranges={"composite_score": Range(10, 80)}),
    "facet_ranges": FilterState(ranges={"krogguiden": Range(2, 5), "google": Range(0, 4.5), "di": Range(0, 25)}),
    "facet_labels": FilterState(michelin=["1_star", "2_star", "selected"], whiteguide=["recommended", "good_class"]),
    "facet_falstaff": FilterState(ranges={"falstaff": Range(85, 100)}),
}


def _facet(state):
    def query(spark, d):
        return serve.apply_filters(P.serving_parts(spark, d), state).select("idx", "name")

    return query


def facet_hours(spark, d):
    """Meals and availability at a fixed clock, joined with plain filters."""
    state = FilterState(meals=["lunch", "dinner"], availability=["openNow", "opensToday"], prices=["lyx", "mellan"])
    return serve.apply_filters(P.serving_parts(spark, d), state, F.lit("2024-05-17 20:30:00").cast("timestamp")).select("idx", "name")


# Friday 20:30; the evening entry is the only one that can be open then
FACET_HOURS_SQL = f"""WITH {SERVING_SQL}
SELECT idx, name FROM s WHERE price IN ('lyx', 'mellan') AND idx % 5 IN (2, 3, 4)"""


def facet_none(spark, d):
    """Default bounds keep every row, also those without values."""
    state = FilterState(ranges={"composite_score": Range(0, 100), "svd": Range(0, 6)})
    return serve.apply_filters(P.serving_parts(spark, d), state).select("idx", "name")


def region_facet(spark, d):
    return serve.in_region(P.serving_parts(spark, d), "malmo").select("idx", "name")


def search_box(spark, d):
    """Top fifty hits of the search box."""
    return serve.search(P.serving_parts(spark, d), "Ring ").limit(50).select("idx", "name", "rank")


def venue_by_id(spark, d):
    return serve.by_id(P.serving_parts(spark, d), "v7", "hotel").select("id", "name", "category")


def venue_detail(spark, d):
    return serve.detail(serve.located(P.serving_parts(spark, d)), "v7", "bar").select("id", "name")


def located_rows(spark, d):
    return serve.located(P.serving_parts(spark, d)).select("idx")


def facet_counts(spark, d):
    return serve.region_facets(P.serving_parts(spark, d))


def facet_list(spark, d):
    return serve.cuisine_facets(P.serving_parts(spark, d), generic=["Promo", "Ring"])


def cuisine_breakdown(spark, d):
    return stats.cuisine_breakdown(P.serving_parts(spark, d))


def top_counts(spark, d):
    """Top fifteen cities of the merge report."""
    return stats.counts_by(table(spark, d, "part"), stats.or_none(F.when(F.col("p_size") % 9 > 0, F.col("p_brand"))), "city", 15)


def sort_name(spark, d):
    """All names with their place in Swedish order: å, ä, ö follow z."""
    first = pick(["z", "å", "ä", "ö", "a"], F.col("p_partkey") % 5)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.concat(first, "p_name").alias("name"))
    return serve.name_positions(p).select("idx", "name", F.col("position").cast("bigint").alias("position"))


def sort_rank(spark, d):
    return serve.sort_by_rank(P.serving_parts(spark, d)).limit(50).select("idx", "rank")


def serving_rows(spark, d):
    s = serve.serving_rows(ranked(spark, d))
    r = F.col("ratings")
    links = F.col("links")
    return s.select(
        "idx", "composite_score", F.round("composite_score_raw", 6).alias("composite_score_raw"), F.col("rank").cast("bigint").alias("rank"),
        F.col("rank_region").cast("bigint").alias("rank_region"), "metro_region", "category", "price_range", "cuisine", "google_rating_count",
        F.col("thatsup_review_count").cast("bigint").alias("reviews"),
        r["michelin"].alias("michelin"), r["whiteguide"].alias("whiteguide"), r["google"].alias("google"), r["di"].alias("di"),
        links["whiteguide"].alias("link_guide"), links["svd"].alias("link_svd"), links["google"].alias("link_maps"))


SERVE_SQL = f"""WITH {SCORED_SQL}
SELECT r.idx, score AS composite_score, round(floor(raw * 10e0 + 0.5e0) / 10e0, 6) AS composite_score_raw, rank_national AS rank, rank_region, metro_region, category,
  CASE r.p_size % 4 WHEN 0 THEN 'budget' WHEN 1 THEN 'mellan' WHEN 2 THEN 'lyx' END AS price_range,
  CASE r.p_size % 5 WHEN 0 THEN 'Italienskt' WHEN 1 THEN 'Sushi' WHEN 2 THEN 'Bar' WHEN 3 THEN 'Café' END AS cuisine,
  CASE WHEN r.q % 150 > 0 THEN CAST(r.q % 150 AS INT) END AS google_rating_count, CASE WHEN r.n % 7 > 1 THEN r.n END AS reviews,
  ['1_star', 'bib_gourmand', 'selected', '2_star', '3_star', '1_key', 'no_such_label'][r.p_size % 10 + 1] AS michelin,
  ['good_class', 'very_good_class', 'recommended', 'Not So White Guide'][r.n % 6 + 1] AS whiteguide,
  CASE WHEN r.q % 3 > 0 THEN (30 + r.q % 21) / 10e0 END AS google, CASE WHEN r.p_size > 25 THEN CAST(r.q % 26 AS DOUBLE) END AS di,
  'https://news.example/' || r.idx AS link_guide, CASE WHEN r.q % 2 = 0 THEN 'https://svd.example/' || r.idx END AS link_svd,
  CASE WHEN r.q % 5 = 0 THEN 'https://maps.example/' || r.idx END AS link_maps
FROM ranked r JOIN facts f USING (idx)
WHERE r.p_size % 10 <= 6 OR r.n % 6 <= 3 OR f.mx >= 48 OR f.mn <= 2 OR r.p_size > 25 OR r.n % 4 = 0 OR r.q % 3 > 0"""


def category_tables(spark, d):
    """Rows of the public tables, counted per table."""
    tables = serve.split_categories(serve.serving_rows(ranked(spark, d)))
    named = [rows.select(F.lit(name).alias("part")) for name, rows in tables.items()]
    return reduce(DataFrame.unionByName, named).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def sitemap_rows(spark, d):
    return serve.sitemap_rows(P.serving_parts(spark, d).withColumn("rank", F.coalesce("rank", F.lit(0))), "https://venues.example", "2024-05-17")


def descriptions(spark, d):
    """Head title, address and dot-separated description of every part."""
    s = P.serving_parts(spark, d)
    text = display.venue_description(F.col("cuisine"), F.col("address"), F.when(F.col("idx") % 3 > 0, F.col("metro_region")), F.col("composite_score"), F.col("rank"))
    head = display.venue_head(F.col("name"), F.col("id"), F.col("category"), text, "Venues", "https://venues.example")
    return s.where("category <> 'exclude'").select("idx", head["title"].alias("title"), head["description"].alias("description"), head["url"].alias("url"), head["kind"].alias("kind"))


QUERIES = {
    "open_now": (open_now, OPEN_SQL),
    "next_open": (next_open, NEXT_SQL),
    "week_schedule": (week_schedule, WEEK_SQL),
    "parsed_hours": (parsed_hours, PERIODS_SQL),
    "nearest": (nearest, f"""WITH {_POINT_SQL}, x AS (SELECT c_custkey, {_hav('59.33e0', '18.07e0', 'lat', 'lng', '6371000e0')} AS m FROM pt)
      SELECT c_custkey, round(m, 3) AS distance, CASE WHEN m < 1000 THEN CAST(floor(m + 0.5e0) AS INT) || ' m' ELSE printf('%.1f km', m / 1000) END AS shown
      FROM x WHERE m IS NOT NULL ORDER BY m, c_custkey LIMIT 50"""),
    "distances": (distances, f"""WITH {_POINT_SQL}, x AS (SELECT c_custkey, round({_hav('59.33e0', '18.07e0', 'lat', 'lng', '6371000e0')}, 3) AS m FROM pt)
      SELECT c_custkey, m AS distance, CASE WHEN m < 1000 THEN CAST(floor(m + 0.5e0) AS INT) || ' m' WHEN m >= 1000 THEN printf('%.1f km', m / 1000) END AS shown FROM x"""),
    "metro_regions": (metro_regions, METRO_SQL),
    "venue_categories": (venue_categories, CATEGORY_OF_SQL),
    "facet_text_price": (_facet(FILTERS["facet_text_price"]), f"""WITH {SERVING_SQL}
      SELECT idx, name FROM s WHERE price IN ('budget', 'mellan') AND lower(concat_ws(' ', name, address, coalesce(region, ''), coalesce(c1 || ', ' || c2, ''))) LIKE '%bolt%'"""),
    "facet_cuisine": (_facet(FILTERS["facet_cuisine"]), f"WITH {SERVING_SQL} SELECT idx, name FROM s WHERE (c1 IN ('Ring', 'Promo') OR c2 IN ('Ring', 'Promo')) AND score BETWEEN 10 AND 80"),
    "facet_ranges": (_facet(FILTERS["facet_ranges"]), f"WITH {SERVING_SQL} SELECT idx, name FROM s WHERE kg BETWEEN 2 AND 5 AND go BETWEEN 0 AND 4.5"),
    "facet_labels": (_facet(FILTERS["facet_labels"]), f"WITH {SERVING_SQL} SELECT idx, name FROM s WHERE z % 10 IN (0, 2, 3) AND z % 8 IN (0, 1)"),
    "facet_falstaff": (_facet(FILTERS["facet_falstaff"]), f"WITH {SERVING_SQL} SELECT idx, name FROM s WHERE fa BETWEEN 85 AND 100"),
    "facet_hours": (facet_hours, FACET_HOURS_SQL),
    "facet_none": (facet_none, "SELECT p_partkey AS idx, p_name AS name FROM part"),
    "region_facet": (region_facet, f"WITH {SERVING_SQL} SELECT idx, name FROM s WHERE metro_region = 'malmo'"),
    "search_box": (search_box, f"""WITH {SERVING_SQL} SELECT idx, name, rank FROM s WHERE lower(concat_ws(' ', name, coalesce(c1 || ', ' || c2, ''), address)) LIKE '%ring%'
      ORDER BY rank ASC NULLS LAST, idx LIMIT 50"""),
    "venue_by_id": (venue_by_id, f"WITH {SERVING_SQL} SELECT 'v' || idx AS id, name, category FROM s WHERE idx = 7 AND category <> 'exclude'"),
    "venue_detail": (venue_detail, f"WITH {SERVING_SQL} SELECT 'v' || idx AS id, name FROM s WHERE idx = 7 AND category = 'bar' AND lat <> 0 AND lng <> 0"),
    "located_rows": (located_rows, f"WITH {SERVING_SQL} SELECT idx FROM s WHERE lat <> 0 AND lng <> 0"),
    "facet_counts": (facet_counts, f"WITH {SERVING_SQL} SELECT metro_region AS region, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM s"),
    "facet_list": (facet_list, f"""WITH {SERVING_SQL}, c AS (SELECT unnest([c1, c2]) AS cuisine FROM s)
      SELECT cuisine, count(*) AS n FROM c WHERE cuisine NOT IN ('Promo', 'Ring') GROUP BY 1 HAVING count(*) >= 3"""),
    "cuisine_breakdown": (cuisine_breakdown, f"WITH {SERVING_SQL} SELECT coalesce(c1, 'Övrigt') AS cuisine, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15"),
    "top_counts": (top_counts, "SELECT CASE WHEN p_size % 9 > 0 THEN p_brand ELSE '(none)' END AS city, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15"),
    "sort_name": (sort_name, """WITH n AS (SELECT p_partkey AS idx, ['z', 'å', 'ä', 'ö', 'a'][p_partkey % 5 + 1] || p_name AS name FROM part)
      SELECT idx, name, row_number() OVER (ORDER BY replace(replace(replace(name, 'å', '{'), 'ä', '|'), 'ö', '}'), idx) AS position FROM n"""),
    "sort_rank": (sort_rank, f"WITH {SERVING_SQL} SELECT idx, rank FROM s ORDER BY rank ASC NULLS LAST, idx LIMIT 50"),
    "serving_rows": (serving_rows, SERVE_SQL),
    "category_tables": (category_tables, f"""WITH {SCORED_SQL} SELECT CASE category WHEN 'exclude' THEN 'excluded' ELSE category END AS part, count(*) AS n
      FROM ranked r JOIN facts f USING (idx) WHERE r.p_size % 10 <= 6 OR r.n % 6 <= 3 OR f.mx >= 48 OR f.mn <= 2 OR r.p_size > 25 OR r.n % 4 = 0 OR r.q % 3 > 0 GROUP BY 1"""),
    "sitemap_rows": (sitemap_rows, f"""WITH {SERVING_SQL}
      SELECT 'https://venues.example' AS loc, '1.0' AS priority, 'weekly' AS changefreq, '2024-05-17' AS lastmod
      UNION ALL SELECT 'https://venues.example/' || p, '0.8', 'weekly', '2024-05-17' FROM (VALUES ('b'), ('f'), ('h')) t(p)
      UNION ALL SELECT 'https://venues.example/' || CASE category WHEN 'restaurant' THEN 'r' WHEN 'bar' THEN 'b' WHEN 'fika' THEN 'f' ELSE 'h' END || '/v' || idx,
        CASE WHEN coalesce(rank, 0) <= CASE category WHEN 'restaurant' THEN 50 ELSE 20 END THEN '0.8' ELSE '0.6' END, 'monthly', '2024-05-17' FROM s WHERE category <> 'exclude'"""),
    "descriptions": (descriptions, f"""WITH {SERVING_SQL}
      SELECT idx, name || ' | Venues' AS title, concat_ws(' · ', c1 || ', ' || c2, CASE WHEN idx % 3 > 0 THEN address || ', ' || metro_region END,
        'Poäng: ' || score || '/100', '#' || rank || ' i Sverige') AS description,
        'https://venues.example/' || CASE category WHEN 'restaurant' THEN 'r' WHEN 'bar' THEN 'b' WHEN 'fika' THEN 'f' ELSE 'h' END || '/v' || idx AS url,
        CASE category WHEN 'restaurant' THEN 'restaurant' ELSE 'website' END AS kind
      FROM s WHERE category <> 'exclude'"""),
}
