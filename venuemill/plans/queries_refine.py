"""Enrichment, cleanup and incremental-ingest queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuemill import schemas
from venuemill.operators import enrich, incremental, stats
from venuemill.plans import pipeline
from venuemill.plans.proxies import pick, table
from venuemill.session import cut_lineage
from venuemill.sources import articles as A


def _venues(spark, d):
    """Parts as merged venues that were never looked up."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    base = p.select(
        k.cast("string").alias("id"), k.alias("idx"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).otherwise(F.lit("")).alias("city"),
        pick(["restaurant", "bar", "cafe", "hotel"], k % 4).alias("venue_type"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    return pipeline.with_place_columns(base)


def _candidates(spark, d):
    """Line items as place candidates of their part."""
    o, ln, qty = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    moment = lambda day, hour: F.struct(F.lit(day).alias("day"), F.lit(hour).alias("hour"), F.lit(0).alias("minute"))
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("venue_id"), F.when(ln < 4, F.lit("first")).otherwise(F.lit("retry")).alias("attempt"),
        (o * 10_000_000 + F.col("l_suppkey") * 10 + ln).alias("position"),
        F.concat(F.lit("pl"), (qty % 12).cast("string"), F.lit("-"), (F.col("l_partkey") % 90).cast("string")).alias("place_id"),
        F.lit("n").alias("display_name"), pick(["Gatan 1, 111 22 Borås, Sverige", "Gatan 2, 0150 Oslo, Norge"], qty % 9 % 8 % 3).alias("formatted_address"),
        pick(["museum", "bar", "cafe", "sushi_restaurant"], qty % 5).alias("primary_type"), F.lit("m").alias("maps_uri"),
        pick(["CLOSED_PERMANENTLY", "OPERATIONAL", "CLOSED_TEMPORARILY"], qty % 6).alias("business_status"),
        F.when(qty % 2 == 0, F.lit("http://w")).alias("website"), F.lit("").alias("phone"), (qty % 50 / 10).alias("rating"),
        F.when(qty % 3 > 0, qty).alias("rating_count"), (qty % 15 + 55).cast("double").alias("lat"), (qty % 14 + 11).cast("double").alias("lng"),
        F.array(F.struct(moment(1, 9).alias("open"), moment(1, 17).alias("close")), F.struct(moment(0, 9).alias("open"), moment(0, 17).alias("close"))).alias("periods"))


def place_enrichment(spark, d):
    e = enrich.enrich(_venues(spark, d), _candidates(spark, d))
    return e.select("id", "enriched", "place_id", "city", "google_rating", "google_rating_count", "primary_type", "business_status", "website", "phone", "lat", "lng",
                    F.array_join(F.transform("hours", lambda h: F.concat(F.array_join(F.transform(h["days"], lambda x: x.cast("string")), ""), h["open"], h["close"])), ",").alias("hours"))


_ENRICHED_SQL = """
c AS (
  SELECT l_partkey AS k, CASE WHEN l_linenumber < 4 THEN 'first' ELSE 'retry' END AS attempt, l_orderkey * 10000000 + l_suppkey * 10 + l_linenumber AS pos,
    CAST(l_quantity AS INT) AS q FROM lineitem
),
t AS (SELECT k, attempt, first(q ORDER BY pos) AS q FROM c GROUP BY 1, 2),
w AS (SELECT k, max(q) FILTER (attempt = 'first') AS f, max(q) FILTER (attempt = 'retry') AS r FROM t GROUP BY 1),
x AS (SELECT k, CASE WHEN f % 5 IN (0, 4) AND r % 5 IN (1, 2, 3) THEN r ELSE f END AS q FROM w WHERE f IS NOT NULL),
e0 AS (
  SELECT p_partkey AS k, p_name AS name, CASE WHEN p_size % 4 > 0 THEN p_brand ELSE '' END AS city0, q,
    coalesce(CASE WHEN q % 9 % 8 % 3 = 1 THEN false ELSE q % 15 + 55 BETWEEN 55.3 AND 69.1 AND q % 14 + 11 BETWEEN 10.9 AND 24.2 END, false) AS ok
  FROM part LEFT JOIN x ON x.k = p_partkey
),
e AS (
  SELECT CAST(k AS VARCHAR) AS id, k, name, ok AS enriched, q, CASE WHEN ok THEN 'pl' || (q % 12) || '-' || (k % 90) END AS place_id,
    CASE WHEN city0 = '' AND ok AND q % 9 % 8 % 3 = 0 THEN 'Borås' ELSE city0 END AS city,
    CASE WHEN ok THEN q % 50 / 10e0 END AS google_rating, CASE WHEN ok THEN CASE WHEN q % 3 > 0 THEN q ELSE 0 END END AS google_rating_count,
    CASE WHEN ok THEN CASE q % 5 WHEN 0 THEN 'museum' WHEN 1 THEN 'bar' WHEN 2 THEN 'cafe' WHEN 3 THEN 'sushi_restaurant' ELSE '' END END AS primary_type,
    CASE WHEN ok THEN CASE q % 6 WHEN 0 THEN 'CLOSED_PERMANENTLY' WHEN 2 THEN 'CLOSED_TEMPORARILY' ELSE 'OPERATIONAL' END END AS business_status,
    CASE WHEN ok AND q % 2 = 0 THEN 'http://w' END AS website, CAST(NULL AS VARCHAR) AS phone,
    CASE WHEN ok THEN CAST(q % 15 + 55 AS DOUBLE) END AS lat, CASE WHEN ok THEN CAST(q % 14 + 11 AS DOUBLE) END AS lng
  FROM e0
)"""


def cleanup_reasons(spark, d):
    """Reasons of all rows, kept ones included."""
    e = enrich.enrich(_venues(spark, d), _candidates(spark, d)).withColumn(
        "lat", F.when(F.col("idx") % 17 == 0, F.lit(48.8)).otherwise(F.col("lat")))
    return e.select("id", enrich.reject_reason().alias("reason"), enrich.reject_reason(True).alias("reason_limited"))


def refined_counts(spark, d):
    """Cleanup, classification and counts by region and category."""
    e = enrich.enrich(_venues(spark, d), _candidates(spark, d))
    kept, _ = enrich.cleanup(e)
    return enrich.classify(kept).groupBy("metro_region", "category").agg(F.count(F.lit(1)).alias("n"))


def _hav(lat, lng):
    a = (f"sin(radians({lat} - lat) / 2) * sin(radians({lat} - lat) / 2) + cos(radians(lat)) * cos(radians({lat}))"
         f" * sin(radians({lng} - lng) / 2) * sin(radians({lng} - lng) / 2)")
    return f"6371e0 * 2 * atan2(sqrt({a}), sqrt(1e0 - ({a})))"


REFINED_SQL = f"""WITH {_ENRICHED_SQL}
SELECT CASE WHEN {_hav('59.33e0', '18.07e0')} <= 50 THEN 'stockholm' WHEN {_hav('57.71e0', '11.97e0')} <= 40 THEN 'gothenburg' WHEN {_hav('55.6e0', '13e0')} <= 50 THEN 'malmo' ELSE 'sweden' END AS metro_region,
  CASE WHEN primary_type = 'museum' THEN 'exclude' WHEN primary_type = 'bar' THEN 'bar' WHEN primary_type = 'cafe' THEN 'fika' WHEN primary_type = '' AND k % 4 = 3 THEN 'hotel'
    WHEN k % 4 = 1 THEN 'bar' WHEN k % 4 = 2 THEN 'fika' ELSE 'restaurant' END AS category, count(*) AS n
FROM e WHERE place_id IS NOT NULL AND business_status = 'OPERATIONAL' GROUP BY 1, 2"""


def needs_lookup(spark, d):
    """Rows to look up in each mode; users with purchases are the cache."""
    e = cut_lineage(enrich.enrich(_venues(spark, d), _candidates(spark, d)))  # read once for each mode
    seen = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("id")).distinct()
    parts = [enrich.needs_enrichment(e, seen, "default").withColumn("mode", F.lit("default")), enrich.needs_enrichment(e, seen, "backfill").withColumn("mode", F.lit("backfill")),
             enrich.needs_enrichment(e, seen, "force", limit=25).withColumn("mode", F.lit("limit")), enrich.needs_enrichment(e, seen, target_id="7").withColumn("mode", F.lit("target"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("mode", "id")


NEEDS_SQL = f"""WITH {_ENRICHED_SQL}
SELECT 'default' AS mode, id FROM e WHERE place_id IS NULL AND id NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase')
UNION ALL SELECT 'backfill', id FROM e WHERE place_id IS NOT NULL
UNION ALL SELECT 'limit', CAST(p_partkey AS VARCHAR) FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 25)
UNION ALL SELECT 'target', '7'"""


def lookup_cost(spark, d):
    return stats.lookup_cost(table(spark, d, "customer"))


def carry_over(spark, d):
    """Labelled documents keep their place data and excerpts in a new merge."""
    k = F.col("doc_id")

    def venues(df, enriched):
        quote = F.struct(F.col("source").alias("source_id"), F.lit("t").alias("text"),
                         (F.when(k % 2 == 0, F.concat(F.lit("x"), k.cast("string"))) if enriched else F.lit(None).cast("string")).alias("excerpt"))
        base = pipeline.with_place_columns(df.select(k.cast("string").alias("id"), F.when(k % 3 > 0, F.col("lang")).otherwise(F.lit("")).alias("city"), F.array(quote).alias("quotes"),
                                                     F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"), k.alias("_k"), *(["quality"] if enriched else [])))
        if enriched:
            base = base.withColumns({"place_id": F.when(F.col("quality") == 1, F.concat(F.lit("p"), "id")), "google_rating": F.lit(4.5), "lat": F.lit(59.0), "city": F.lit("prev")})
        return base.drop("_k", "quality")

    docs = table(spark, d, "documents")
    previous = docs.join(table(spark, d, "labels"), "doc_id")
    out = enrich.carry_over(venues(docs, False), venues(previous, True))
    return out.select("id", "carried", "place_id", "google_rating", "lat", "lng", "city", F.col("quotes")[0]["excerpt"].alias("excerpt"))


def incremental_new(spark, d):
    """Documents without labels yet."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return incremental.unseen(docs, table(spark, d, "labels"), "doc_id")


def append_unseen(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return incremental.append_unseen(table(spark, d, "labels").select("doc_id", "quality"), docs, "doc_id")


def carry_body(spark, d):
    """A refresh of all documents keeps the texts of the labelled ones."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    fresh = docs.select(k.cast("string").alias("url"), F.lit("").alias("body_text"), F.lit(None).cast("string").alias("enriched_at"))
    old = docs.join(table(spark, d, "labels"), "doc_id").select(
        k.cast("string").alias("url"), F.when(F.col("quality") == 1, F.col("text")).otherwise(F.lit("")).alias("body_text"), F.lit("2024").alias("enriched_at"), k.alias("pos"))
    out = incremental.carry_body_text(fresh, old)
    return out.select("url", F.md5("body_text").alias("digest"), "enriched_at")


def keep_first(spark, d):
    """First event per user and type."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"))
    return incremental.keep_first(e, ["user_id", "event_type"], ["event_id"])


def lookup_cache(spark, d):
    """Newest lookup per user, misses included."""
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("id"), F.when(F.col("event_type") != "error", F.concat(F.lit("p"), F.col("event_id").cast("string"))).alias("place_id"),
                    F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("-"), F.format_string("%09d", "event_id")).alias("queried_at"), "event_type")
    return incremental.update_lookups(rows.where("event_type <> 'click'"), rows.where("event_type = 'click'"))


def until_cutoff(spark, d):
    """Events before the first large one."""
    e = table(spark, d, "events").select("event_id", F.format_string("%06.2f", 999 - F.col("value")).alias("inverse"))
    return incremental.until_cutoff(e, "event_id", "inverse", "620.00").select("event_id")


def fingerprint(spark, d):
    """Fingerprints of the orders in two layouts, without one row, and with one value changed."""
    o = table(spark, d, "orders")
    last = F.col("o_orderkey") == o.agg(F.max("o_orderkey")).scalar()
    variants = {
        "same": o, "moved": o.repartition("o_custkey"), "shorter": o.where(~last),
        "changed": o.withColumn("o_orderpriority", F.when(last, F.lit("none")).otherwise(F.col("o_orderpriority"))),
    }
    prints = reduce(DataFrame.unionByName, [incremental.table_fingerprint(x).withColumn("variant", F.lit(v)) for v, x in variants.items()])
    first = prints.where("variant = 'same'").select("fingerprint").scalar()
    hexes = F.col("fingerprint").rlike("^[0-9a-f]{16}$")
    return prints.select("variant", hexes.alias("well_formed"), (F.col("fingerprint") == first).alias("as_before"))


def renormalized(spark, d):
    """How many parts change when their names are normalised again."""
    k = F.col("p_partkey")
    given = {"id": k.cast("string"), "source_id": F.lit("di"), "url": F.lit("u"), "venue_name": F.concat("p_name", pick(["", ".", "  x"], k % 4)), "venue_city": F.when(k % 5 == 0, F.lit("malmö")), "price_range": F.lit("lyx")}
    before = table(spark, d, "part").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ARTICLE.fields])
    return stats.changed_rows(before, A.normalize_articles(before), "id", ["venue_name", "venue_address", "venue_city", "price_range", "sub_articles"])


def collector_stats(spark, d):
    """Per-priority score ranges of orders as collected articles."""
    a = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 26).cast("double").alias("score"))
    return stats.collector_stats(a)


QUERIES = {
    "place_enrichment": (place_enrichment, f"""WITH {_ENRICHED_SQL} SELECT id, enriched, place_id, city, google_rating, google_rating_count, primary_type, business_status, website, phone, lat, lng,
      CASE WHEN enriched THEN '0109:0017:00' END AS hours FROM e"""),
    "cleanup_reasons": (cleanup_reasons, f"""WITH {_ENRICHED_SQL}, j AS (SELECT *, CASE WHEN k % 17 = 0 THEN 48.8e0 ELSE lat END AS lat2 FROM e),
      r AS (SELECT id, place_id IS NULL AS unplaced, lat2 <> 0 AND lng <> 0 AND NOT (lat2 BETWEEN 55.3 AND 69.1 AND lng BETWEEN 10.9 AND 24.2) AS abroad, city, business_status AS b FROM j)
      SELECT id, CASE WHEN unplaced THEN 'no place data' WHEN abroad THEN 'not in country (' || CASE WHEN city = '' THEN 'unknown' ELSE city END || ')' WHEN b LIKE 'CLOSED%' THEN replace(lower(b), '_', ' ') END AS reason,
        CASE WHEN unplaced THEN NULL WHEN abroad THEN 'not in country (' || CASE WHEN city = '' THEN 'unknown' ELSE city END || ')' WHEN b LIKE 'CLOSED%' THEN replace(lower(b), '_', ' ') END AS reason_limited FROM r"""),
    "refined_counts": (refined_counts, REFINED_SQL),
    "needs_lookup": (needs_lookup, NEEDS_SQL),
    "lookup_cost": (lookup_cost, "SELECT CAST(ceil(count(*) * 1.3e0) AS BIGINT) AS calls, round(ceil(count(*) * 1.3e0) * 0.032e0, 2) AS cost FROM customer"),
    "carry_over": (carry_over, """WITH o AS (SELECT doc_id FROM labels WHERE quality = 1)
      SELECT CAST(d.doc_id AS VARCHAR) AS id, o.doc_id IS NOT NULL AS carried, 'p' || o.doc_id AS place_id, CASE WHEN o.doc_id IS NOT NULL THEN 4.5e0 END AS google_rating,
        CASE WHEN o.doc_id IS NOT NULL THEN 59e0 ELSE 1e0 END AS lat, 2e0 AS lng, CASE WHEN d.doc_id % 3 > 0 THEN lang WHEN o.doc_id IS NOT NULL THEN 'prev' ELSE '' END AS city,
        CASE WHEN d.doc_id % 2 = 0 THEN 'x' || o.doc_id END AS excerpt FROM documents d LEFT JOIN o USING (doc_id)"""),
    "incremental_new": (incremental_new, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "append_unseen": (append_unseen, "SELECT doc_id, quality, NULL AS lang FROM labels UNION ALL SELECT doc_id, NULL, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "carry_body": (carry_body, """SELECT CAST(d.doc_id AS VARCHAR) AS url, md5(CASE WHEN quality = 1 THEN text ELSE '' END) AS digest, CASE WHEN quality = 1 AND text <> '' THEN '2024' END AS enriched_at
      FROM documents d LEFT JOIN labels USING (doc_id)"""),
    "keep_first": (keep_first, "SELECT user_id, event_type, event_id, round(value, 2) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1"),
    "lookup_cache": (lookup_cache, """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN event_type <> 'error' THEN 'p' || event_id END AS place_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '-' || printf('%09d', event_id) AS queried_at FROM events)
      SELECT id, place_id, queried_at FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY queried_at DESC) = 1"""),
    "until_cutoff": (until_cutoff, "SELECT event_id FROM events WHERE event_id < coalesce((SELECT min(event_id) FROM events WHERE printf('%06.2f', 999 - value) < '620.00'), 9223372036854775807)"),
    "fingerprint": (fingerprint, """SELECT v AS variant, (SELECT count(*) > 0 FROM orders) AS well_formed, v IN ('same', 'moved') AS as_before
      FROM (VALUES ('same'), ('moved'), ('shorter'), ('changed')) t(v)"""),
    "renormalized": (renormalized, "SELECT count(*) AS rows, count(*) FILTER (p_partkey % 4 IN (1, 2) OR p_partkey % 5 = 0) AS changed FROM part"),
    "collector_stats": (collector_stats, "SELECT o_orderpriority AS source_id, count(*) AS articles, count(*) FILTER (o_orderkey % 3 > 0 AND o_orderkey % 26 > 0) AS with_score, min(CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 26 AS DOUBLE) END) AS min_score, max(CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 26 AS DOUBLE) END) AS max_score FROM orders GROUP BY 1"),
}
