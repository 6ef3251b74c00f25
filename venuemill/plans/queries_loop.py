"""Queries over several stages: refine after refine, aliases fed back, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuemill import schemas
from venuemill.functions.text import name_key
from venuemill.operators import consolidate, dedup, enrich, resolve, stats
from venuemill.plans import pipeline
from venuemill.plans.proxies import pick, table
from venuemill.plans.queries_match import _PLACED_SQL, _line_mentions, _placed
from venuemill.plans.queries_refine import _ENRICHED_SQL, _candidates, _venues
from venuemill.session import stored


def refine_again(spark, d):
    """A second refine over the merge's own venues: carried, known as missing, and newly looked up ones."""
    merged = consolidate.consolidate(_line_mentions(spark, d), ("l_partkey",)).withColumnRenamed("venue_ord", "idx")
    merged = stored(merged, "merged")  # read by both runs and for their places
    part = F.concat_ws(":", "idx.pass", "idx.pos", "idx.sub")
    venues = merged.withColumns({"id": part, "n": F.col("idx.pos") % 6})
    fresh = venues.drop("n")
    first = venues.where("n = 0")
    places = _places(venues.where("n != 3"), "new", 4.0)
    previous, _, _, _ = pipeline.refine_again(first.drop("n"), _places(first, "old", 3.0), keep_unplaced=True)
    excerpt = F.transform("quotes", lambda q: q.withField("excerpt", F.concat(F.lit("from "), q["url"])))
    misses = venues.where("n = 1").select("id", F.lit(None).cast("string").alias("place_id"), F.lit("2001-01-01").alias("queried_at"))
    kept, _, _, lookups = pipeline.refine_again(
        fresh, places, previous.withColumn("quotes", excerpt), misses, keep_unplaced=True, queried_at="2002-01-01")
    asked = lookups.select(F.col("id").alias("_id"), "queried_at")
    shown = kept.select(
        F.col("id").alias("founder"), "place_id", "google_rating", F.exists("quotes", lambda q: q["excerpt"].isNotNull()).alias("has_excerpt"))
    return shown.join(asked, shown["founder"] == asked["_id"], "left").select("founder", "place_id", "google_rating", "queried_at", "has_excerpt")


def _places(venues, run, rating):
    """One candidate a venue, with a place of its own."""
    given = {
        "place_id": F.concat(F.lit(f"{run}-"), "id"), "formatted_address": F.lit("Gatan 1, 111 22 Borås, Sverige"), "primary_type": F.lit("cafe"),
        "rating": F.lit(rating), "rating_count": F.lit(5), "lat": F.lit(59.0), "lng": F.lit(15.0), "business_status": F.lit("OPERATIONAL"),
    }
    place = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PLACE.fields]
    return venues.select(F.col("id").alias("venue_id"), F.lit("first").alias("attempt"), F.lit(1).alias("position"), *place)


REFINE_AGAIN_SQL = """
WITH m AS (
  SELECT l_partkey, l_linenumber AS ln, l_orderkey * 10000000 + l_suppkey AS pos, CAST(l_quantity AS INT) AS q, l_orderkey, l_suppkey,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey * 10000000 + l_suppkey) AS rn
  FROM lineitem
),
g AS (
  SELECT l_partkey, first(ln || ':' || pos || ':' || l_partkey ORDER BY rn) AS founder, first(pos % 6 ORDER BY rn) AS n, count(*) FILTER (ln <> 2 AND q + 5 >= 20) AS quotes
  FROM m GROUP BY 1
)
SELECT founder, CASE n WHEN 0 THEN 'old-' || founder WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE 'new-' || founder END AS place_id,
  CASE n WHEN 0 THEN 3e0 WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE 4e0 END AS google_rating,
  CASE n WHEN 0 THEN NULL WHEN 1 THEN '2001-01-01' ELSE '2002-01-01' END AS queried_at, n = 0 AND quotes > 0 AS has_excerpt FROM g"""


def alias_feedback(spark, d):
    """Dedup, upsert into an older run's aliases, and resolve all names again through them."""
    placed = _placed(spark, d)
    old = placed.where((F.col("idx") % 4 == 0) & F.col("place_id").isNotNull()).select(
        "place_id", F.lit("gone").alias("canonical_name"), F.concat(F.lit("old "), "name").alias("alias"), F.col("idx").cast("long").alias("pos"))
    merges = dedup.upsert_known_merges(old, dedup.known_merges(placed))
    kept = dedup.dedup_by_place(placed)
    venues = kept.select(F.col("idx").alias("venue_ord"), name_key(F.col("name")).alias("key"), F.lit(None).cast("string").alias("city"))
    named = placed.select(F.col("idx").alias("row_id"), name_key(F.concat(F.when(F.col("idx") % 3 == 0, F.lit("old ")).otherwise(F.lit("")), "name")).alias("key"), F.lit(None).cast("string").alias("city"))
    out = resolve.exact_match(named, venues, resolve.alias_keys(merges), False)
    return out.select(F.col("row_id").alias("idx"), F.col("venue_ord").alias("venue"), "match_kind")


ALIAS_FEEDBACK_SQL = f"""WITH {_PLACED_SQL},
r AS (
  SELECT place_id, 'gone' AS canonical_name, 'old ' || name AS alias, 0 AS run, idx AS pos FROM p WHERE idx % 4 = 0 AND place_id IS NOT NULL
  UNION ALL
  SELECT k.place_id, b.name, k.name, 1, row_number() OVER (ORDER BY k.sc DESC, k.idx) FROM k JOIN k b ON b.g = k.g AND b.rn = 1 WHERE k.rn > 1 AND k.place_id IS NOT NULL
),
names AS (SELECT place_id, arg_max(canonical_name, run) AS canonical FROM r GROUP BY 1),
a0 AS (SELECT place_id, alias, min((run, pos)) AS spot FROM r GROUP BY 1, 2),
a AS (SELECT alias, arg_max(canonical, (spot, place_id, alias)) AS canonical FROM a0 JOIN names USING (place_id) GROUP BY 1),
v AS (SELECT name, min(idx) AS idx FROM k WHERE rn = 1 GROUP BY 1),
n AS (SELECT idx, CASE WHEN idx % 3 = 0 THEN 'old ' ELSE '' END || name AS name FROM p)
SELECT n.idx, coalesce(v.idx, w.idx) AS venue, CASE WHEN v.idx IS NOT NULL THEN 'exact' WHEN w.idx IS NOT NULL THEN 'alias' END AS match_kind
FROM n LEFT JOIN v ON v.name = n.name LEFT JOIN a ON a.alias = n.name LEFT JOIN v w ON w.name = a.canonical"""


def rekeyed_articles(spark, d):
    """Ordered article ids behind each venue after dedup, donors' articles included."""
    refs = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("venue_ord"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("source_id"),
        (F.col("l_orderkey") % 50).cast("string").alias("article_id"), F.struct(F.col("l_linenumber").alias("pass"), F.col("l_orderkey").alias("pos")).alias("ord"))
    refs = consolidate.article_refs(refs)
    out = dedup.rekey_article_refs(refs, dedup.donor_keepers(_placed(spark, d)))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "article_id"))), lambda x: x["article_id"]), ",")
    return out.groupBy(F.col("venue_ord").alias("venue"), "source_id").agg(listed.alias("article_ids"))


REKEYED_SQL = f"""WITH {_PLACED_SQL},
keep AS (SELECT k.idx AS donor, b.idx AS keeper FROM k JOIN k b ON b.g = k.g AND b.rn = 1 WHERE k.place_id IS NOT NULL),
r AS (
  SELECT coalesce(keeper, l_partkey) AS venue, 's' || l_linenumber AS source_id, CAST(l_orderkey % 50 AS VARCHAR) AS article_id, min((l_linenumber, l_orderkey)) AS ord
  FROM lineitem LEFT JOIN keep ON donor = l_partkey GROUP BY 1, 2, 3
)
SELECT venue, source_id, string_agg(article_id, ',' ORDER BY ord, article_id) AS article_ids FROM r GROUP BY 1, 2"""


def merge_report(spark, d):
    """Merged venues by number of sources and by type."""
    return stats.counts_of(consolidate.consolidate(_line_mentions(spark, d), ("l_partkey",)), {"sources": F.col("source_count"), "type": F.col("venue_type")})


MERGE_REPORT_SQL = """
WITH m AS (
  SELECT l_partkey, l_linenumber AS ln, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey * 10000000 + l_suppkey) AS rn FROM lineitem
),
g AS (
  SELECT count(DISTINCT ln) AS sources, CASE WHEN count(*) FILTER (ln = 3 AND q % 4 = 3) > 0 THEN 'hotel' ELSE
    coalesce(first(CASE q % 4 WHEN 1 THEN 'bar' WHEN 2 THEN 'cafe' ELSE 'hotel' END ORDER BY rn) FILTER (q % 4 > 0 AND (ln <> 3 OR rn = 1)), 'restaurant') END AS kind
  FROM m GROUP BY l_partkey
)
SELECT 'sources' AS what, CAST(sources AS VARCHAR) AS name, count(*) AS n FROM g GROUP BY 2 UNION ALL SELECT 'type', kind, count(*) FROM g GROUP BY 2"""


def refine_report(spark, d):
    """Refined venues by region, category and place type."""
    kept, _ = enrich.cleanup(enrich.enrich(_venues(spark, d), _candidates(spark, d)))
    refined = enrich.classify(kept)
    return stats.counts_of(refined, {"category": F.col("category"), "place type": stats.or_none(F.col("primary_type"))})


REFINE_REPORT_SQL = f"""WITH {_ENRICHED_SQL},
f AS (
  SELECT CASE WHEN primary_type = '' THEN '(none)' ELSE primary_type END AS t, CASE WHEN primary_type = 'museum' THEN 'exclude' WHEN primary_type = 'bar' THEN 'bar' WHEN primary_type = 'cafe' THEN 'fika'
    WHEN primary_type = '' AND k % 4 = 3 THEN 'hotel' WHEN k % 4 = 1 THEN 'bar' WHEN k % 4 = 2 THEN 'fika' ELSE 'restaurant' END AS c
  FROM e WHERE place_id IS NOT NULL AND business_status = 'OPERATIONAL'
)
SELECT 'category' AS what, c AS name, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'place type', t, count(*) FROM f GROUP BY 2"""


def collector_report(spark, d):
    """Collected articles by city, price, type and distinction."""
    p, size = table(spark, d, "part"), F.col("p_size")
    a = p.select(
        F.when(size % 3 > 0, F.col("p_brand")).alias("venue_city"), pick(["budget", "", "lyx"], size % 3).alias("price_range"),
        F.col("p_type").alias("venue_type"), F.when(size % 4 == 0, F.array(F.lit("1_star"), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return stats.collector_report(a)


COLLECTOR_REPORT_SQL = """
SELECT 'city' AS what, CASE WHEN p_size % 3 > 0 THEN p_brand ELSE '(none)' END AS name, count(*) AS n FROM part GROUP BY 2
UNION ALL SELECT 'price', CASE p_size % 3 WHEN 0 THEN 'budget' WHEN 1 THEN '(none)' ELSE 'lyx' END, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'distinction', CASE WHEN p_size % 4 = 0 THEN '1_star' ELSE '(none)' END, count(*) FROM part GROUP BY 2"""


def recategorized(spark, d):
    """Stored rows whose category is worked out again."""
    e = enrich.enrich(_venues(spark, d), _candidates(spark, d)).withColumn("category", F.lit("stale"))
    return pipeline.recategorize(e).select("id", "category")


RECATEGORIZED_SQL = f"""WITH {_ENRICHED_SQL}
SELECT id, CASE WHEN primary_type = 'museum' THEN 'exclude' WHEN primary_type = 'bar' THEN 'bar' WHEN primary_type = 'cafe' THEN 'fika'
  WHEN coalesce(primary_type, '') = '' AND k % 4 = 3 THEN 'hotel' WHEN k % 4 = 1 THEN 'bar' WHEN k % 4 = 2 THEN 'fika' ELSE 'restaurant' END AS category FROM e"""

QUERIES = {
    "refine_again": (refine_again, REFINE_AGAIN_SQL),
    "alias_feedback": (alias_feedback, ALIAS_FEEDBACK_SQL),
    "rekeyed_articles": (rekeyed_articles, REKEYED_SQL),
    "merge_report": (merge_report, MERGE_REPORT_SQL),
    "refine_report": (refine_report, REFINE_REPORT_SQL),
    "collector_report": (collector_report, COLLECTOR_REPORT_SQL),
    "recategorized": (recategorized, RECATEGORIZED_SQL),
}
