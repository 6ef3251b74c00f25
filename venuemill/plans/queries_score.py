"""Scoring and ranking queries with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuemill.functions import display, score
from venuemill.operators import ranking, stats
from venuemill.plans import proxies as P
from venuemill.plans.proxies import table

FACTS_SQL = """
facts AS (
  SELECT p_partkey AS idx, p_name AS name, p_brand, p_type, p_size, n, q, mx, mn, r, last
  FROM part JOIN (
    SELECT l_partkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q,
      CAST(max(l_quantity) AS BIGINT) AS mx, CAST(min(l_quantity) AS BIGINT) AS mn,
      count(*) FILTER (l_returnflag = 'R') AS r, max(l_shipdate) AS last
    FROM lineitem GROUP BY l_partkey
  ) ON l_partkey = p_partkey
)"""

CATEGORY_SQL = """CASE p_type WHEN 'ECONOMY' THEN 'restaurant' WHEN 'LARGE' THEN 'restaurant'
  WHEN 'MEDIUM' THEN 'fika' WHEN 'PROMO' THEN 'hotel' WHEN 'SMALL' THEN 'bar' WHEN 'STANDARD' THEN 'exclude' END"""
REGION_SQL = """CASE CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 4
  WHEN 0 THEN 'stockholm' WHEN 1 THEN 'gothenburg' WHEN 2 THEN 'malmo' ELSE 'sweden' END"""

# source scores on the 0-10 scale, one column each, in the fixed order
SCORED_SQL = f"""
{FACTS_SQL},
src AS (
  SELECT *,
    CASE p_size % 10 WHEN 0 THEN 9e0 WHEN 1 THEN 8e0 WHEN 2 THEN 7.5e0 WHEN 3 THEN 9.5e0 WHEN 4 THEN 10e0 WHEN 5 THEN 9e0 END AS s_mi,
    CASE n % 6 WHEN 0 THEN 8e0 WHEN 1 THEN 8.5e0 WHEN 2 THEN 7.5e0 END AS s_wg,
    CASE WHEN mx >= 48 THEN CAST(1 + q % 6 AS DOUBLE) / 6e0 * 10e0 END AS s_svd,
    CASE WHEN p_size > 25 THEN CAST(q % 26 AS DOUBLE) / 25e0 * 10e0 END AS s_di,
    CASE WHEN n % 4 = 0 THEN CAST(10 + q % 41 AS DOUBLE) / 10e0 / 5e0 * 10e0 END AS s_kg,
    CASE WHEN r % 3 = 0 THEN CAST(80 + q % 21 AS DOUBLE) / 100e0 * 10e0 END AS s_fa,
    CASE WHEN mn <= 2 THEN CAST(1 + q % 5 AS DOUBLE) / 5e0 * 10e0 END AS s_dn,
    CASE WHEN n % 7 > 1 THEN CAST(q % 51 AS DOUBLE) / 10e0 / 5e0 * 10e0 END AS s_th,
    CASE WHEN q % 3 > 0 AND q % 150 > 0 THEN
      least(1e0, (q % 150) / 100e0) * (CAST(30 + q % 21 AS DOUBLE) / 10e0 / 5e0 * 10e0)
      + (1e0 - least(1e0, (q % 150) / 100e0)) * 7e0 END AS s_go,
    (epoch_ms(TIMESTAMP '2003-01-01') - epoch_ms(date_trunc('day', last))) / 31557600000e0 AS years,
    p_size % 10 IN (0, 3, 4, 5) AS starred,
    p_size % 10 <= 6 OR n % 6 <= 3 OR r % 3 = 0 AS prestige
  FROM facts
),
decayed AS (
  SELECT *, CASE WHEN years <= 3e0 THEN 1e0 ELSE greatest(0.4e0, 1e0 - (years - 3e0) * 0.15e0) END AS d FROM src
),
summed AS (
  SELECT *,
    0e0 + CASE WHEN s_mi IS NOT NULL THEN 0.3e0 * s_mi ELSE 0e0 END + CASE WHEN s_wg IS NOT NULL THEN 0.22e0 * s_wg ELSE 0e0 END
      + CASE WHEN s_svd IS NOT NULL THEN 0.12e0 * d * s_svd ELSE 0e0 END + CASE WHEN s_di IS NOT NULL THEN 0.14e0 * d * s_di ELSE 0e0 END
      + CASE WHEN s_kg IS NOT NULL THEN 0.1e0 * s_kg ELSE 0e0 END + CASE WHEN s_fa IS NOT NULL THEN 0.22e0 * s_fa ELSE 0e0 END
      + CASE WHEN s_dn IS NOT NULL THEN 0.12e0 * d * s_dn ELSE 0e0 END + CASE WHEN s_th IS NOT NULL THEN 0.08e0 * s_th ELSE 0e0 END
      + CASE WHEN s_go IS NOT NULL THEN 0.08e0 * s_go ELSE 0e0 END AS ws,
    0e0 + CASE WHEN s_mi IS NOT NULL THEN 0.3e0 ELSE 0e0 END + CASE WHEN s_wg IS NOT NULL THEN 0.22e0 ELSE 0e0 END
      + CASE WHEN s_svd IS NOT NULL THEN 0.12e0 * d ELSE 0e0 END + CASE WHEN s_di IS NOT NULL THEN 0.14e0 * d ELSE 0e0 END
      + CASE WHEN s_kg IS NOT NULL THEN 0.1e0 ELSE 0e0 END + CASE WHEN s_fa IS NOT NULL THEN 0.22e0 ELSE 0e0 END
      + CASE WHEN s_dn IS NOT NULL THEN 0.12e0 * d ELSE 0e0 END + CASE WHEN s_th IS NOT NULL THEN 0.08e0 ELSE 0e0 END
      + CASE WHEN s_go IS NOT NULL THEN 0.08e0 ELSE 0e0 END AS w,
    coalesce(s_mi >= 9.5e0, true) AND coalesce(s_wg >= 9.5e0, true) AND coalesce(s_svd >= 9.5e0, true) AND coalesce(s_di >= 9.5e0, true)
      AND coalesce(s_kg >= 9.5e0, true) AND coalesce(s_fa >= 9.5e0, true) AND coalesce(s_dn >= 9.5e0, true)
      AND coalesce(s_th >= 9.5e0, true) AND coalesce(s_go >= 9.5e0, true) AS perfect
  FROM decayed
),
capped AS (
  SELECT *, CASE WHEN w = 0e0 THEN 0e0 WHEN starred THEN ws / w WHEN prestige THEN least(ws / w, 9.5e0)
    ELSE ws / w / 10e0 * 7.5e0 END * 10e0 AS raw FROM summed
),
scored AS (
  SELECT idx, name, p_brand, p_type, p_size, n, q, s_mi, s_wg, s_svd, s_di, s_kg, s_fa, s_dn, s_th, s_go,
    {CATEGORY_SQL} AS category, {REGION_SQL} AS metro_region, raw,
    CAST(CASE WHEN floor(raw + 0.5e0) >= 100 AND NOT (starred AND perfect) THEN 99
      ELSE greatest(0, least(100, floor(raw + 0.5e0))) END AS INT) AS score
  FROM capped
),
ranked AS (
  SELECT *,
    CASE WHEN category <> 'exclude' AND score > 0 THEN row_number() OVER (
      PARTITION BY category, category <> 'exclude' AND score > 0 ORDER BY raw DESC, idx) ELSE 0 END AS rank_national,
    CASE WHEN category <> 'exclude' AND score > 0 AND metro_region <> 'sweden' THEN row_number() OVER (
      PARTITION BY category, metro_region, category <> 'exclude' AND score > 0 ORDER BY raw DESC, idx) END AS rank_region
  FROM scored
)"""


def scored(spark, d):
    return score.composite_score(P.rated_venues(spark, d), score.PIPELINE_POLICY, score.inputs_from_nested(), P.as_of())


def ranked(spark, d):
    return ranking.assign_ranks(scored(spark, d))


def composite_score_rank(spark, d):
    return ranked(spark, d).select(
        "idx", "name", "category", "metro_region", "composite_score",
        F.round("composite_score_raw", 6).alias("composite_score_raw"),
        F.col("rank_national").cast("bigint").alias("rank_national"),
        F.col("rank_region").cast("bigint").alias("rank_region"),
    )


def normalized_ratings(spark, d):
    """Long form of the per-source map."""
    return scored(spark, d).select("idx", F.explode("normalized_ratings").alias("source", "value"))


def legacy_score(spark, d):
    out = score.composite_score(P.flat_ratings(spark, d), score.LEGACY_POLICY, score.inputs_from_flat())
    return out.select("idx", "composite_score", F.round("composite_score_raw", 6).alias("composite_score_raw"))


LEGACY_SQL = f"""WITH {FACTS_SQL},
src AS (
  SELECT *,
    CASE p_size % 10 WHEN 0 THEN 9e0 WHEN 1 THEN 8e0 WHEN 2 THEN 7.5e0 WHEN 3 THEN 9.5e0 WHEN 4 THEN 10e0 WHEN 5 THEN 9e0 END AS s_mi,
    CASE n % 8 WHEN 0 THEN 7e0 WHEN 1 THEN 7.5e0 WHEN 2 THEN 8.5e0 WHEN 3 THEN 9e0 WHEN 4 THEN 10e0 END AS s_wg,
    CASE WHEN mx >= 48 AND q % 7 > 0 THEN CAST(q % 7 AS DOUBLE) / 6e0 * 10e0 END AS s_svd,
    CASE WHEN n % 4 = 0 THEN CAST(10 + q % 41 AS DOUBLE) / 10e0 / 5e0 * 10e0 END AS s_kg,
    CASE WHEN p_size > 25 AND q % 26 > 0 THEN CAST(q % 26 AS DOUBLE) / 25e0 * 10e0 END AS s_di,
    CASE WHEN r % 3 = 0 AND q % 101 > 0 THEN CAST(q % 101 AS DOUBLE) / 100e0 * 10e0 END AS s_fa,
    CASE WHEN mn <= 2 AND q % 6 > 0 THEN CAST(q % 6 AS DOUBLE) / 5e0 * 10e0 END AS s_dn,
    CASE WHEN q % 3 > 0 THEN least(1e0, (q % 150) / 100e0) * (CAST(30 + q % 21 AS DOUBLE) / 10e0 / 5e0 * 10e0)
      + (1e0 - least(1e0, (q % 150) / 100e0)) * 7e0 END AS s_go,
    p_size % 10 IN (0, 3, 4) AS starred, p_size % 10 < 6 OR n % 8 < 5 AS prestige,
    n % 3 = 0 AND n % 4 <> 0 AS visited
  FROM facts
),
summed AS (
  SELECT *,
    0e0 + CASE WHEN s_mi IS NOT NULL THEN 0.28e0 * s_mi ELSE 0e0 END + CASE WHEN s_wg IS NOT NULL THEN 0.2e0 * s_wg ELSE 0e0 END
      + CASE WHEN s_svd IS NOT NULL THEN 0.16e0 * s_svd ELSE 0e0 END + CASE WHEN s_kg IS NOT NULL THEN 0.16e0 * s_kg ELSE 0e0 END
      + CASE WHEN s_di IS NOT NULL THEN 0.16e0 * s_di ELSE 0e0 END + CASE WHEN s_fa IS NOT NULL THEN 0.14e0 * s_fa ELSE 0e0 END
      + CASE WHEN s_dn IS NOT NULL THEN 0.14e0 * s_dn ELSE 0e0 END + CASE WHEN s_go IS NOT NULL THEN 0.1e0 * s_go ELSE 0e0 END AS ws,
    0e0 + CASE WHEN s_mi IS NOT NULL THEN 0.28e0 ELSE 0e0 END + CASE WHEN s_wg IS NOT NULL THEN 0.2e0 ELSE 0e0 END
      + CASE WHEN s_svd IS NOT NULL THEN 0.16e0 ELSE 0e0 END + CASE WHEN s_kg IS NOT NULL THEN 0.16e0 ELSE 0e0 END
      + CASE WHEN s_di IS NOT NULL THEN 0.16e0 ELSE 0e0 END + CASE WHEN s_fa IS NOT NULL THEN 0.14e0 ELSE 0e0 END
      + CASE WHEN s_dn IS NOT NULL THEN 0.14e0 ELSE 0e0 END + CASE WHEN s_go IS NOT NULL THEN 0.1e0 ELSE 0e0 END AS w,
    CAST(s_mi IS NOT NULL AS INT) + CAST(s_wg IS NOT NULL AS INT) + CAST(s_svd IS NOT NULL AS INT) + CAST(s_kg IS NOT NULL AS INT)
      + CAST(s_di IS NOT NULL AS INT) + CAST(s_fa IS NOT NULL AS INT) + CAST(s_dn IS NOT NULL AS INT) + CAST(s_go IS NOT NULL AS INT) AS k,
    coalesce(s_mi >= 9.5e0, true) AND coalesce(s_wg >= 9.5e0, true) AND coalesce(s_svd >= 9.5e0, true) AND coalesce(s_kg >= 9.5e0, true)
      AND coalesce(s_di >= 9.5e0, true) AND coalesce(s_fa >= 9.5e0, true) AND coalesce(s_dn >= 9.5e0, true) AND coalesce(s_go >= 9.5e0, true) AS perfect
  FROM src
),
meaned AS (
  SELECT *, ws / w * CASE k WHEN 1 THEN 0.88e0 WHEN 2 THEN 0.95e0 ELSE 1e0 END AS m0 FROM summed WHERE k > 0
),
capped AS (
  SELECT *, CASE WHEN visited THEN least(m0, 7e0) ELSE m0 END AS m FROM meaned
),
final AS (
  SELECT *, CASE WHEN starred THEN m WHEN prestige THEN least(m, 9.5e0) ELSE least(m, 8e0) END * 10e0 AS raw FROM capped
)
SELECT facts.idx,
  CAST(CASE WHEN floor(raw + 0.5e0) >= 100 AND NOT (starred AND perfect) THEN 99 ELSE floor(raw + 0.5e0) END AS INT) AS composite_score,
  round(raw, 6) AS composite_score_raw
FROM facts LEFT JOIN final USING (idx)"""


def time_decay(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(score.time_decay(F.col("o_orderdate").cast("string"), P.as_of()), 9).alias("decay"))


def bayes_shrink(spark, d):
    """Ratings of customers, shrunk by their number of orders."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("votes"))
    c = table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    rating = (10 + F.col("c_custkey") % 41) / 10
    return c.select("c_custkey", F.round(score.crowd_score(rating, F.coalesce("votes", F.lit(0)) * 7), 9).alias("shrunk"))


def top_scored(spark, d):
    return stats.top_scored(scored(spark, d), 20).select("idx", "name", "composite_score", F.round("composite_score_raw", 6).alias("composite_score_raw"))


def score_summary(spark, d):
    return stats.score_summary(scored(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


def score_histogram(spark, d):
    return stats.score_histogram(scored(spark, d))


def region_leaderboard(spark, d):
    return stats.region_leaderboard(scored(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


def rating_coverage(spark, d):
    return stats.merge_stats(P.rated_venues(spark, d))


def display_values(spark, d):
    """Colours, icon buckets, stars and best rating of every order."""
    s = (F.col("o_orderkey") * 7 % 101).cast("int")
    google = F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 51) / 10)
    krog = F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 41) / 10)
    best = display.best_numeric_rating(google, krog)
    st = display.stars(best)
    return table(spark, d, "orders").select(
        "o_orderkey", display.score_color(s).alias("fill"), display.score_stroke_color(s).alias("stroke"),
        display.icon_bucket(s).alias("bucket"), best.alias("best"),
        st["full"].alias("full_stars"), st["half"].alias("half_star"), st["empty"].alias("empty_stars"),
    )


DISPLAY_SQL = """
WITH o AS (
  SELECT o_orderkey, CAST(o_orderkey * 7 % 101 AS INT) AS s,
    coalesce(CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 51) / 10e0 END, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 41) / 10e0 END) AS best
  FROM orders
),
seg AS (
  SELECT *, CASE WHEN s <= 25 THEN 0 WHEN s <= 50 THEN 25 WHEN s <= 75 THEN 50 ELSE 75 END AS s0 FROM o
),
mix AS (
  SELECT *, (s - s0) / 25e0 AS t,
    CASE s0 WHEN 0 THEN 0e0 WHEN 25 THEN 15e0 WHEN 50 THEN 45e0 ELSE 90e0 END AS h0,
    CASE s0 WHEN 0 THEN 15e0 WHEN 25 THEN 30e0 WHEN 50 THEN 45e0 ELSE 50e0 END AS dh,
    CASE s0 WHEN 0 THEN 70e0 WHEN 25 THEN 80e0 WHEN 50 THEN 90e0 ELSE 60e0 END AS a0,
    CASE s0 WHEN 0 THEN 10e0 WHEN 25 THEN 10e0 WHEN 50 THEN -30e0 ELSE -10e0 END AS da,
    CASE s0 WHEN 0 THEN 45e0 WHEN 25 THEN 48e0 WHEN 50 THEN 50e0 ELSE 42e0 END AS l0,
    CASE s0 WHEN 0 THEN 3e0 WHEN 25 THEN 2e0 WHEN 50 THEN -8e0 ELSE -10e0 END AS dl
  FROM seg
),
col AS (
  SELECT *, CAST(floor(h0 + t * dh + 0.5e0) AS INT) AS h, CAST(floor(a0 + t * da + 0.5e0) AS INT) AS a, CAST(floor(l0 + t * dl + 0.5e0) AS INT) AS l FROM mix
)
SELECT o_orderkey,
  CASE WHEN s >= 100 THEN 'hsl(43, 80%, 50%)' ELSE concat('hsl(', h, ', ', a, '%, ', l, '%)') END AS fill,
  concat('hsl(', h, ', ', a, '%, ', l - 10, '%)') AS stroke,
  CAST(floor(s / 5e0 + 0.5e0) AS BIGINT) * 5 AS bucket, best,
  CAST(floor(best) AS INT) AS full_stars, best - floor(best) >= 0.3e0 AS half_star,
  5 - CAST(floor(best) AS INT) - CAST(best - floor(best) >= 0.3e0 AS INT) AS empty_stars
FROM col"""

QUERIES = {
    "composite_score_rank": (composite_score_rank, f"""WITH {SCORED_SQL}
      SELECT idx, name, category, metro_region, score AS composite_score, round(raw, 6) AS composite_score_raw, rank_national, rank_region FROM ranked"""),
    "normalized_ratings": (normalized_ratings, f"""WITH {SCORED_SQL},
      long AS (SELECT idx, unnest([{{'s': 'michelin', 'v': s_mi}}, {{'s': 'whiteguide', 'v': s_wg}}, {{'s': 'svd', 'v': s_svd}}, {{'s': 'di', 'v': s_di}},
        {{'s': 'krogguiden', 'v': s_kg}}, {{'s': 'falstaff', 'v': s_fa}}, {{'s': 'dn', 'v': s_dn}}, {{'s': 'thatsup', 'v': s_th}}, {{'s': 'google', 'v': s_go}}]) AS e FROM scored)
      SELECT idx, e.s AS source, floor(e.v * 100e0 + 0.5e0) / 100e0 AS value FROM long WHERE e.v IS NOT NULL"""),
    "legacy_score": (legacy_score, LEGACY_SQL),
    "time_decay": (time_decay, """
      WITH a AS (SELECT o_orderkey, (epoch_ms(TIMESTAMP '2003-01-01') - epoch_ms(o_orderdate)) / 31557600000e0 AS y FROM orders)
      SELECT o_orderkey, round(CASE WHEN y <= 3e0 THEN 1e0 ELSE greatest(0.4e0, 1e0 - (y - 3e0) * 0.15e0) END, 9) AS decay FROM a"""),
    "bayes_shrink": (bayes_shrink, """
      WITH v AS (SELECT c_custkey, count(o_orderkey) * 7 AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
      SELECT c_custkey, round(least(1e0, n / 100e0) * ((10 + c_custkey % 41) / 10e0 / 5e0 * 10e0) + (1e0 - least(1e0, n / 100e0)) * 7e0, 9) AS shrunk FROM v"""),
    "top_scored": (top_scored, f"""WITH {SCORED_SQL}
      SELECT idx, name, score AS composite_score, round(raw, 6) AS composite_score_raw FROM scored WHERE score > 0 ORDER BY raw DESC, idx LIMIT 20"""),
    "score_summary": (score_summary, f"""WITH {SCORED_SQL}
      SELECT count(*) AS venues, count(*) FILTER (score > 0) AS scored, round(avg(score) FILTER (score > 0), 6) AS mean_score, count(*) FILTER (score = 100) AS perfect FROM scored"""),
    "score_histogram": (score_histogram, f"""WITH {SCORED_SQL}
      SELECT CAST(floor(score / 10e0) AS INT) * 10 AS bucket, count(*) AS n FROM scored GROUP BY 1"""),
    "region_leaderboard": (region_leaderboard, f"""WITH {SCORED_SQL}
      SELECT metro_region AS region, count(*) AS venues, round(avg(score) FILTER (score > 0), 6) AS mean_score,
        first(name ORDER BY raw DESC, idx) AS best_name FROM scored GROUP BY 1 HAVING count(*) FILTER (score > 0) > 0"""),
    "rating_coverage": (rating_coverage, f"""WITH {FACTS_SQL}
      SELECT count(*) AS venues, count(*) FILTER (idx * 37 % 1500 >= 0) AS with_coordinates, count(*) FILTER (p_size % 10 <= 6) AS rated_michelin,
        count(*) FILTER (n % 6 <= 3) AS rated_whiteguide, count(*) FILTER (mx >= 48) AS rated_svd, count(*) FILTER (mn <= 2) AS rated_dn,
        count(*) FILTER (p_size > 25) AS rated_di, count(*) FILTER (n % 4 = 0) AS rated_krogguiden,
        count(*) FILTER (r % 3 = 0) AS rated_falstaff, count(*) FILTER (n % 7 > 1) AS rated_thatsup FROM facts"""),
    "display_values": (display_values, DISPLAY_SQL),
}
