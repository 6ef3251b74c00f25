"""Matching, consolidation, slug and dedup queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill import schemas
from venuemill.functions import text
from venuemill.operators import consolidate, dedup, fuzzy, resolve, slugs
from venuemill.plans import pipeline
from venuemill.plans.proxies import pick, table
from venuemill.session import dealt, spread


def exact_alias_match(spark, d):
    """Every part as a row against all parts as venues, by key, then alias."""
    p = table(spark, d, "part")
    size = F.col("p_size")
    name = (
        F.when(size < 10, F.concat("p_name", F.lit(" Corner")))
        .when(size < 20, F.concat(F.lit("Restaurang "), "p_name", F.lit(" Bar")))
        .when(size < 30, F.concat("p_name", F.lit(" Unknown")))
        .otherwise(F.col("p_name"))
    )
    rows = p.select(F.col("p_partkey").alias("row_id"), text.name_key(name).alias("key"),
                    F.concat(F.lit("BRAND#"), (size % 25 + 1).cast("string")).alias("city"))
    venues = p.select(F.col("p_partkey").alias("venue_ord"), text.name_key(F.col("p_name")).alias("key"), F.col("p_brand").alias("city"))
    known = p.select(F.col("p_name").alias("canonical_name"), F.concat("p_name", F.lit(" corner")).alias("alias"), F.col("p_partkey").alias("pos"))
    out = resolve.exact_match(rows, venues, resolve.alias_keys(known))
    return out.select("row_id", "venue_ord", "match_kind")


EXACT_SQL = """
WITH r AS (
  SELECT p_partkey AS row_id, CASE WHEN p_size < 10 THEN NULL WHEN p_size < 20 THEN p_name WHEN p_size < 30 THEN NULL ELSE p_name END AS direct,
    CASE WHEN p_size < 10 THEN p_name END AS aliased, 'brand#' || (p_size % 25 + 1) AS city FROM part
),
f AS (SELECT p_name, min(p_partkey) AS first_ord FROM part GROUP BY 1),
c AS (SELECT p_name, lower(p_brand) AS city, min(p_partkey) AS city_ord FROM part GROUP BY 1, 2)
SELECT row_id, coalesce(c.city_ord, f.first_ord) AS venue_ord,
  CASE WHEN direct IS NOT NULL THEN 'exact' WHEN aliased IS NOT NULL THEN 'alias' END AS match_kind
FROM r LEFT JOIN f ON f.p_name = coalesce(direct, aliased) LEFT JOIN c ON c.p_name = coalesce(direct, aliased) AND c.city = r.city"""


def _typo(name):
    """One letter off, at a place that depends on the row."""
    at = (F.col("p_partkey") % F.length(name)).cast("int")
    return F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.length(name)))


def fuzzy_match_best(spark, d):
    """Misspelt part names against all part names."""
    full = F.lower(F.concat("p_name", F.lit(" "), "p_type"))
    p = table(spark, d, "part").withColumn("full", full)
    address = F.concat("p_brand", F.lit(" street "), F.col("p_size").cast("string"))
    rows = p.select(
        F.col("p_partkey").alias("row_id"), _typo(F.col("full")).alias("key"),
        F.when(F.col("p_size") % 5 > 0, address).alias("address"),
        F.concat(F.lit("Brand#"), (F.col("p_size") % 30 + 1).cast("string")).alias("city"),
        F.when(F.col("p_size") % 5 > 0, F.lit(0.85)).otherwise(F.lit(0.90)).alias("threshold"),
    )
    venues = p.select(F.col("p_partkey").alias("venue_ord"), F.col("full").alias("key"), address.alias("address"), F.col("p_brand").alias("city"))
    out = fuzzy.best_fuzzy_match(rows, venues)
    return out.select("row_id", "venue_ord", F.round("name_similarity", 9).alias("name_similarity"),
                      F.round("address_similarity", 9).alias("address_similarity"), F.round("combined_score", 9).alias("combined_score"))


FUZZY_SQL = """
WITH p AS (SELECT *, lower(p_name || ' ' || p_type) AS nm FROM part),
r AS (
  SELECT p_partkey AS row_id, nm[1:p_partkey % length(nm)] || nm[p_partkey % length(nm) + 2:] AS key,
    CASE WHEN p_size % 5 > 0 THEN lower(p_brand) || ' street' END AS street, CAST(p_size AS VARCHAR) AS num,
    'brand#' || (p_size % 30 + 1) AS city, CASE WHEN p_size % 5 > 0 THEN 0.85e0 ELSE 0.9e0 END AS threshold FROM p
),
rk AS (SELECT DISTINCT key FROM r),
vk AS (SELECT DISTINCT nm FROM p),
pairs AS (
  SELECT key, nm, 1e0 - levenshtein(key, nm) / CAST(greatest(length(key), length(nm)) AS DOUBLE) AS ns
  FROM rk, vk WHERE key <> nm AND 1e0 - levenshtein(key, nm) / CAST(greatest(length(key), length(nm)) AS DOUBLE) >= 0.85e0
),
cand AS (
  SELECT row_id, p.p_partkey AS venue_ord, ns, lower(p.p_brand) = r.city AS in_city,
    CASE WHEN street IS NULL THEN 0e0 ELSE
      CASE WHEN street = lower(p.p_brand) || ' street' THEN 1e0 ELSE 1e0 - levenshtein(street, lower(p.p_brand) || ' street')
        / CAST(greatest(length(street), length(p.p_brand || ' street')) AS DOUBLE) END * 0.7e0
      + CASE WHEN num = CAST(p.p_size AS VARCHAR) THEN 1e0 ELSE 0e0 END * 0.3e0 END AS adr
  FROM r JOIN pairs USING (key) JOIN p ON p.nm = pairs.nm WHERE ns >= threshold
)
SELECT row_id, venue_ord, round(ns, 9) AS name_similarity, round(adr, 9) AS address_similarity, round(ns * 0.8e0 + adr * 0.2e0, 9) AS combined_score
FROM cand QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY in_city DESC, ns * 0.8e0 + adr * 0.2e0 DESC, venue_ord) = 1"""


def slug_unique(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("venue_ord"), F.col("p_name").alias("name"),
                                       F.when(F.col("p_size") % 4 > 0, F.lower("p_type")).alias("city"))
    return slugs.unique_slugs(p).select("venue_ord", "id")


def slug_contested(spark, d):
    """Cities that end in numbers, so that counters meet literal slugs."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("venue_ord"), F.col("p_name").alias("name"),
                                       F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise(F.lit("Brand")).alias("city"))
    return slugs.unique_slugs(p).select("venue_ord", "id")


PASS_SOURCES = ["", "whiteguide-review", "krogguiden", "michelin", "di", "dn-review", "svd-review", "falstaff"]
RATING_KEYS = ["", "whiteguide", "krogguiden", "michelin", "di", "dn", "svd", "falstaff"]


def _line_order():
    return F.struct(F.col("l_linenumber").alias("pass"), (F.col("l_orderkey") * 10_000_000 + F.col("l_suppkey")).alias("pos"), F.col("l_partkey").cast("int").alias("sub"))


def _line_rows(spark, d, founded=False):
    """Line items as rows about their part: the line number is the pass.  With ``founded`` lines are dealt by part to tasks of bounded size,
    and the founder stands beside them before texts are made of them."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    lines = table(spark, d, "lineitem")
    if founded:
        lines = dealt(lines, "l_partkey").withColumn("venue_ord", F.min(_line_order()).over(Window.partitionBy("l_partkey")))
    x = lines.join(p, F.col("l_partkey") == F.col("p_partkey"))
    ln, qty = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    order = _line_order()
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return x.select(
        "l_partkey", order.alias("ord"), pick(PASS_SOURCES, ln).alias("source_id"), pick(RATING_KEYS, ln).alias("rating_key"),
        F.lit(0.0).alias("scale_min"), F.lit(100.0).alias("scale_max"), F.lit(False).alias("is_sub"),
        F.concat("p_name", F.lit(" "), ln.cast("string"), F.lit("-"), (qty % 3).cast("string")).alias("name"),
        F.when(qty % 4 == 0, F.concat(F.lit("street "), qty.cast("string"))).alias("address"),
        F.when(qty % 3 == 0, F.concat(F.lit("city "), qty.cast("string"))).alias("match_city"),
        F.when(qty % 3 == 0, F.concat(F.lit("city "), qty.cast("string"))).alias("fill_city"),
        pick(["restaurant", "bar", "cafe", "hotel"], qty % 4).alias("venue_type"),
        (qty % 10).cast("double").alias("score"), pick(["", "budget", "lyx"], qty % 3).alias("price_range"),
        F.when(qty % 5 == 0, (qty + 10).cast("double")).alias("lat"), F.when(qty % 5 == 0, (qty + 20).cast("double")).alias("lng"),
        F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("article_id"),
        F.concat(F.lit("u"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("url"),
        F.lit("review").alias("content_type"), F.when(qty % 2 == 0, day).otherwise(F.lit("")).alias("published_at"),
        F.concat(F.lit("text "), F.expr("repeat('x', cast(l_quantity as int))")).alias("body_text"),
        F.when(qty % 2 == 0, F.array(F.concat(F.lit("tag"), qty.cast("string")))).alias("tags"),
        F.lit(None).cast(schemas.SUB_SCORES).alias("explicit_sub_scores"), qty.alias("review_count"), *(["venue_ord"] if founded else []),
    )


def _line_mentions(spark, d):
    """Line items as mentions of their part, which the first of them founds."""
    return _line_rows(spark, d, founded=True)


def consolidate_first(spark, d):
    v = consolidate.consolidate(_line_mentions(spark, d), ("l_partkey",))
    r = F.col("ratings")
    return v.select(
        F.concat_ws(":", F.col("venue_ord.pass"), F.col("venue_ord.pos"), F.col("venue_ord.sub")).alias("founder"),
        "name", "address", "city", "venue_type", "price_range", "lat", "lng", "source_count",
        F.array_join(F.transform("sources", lambda s: s["source_id"]), ",").alias("source_ids"),
        F.element_at("sources", 1)["url"].alias("first_url"),
        F.array_join(F.transform("quotes", lambda q: q["source_id"]), ",").alias("quoted"),
        r["michelin"]["distinction"].alias("distinction"), r["michelin"]["score"].alias("michelin_score"),
        r["whiteguide"]["classification"].alias("classification"), r["whiteguide"].isNotNull().alias("has_guide"),
        r["di"]["score"].alias("di"), r["di"]["published_at"].alias("di_at"), r["svd"]["score"].alias("svd"),
        r["krogguiden"]["review_count"].alias("kg_reviews"), r["dn"]["score"].alias("dn"), r["falstaff"]["score"].alias("falstaff"),
    )


CONSOLIDATE_SQL = """
WITH m AS (
  SELECT l_partkey, p_name, l_linenumber AS ln, l_orderkey AS o, l_suppkey AS s, CAST(l_quantity AS INT) AS q,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey, l_suppkey) AS rn,
    CASE l_linenumber WHEN 1 THEN 'whiteguide-review' WHEN 2 THEN 'krogguiden' WHEN 3 THEN 'michelin' WHEN 4 THEN 'di' WHEN 5 THEN 'dn-review' WHEN 6 THEN 'svd-review' ELSE 'falstaff' END AS src,
    p_name || ' ' || l_linenumber || '-' || (CAST(l_quantity AS INT) % 3) AS nm, strftime(l_shipdate, '%Y-%m-%d') AS day
  FROM lineitem JOIN part ON p_partkey = l_partkey
),
a AS (
  SELECT l_partkey,
    first(ln || ':' || (o * 10000000 + s) || ':' || l_partkey ORDER BY rn) AS founder,
    last(nm ORDER BY rn) FILTER (ln = 3) AS n3, last(nm ORDER BY rn) FILTER (ln = 1) AS n1, last(nm ORDER BY rn) FILTER (ln = 5) AS n5,
    last(nm ORDER BY rn) FILTER (ln = 6) AS n6, last(nm ORDER BY rn) FILTER (ln = 4) AS n4, last(nm ORDER BY rn) FILTER (ln = 2) AS n2,
    last(nm ORDER BY rn) FILTER (ln = 7) AS n7,
    first('street ' || q ORDER BY rn) FILTER (q % 4 = 0) AS address, first('city ' || q ORDER BY rn) FILTER (q % 3 = 0) AS city,
    count(*) FILTER (ln = 3 AND q % 4 = 3) AS hotels,
    first(CASE q % 4 WHEN 1 THEN 'bar' WHEN 2 THEN 'cafe' ELSE 'hotel' END ORDER BY rn) FILTER (q % 4 > 0 AND (ln <> 3 OR rn = 1)) AS kind,
    first(CASE q % 3 WHEN 1 THEN 'budget' ELSE 'lyx' END ORDER BY rn) FILTER (q % 3 > 0) AS price,
    first(q ORDER BY rn) FILTER (q % 5 = 0) AS geo, count(DISTINCT ln) AS sources,
    first('u' || o || '-' || s ORDER BY rn) AS first_url, first('tag' || q ORDER BY rn) FILTER (ln = 3 AND q % 2 = 0) AS distinction,
    first(q % 10 ORDER BY rn) FILTER (ln = 3 AND q % 2 = 0) AS mscore,
    first(CASE WHEN q % 2 = 0 THEN 'tag' || q ELSE '-' END ORDER BY rn) FILTER (ln = 1) AS cls, count(*) FILTER (ln = 1) AS guide,
    first(q % 10 ORDER BY rn) FILTER (ln = 4 AND q % 10 > 0) AS di, first(CASE WHEN q % 2 = 0 THEN day ELSE '-' END ORDER BY rn) FILTER (ln = 4 AND q % 10 > 0) AS di_at,
    first(q % 10 ORDER BY rn) FILTER (ln = 6 AND q % 10 > 0) AS svd, first(q ORDER BY rn) FILTER (ln = 2 AND q % 10 > 0) AS kg,
    first(q % 10 ORDER BY rn) FILTER (ln = 5 AND q % 10 > 0) AS dn, first(q % 10 ORDER BY rn) FILTER (ln = 7 AND q % 10 > 0) AS fa
  FROM m GROUP BY l_partkey
),
f AS (SELECT l_partkey, src, min(rn) AS rn FROM m GROUP BY 1, 2),
fs AS (SELECT l_partkey, string_agg(src, ',' ORDER BY rn) AS source_ids FROM f GROUP BY 1),
z AS (SELECT l_partkey, src, min(rn) AS rn FROM m WHERE ln <> 2 AND q + 5 >= 20 GROUP BY 1, 2),
zs AS (SELECT l_partkey, string_agg(src, ',' ORDER BY rn) AS quoted FROM z GROUP BY 1)
SELECT founder, coalesce(n3, n1, n5, n6, n4, n2, n7) AS name, coalesce(address, '') AS address, coalesce(city, '') AS city,
  CASE WHEN hotels > 0 THEN 'hotel' ELSE coalesce(kind, 'restaurant') END AS venue_type, coalesce(price, '') AS price_range,
  CAST(geo + 10 AS DOUBLE) AS lat, CAST(geo + 20 AS DOUBLE) AS lng, CAST(sources AS INT) AS source_count, source_ids, first_url, coalesce(quoted, '') AS quoted,
  distinction, CAST(mscore AS DOUBLE) AS michelin_score, nullif(cls, '-') AS classification, guide > 0 AS has_guide,
  CAST(di AS DOUBLE) AS di, nullif(di_at, '-') AS di_at, CAST(svd AS DOUBLE) AS svd, kg AS kg_reviews, CAST(dn AS DOUBLE) AS dn, CAST(fa AS DOUBLE) AS falstaff
FROM a JOIN fs USING (l_partkey) LEFT JOIN zs USING (l_partkey)"""


def article_refs(spark, d):
    """Distinct articles behind each part and source, counted."""
    refs = consolidate.article_refs(_line_rows(spark, d).withColumn("venue_ord", F.col("l_partkey")))
    return refs.groupBy(F.col("venue_ord").alias("part"), "source_id").agg(F.count(F.lit(1)).alias("articles"))


def _placed(spark, d):
    """Parts that share a place id by name and type."""
    p, size = table(spark, d, "part"), F.col("p_size")

    def numeric(when):
        return F.when(when, F.struct(
            (size % 7).cast("double").alias("score"), F.lit(0.0).alias("scale_min"), F.lit(5.0).alias("scale_max"),
            F.lit(None).cast(schemas.SUB_SCORES).alias("sub_scores"), F.lit(None).cast("string").alias("published_at"),
            size.alias("review_count")))

    ratings = F.struct(
        F.when(size % 9 == 0, F.struct(F.concat(F.lit("d"), size.cast("string")).alias("distinction"), F.lit(1.0).alias("score"))).alias("michelin"),
        F.lit(None).cast(schemas.RATINGS["whiteguide"].dataType).alias("whiteguide"),
        *[numeric(size % 11 == i).alias(k) for i, k in enumerate(consolidate.NUMERIC_KEYS)],
    )
    def source(i, when):
        return F.when(when, F.struct(F.lit(f"s{i}").alias("source_id"), F.concat(F.lit(f"u{i}-"), F.col("p_partkey").cast("string")).alias("url")))

    sources = F.filter(F.array(source(0, size > 0), source(1, size % 2 == 0), source(2, size % 3 == 0), source(3, size % 5 == 0)), lambda s: s.isNotNull())
    quotes = F.filter(F.array(source(0, size % 13 == 0), source(2, size % 17 == 0)), lambda s: s.isNotNull())
    return p.select(
        F.col("p_partkey").alias("idx"), "p_name", F.concat("p_name", F.lit(" "), "p_brand").alias("name"),
        F.when(size % 10 > 0, F.concat("p_name", F.lit("/"), "p_type")).alias("place_id"),
        pick(["", "street"], (size % 4 == 0).cast("int")).alias("address"), F.when(size % 3 == 1, F.col("p_brand")).alias("city"),
        pick(["", "budget", "lyx"], size % 3).alias("price_range"), ratings.alias("ratings"), sources.alias("sources"), quotes.alias("quotes"),
        F.size(sources).alias("source_count"))


def dedup_keeper(spark, d):
    out = dedup.dedup_by_place(_placed(spark, d))
    r = F.col("ratings")
    return out.select(
        "idx", "name", "place_id", "address", "city", "price_range", "source_count",
        F.array_join(F.transform("sources", lambda s: s["url"]), ",").alias("urls"),
        F.array_join(F.transform("quotes", lambda s: s["url"]), ",").alias("quote_urls"),
        r["michelin"]["distinction"].alias("distinction"), r["svd"]["review_count"].alias("svd_size"), r["di"]["review_count"].alias("di_size"))


_PLACED_SQL = """p AS (
  SELECT p_partkey AS idx, p_name || ' ' || p_brand AS name, CASE WHEN p_size % 10 > 0 THEN p_name || '/' || p_type END AS place_id,
    CASE WHEN p_size % 4 = 0 THEN 'street' ELSE '' END AS address, CASE WHEN p_size % 3 = 1 THEN p_brand END AS city,
    CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'budget' ELSE 'lyx' END AS price, p_size AS z,
    1 + CAST(p_size % 2 = 0 AS INT) + CAST(p_size % 3 = 0 AS INT) + CAST(p_size % 5 = 0 AS INT) AS sc
  FROM part
),
k AS (SELECT *, coalesce(place_id, 'row' || idx) AS g, row_number() OVER (PARTITION BY coalesce(place_id, 'row' || idx) ORDER BY sc DESC, idx) AS rn FROM p)"""

DEDUP_SQL = f"""
WITH {_PLACED_SQL},
a AS (
  SELECT g, first(idx ORDER BY rn) AS idx, first(name ORDER BY rn) AS name, first(place_id ORDER BY rn) AS place_id,
    coalesce(first(address ORDER BY rn) FILTER (address <> ''), '') AS address,
    first(city ORDER BY rn) FILTER (city IS NOT NULL) AS city, coalesce(first(price ORDER BY rn) FILTER (price <> ''), '') AS price_range,
    first('d' || z ORDER BY rn) FILTER (z % 9 = 0) AS distinction, first(z ORDER BY rn) FILTER (z % 11 = 0) AS svd_size, first(z ORDER BY rn) FILTER (z % 11 = 2) AS di_size
  FROM k GROUP BY g
),
e AS (
  SELECT g, rn, 0 AS i, 'u0-' || idx AS u FROM k UNION ALL SELECT g, rn, 1, 'u1-' || idx FROM k WHERE z % 2 = 0
  UNION ALL SELECT g, rn, 2, 'u2-' || idx FROM k WHERE z % 3 = 0 UNION ALL SELECT g, rn, 3, 'u3-' || idx FROM k WHERE z % 5 = 0
),
e1 AS (SELECT g, i, min(rn) AS rn, first(u ORDER BY rn) AS u FROM e GROUP BY 1, 2),
e2 AS (SELECT g, string_agg(u, ',' ORDER BY rn, i) AS urls, CAST(count(*) AS INT) AS source_count FROM e1 GROUP BY 1),
q AS (SELECT g, rn, 0 AS i, 'u0-' || idx AS u FROM k WHERE z % 13 = 0 UNION ALL SELECT g, rn, 2, 'u2-' || idx FROM k WHERE z % 17 = 0),
q1 AS (SELECT g, i, min(rn) AS rn, first(u ORDER BY rn) AS u FROM q GROUP BY 1, 2),
q2 AS (SELECT g, string_agg(u, ',' ORDER BY rn, i) AS quote_urls FROM q1 GROUP BY 1)
SELECT idx, name, place_id, address, city, price_range, source_count, urls, coalesce(quote_urls, '') AS quote_urls, distinction, svd_size, di_size
FROM a JOIN e2 USING (g) LEFT JOIN q2 USING (g)"""


def known_merges(spark, d):
    return dedup.known_merges(_placed(spark, d)).select("place_id", "canonical_name", "alias", "pos")


def upsert_known_merges(spark, d):
    """Aliases of one run merged into those of an older run."""
    p = table(spark, d, "part")
    old = p.where("p_size > 20").select(F.col("p_type").alias("place_id"), F.lit("old").alias("canonical_name"), F.col("p_name").alias("alias"), F.col("p_partkey").alias("pos"))
    new = p.where("p_size <= 30").select(F.col("p_type").alias("place_id"), F.lit("new").alias("canonical_name"), F.concat("p_name", F.lit(" "), "p_brand").alias("alias"), F.col("p_partkey").alias("pos"))
    return dedup.upsert_known_merges(old, new)


def guide_articles_of(spark, d):
    """Articles of two guides about every part; the second one misspells."""
    full = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    p = spread(table(spark, d, "part"), "p_partkey").withColumn("full", full)

    def articles(source_id, name, address, score):
        given = {
            "id": F.concat(F.lit(source_id), F.col("p_partkey").cast("string")), "source_id": F.lit(source_id),
            "url": F.concat(F.lit(f"https://{source_id}.example/"), F.col("p_partkey").cast("string")), "title": name,
            "published_at": F.lit(""), "content_type": F.lit("review"), "body_text": F.lit(""), "venue_type": F.lit("restaurant"),
            "venue_name": name, "venue_address": address, "venue_city": F.col("p_brand"), "score": score, "tags": F.array(F.lit("God klass")),
        }
        return p.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ARTICLE.fields], F.col("p_partkey").alias("pos"))

    address = F.concat("p_brand", F.lit(" street "), F.col("p_size").cast("string"))
    return articles("whiteguide-review", F.col("full"), address, F.lit(None)).unionByName(
        articles("krogguiden", _typo(F.col("full")), F.when(F.col("p_size") % 5 > 0, address), F.col("p_size") % 6))


def resolve_mentions(spark, d):
    """Two guides about all parts, resolved in source order."""
    out = resolve.resolve(resolve.articles_to_mentions(guide_articles_of(spark, d)))
    return out.select("article_id", "match_kind", F.concat_ws(":", "venue_ord.pass", "venue_ord.pos").alias("venue"))


def fuzzy_customers(spark, d):
    """All customer names resolved in order; most resemble very many others."""
    mentions = table(spark, d, "customer").select(
        F.struct(F.lit(1).alias("pass"), F.col("c_custkey").alias("pos"), F.lit(0).alias("sub")).alias("ord"), F.lower("c_name").alias("key"),
        F.lit(None).cast("string").alias("address"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("match_city"),
        F.lit(0.85).alias("threshold"), F.lit(True).alias("can_found"))
    out = resolve.resolve(mentions)
    return out.select(F.col("ord.pos").alias("custkey"), F.col("venue_ord.pos").alias("founder"), "match_kind")


FUZZY_CUSTOMERS_SQL = """
WITH RECURSIVE m AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i, lower(c_name) AS key, c_nationkey AS city FROM customer),
sim AS (
  SELECT a.i, b.i AS j, 1e0 - levenshtein(a.key, b.key) / CAST(greatest(length(a.key), length(b.key)) AS DOUBLE) AS s
  FROM m a JOIN m b ON b.i < a.i WHERE 1e0 - levenshtein(a.key, b.key) / CAST(greatest(length(a.key), length(b.key)) AS DOUBLE) >= 0.85e0
),
pred AS (SELECT i, list(j) AS js FROM sim GROUP BY i),
walk(i, f) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL SELECT w.i + 1, CASE WHEN list_has_any(w.f, coalesce(js, [])) THEN w.f ELSE list_append(w.f, w.i + 1) END
  FROM walk w LEFT JOIN pred ON pred.i = w.i + 1 WHERE w.i < (SELECT count(*) FROM m)
),
fl AS (SELECT unnest(f) AS i FROM (SELECT f FROM walk ORDER BY i DESC LIMIT 1)),
fz AS (
  SELECT sim.i, sim.j FROM sim JOIN fl ON fl.i = sim.j JOIN m ON m.i = sim.i JOIN m v ON v.i = sim.j WHERE sim.i NOT IN (SELECT i FROM fl)
  QUALIFY row_number() OVER (PARTITION BY sim.i ORDER BY m.city = v.city DESC, s DESC, sim.j) = 1
)
SELECT c_custkey AS custkey, c_custkey AS founder, 'founded' AS match_kind FROM fl JOIN m USING (i)
UNION ALL SELECT m.c_custkey, v.c_custkey, 'fuzzy' FROM fz JOIN m USING (i) JOIN m v ON v.i = fz.j"""


def merged_venues(spark, d):
    """The whole merge: mentions, venues, slugs."""
    v = pipeline.merge(guide_articles_of(spark, d))
    return v.select("id", "name", "address", "city", "source_count", F.col("ratings.krogguiden.score").alias("krogguiden"))


def nine_passes_of(spark, d):
    """(articles, known merges): every part in three or so of the nine passes, with misspellings, nicknames, listings and news,
    sub-articles, and rows without address and city."""
    p, k, size = spread(table(spark, d, "part"), "p_partkey"), F.col("p_partkey"), F.col("p_size")
    full = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    address = F.when(size % 5 > 0, F.concat("p_brand", F.lit(" street "), size.cast("string")))
    passes = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(source).alias("source")) for n, source, *_ in V.SOURCE_PASSES])
    rows = p.withColumn("full", full).select("*", F.explode(passes).alias("at")).where((k + F.col("at.n")) % 3 == 0)
    n, source = F.col("at.n"), F.col("at.source")
    name = F.when(n.isin(2, 4, 8), _typo(F.col("full"))).when((n == 9) & (k % 5 == 0), F.concat(F.lit("Nick "), "full")).otherwise(F.col("full"))
    part = schemas.SUB_ARTICLE

    def sub(**given):
        return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in part.fields])

    subs = F.array(sub(venue_name=F.col("full")), sub(venue_name=_typo(F.col("full")), venue_address=address, venue_city=F.when(size % 2 == 0, F.col("p_brand"))))
    given = {
        "id": F.concat(source, k.cast("string")), "source_id": source, "url": F.concat(source, F.lit("/"), k.cast("string")), "title": name,
        "published_at": F.lit(""), "content_type": F.when((k + n) % 7 > 0, "review").when(k % 2 == 0, "listing").otherwise("news"),
        "body_text": F.lit(""), "venue_type": F.lit("restaurant"), "venue_name": name, "venue_address": address,
        "venue_city": F.when(size % 10 > 0, F.col("p_brand")), "score": (size % 6).cast("double"),
        "sub_articles": F.when((n == 5) & (k % 4 < 2), subs),
    }
    articles = rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ARTICLE.fields], k.alias("pos"))
    known = p.select(full.alias("canonical_name"), F.concat(F.lit("nick "), full).alias("alias"), k.alias("pos"))
    return articles, known


def merged_all_passes(spark, d):
    """The whole merge over nine passes, fed with known merges."""
    v = pipeline.merge(*nine_passes_of(spark, d))
    return v.select(
        "id", "name", "address", "city", "source_count", F.array_join(F.transform("sources", lambda s: s["source_id"]), ",").alias("source_ids"),
        F.concat_ws(":", "idx.pass", "idx.pos", "idx.sub").alias("founder"), F.col("ratings.dn.score").alias("dn"))


MERGED_ALL_SQL = """
WITH RECURSIVE p AS (
  SELECT *, p_name || ' ' || lower(p_type) AS nm, nm[1:p_partkey % length(nm)] || nm[p_partkey % length(nm) + 2:] AS typo,
    CASE WHEN p_size % 5 > 0 THEN p_size END AS num, CASE WHEN p_size % 10 > 0 THEN p_brand END AS city FROM part
),
s(i, src) AS (VALUES (1, 'whiteguide-review'), (2, 'krogguiden'), (3, 'michelin'), (4, 'di'), (5, 'dn-review'), (7, 'svd-review'), (8, 'falstaff'), (9, 'thatsup')),
art AS (
  SELECT p.*, i, src, CASE WHEN i IN (2, 4, 8) THEN typo WHEN i = 9 AND p_partkey % 5 = 0 THEN 'Nick ' || nm ELSE nm END AS name
  FROM p, s WHERE (p_partkey + i) % 3 = 0
),
m0 AS (
  SELECT i AS pass, p_partkey AS pos, 0 AS sub, name, city, city AS fill, num, p_brand, p_size, src,
    CASE WHEN i NOT IN (1, 3) AND (i = 7 OR num IS NULL) THEN 0.9e0 ELSE 0.85e0 END AS t, i IN (1, 3) OR num IS NOT NULL OR city IS NOT NULL AS can
  FROM art WHERE i IN (1, 3) OR (p_partkey + i) % 7 > 0
  UNION ALL
  SELECT 6, p_partkey, u, CASE u WHEN 0 THEN nm ELSE typo END, coalesce(CASE WHEN u = 1 AND p_size % 2 = 0 THEN p_brand END, city),
    CASE WHEN u = 1 AND p_size % 2 = 0 THEN p_brand END, CASE u WHEN 1 THEN num END, p_brand, p_size, src, 0.85e0, (u = 1 AND num IS NOT NULL) OR (u = 1 AND p_size % 2 = 0) OR city IS NOT NULL
  FROM art, (VALUES (0), (1)) x(u) WHERE i = 5 AND p_partkey % 4 < 2
),
m AS (SELECT *, lower(name) AS key, (pass, pos, sub) AS ord, lower(p_brand) || ' street' AS street FROM m0),
al AS (SELECT DISTINCT 'nick ' || nm AS key, nm AS canon FROM p),
n0 AS (SELECT key, t, min(ord) AS ord FROM m WHERE can GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (ORDER BY ord, key, t) AS i FROM n0),
k AS (SELECT DISTINCT key FROM m),
sim AS (
  SELECT a.key AS key, b.key AS other, 1e0 - levenshtein(a.key, b.key) / CAST(greatest(length(a.key), length(b.key)) AS DOUBLE) AS s
  FROM k a, k b WHERE a.key <> b.key AND abs(length(a.key) - length(b.key)) <= 6
    AND 1e0 - levenshtein(a.key, b.key) / CAST(greatest(length(a.key), length(b.key)) AS DOUBLE) >= 0.85e0
),
pred AS (
  SELECT i, list(j) AS js FROM (
    SELECT d.i, e.i AS j FROM n d JOIN n e ON e.key = d.key AND e.i < d.i
    UNION ALL SELECT d.i, e.i FROM n d JOIN al ON al.key = d.key JOIN n e ON e.key = al.canon AND e.i < d.i
    UNION ALL SELECT d.i, e.i FROM n d JOIN sim ON sim.key = d.key AND s >= d.t JOIN n e ON e.key = sim.other AND e.i < d.i
  ) GROUP BY i
),
walk(i, f) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL SELECT w.i + 1, CASE WHEN list_has_any(w.f, coalesce(js, [])) THEN w.f ELSE list_append(w.f, w.i + 1) END
  FROM walk w LEFT JOIN pred ON pred.i = w.i + 1 WHERE w.i < (SELECT count(*) FROM n)
),
fl AS (SELECT unnest(f) AS i FROM (SELECT f FROM walk ORDER BY i DESC LIMIT 1)),
v AS (SELECT m.* FROM fl JOIN n USING (i) JOIN m USING (ord)),
ex AS (
  SELECT m.ord, coalesce(a.ord, b.ord) AS vo FROM m LEFT JOIN v a ON a.key = m.key AND a.ord <= m.ord
  LEFT JOIN al ON al.key = m.key LEFT JOIN v b ON b.key = al.canon AND b.ord < m.ord WHERE coalesce(a.ord, b.ord) IS NOT NULL
),
fz AS (
  SELECT m.ord, v.ord AS vo FROM m JOIN sim ON sim.key = m.key AND s >= m.t JOIN v ON v.key = sim.other AND v.ord < m.ord
  WHERE m.ord NOT IN (SELECT ord FROM ex)
  QUALIFY row_number() OVER (PARTITION BY m.ord ORDER BY coalesce(v.city = m.city, false) DESC, s * 0.8e0 + CASE WHEN m.num IS NULL OR v.num IS NULL THEN 0e0 ELSE
    CASE WHEN m.street = v.street THEN 1e0 ELSE 1e0 - levenshtein(m.street, v.street) / CAST(greatest(length(m.street), length(v.street)) AS DOUBLE) END * 0.7e0
    + CASE WHEN m.num = v.num THEN 1e0 ELSE 0e0 END * 0.3e0 END * 0.2e0 DESC, v.ord) = 1
),
h AS (SELECT m.*, vo FROM m JOIN (SELECT * FROM ex UNION ALL SELECT * FROM fz) USING (ord)),
src AS (
  SELECT vo, src, min(ord) AS first, last(name ORDER BY ord) FILTER (pass <> 6) AS last_name, min(ord) FILTER (pass <> 6) AS named FROM h GROUP BY 1, 2
),
g AS (
  SELECT vo, coalesce(
      max(last_name) FILTER (src = 'michelin'), max(last_name) FILTER (src = 'whiteguide-review'), max(last_name) FILTER (src = 'dn-review'),
      max(last_name) FILTER (src = 'svd-review'), max(last_name) FILTER (src = 'di'), max(last_name) FILTER (src = 'krogguiden'),
      first(last_name ORDER BY named) FILTER (named IS NOT NULL)) AS name, string_agg(src, ',' ORDER BY first) AS source_ids, CAST(count(*) AS INT) AS source_count
  FROM src GROUP BY vo
),
f AS (
  SELECT vo, first(p_brand || ' street ' || p_size ORDER BY ord) FILTER (num IS NOT NULL) AS address,
    first(CASE WHEN ord = vo THEN city ELSE fill END ORDER BY ord) FILTER (CASE WHEN ord = vo THEN city ELSE fill END IS NOT NULL) AS city,
    first(name ORDER BY ord) AS founder_name, CAST(first(p_size % 6 ORDER BY ord) FILTER (pass = 5 AND p_size % 6 > 0) AS DOUBLE) AS dn
  FROM h GROUP BY vo
),
b AS (SELECT *, coalesce(name, founder_name) AS nm FROM g JOIN f USING (vo)),
r AS (
  SELECT *, replace(lower(nm), ' ', '-') || '-' || CASE WHEN city IS NULL THEN 'sweden' ELSE replace(lower(city), '#', '-') END AS base FROM b
)
SELECT CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '-' || row_number() OVER w END AS id, nm AS name, coalesce(address, '') AS address, coalesce(city, '') AS city,
  source_count, source_ids, vo[1] || ':' || vo[2] || ':' || vo[3] AS founder, dn FROM r WINDOW w AS (PARTITION BY base ORDER BY vo)"""


# walks each name's venues in order; slugs of different names never meet
CONTESTED_SQL = """
WITH RECURSIVE b AS (
  SELECT p_partkey AS venue_ord, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_name) AS c,
    replace(p_name, ' ', '-') || CASE WHEN p_size % 3 > 0 THEN '-' || replace(lower(p_brand), '#', '-') ELSE '-brand' END AS base
  FROM part
),
walk(p_name, i, venue_ord, id, used) AS (
  SELECT DISTINCT p_name, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]) FROM b
  UNION ALL
  SELECT p_name, i, venue_ord, id, list_append(used, id) FROM (
    SELECT b.p_name, b.i, b.venue_ord, w.used,
      list_filter(list_prepend(base, list_transform(range(2, c + 30), lambda n: base || '-' || n)), lambda s: NOT list_contains(w.used, s))[1] AS id
    FROM walk w JOIN b ON b.p_name = w.p_name AND b.i = w.i + 1
  )
)
SELECT venue_ord, id FROM walk WHERE i > 0"""

# walks the distinct names in order, collecting founders
RESOLVE_SQL = """
WITH RECURSIVE p AS (SELECT *, lower(p_name || ' ' || p_type) AS nm FROM part),
m AS (
  SELECT 'whiteguide-review' || p_partkey AS article_id, 1 AS pass, p_partkey AS pos, nm AS key, p_brand AS city, lower(p_brand) || ' street' AS street, p_size AS num, 0.85e0 AS t FROM p
  UNION ALL
  SELECT 'krogguiden' || p_partkey, 2, p_partkey, nm[1:p_partkey % length(nm)] || nm[p_partkey % length(nm) + 2:], p_brand,
    CASE WHEN p_size % 5 > 0 THEN lower(p_brand) || ' street' END, p_size, CASE WHEN p_size % 5 > 0 THEN 0.85e0 ELSE 0.9e0 END FROM p
),
n0 AS (SELECT key, t, min((pass, pos)) AS ord FROM m GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM n0),
k AS (SELECT DISTINCT key FROM m),
sim AS (
  SELECT a.key AS key, b.key AS other, 1e0 - levenshtein(a.key, b.key) / CAST(greatest(length(a.key), length(b.key)) AS DOUBLE) AS s
  FROM k a, k b WHERE a.key <> b.key AND abs(length(a.key) - length(b.key)) <= 4
    AND 1e0 - levenshtein(a.key, b.key) / CAST(greatest(length(a.key), length(b.key)) AS DOUBLE) >= 0.85e0
),
pred AS (
  SELECT i, list(j) AS js FROM (
    SELECT d.i, e.i AS j FROM n d JOIN n e ON e.key = d.key AND e.i < d.i
    UNION ALL SELECT d.i, e.i FROM n d JOIN sim ON sim.key = d.key AND s >= d.t JOIN n e ON e.key = sim.other AND e.i < d.i
  ) GROUP BY i
),
walk(i, f) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL SELECT w.i + 1, CASE WHEN list_has_any(w.f, coalesce(js, [])) THEN w.f ELSE list_append(w.f, w.i + 1) END
  FROM walk w LEFT JOIN pred ON pred.i = w.i + 1 WHERE w.i < (SELECT count(*) FROM n)
),
fl AS (SELECT unnest(f) AS i FROM (SELECT f FROM walk ORDER BY i DESC LIMIT 1)),
v AS (SELECT m.* FROM fl JOIN n USING (i) JOIN m ON (m.pass, m.pos) = n.ord),
ex AS (SELECT m.article_id, v.pass AS vp, v.pos AS vo FROM m JOIN v ON v.key = m.key AND (v.pass, v.pos) <= (m.pass, m.pos)),
fz AS (
  SELECT m.article_id, v.pass AS vp, v.pos AS vo FROM m JOIN sim ON sim.key = m.key AND s >= m.t JOIN v ON v.key = sim.other AND (v.pass, v.pos) < (m.pass, m.pos)
  WHERE m.article_id NOT IN (SELECT article_id FROM ex)
  QUALIFY row_number() OVER (PARTITION BY m.article_id ORDER BY v.city = m.city DESC, s * 0.8e0 + CASE WHEN m.street IS NULL OR v.street IS NULL THEN 0e0 ELSE
    CASE WHEN m.street = v.street THEN 1e0 ELSE 1e0 - levenshtein(m.street, v.street) / CAST(greatest(length(m.street), length(v.street)) AS DOUBLE) END * 0.7e0
    + CASE WHEN m.num = v.num THEN 1e0 ELSE 0e0 END * 0.3e0 END * 0.2e0 DESC, v.pass, v.pos) = 1
)
SELECT m.article_id, CASE WHEN m.pass = vp AND m.pos = vo THEN 'founded' ELSE 'exact' END AS match_kind, vp || ':' || vo AS venue FROM m JOIN ex USING (article_id)
UNION ALL SELECT article_id, 'fuzzy', vp || ':' || vo FROM fz"""

_HEAD, _TAIL = RESOLVE_SQL.split("SELECT m.article_id, CASE WHEN m.pass = vp")
MERGED_SQL = _HEAD.rstrip() + """,
hit AS (SELECT article_id, vp, vo FROM ex UNION ALL SELECT article_id, vp, vo FROM fz),
g AS (
  SELECT vp, vo, coalesce(last(key ORDER BY m.pos) FILTER (m.pass = 1), last(key ORDER BY m.pos)) AS name,
    first(p_brand || ' street ' || p_size ORDER BY m.pass, m.pos) FILTER (m.pass = 1 OR p_size % 5 > 0) AS address, first(p_brand ORDER BY m.pass, m.pos) AS city,
    CAST(count(DISTINCT m.pass) AS INT) AS source_count, CAST(first(p_size % 6 ORDER BY m.pos) FILTER (m.pass = 2 AND p_size % 6 > 0) AS DOUBLE) AS krogguiden
  FROM m JOIN hit USING (article_id) JOIN part ON p_partkey = m.pos GROUP BY vp, vo
),
s AS (SELECT *, replace(name, ' ', '-') || '-' || replace(lower(city), '#', '-') AS base FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY vp, vo) AS rn FROM s)
SELECT CASE WHEN rn = 1 THEN base ELSE base || '-' || rn END AS id, name, coalesce(address, '') AS address, city, source_count, krogguiden FROM r"""

QUERIES = {
    "exact_alias_match": (exact_alias_match, EXACT_SQL),
    "fuzzy_match_best": (fuzzy_match_best, FUZZY_SQL),
    "slug_unique": (slug_unique, """WITH b AS (SELECT p_partkey AS venue_ord, replace(p_name, ' ', '-') || '-' || CASE WHEN p_size % 4 > 0 THEN lower(p_type) ELSE 'sweden' END AS base FROM part),
      n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY venue_ord) AS n FROM b)
      SELECT venue_ord, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM n"""),
    "slug_contested": (slug_contested, CONTESTED_SQL),
    "consolidate_first": (consolidate_first, CONSOLIDATE_SQL),
    "article_refs": (article_refs, """SELECT l_partkey AS part, CASE l_linenumber WHEN 1 THEN 'whiteguide-review' WHEN 2 THEN 'krogguiden' WHEN 3 THEN 'michelin' WHEN 4 THEN 'di'
      WHEN 5 THEN 'dn-review' WHEN 6 THEN 'svd-review' ELSE 'falstaff' END AS source_id, count(DISTINCT l_orderkey) AS articles FROM lineitem GROUP BY 1, 2"""),
    "dedup_keeper": (dedup_keeper, DEDUP_SQL),
    "known_merges": (known_merges, f"""WITH {_PLACED_SQL}
      SELECT k.place_id, b.name AS canonical_name, k.name AS alias, row_number() OVER (ORDER BY k.sc DESC, k.idx) AS pos
      FROM k JOIN k b ON b.g = k.g AND b.rn = 1 WHERE k.rn > 1 AND k.place_id IS NOT NULL"""),
    "upsert_known_merges": (upsert_known_merges, """WITH r AS (
        SELECT p_type AS place_id, p_name AS alias, 0 AS run, p_partkey AS pos FROM part WHERE p_size > 20
        UNION ALL SELECT p_type, p_name || ' ' || p_brand, 1, p_partkey FROM part WHERE p_size <= 30)
      SELECT place_id, 'new' AS canonical_name, alias, row_number() OVER (ORDER BY run, pos, place_id, alias) AS pos FROM (
        SELECT place_id, alias, min(run) AS run, first(pos ORDER BY run, pos) AS pos FROM r GROUP BY place_id, alias)"""),
    "resolve_mentions": (resolve_mentions, RESOLVE_SQL),
    "merged_venues": (merged_venues, MERGED_SQL),
    "merged_all_passes": (merged_all_passes, MERGED_ALL_SQL),
    "fuzzy_customers": (fuzzy_customers, FUZZY_CUSTOMERS_SQL),
}
