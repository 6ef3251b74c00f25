"""Text, address and id queries with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuemill.functions import similarity, text
from venuemill.plans.proxies import pick, table
from venuemill.sources import articles as A

TITLE = r"(?is)<title>(.*?)</title>"

ADDRESS_TAILS = ["", ", tel: 08-12 34 56.", ", Lund", ", Dalarna / Falun", ".  ", "\nIngång från gården", ", www", "  B"]
CITY_WORDS = ["Gothenburg", " södermalm ", "Skåne", "Visby", "MALMO", "gotland", "s:t ibb", " Umeå"]
NAME_TAILS = ["", ".", "  Krog", "’s", " “X”", ". "]
PRICE_WORDS = ["$", "$$", "$$$$", "Mellanklass", " Högt", "mycket högt", "Enkel", "other"]


def _address(key: str):
    k = F.col(key)
    return F.concat(
        F.when(k % 3 == 0, F.lit("Adress:  ")).otherwise(F.lit("")), F.lit(" Storgatan  "),
        (k % 97).cast("string"), pick(ADDRESS_TAILS, k % 8),
    )


def normalize_fields(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey",
        text.normalize_address(_address("c_custkey")).alias("address"),
        text.normalize_city(pick(CITY_WORDS, k % 8)).alias("city"),
        text.normalize_venue_name(F.concat(F.lit("  "), F.initcap("c_mktsegment"), pick(NAME_TAILS, k % 6))).alias("name"),
        text.normalize_price(pick(PRICE_WORDS, k % 8)).alias("price"),
        text.is_city_header(pick(["Stockholm ", "Krogen", "UMEÅ"], k % 3)).alias("city_header"),
    )


NORMALIZE_SQL = """
SELECT c_custkey,
  CASE c_custkey % 8 WHEN 7 THEN concat('Storgatan ', c_custkey % 97, ' B') ELSE concat('Storgatan ', c_custkey % 97) END AS address,
  CASE c_custkey % 8 WHEN 0 THEN 'Göteborg' WHEN 1 THEN 'Stockholm' WHEN 2 THEN '' WHEN 3 THEN 'Visby' WHEN 4 THEN 'Malmö'
    WHEN 5 THEN '' WHEN 6 THEN 'S:t Ibb' ELSE 'Umeå' END AS city,
  concat(upper(c_mktsegment[1:1]), lower(c_mktsegment[2:]), CASE c_custkey % 6 WHEN 2 THEN ' Krog' WHEN 3 THEN '''s' WHEN 4 THEN ' "X"' ELSE '' END) AS name,
  CASE c_custkey % 8 WHEN 0 THEN 'budget' WHEN 1 THEN 'mellan' WHEN 2 THEN 'lyx' WHEN 3 THEN 'mellan' WHEN 4 THEN 'lyx' WHEN 5 THEN 'lyx'
    WHEN 6 THEN 'budget' ELSE 'other' END AS price,
  c_custkey % 3 <> 1 AS city_header
FROM customer"""


def page_titles(spark, d):
    """Match keys and slugs of every page title."""
    title = F.regexp_extract("html", TITLE, 1)
    return table(spark, d, "pages").select(
        "page_id", text.name_key(title).alias("key"), text.slugify(title).alias("slug"),
        text.record_id(F.lit("svd-review"), F.col("url")).alias("id16"), text.record_id(F.lit("di"), F.col("url"), 12).alias("id12"),
    )


_SQL_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}),
  '^(?:restaurang|restaurant|ristorante|trattoria|brasserie|bistro|café|cafe|hotell?|hotel)\s+', ''),
  '\s+(?:restaurang|restaurant|bar|grill|kitchen|kök|& bar|& grill|& restaurang)$', ''),
  '[''´`]', '', 'g'), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' +', ' ', 'g'))"""
_FOLD_FROM = "åäöÅÄÖéèêëÉÈÊËáàâãÁÀÂÃíìîïÍÌÎÏóòôõÓÒÔÕúùûüÚÙÛÜýÿÝñÑçÇøØ"
_FOLD_TO = "aaoAAOeeeeEEEEaaaaAAAAiiiiIIIIooooOOOOuuuuUUUUyyYnNcCoO"
_SQL_SLUG = (
    "regexp_replace(regexp_replace(lower(replace(replace(replace(translate({0}, '" + _FOLD_FROM + "', '" + _FOLD_TO
    + "'), 'æ', 'ae'), 'Æ', 'AE'), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
)

def name_keys(spark, d):
    """Prefix and suffix words and marks around every part name."""
    k = F.col("p_partkey")
    raw = F.concat(pick(["Restaurang ", "HOTELL ", "Café ", "", "L'"], k % 5), "p_name", pick([" Bar", " & Grill", " kök", "", " (Södra)!"], k % 7 % 5))
    return table(spark, d, "part").select("p_partkey", text.name_key(raw).alias("key"))


def document_slugs(spark, d):
    """Letters folded and slugs cut over whole texts."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.slugify(F.col("text"))).alias("slug_md5"))


def address_parts(spark, d):
    raw = F.concat("p_type", F.lit("gatan "), F.col("p_size").cast("string"),
                   pick(["", " B", ".", ", Stockholm", ", 111 22 Göteborg, Sweden", " Malmö, Sverige"], F.col("p_partkey") % 6))
    part = text.street_number(raw)
    return table(spark, d, "part").select("p_partkey", text.address_key(raw).alias("address_key"), part["street"].alias("street"), part["number"].alias("number"))


# ASCII word edges; RE2 has them as \b
_SQL_ADDR = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\s+', ' ', 'g'), '\.$', ''), ',\s*', ' ', 'g'),
  '\b(?:stockholm|göteborg|malmö|sweden|sverige)\b', '', 'g'))"""


def address_similarity(spark, d):
    """Each part's address against that of the next part."""
    a = table(spark, d, "part").select(
        "p_partkey", text.street_number(F.concat(F.lower("p_type"), F.lit("gatan "), F.col("p_size").cast("string"))).alias("place"))
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("place").alias("next_place"))
    return a.join(b, "p_partkey").select(
        "p_partkey", F.round(similarity.address_similarity(F.col("place"), F.col("next_place")), 9).alias("similarity"))


def guide_cities(spark, d):
    """Four address dialects, the cleaned address and country suffixes."""
    k = F.col("s_suppkey")
    n = (k % 90 + 10).cast("string")
    before = F.concat(F.lit("Storgatan "), n, F.lit(", Lund, 111 "), n, F.lit(", Sweden"))
    after = F.concat(F.lit("Storgatan "), n, pick([", 123 45 Umeå", ", Dalarna / Falun"], k % 2))
    last = F.concat(F.lit("Storgatan "), n, pick([", 11122, Kalmar", ", 114 46 Visby, Sweden"], k % 2))
    place = F.concat(F.lit("Storgatan "), n, pick([", 111 22 Borås, Sverige", ""], k % 2))
    city = text.city_before_postcode(before)
    return table(spark, d, "supplier").select(
        "s_suppkey", city.alias("city_before"), text.city_after_postcode(after).alias("city_after"),
        text.city_from_last_part(last).alias("city_last"), text.city_from_place_address(place).alias("city_place"),
        text.clean_guide_address(before, city).alias("cleaned"), text.strip_country(place).alias("no_country"),
    )


def tiers_and_sub_scores(spark, d):
    """Sub-scores, distinction levels, euro tiers and price labels of parts."""
    s = F.col("p_size")
    tier = text.euro_price_tier(F.expr("repeat('€', p_size % 5)"))
    return table(spark, d, "part").select(
        "p_partkey", text.sub_score(s % 16, 15.0).alias("food"), text.sub_score(s, 39.0).alias("guide_food"),
        text.sub_score(s % 21, F.lit(20.0)).alias("service"), tier.alias("tier"), text.price_label(tier).alias("label"),
        text.leading_int(F.concat(s.cast("string"), F.lit(" p"))).alias("points"),
        text.lookup({"selected": 0.0, "bib_gourmand": 0.5}, F.when(s % 2 == 0, F.lit("selected")).otherwise(F.lit("bib_gourmand"))).alias("level"),
    )


def titles_to_names(spark, d):
    """Venue names out of ``Name: headline`` titles."""
    k = F.col("p_partkey")
    title = F.concat(pick(["", "Veckans ", "Studio DN ", "Krogkommissionen "], k % 6), "p_name", pick([": ", " - "], k % 5 % 2), "p_type")
    return table(spark, d, "part").select("p_partkey", text.name_from_title(title).alias("venue_name"))


def tag_lists(spark, d):
    """Cleaned tags and comma lists, joined for comparison."""
    listed = F.concat("p_type", F.lit(", "), F.lit(" ,"), "p_name", F.lit(" , "))
    tags = F.array("p_type", F.lit(" "), "p_name", "p_type", F.lit(""))
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(text.split_list(listed), "|").alias("items"), F.array_join(text.clean_tags(tags), "|").alias("tags"))


def feed_dates(spark, d):
    """Feed items from the cutoff date on, by their mail-style dates."""
    stamp = F.concat(F.date_format("o_orderdate", "E, dd MMM yyyy HH:mm:ss"), F.lit(" +0100"))
    items = table(spark, d, "orders").select(
        F.concat(F.lit("https://news.example/kultur/"), F.col("o_orderkey").cast("string")).alias("link"),
        F.lit("t").alias("title"), stamp.alias("pubDate"), F.lit("d").alias("description"))
    known = table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("https://news.example/kultur/"), F.col("o_orderkey").cast("string")).alias("url"))
    out = A.new_feed_items(A.rss_items(items), known, "1999-06-15T00:00:00.000Z")
    return out.select("url", F.date_format(A.rfc822_timestamp(F.col("pub_date")), "yyyy-MM-dd HH:mm").alias("at"))


def subarticle_mentions(spark, d):
    """Listing articles re-normalised, then unnested into mentions."""
    from venuemill.operators.resolve import articles_to_mentions

    m = articles_to_mentions(A.normalize_articles(_listings(spark, d)))
    return m.select(
        "article_id", F.col("ord.sub").alias("sub"), "name", "key", "address", "match_city", "fill_city",
        "price_range", "score", "threshold", "can_found")


def _listings(spark, d):
    from venuemill import schemas

    size = F.col("p_size")
    sub = F.array(
        F.struct(F.concat("p_name", F.lit(".")).alias("venue_name"), F.concat(F.lit("Adress: Gatan "), size.cast("string")).alias("venue_address"),
                 F.lit(None).cast("string").alias("venue_city"), (size % 6).cast("double").alias("score"), F.lit("$$").alias("price_range"), F.lit(None).cast("string").alias("body_text")),
        F.struct(F.lit("Göteborg").alias("venue_name"), F.lit(None).cast("string").alias("venue_address"), F.lit(None).cast("string").alias("venue_city"),
                 F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("price_range"), F.lit(None).cast("string").alias("body_text")),
        F.struct(F.concat("p_type", F.lit(" Bar")).alias("venue_name"), F.lit(None).cast("string").alias("venue_address"), F.lit("malmo").alias("venue_city"),
                 F.lit(None).cast("double").alias("score"), F.lit("weird").alias("price_range"), F.lit(None).cast("string").alias("body_text")),
    )
    given = {
        "id": F.concat(F.lit("a"), F.col("p_partkey").cast("string")), "source_id": F.lit("dn-review"), "url": F.lit("u"),
        "title": F.lit("t"), "published_at": F.lit(""), "content_type": F.lit("listing"), "venue_name": F.lit(""),
        "venue_city": F.when(size % 2 == 0, F.lit("Södermalm")), "sub_articles": sub,
    }
    return table(spark, d, "part").select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ARTICLE.fields], F.col("p_partkey").alias("pos"))


QUERIES = {
    "normalize_fields": (normalize_fields, NORMALIZE_SQL),
    "page_titles": (page_titles, f"""WITH t AS (SELECT page_id, url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages)
      SELECT page_id, {_SQL_KEY.format('title')} AS key, {_SQL_SLUG.format('title')} AS slug,
        sha256('svd-review:' || url)[1:16] AS id16, sha256('di:' || url)[1:12] AS id12 FROM t"""),
    "name_keys": (name_keys, f"""WITH t AS (SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN 'Restaurang ' WHEN 1 THEN 'HOTELL ' WHEN 2 THEN 'Café ' WHEN 3 THEN '' ELSE 'L''' END,
        p_name, CASE p_partkey % 7 % 5 WHEN 0 THEN ' Bar' WHEN 1 THEN ' & Grill' WHEN 2 THEN ' kök' WHEN 3 THEN '' ELSE ' (Södra)!' END) AS raw FROM part)
      SELECT p_partkey, {_SQL_KEY.format('raw')} AS key FROM t"""),
    "document_slugs": (document_slugs, f"SELECT doc_id, md5({_SQL_SLUG.format('text')}) AS slug_md5 FROM documents"),
    "address_parts": (address_parts, f"""WITH t AS (SELECT p_partkey, concat(p_type, 'gatan ', p_size, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' B' WHEN 2 THEN '.' WHEN 3 THEN ', Stockholm'
        WHEN 4 THEN ', 111 22 Göteborg, Sweden' ELSE ' Malmö, Sverige' END) AS raw FROM part),
      k AS (SELECT p_partkey, {_SQL_ADDR.format('raw')} AS address_key FROM t),
      c AS (SELECT *, trim(regexp_replace(address_key, '\\s+', ' ', 'g')) AS z FROM k)
      SELECT p_partkey, address_key, CASE WHEN regexp_matches(z, '^(.+?)\\s+(\\d+\\s*[a-z]?)$') THEN trim(regexp_extract(z, '^(.+?)\\s+(\\d+\\s*[a-z]?)$', 1)) ELSE z END AS street,
        trim(regexp_extract(z, '^(.+?)\\s+(\\d+\\s*[a-z]?)$', 2)) AS number FROM c"""),
    "address_similarity": (address_similarity, """WITH a AS (SELECT p_partkey, lower(p_type) || 'gatan' AS s, CAST(p_size AS VARCHAR) AS n FROM part),
      b AS (SELECT a.p_partkey, a.s AS s1, a.n AS n1, x.s AS s2, x.n AS n2 FROM a JOIN a x ON x.p_partkey = a.p_partkey + 1)
      SELECT p_partkey, round(CASE WHEN s1 = s2 THEN 1e0 ELSE 1e0 - levenshtein(s1, s2) / CAST(greatest(length(s1), length(s2)) AS DOUBLE) END * 0.7e0
        + CASE WHEN n1 = n2 THEN 1e0 ELSE 0e0 END * 0.3e0, 9) AS similarity FROM b"""),
    "guide_cities": (guide_cities, """SELECT s_suppkey, 'Lund' AS city_before, CASE s_suppkey % 2 WHEN 0 THEN 'Umeå' ELSE 'Falun' END AS city_after,
        CASE s_suppkey % 2 WHEN 0 THEN 'Kalmar' ELSE 'Visby' END AS city_last, CASE s_suppkey % 2 WHEN 0 THEN 'Borås' ELSE '' END AS city_place,
        concat('Storgatan ', s_suppkey % 90 + 10) AS cleaned,
        concat('Storgatan ', s_suppkey % 90 + 10, CASE s_suppkey % 2 WHEN 0 THEN ', 111 22 Borås' ELSE '' END) AS no_country FROM supplier"""),
    "tiers_and_sub_scores": (tiers_and_sub_scores, """SELECT p_partkey, floor(CAST(p_size % 16 AS DOUBLE) / 15e0 * 10e0 * 10e0 + 0.5e0) / 10e0 AS food,
        floor(CAST(p_size AS DOUBLE) / 39e0 * 10e0 * 10e0 + 0.5e0) / 10e0 AS guide_food, floor(CAST(p_size % 21 AS DOUBLE) / 20e0 * 10e0 * 10e0 + 0.5e0) / 10e0 AS service,
        CASE WHEN p_size % 5 <= 1 THEN 'budget' WHEN p_size % 5 = 2 THEN 'mellan' ELSE 'lyx' END AS tier,
        CASE WHEN p_size % 5 <= 1 THEN '€' WHEN p_size % 5 = 2 THEN '€€' ELSE '€€€' END AS label, p_size AS points,
        CASE WHEN p_size % 2 = 0 THEN 0e0 ELSE 0.5e0 END AS level FROM part"""),
    "titles_to_names": (titles_to_names, """SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2, 4) AND p_partkey % 6 = 0 THEN p_name END AS venue_name FROM part"""),
    "tag_lists": (tag_lists, "SELECT p_partkey, p_type || '|' || p_name AS items, p_type || '|' || p_name AS tags FROM part"),
    "feed_dates": (feed_dates, """SELECT 'https://news.example/kultur/' || o_orderkey AS url, strftime(o_orderdate - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS at
      FROM orders WHERE o_orderdate - INTERVAL 1 HOUR >= TIMESTAMP '1999-06-15' AND o_orderstatus <> 'F'"""),
    "subarticle_mentions": (subarticle_mentions, """
      SELECT 'a' || p_partkey AS article_id, 0 AS sub, p_name AS name, p_name AS key, concat('Gatan ', p_size) AS address,
        CASE WHEN p_size % 2 = 0 THEN 'Stockholm' END AS match_city, CAST(NULL AS VARCHAR) AS fill_city, 'mellan' AS price_range,
        CAST(p_size % 6 AS DOUBLE) AS score, 0.85e0 AS threshold, true AS can_found FROM part
      UNION ALL SELECT 'a' || p_partkey, 1, p_type || ' Bar', lower(p_type), NULL, 'Malmö', 'Malmö', 'weird', NULL, 0.85e0, true FROM part"""),
}
