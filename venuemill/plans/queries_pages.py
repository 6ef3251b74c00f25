"""Extraction queries over pages, and over markup derived from parts.

The given pages hold no linked data or guide cards, so those queries wrap
every part into such markup first and read it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill.functions import text
from venuemill.plans.proxies import pick, spread_table, table
from venuemill.sources import articles as A
from venuemill.sources import pages as X

STAMP = "2024-05-17T00:00:00.000Z"


def html_text(spark, d):
    """Plain text of whole pages, compared by digest."""
    t = text.strip_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(t).alias("digest"), F.length(t).alias("chars"))


_STRIP_SQL = """regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&auml;', 'ä'), '&ouml;', 'ö'), '&aring;', 'å'),
  '&Auml;', 'Ä'), '&Ouml;', 'Ö'), '&Aring;', 'Å'), '&ndash;', '–'), '&mdash;', '—'), '&nbsp;', ' '), chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"""


def page_links(spark, d):
    """Every link of every page, with its place."""
    return table(spark, d, "pages").select("page_id", F.posexplode(X.links(F.col("html"))).alias("pos", "href"))


def article_text(spark, d):
    """Article paragraphs of all pages, in the three kinds of elements that hold them, with planted references."""
    k = F.col("page_id") % 3
    opening = F.when(k == 1, F.lit('<section class="main article__body">')).when(k == 2, F.lit("<section class='news-article wide'>")).otherwise(F.lit("<article>"))
    html = F.replace(F.replace("html", F.lit("<article>"), opening), F.lit("</article>"), F.when(k > 0, F.lit("</section>")).otherwise(F.lit("</article>")))
    t = X.article_text(F.concat(html, F.lit("<article class='x'><p>Plant&#233; caf&eacute; &amp; th&#xE9; &unknown; as it is.</p></article>")))
    return table(spark, d, "pages").select("page_id", F.md5(t).alias("digest"), F.length(t).alias("chars"))


def _decoded_sql(x):
    for name, char in (("&#233;", "é"), ("&eacute;", "é"), ("&#xE9;", "é"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


_PARAGRAPHS_SQL = r"""
a AS (SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<article\b[^>]*>.*?</article>|<section\b[^>]*\sclass=["''][^"'']*article[^"'']*["''][^>]*>.*?</section>', 0), ' ') AS body FROM h),
s AS (SELECT page_id, string_split_regex(body, '(?i)<p(?:\s[^>]*)?>')[2:] AS parts FROM a),
p AS (SELECT page_id, list_transform(parts, lambda x: regexp_replace(""" + _decoded_sql(r"""regexp_replace(regexp_replace(x, '(?is)</p>.*', ''), '<[^>]*>', '', 'g')""") + r""", '^\s+|\s+$', '', 'g')) AS ps FROM s),
t AS (SELECT page_id, coalesce(array_to_string(list_filter(ps, lambda x: length(x) > 20 AND NOT contains(x, 'Redan prenumerant') AND NOT contains(x, 'Logga in för')), chr(10) || chr(10)), '') AS t FROM p)"""

ARTICLE_SQL = r"""
WITH h AS (
  SELECT page_id, replace(replace(html, '<article>', CASE page_id % 3 WHEN 1 THEN '<section class="main article__body">' WHEN 2 THEN '<section class=''news-article wide''>' ELSE '<article>' END),
    '</article>', CASE page_id % 3 WHEN 0 THEN '</article>' ELSE '</section>' END) || '<article class=''x''><p>Plant&#233; caf&eacute; &amp; th&#xE9; &unknown; as it is.</p></article>' AS html FROM pages
),""" + _PARAGRAPHS_SQL + """
SELECT page_id, md5(t) AS digest, CAST(length(t) AS INT) AS chars FROM t"""


def page_meta(spark, d):
    """Meta tags added to every page, read back in either attribute order."""
    html = F.concat(
        F.lit('<head><meta property="og:title" content="'), "url", F.lit("\"><meta content='2024-01-02' property='article:published_time' />"),
        F.lit('<META property="og:description" name="d" content="it&#39;s Mat &amp; Vin &#x26;amp; '), F.col("page_id").cast("string"), F.lit('"></head>'), F.col("html"))
    return X.page_metadata(table(spark, d, "pages").withColumn("html", html))


def discovered(spark, d):
    """Review links and slugs planted in the pages, found again once each."""
    k = F.col("page_id")
    planted = F.concat(
        F.col("html"), F.lit('<a href="https://www.svd.se/a/x'), (k % 40).cast("string"), pick(["/recension-a", "/krogen", "/annat"], k % 3), F.lit('">x</a>'),
        F.lit('<a class="c" href="/restauranger/view/slug-'), (k % 25).cast("string"), F.lit('">'), F.lit('<a href="/restauranger/view/annonsera-pa-krogguiden">'))
    pages = table(spark, d, "pages").select("url", planted.alias("html"))
    return X.discover_review_urls(pages).select(F.col("url").alias("found")).unionByName(X.discover_slugs(pages, pages).select(F.col("slug").alias("found")))


# --- linked data -----------------------------------------------------------


def _script(json: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">'), json, F.lit("</script>"))


def _part_pages(spark, d, html: Column) -> DataFrame:
    return spread_table(spark, d, "part").select(F.concat(F.lit("https://p.example/"), F.col("p_partkey").cast("string"), F.lit("-recension")).alias("url"), html.alias("html"))


def _review_json(name: Column, kind: str = "Restaurant") -> Column:
    size = F.col("p_size")
    return F.to_json(F.struct(
        F.lit("Review").alias("@type"),
        F.struct(F.lit(kind).alias("@type"), name.alias("name"), F.concat(F.lit("Adress: Gatan "), size.cast("string")).alias("address"), F.lit("$$").alias("servesCuisine")).alias("itemReviewed"),
        F.struct((size % 13 / 2).alias("ratingValue")).alias("reviewRating"),
        F.lit("2024-02-03").alias("datePublished"),
    ))


def ld_reviews(spark, d):
    """Last readable review block of each page; other types do not count."""
    k = F.col("p_partkey")
    html = F.concat(
        F.lit("<html>"), _script(_review_json(F.lit("first"))), _script(F.lit("{broken")), _script(F.lit('{"@type":"Thing"}')),
        F.when(k % 3 == 0, _script(_review_json(F.col("p_name"), "Hotel"))).otherwise(_script(_review_json(F.concat("p_name", F.lit("."))))), F.lit("</html>"))
    return X.review_page(_part_pages(spark, d, html))


def ld_restaurants(spark, d):
    """Detail pages as array, graph and single blocks."""
    k, size = F.col("p_partkey"), F.col("p_size")
    place = F.struct(
        F.lit("Restaurant").alias("@type"), F.col("p_name").alias("name"),
        F.struct(F.when(k % 11 > 0, F.concat(F.lit(" Gatan "), size.cast("string"))).alias("streetAddress"), F.lit("111 22").alias("postalCode"), F.lit("Malmö").alias("addressLocality")).alias("address"),
        F.lit("$$").alias("priceRange"), F.lit("Thai, Sushi, ").alias("servesCuisine"))
    one = F.to_json(place.withField("image", F.lit("http://i/1.png")))
    two = F.to_json(place.withField("image", F.struct(F.lit("http://i/2.png").alias("url"))))
    rating = F.to_json(F.struct(F.lit("AggregateRating").alias("@type"), (size % 50 / 10).cast("string").alias("ratingValue")))
    reviewed = F.concat(F.lit('{"@type":"Review","itemReviewed":'), one, F.lit("}"))
    html = (
        F.when(k % 4 == 0, _script(F.concat(F.lit("["), one, F.lit(","), rating, F.lit("]"))))
        .when(k % 4 == 1, _script(F.concat(F.lit('{"@graph":['), rating, F.lit(","), two, F.lit("]}"))))
        .when(k % 4 == 2, F.concat(_script(reviewed), _script(rating)))
        .otherwise(_script(F.lit('{"@type":"Person"}'))))
    return X.restaurant_page(_part_pages(spark, d, html)).drop("region")


def ld_lists(spark, d):
    """List pages: graph nodes named by the item list, as articles."""
    k, size = F.col("p_partkey"), F.col("p_size")
    key = k.cast("string")

    def node(i, kind, rating):
        name = F.concat("p_name", F.lit(f" {i}"))
        return F.to_json(F.struct(
            F.concat(F.lit(f"#{i}-"), key).alias("@id"), F.lit(kind).alias("@type"), name.alias("name"),
            F.struct(F.lit("Gatan 1").alias("streetAddress"), F.lit("gothenburg").alias("addressLocality")).alias("address"),
            F.struct(F.lit(57.5).alias("latitude"), F.lit(12.5).alias("longitude")).alias("geo"),
            F.struct(rating.alias("ratingValue"), size.alias("reviewCount")).alias("aggregateRating"),
            F.array(F.lit("Sushi")).alias("servesCuisine"), F.lit("$").alias("priceRange")))

    items = F.when(k % 2 == 0, F.concat(F.lit(',{"@type":"ItemList","itemListElement":[{"item":{"@id":"#0-'), key, F.lit('"}},{"item":{"@id":"#2-'), key, F.lit('"}}]}'))).otherwise(F.lit(""))
    graph = F.concat(F.lit('{"@graph":['), node(0, "BarOrPub", size % 6 / F.lit(1)), F.lit(","), node(1, "Hotel", F.lit(4.5)), F.lit(","), node(2, "LocalBusiness", F.lit(3.0)),
                     F.lit(","), node(3, "Person", F.lit(5.0)), items, F.lit("]}"))
    nodes = X.list_page(_part_pages(spark, d, F.concat(_script(F.lit('{"@type":"WebSite"}')), _script(graph))))
    return X.list_articles(nodes, STAMP, "cafe").select("id", "url", "title", "venue_type", "venue_city", "score", "review_count", "price_range", "lat", "lng")


LISTS_SQL = """WITH n AS (SELECT p_partkey AS k, p_name, p_size, i FROM part, range(3) t(i))
SELECT sha256('thatsup:#' || i || '-' || k)[1:16] AS id, '#' || i || '-' || k AS url, p_name || ' ' || i AS title,
  CASE i WHEN 0 THEN 'bar' WHEN 1 THEN 'hotel' ELSE 'cafe' END AS venue_type, 'Göteborg' AS venue_city,
  CASE i WHEN 0 THEN CAST(p_size % 6 AS DOUBLE) WHEN 1 THEN 4.5e0 ELSE 3e0 END AS score, p_size AS review_count, 'budget' AS price_range, 57.5e0 AS lat, 12.5e0 AS lng
FROM n WHERE (k % 2 = 1 OR i <> 1) AND NOT (i = 0 AND p_size % 6 = 0)"""


# --- guide cards -----------------------------------------------------------


def _card(body: Column, attrs: Column) -> Column:
    return F.concat(F.lit('<div class="card__menu selection-card js" '), attrs, F.lit(">"), body, F.lit("</div>"))


def guide_cards(spark, d):
    """Two cards per page: icons, title, place, price and cuisine."""
    k, size = F.col("p_partkey"), F.col("p_size")
    key = k.cast("string")
    icons = pick(['<img data-src="/michelin-star.svg">', '<img src="/michelin-star.svg"><img class="x" src="/michelin-star.svg">',
                  '<img src="/star.svg"><img src="/Bibendum.svg">', '<img src="/michelin-star.svg"><img src="/michelin-star.svg"><img src="/michelin-star.svg">'], k % 5)
    title = F.concat(F.lit('<h3 class="card__menu-content--title pl-text"><a href="/se/'), key, F.lit('"> '), "p_name", F.lit(" </a></h3>"))
    footer = F.concat(F.lit('<div class="card__menu-footer--location flex-fill"> Malmö, Sweden </div><div class="card__menu-footer--price"> '),
                      F.expr("repeat('€', p_size % 4 + 1)"), F.lit(" · "), "p_type", F.lit(", Thai </div>"))
    one = _card(F.concat(F.coalesce(icons, F.lit("")), title, footer), F.concat(F.lit('data-dtm-address="Gatan '), size.cast("string"), F.lit('"')))
    nameless = _card(F.lit("<p>no title</p>"), F.lit(""))
    html = F.concat(F.lit("<main>"), nameless, F.lit("\n"), one, F.lit("</main>"))
    return X.card_entries(_part_pages(spark, d, html)).select("pos", "name", "address", "city", "distinction", "cuisine", "price_range", "url", "venue_type")


def cards_first(spark, d):
    """Pages that link the same venues: the first card of each counts."""
    k = F.col("p_partkey")
    link = F.concat(F.lit('<h3 class="card__menu-content--title"><a href="/se/'), (k % 97).cast("string"), F.lit('">'), "p_name", F.lit("</a></h3>"))
    pages = spread_table(spark, d, "part").select(F.lpad(k.cast("string"), 10, "0").alias("url"), _card(link, F.lit("")).alias("html"))
    return X.first_cards(X.card_entries(pages)).select("url", "name", "page")


def lists_first(spark, d):
    """List pages that name the same venues: the first node counts, also when it is rejected."""
    k = F.col("p_partkey")
    node = F.to_json(F.struct(
        F.concat(F.lit("#"), (k % 97).cast("string")).alias("@id"), F.lit("Restaurant").alias("@type"), F.when(k % 3 > 0, F.col("p_name")).alias("name"),
        F.struct(F.lit(4.5).alias("ratingValue")).alias("aggregateRating")))
    html = _script(F.concat(F.lit('{"@graph":['), node, F.lit("]}")))
    pages = spread_table(spark, d, "part").select(F.lpad(k.cast("string"), 10, "0").alias("url"), html.alias("html"))
    return X.list_articles(X.first_nodes(X.list_page(pages)), STAMP).select("url", "title")


def hotel_cards(spark, d):
    k = F.col("s_suppkey")
    keys = F.expr("repeat('<img src=\"/key.svg\">', cast(s_suppkey % 5 as int))")
    title = F.concat(F.lit('<h3 class="card__menu-content--title"><a href="https://h.example/'), k.cast("string"), F.lit('">'), "s_name", F.lit("</a></h3>"))
    body = F.concat(keys, title, F.lit('<span class="card__menu-footer--score">Score 8.5/10</span>'))
    card = _card(body, F.concat(F.lit('data-dtm-city="Visby" data-lat="57.5" data-lng="'), (k % 3 * 18).cast("string"), F.lit('"')))
    pages = spread_table(spark, d, "supplier").select(F.lit("u").alias("url"), card.alias("html"))
    return X.card_entries(pages, "hotel").select("name", "city", "distinction", "url", "lat", "lng", "guest_score")


def detail_pages(spark, d):
    """Entries enriched by their detail pages, then mapped to articles."""
    k, size = F.col("p_partkey"), F.col("p_size")
    url = F.concat(F.lit("https://g.example/"), k.cast("string"))
    entries = spread_table(spark, d, "part").select(
        F.col("p_name").alias("name"), F.lit("").alias("address"), F.when(k % 7 > 0, F.lit("Lund")).otherwise(F.lit("")).alias("city"),
        pick(["1_star", "selected", "2_key"], k % 3).alias("distinction"), F.lit("old").alias("cuisine"), F.lit("€").alias("price_range"),
        url.alias("url"), F.when(k % 2 == 0, F.lit("hotel")).otherwise(F.lit("restaurant")).alias("venue_type"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    block = lambda c: F.concat(F.lit('<div class="data-sheet__block--text">'), c, F.lit("</div>"))
    html = F.concat(
        F.when(k % 5 > 0, block(F.concat(F.lit("Gatan "), size.cast("string"), F.lit(", Umeå, 901 10, Sweden")))).otherwise(F.lit("")),
        block(F.concat(F.lit("€€€ · "), "p_type", F.lit(", Nordic"))),
        F.lit('<div class="data-sheet__description">A long description of '), "p_name", F.lit("</div>"))
    details = spread_table(spark, d, "part").select(url.alias("url"), html.alias("html"))
    out = A.distinction_articles(X.enrich_entries(entries, details), STAMP)
    return out.select("id", "url", "venue_name", "venue_address", "venue_city", "score", "body_text", "price_range",
                      F.array_join("cuisine", "|").alias("cuisine"), F.col("tags")[0].alias("tag"))


DETAIL_SQL = """SELECT sha256('michelin:https://g.example/' || p_partkey)[1:16] AS id, 'https://g.example/' || p_partkey AS url, p_name AS venue_name,
  CASE WHEN p_partkey % 5 > 0 THEN 'Gatan ' || p_size END AS venue_address,
  CASE WHEN p_partkey % 5 > 0 THEN 'Umeå' WHEN p_partkey % 7 > 0 THEN 'Lund' END AS venue_city,
  CASE p_partkey % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 ELSE 2e0 END AS score, 'A long description of ' || p_name AS body_text,
  CASE WHEN p_partkey % 2 = 0 THEN 'budget' ELSE 'lyx' END AS price_range, CASE WHEN p_partkey % 2 = 0 THEN 'old' ELSE p_type || '|Nordic' END AS cuisine,
  ['1_star', 'selected', '2_key'][p_partkey % 3 + 1] AS tag
FROM part WHERE NOT (p_partkey % 2 = 0 AND p_partkey % 5 = 0 AND p_partkey % 7 = 0)"""


# --- record mappers --------------------------------------------------------


def matrix_records(spark, d):
    """One-row column/row matrices of every part, decoded and mapped."""
    k, size = F.col("p_partkey"), F.col("p_size")
    cols = ["Restaurang", "Totalpoäng", "Mat", "Miljö", "Service", "Kordinater", "Länk test-artikel omtest", "Länk test-artikel", "Datum omtest", "Datum", "Adress", "Ort", "Prisklass"]
    row = F.array(
        F.when(k % 10 > 0, F.concat(F.lit(" "), F.col("p_name"))), F.when(k % 13 > 0, F.concat(size.cast("string"), F.lit(" p"))).otherwise(F.lit("saknas")),
        (size % 16).cast("string"), (size % 6).cast("string"), F.lit(""), F.when(k % 3 > 0, F.concat(F.lit("59.5, "), (size % 7).cast("string"), F.lit(".25"))),
        F.when(k % 4 == 0, F.concat(F.lit("http://re/"), k.cast("string"))).otherwise(F.lit("")), F.when(k % 5 > 0, F.concat(F.lit("http://o/"), k.cast("string"))),
        F.lit(None).cast("string"), F.lit("2020-01-02"), F.lit(" Gatan 1."), F.lit("malmo"), F.lit("Högt"))
    payload = spread_table(spark, d, "part").select(F.array(*[F.lit(c) for c in cols]).alias("cols"), F.array(row).alias("rows"))
    out = A.matrix_articles(A.decode_matrix(payload), STAMP)
    return out.select("id", "url", "published_at", "venue_name", "venue_address", "venue_city", "score", "price_range", "lat", "lng",
                      F.col("explicit_sub_scores.food").alias("food"), F.col("explicit_sub_scores.ambiance").alias("ambiance"), F.col("explicit_sub_scores.service").alias("service"))


MATRIX_SQL = """WITH m AS (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'http://re/' || p_partkey WHEN p_partkey % 5 > 0 THEN 'http://o/' || p_partkey ELSE '' END AS url FROM part WHERE p_partkey % 10 > 0 AND p_partkey % 13 > 0)
SELECT sha256('di:' || CASE WHEN url = '' THEN 'di:' || p_name ELSE url END)[1:12] AS id, url, '2020-01-02' AS published_at, p_name AS venue_name, 'Gatan 1' AS venue_address, 'Malmö' AS venue_city,
  CAST(p_size AS DOUBLE) AS score, 'lyx' AS price_range, CASE WHEN k % 3 > 0 THEN 59.5e0 END AS lat, CASE WHEN k % 3 > 0 THEN p_size % 7 + 0.25e0 END AS lng,
  CASE WHEN p_size % 16 > 0 THEN floor(CAST(p_size % 16 AS DOUBLE) / 15e0 * 10e0 * 10e0 + 0.5e0) / 10e0 END AS food,
  CASE WHEN p_size % 6 > 0 THEN floor(CAST(p_size % 6 AS DOUBLE) / 5e0 * 10e0 * 10e0 + 0.5e0) / 10e0 END AS ambiance, CAST(NULL AS DOUBLE) AS service
FROM m"""


def guide_records(spark, d):
    """API records with repeated places; the first per type and place counts."""
    size = F.col("p_size")
    items = spread_table(spark, d, "part").select(
        F.lower("p_type").alias("venue_type"), (F.col("p_partkey") % 300).alias("place_id"), F.col("p_partkey").alias("pos"),
        F.concat("p_name", F.lit(". ")).alias("place_title"), F.lit("t").alias("title"), F.concat(F.lit("Gatan "), size.cast("string"), F.lit(", 123 45 Gothenburg")).alias("address"),
        pick(["God klass", ""], size % 3).alias("classification"),
        F.when(size % 4 > 0, F.struct(size.cast("double").alias("food"), F.lit(10.0).alias("service"), F.lit(None).cast("double").alias("environment"), F.lit(5.0).alias("drink"))).alias("scores"),
        F.array(F.lit("a"), F.lit(" "), F.lit("a"), F.lit("b")).alias("tag_names"), F.lit(57.0).alias("lat"), F.lit(None).cast("double").alias("lng"))
    out = A.guide_articles(items, STAMP)
    return out.select("id", "title", "venue_type", "venue_name", "venue_address", "venue_city", F.array_join("cuisine", "|").alias("cuisine"), F.try_element_at("tags", F.lit(1)).alias("tag"),
                      "lat", F.col("explicit_sub_scores.food").alias("food"), F.col("explicit_sub_scores.ambiance").alias("ambiance"), F.col("explicit_sub_scores.drinks").alias("drinks"))


GUIDE_SQL = """WITH f AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_partkey % 300 ORDER BY p_partkey) = 1)
SELECT sha256('whiteguide-review:https://whiteguide.com/se/sv/' || lower(p_type) || 's/' || (p_partkey % 300))[1:16] AS id,
  p_name || ' — ' || CASE WHEN p_size % 3 = 0 THEN 'God klass' ELSE '' END AS title, lower(p_type) AS venue_type, p_name AS venue_name,
  'Gatan ' || p_size || ', 123 45 Gothenburg' AS venue_address, 'Göteborg' AS venue_city, 'a|b' AS cuisine, CASE WHEN p_size % 3 = 0 THEN 'God klass' END AS tag, 57e0 AS lat,
  CASE WHEN p_size % 4 > 0 THEN floor(CAST(p_size AS DOUBLE) / 39e0 * 10e0 * 10e0 + 0.5e0) / 10e0 END AS food, CASE WHEN p_size % 4 > 0 THEN 0e0 END AS ambiance,
  CASE WHEN p_size % 4 > 0 THEN 2.5e0 END AS drinks FROM f"""


def news_records(spark, d):
    """News up to the first one before the cutoff, newest first."""
    o = spread_table(spark, d, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    late = F.unix_date(F.to_date(F.lit("2001-08-01"))) - F.unix_date(F.to_date("o_orderdate"))
    items = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))).alias("slug"),
        F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderpriority")).alias("title"), F.lit("<b>tag</b>").alias("tagline"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<p>A &amp; B "), F.col("o_orderstatus"), F.lit("</p>"))).alias("body"),
        F.when(F.col("o_orderkey") % 7 > 0, stamp).alias("publish_date"), (late.cast("bigint") * 10_000_000 + F.col("o_orderkey")).alias("pos"))
    return A.news_articles(items, STAMP, "1999-01-01T00:00:00.000Z").select("id", "url", "title", "published_at", "body_text")


NEWS_SQL = """WITH n AS (SELECT *, date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') * 10000000 + o_orderkey AS pos,
    CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') ELSE '' END AS pub FROM orders WHERE o_orderkey % 50 > 0),
s AS (SELECT min(pos) AS stop FROM n WHERE pub <> '' AND pub < '1999-01-01T00:00:00.000Z'),
u AS (SELECT *, 'https://whiteguide.com/se/sv/news/' || CASE WHEN o_orderkey % 3 > 0 THEN 's' ELSE '' END || o_orderkey AS url FROM n, s WHERE pos < stop)
SELECT sha256('whiteguide-news:' || url)[1:16] AS id, url, o_orderpriority AS title, pub AS published_at, CASE WHEN o_orderkey % 2 = 0 THEN 'A & B ' || o_orderstatus ELSE 'tag' END AS body_text FROM u"""


def points_records(spark, d):
    """Raw records of the 100-point guide."""
    k, size = F.col("p_partkey"), F.col("p_size")
    part = lambda x, m: F.struct(x.cast("double").alias("score"), F.lit(m).alias("max"))
    subs = F.create_map(F.lit("food"), part(size, 50.0), F.lit("drinks"), part(size % 20, 50.0), F.lit("style"), part(size % 10, 10.0))
    subs = F.when(k % 3 == 0, F.map_concat(subs, F.create_map(F.lit("wine"), part(size % 20, 20.0)))).when(k % 3 == 1, subs)
    raw = spread_table(spark, d, "part").select(
        F.col("p_name").alias("name"), F.concat(F.lit("https://f.example"), pick(["/bars/", "/r/"], k % 2), k.cast("string")).alias("url"), (size + 60).cast("double").alias("score"),
        F.concat(F.lit("Gatan "), size.cast("string"), pick([", 11122, Malmo", ", 114 46 Lund, Sweden"], k % 2)).alias("address"), F.array("p_type").alias("cuisine"), subs.alias("sub_scores"), F.lit(None).cast("string").alias("body_text"))
    s = F.col("explicit_sub_scores")
    return A.points_articles(raw, STAMP).select("id", "venue_type", "venue_address", "venue_city", "score", s["food"].alias("food"), s["drinks"].alias("drinks"), s["ambiance"].alias("ambiance"))


POINTS_SQL = """WITH r AS (SELECT *, p_partkey AS k, 'https://f.example' || CASE p_partkey % 2 WHEN 0 THEN '/bars/' ELSE '/r/' END || p_partkey AS url FROM part)
SELECT sha256('falstaff:' || url)[1:16] AS id, CASE k % 2 WHEN 0 THEN 'bar' ELSE 'restaurant' END AS venue_type, 'Gatan ' || p_size AS venue_address, CASE k % 2 WHEN 0 THEN 'Malmö' ELSE 'Lund' END AS venue_city,
  CASE WHEN p_size + 60 BETWEEN 80 AND 100 THEN CAST(p_size + 60 AS DOUBLE) END AS score,
  CASE WHEN k % 3 < 2 THEN floor(CAST(p_size AS DOUBLE) / 50e0 * 10e0 * 10e0 + 0.5e0) / 10e0 END AS food,
  CASE k % 3 WHEN 0 THEN floor(CAST(p_size % 20 AS DOUBLE) / 20e0 * 10e0 * 10e0 + 0.5e0) / 10e0 WHEN 1 THEN floor(CAST(p_size % 20 AS DOUBLE) / 50e0 * 10e0 * 10e0 + 0.5e0) / 10e0 END AS drinks,
  CASE WHEN k % 3 < 2 THEN floor(CAST(p_size % 10 AS DOUBLE) / 10e0 * 10e0 * 10e0 + 0.5e0) / 10e0 END AS ambiance FROM r"""


def listing_records(spark, d):
    """Older raw list; rows without name or address drop out."""
    k = F.col("p_partkey")
    raw = spread_table(spark, d, "part").select(
        F.concat(F.lit("s-"), k.cast("string")).alias("slug"), F.when(k % 10 > 0, F.col("p_name")).alias("name"), pick(["Gatan 1", "", "Vägen 2."], k % 3).alias("address"),
        F.lit("södermalm").alias("city"), pick(["Norr", ""], k % 2).alias("region"), F.lit("$$$").alias("price_range"), F.lit("Thai, , Sushi").alias("cuisine"),
        (F.col("p_size") % 5).cast("double").alias("rating"), F.when(k % 4 == 0, F.lit("http://own")).alias("url"))
    return A.import_listing(raw, STAMP).select("id", "url", "venue_name", "venue_address", "venue_city", "score", "price_range", F.array_join("cuisine", "|").alias("cuisine"), F.try_element_at("tags", F.lit(1)).alias("tag"))


LISTING_SQL = """SELECT sha256('krogguiden:s-' || p_partkey)[1:12] AS id, CASE WHEN p_partkey % 4 = 0 THEN 'http://own' ELSE 'https://www.krogguiden.se/restauranger/view/s-' || p_partkey END AS url,
  p_name AS venue_name, CASE p_partkey % 3 WHEN 0 THEN 'Gatan 1' ELSE 'Vägen 2' END AS venue_address, 'Stockholm' AS venue_city, CASE WHEN p_size % 5 > 0 THEN CAST(p_size % 5 AS DOUBLE) END AS score,
  'lyx' AS price_range, 'Thai|Sushi' AS cuisine, CASE p_partkey % 2 WHEN 0 THEN 'Norr' END AS tag FROM part WHERE p_partkey % 10 > 0 AND p_partkey % 3 <> 1"""


def guide_import_records(spark, d):
    """Older raw guide list: every row is a restaurant, with or without an address."""
    k = F.col("p_partkey")
    raw = spread_table(spark, d, "part").select(
        F.concat(F.lit(" "), F.col("p_name"), F.lit(" .")).alias("name"),
        pick(["Gatan 1, Lund, 222 22, Sweden", "Torget 2, Östermalm, Stockholm, Sweden", "", None], k % 4).alias("address"),
        pick(["Lund", "södermalm", ""], k % 3).alias("city"), pick(["bib_gourmand", "2_star", "selected"], k % 3).alias("distinction"),
        pick(["Modern, , Nordic", ""], k % 2).alias("cuisine"), pick(["€", "€€", "€€€€", ""], k % 4).alias("price_range"),
        F.concat(F.lit("https://guide/"), k.cast("string")).alias("url"))
    return A.import_guide(raw, STAMP).select(
        "id", "url", "venue_type", "venue_name", "venue_address", "venue_city", "score", "price_range", F.array_join("cuisine", "|").alias("cuisine"),
        F.try_element_at("tags", F.lit(1)).alias("tag"), F.col("lat").isNull().alias("unplaced"))


GUIDE_IMPORT_SQL = """SELECT sha256('michelin:https://guide/' || p_partkey)[1:16] AS id, 'https://guide/' || p_partkey AS url, 'restaurant' AS venue_type, p_name || ' ' AS venue_name,
  CASE p_partkey % 4 WHEN 0 THEN 'Gatan 1' WHEN 1 THEN 'Torget 2, Östermalm' END AS venue_address,
  CASE p_partkey % 4 WHEN 0 THEN 'Lund' WHEN 1 THEN 'Stockholm' ELSE CASE p_partkey % 3 WHEN 0 THEN 'Lund' WHEN 1 THEN 'Stockholm' END END AS venue_city,
  CASE p_partkey % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 2e0 ELSE 0e0 END AS score, CASE p_partkey % 4 WHEN 0 THEN 'budget' WHEN 1 THEN 'mellan' WHEN 2 THEN 'lyx' END AS price_range,
  CASE WHEN p_partkey % 2 = 0 THEN 'Modern|Nordic' END AS cuisine, CASE p_partkey % 3 WHEN 0 THEN 'bib_gourmand' WHEN 1 THEN '2_star' ELSE 'selected' END AS tag, true AS unplaced FROM part"""


def review_page_articles(spark, d):
    """All pages as articles: no review data, so titled by meta tag or url."""
    return X.review_articles(table(spark, d, "pages"), STAMP).select("id", "url", "title", "content_type", "venue_name", F.length("body_text").alias("chars"))


REVIEW_PAGES_SQL = "WITH h AS (SELECT page_id, html FROM pages)," + _PARAGRAPHS_SQL + """
SELECT sha256('svd-review:' || url)[1:16] AS id, url, replace(string_split(url, '/')[-1], '-', ' ') AS title,
  CASE WHEN contains(url, 'recension') THEN 'review' ELSE 'listing' END AS content_type, '' AS venue_name, CAST(length(t) AS INT) AS chars FROM t JOIN pages USING (page_id)"""

QUERIES = {
    "html_text": (html_text, f"SELECT page_id, md5({_STRIP_SQL}) AS digest, CAST(length({_STRIP_SQL}) AS INT) AS chars FROM pages"),
    "page_links": (page_links, """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)href=["'']([^"''<>\\s]+)["'']', 1) AS hs FROM pages)
      SELECT page_id, CAST(unnest(range(len(hs))) AS INT) AS pos, unnest(hs) AS href FROM l"""),
    "article_text": (article_text, ARTICLE_SQL),
    "cards_first": (cards_first, """SELECT 'https://guide.michelin.com/se/' || (p_partkey % 97) AS url, first(p_name ORDER BY p_partkey) AS name, lpad(CAST(min(p_partkey) AS VARCHAR), 10, '0') AS page
      FROM part GROUP BY p_partkey % 97"""),
    "lists_first": (lists_first, """SELECT '#' || (p_partkey % 97) AS url, p_name AS title FROM part
      QUALIFY row_number() OVER (PARTITION BY p_partkey % 97 ORDER BY p_partkey) = 1 AND p_partkey % 3 > 0"""),
    "page_meta": (page_meta, "SELECT url, url AS og_title, 'it''s Mat & Vin &amp; ' || page_id AS og_description, '2024-01-02' AS published_at FROM pages"),
    "discovered": (discovered, """SELECT DISTINCT 'https://www.svd.se/a/x' || (page_id % 40) || CASE page_id % 3 WHEN 0 THEN '/recension-a' ELSE '/krogen' END AS found FROM pages WHERE page_id % 3 < 2
      UNION ALL SELECT DISTINCT 'slug-' || (page_id % 25) FROM pages"""),
    "ld_reviews": (ld_reviews, """SELECT 'https://p.example/' || p_partkey || '-recension' AS url, p_name AS name, 'Gatan ' || p_size AS address, 'mellan' AS price_range,
      p_size % 13 / 2e0 AS score, '2024-02-03' AS published_at FROM part WHERE p_partkey % 3 > 0"""),
    "ld_restaurants": (ld_restaurants, """SELECT 'https://p.example/' || p_partkey || '-recension' AS url, p_name AS name, 'Gatan ' || p_size AS address, '11122' AS postal_code, 'Malmö' AS city, '$$' AS price_range,
      'Thai, Sushi' AS cuisine, CASE p_partkey % 4 WHEN 1 THEN 'http://i/2.png' ELSE 'http://i/1.png' END AS image, p_size % 50 / 10e0 AS rating FROM part WHERE p_partkey % 4 < 3 AND p_partkey % 11 > 0"""),
    "ld_lists": (ld_lists, LISTS_SQL),
    "guide_cards": (guide_cards, """SELECT 1 AS pos, p_name AS name, 'Gatan ' || p_size AS address, 'Malmö' AS city,
      CASE p_partkey % 5 WHEN 0 THEN '1_star' WHEN 1 THEN '2_star' WHEN 2 THEN 'bib_gourmand' WHEN 3 THEN '3_star' ELSE 'selected' END AS distinction,
      p_type || ', Thai' AS cuisine, repeat('€', p_size % 4 + 1) AS price_range, 'https://guide.michelin.com/se/' || p_partkey AS url, 'restaurant' AS venue_type FROM part"""),
    "hotel_cards": (hotel_cards, """SELECT s_name AS name, 'Visby' AS city, CASE s_suppkey % 5 WHEN 0 THEN 'selected' WHEN 1 THEN '1_key' WHEN 2 THEN '2_key' ELSE '3_key' END AS distinction,
      'https://h.example/' || s_suppkey AS url, 57.5e0 AS lat, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 * 18e0 END AS lng, 8.5e0 AS guest_score FROM supplier"""),
    "detail_pages": (detail_pages, DETAIL_SQL),
    "matrix_records": (matrix_records, MATRIX_SQL),
    "guide_records": (guide_records, GUIDE_SQL),
    "news_records": (news_records, NEWS_SQL),
    "points_records": (points_records, POINTS_SQL),
    "listing_records": (listing_records, LISTING_SQL),
    "guide_import_records": (guide_import_records, GUIDE_IMPORT_SQL),
    "review_page_articles": (review_page_articles, REVIEW_PAGES_SQL),
}
