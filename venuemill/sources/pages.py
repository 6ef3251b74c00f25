"""Extraction from crawled pages ``(url, html)``.

A page is one row, so extraction is regular expressions, JSON variants and
higher-order functions inside the row; nothing shuffles until rows of
different pages must meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.functions import text
from venuemill.functions.entities import decode_entities
from venuemill.functions.text import blank_to_null, present
from venuemill.operators.incremental import keep_first

# a page in pieces that each begin with a tag; comments, scripts and styles are one piece
_PIECE = r"""(?is)(?:<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)|<[^>]*>|<)[^<]*|\A[^<]+"""
# an article element, or one whose class holds "article"
_ARTICLE = r"""(?is)\A<(?:article\b|\w[^>]*\sclass=(?:"[^">]*article|'[^'>]*article|[^\s"'>]*article))"""
# elements that hold no paragraphs, or no elements at all
_NO_HOLDERS = ["p", "script", "style", "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
_LD_BLOCK = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


# --- linked data ----------------------------------------------------------


def ld_blocks(html: Column) -> Column:
    """Readable linked-data blocks of a page in order, as variants."""
    blocks = F.regexp_extract_all(html, F.lit(_LD_BLOCK), 1)
    return F.filter(F.transform(blocks, F.try_parse_json), lambda v: v.isNotNull())


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _type(v: Column) -> Column:
    return _get(v, '$["@type"]', "string")


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def review_page(pages: DataFrame) -> DataFrame:
    """Single restaurant review per page: the last review block counts."""
    reviews = F.filter(
        ld_blocks(F.col("html")),
        lambda v: (_type(v) == "Review") & _get(v, "$.itemReviewed", "variant").isNotNull(),
    )
    r = F.col("_r")
    return (
        pages.withColumn("_r", _last(reviews))
        .where(_get(r, '$.itemReviewed["@type"]', "string") == "Restaurant")
        .select(
            "url",
            text.normalize_venue_name(F.coalesce(_get(r, "$.itemReviewed.name", "string"), F.lit(""))).alias("name"),
            text.normalize_address(F.coalesce(_get(r, "$.itemReviewed.address", "string"), F.lit(""))).alias("address"),
            text.normalize_price(F.coalesce(_get(r, "$.itemReviewed.servesCuisine", "string"), F.lit(""))).alias("price_range"),
            _get(r, "$.reviewRating.ratingValue", "double").alias("score"),
            F.coalesce(_get(r, "$.datePublished", "string"), F.lit("")).alias("published_at"),
        )
    )


def _ld_items(v: Column) -> Column:
    return F.coalesce(_get(v, "$", "array<variant>"), _get(v, '$["@graph"]', "array<variant>"), F.array(v))


def restaurant_page(pages: DataFrame) -> DataFrame:
    """Venue data of a detail page: array, graph or single object blocks; the
    venue itself or one under review; the last one counts."""
    items = F.flatten(F.transform(ld_blocks(F.col("html")), _ld_items))

    def venue_of(i: Column) -> Column:
        reviewed = _get(i, "$.itemReviewed", "variant")
        return F.when(_type(i).isin(V.LD_VENUE_TYPES), i).when(
            (_type(i) == "Review") & _type(reviewed).isin(V.LD_VENUE_TYPES), reviewed
        )

    def field(path: str) -> Column:
        return F.coalesce(_get(F.col("_v"), path, "string"), F.lit(""))

    venues = F.filter(F.transform("_items", venue_of), lambda v: v.isNotNull())
    totals = F.filter("_items", lambda i: _type(i) == "AggregateRating")
    return (
        pages.withColumn("_items", items)
        .withColumns({"_v": _last(venues), "_rating": _get(_last(totals), "$.ratingValue", "string")})
        .where(F.col("_v").isNotNull())
        .select(
            "url",
            field("$.name").alias("name"),
            text.strip(field("$.address.streetAddress")).alias("address"),
            F.regexp_replace(field("$.address.postalCode"), text.WS, "").alias("postal_code"),
            field("$.address.addressLocality").alias("city"),
            field("$.address.addressRegion").alias("region"),
            field("$.priceRange").alias("price_range"),
            F.regexp_replace(field("$.servesCuisine"), rf",{text.WS}*\z", "").alias("cuisine"),
            F.coalesce(
                F.when(F.schema_of_variant(_get(F.col("_v"), "$.image", "variant")) == "STRING", field("$.image")),
                field("$.image.url"),
            ).alias("image"),
            text.leading_double(F.col("_rating")).alias("rating"),
        )
        .where((F.col("name") != "") & (F.col("address") != ""))
    )


def list_page(pages: DataFrame) -> DataFrame:
    """Venue nodes of list pages, kept when the item list names them.

    The first block with a graph array counts; an empty list keeps all."""
    graphs = F.filter(
        F.transform(ld_blocks(F.col("html")), lambda v: _get(v, '$["@graph"]', "array<variant>")),
        lambda g: g.isNotNull(),
    )
    lists = F.filter("_graph", lambda n: _type(n) == "ItemList")
    elements = _get(F.try_element_at(lists, F.lit(1)), "$.itemListElement", "array<variant>")
    ids = F.array_distinct(F.filter(
        F.transform(F.coalesce(elements, F.array().cast("array<variant>")), lambda e: _get(e, '$.item["@id"]', "string")),
        present,
    ))
    listed = F.filter(
        "_graph",
        lambda n: _type(n).isin(V.LD_LISTED_TYPES)
        & ((F.size("_ids") == 0) | F.array_contains("_ids", _get(n, '$["@id"]', "string"))),
    )
    return (
        # a page without a graph explodes into nothing; a filter for it would read the page's blocks once more
        pages.withColumn("_graph", F.try_element_at(graphs, F.lit(1)))
        .withColumn("_ids", ids)
        .select("url", F.size("_ids").alias("listed"), F.posexplode(listed).alias("pos", "node"))
    )


def _node_url(node: Column) -> Column:
    return F.coalesce(blank_to_null(_get(node, "$.url", "string")), blank_to_null(_get(node, '$["@id"]', "string")))


def first_nodes(nodes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First list node of each address; one that is rejected later has still used it up."""
    keyed = nodes.withColumn("_address", _node_url(F.col("node"))).where("_address is not null")
    return keep_first(keyed, ["_address"], order or ["url", "pos"]).drop("_address")


def list_articles(nodes: DataFrame, collected_at: str, fallback: str = "restaurant") -> DataFrame:
    """List nodes to articles; needs a name, a url and a rating."""
    from venuemill.sources.articles import _article

    n = F.col("node")
    url = _node_url(n)
    name = _get(n, "$.name", "string")
    score = _get(n, "$.aggregateRating.ratingValue", "double")
    city = _get(n, "$.address.addressLocality", "string")
    count = _get(n, "$.aggregateRating.reviewCount", "int")
    cuisine = _get(n, "$.servesCuisine", "array<string>")
    return _article(
        nodes.where(present(name) & url.isNotNull() & F.coalesce(score != 0, F.lit(False))),
        id=text.record_id(F.lit("thatsup"), url), source_id=F.lit("thatsup"), url=url, title=name,
        published_at=F.lit(""), content_type=F.lit("review"), body_text=F.lit(""),
        venue_type=F.coalesce(text.lookup(V.LD_TYPE_TO_VENUE_TYPE, _type(n)), F.lit(fallback)),
        venue_name=text.normalize_venue_name(name),
        venue_address=blank_to_null(_get(n, "$.address.streetAddress", "string")),
        venue_city=F.when(present(city), text.normalize_city(city)), score=score,
        review_count=F.when(count != 0, count), cuisine=F.when(F.size(cuisine) > 0, cuisine),
        price_range=text.normalize_price(F.coalesce(_get(n, "$.priceRange", "string"), F.lit(""))),
        lat=_get(n, "$.geo.latitude", "double"), lng=_get(n, "$.geo.longitude", "double"),
        collected_at=F.lit(collected_at),
    )


# --- meta tags, paragraphs, links ----------------------------------------


def meta_content(html: Column, prop: str) -> Column:
    """Content of the first meta tag with this property; empty when absent."""
    tag = F.regexp_extract(html, rf"""(?is)(<meta[^>]*property=["']{prop}["'][^>]*>)""", 1)
    return decode_entities(F.regexp_extract(tag, r"""(?is)content=(["'])(.*?)\1""", 2))


def page_metadata(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    return pages.select(
        "url", meta_content(html, "og:title").alias("og_title"),
        meta_content(html, "og:description").alias("og_description"),
        meta_content(html, "article:published_time").alias("published_at"),
    )


def _plain(fragment: Column) -> Column:
    return text.strip(decode_entities(F.regexp_replace(fragment, "<[^>]*>", "")))


def _articles(html: Column) -> Column:
    """Outermost article elements of a page, by the depth of elements of the same name; one without an end reaches to the page's."""
    def piece(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"(?is)\A</?([a-z][^\s/>]*)", 1))
        return F.struct(
            name.alias("name"), F.startswith(t, F.lit("</")).alias("ends"),
            (t.rlike(_ARTICLE) & ~name.isin(_NO_HOLDERS)).alias("holds"), F.length(t).alias("size"),
        )

    def step(at: Column, t: Column) -> Column:
        inside, same = at["depth"] > 0, t["name"] == at["name"]
        opens = ~inside & t["holds"]
        depth = F.when(opens, 1).when(inside & same, at["depth"] + F.when(t["ends"], -1).otherwise(1)).otherwise(at["depth"])
        span = F.struct((at["start"]).alias("start"), (at["pos"] - at["start"]).alias("size"))
        return F.struct(
            (at["pos"] + t["size"]).alias("pos"), depth.cast("int").alias("depth"),
            F.when(opens, t["name"]).otherwise(at["name"]).alias("name"), F.when(opens, at["pos"]).otherwise(at["start"]).alias("start"),
            F.when(inside & (depth == 0), F.concat(at["spans"], F.array(span))).otherwise(at["spans"]).alias("spans"),
        )

    none = F.from_json(F.lit('{"pos":1,"depth":0,"name":"","start":1,"spans":[]}'), "pos int, depth int, name string, start int, spans array<struct<start:int,size:int>>")
    spans = F.aggregate(
        F.transform(F.regexp_extract_all(html, F.lit(_PIECE), 0), piece), none, step,
        lambda at: F.when(at["depth"] > 0, F.concat(at["spans"], F.array(F.struct(at["start"].alias("start"), (at["pos"] - at["start"]).alias("size"))))).otherwise(at["spans"]),
    )
    return F.transform(spans, lambda x: F.substring(html, x["start"], x["size"]))


def article_text(html: Column) -> Column:
    """Paragraphs of the article over 20 characters, without paywall lines.

    A paragraph belongs to it inside an ``article`` element or any element whose class
    holds "article" (so also "article__body"); the outermost such element counts.
    """
    # a paragraph ends where the next one starts, closed or not
    inside = F.transform(_articles(html), lambda x: F.regexp_extract_all(x, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p>|<p[\s>]|\z)"), 1))
    paragraphs = F.transform(F.flatten(inside), _plain)
    walled = lambda p: reduce(lambda a, b: a | b, [F.contains(p, F.lit(w)) for w in V.PAYWALL_PHRASES])
    return F.array_join(F.filter(paragraphs, lambda p: (F.length(p) > 20) & ~walled(p)), "\n\n")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"'<>\s]+)["']"""), 1)


def discover_review_urls(pages: DataFrame) -> DataFrame:
    """Review links of listing pages: distinct, by two words in the address."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r"""svd\.se/a/[^"<>\s]+"""), 0)
    return (
        pages.select(F.explode(F.transform(found, lambda u: F.concat(F.lit("https://www."), u))).alias("url"))
        .where(F.contains("url", F.lit("recension")) | F.contains("url", F.lit("krog")))
        .distinct()
    )


def discover_slugs(*page_sets: DataFrame, excluded: list[str] = V.EXCLUDED_SLUGS) -> DataFrame:
    """Slugs linked from any of the page sets, without the excluded ones."""

    def slugs(pages: DataFrame) -> DataFrame:
        found = F.regexp_extract_all(F.col("html"), F.lit(r"""<a[^>]*href=["'][^"']*/restauranger/view/([^"']+)["']"""), 1)
        return pages.select(F.explode(found).alias("slug"))

    every = reduce(DataFrame.unionByName, [slugs(p) for p in page_sets])
    return every.where(~F.col("slug").isin(excluded)).distinct()


def review_articles(pages: DataFrame, collected_at: str) -> DataFrame:
    """Pages to articles: with review data, else titled by its meta tags."""
    from venuemill.sources.articles import _article

    body = pages.select("url", article_text(F.col("html")).alias("body"), meta_content(F.col("html"), "og:title").alias("og_title"),
                        meta_content(F.col("html"), "article:published_time").alias("og_published"))
    joined = body.join(review_page(pages), "url", "left")
    named = present(F.col("name"))
    tail = F.replace(F.element_at(F.split("url", "/"), -1), F.lit("-"), F.lit(" "))
    review = F.contains(F.col("url"), F.lit("recension"))
    return _article(
        joined,
        id=text.record_id(F.lit("svd-review"), F.col("url")), source_id=F.lit("svd-review"), url=F.col("url"),
        title=F.when(named, F.col("name")).otherwise(F.coalesce(blank_to_null(F.col("og_title")), tail)),
        published_at=F.when(named, F.col("published_at")).otherwise(F.col("og_published")),
        content_type=F.when(named | review, F.lit("review")).otherwise(F.lit("listing")),
        body_text=F.col("body"), venue_name=F.when(named, F.col("name")).otherwise(F.lit("")),
        venue_address=F.when(named, blank_to_null(F.col("address"))), score=F.when(named, F.col("score")),
        price_range=F.when(named, blank_to_null(F.col("price_range"))), collected_at=F.lit(collected_at),
        enriched_at=F.when(named, F.lit(collected_at)),
    )


# --- guide cards and detail pages ----------------------------------------


def _attr(tag: Column, name: str) -> Column:
    return decode_entities(F.regexp_extract(tag, rf"""(?is)\s{name}=["']([^"']*)["']""", 1))


def _by_class(fragment: Column, cls: str) -> Column:
    """Plain text of the first element with this class."""
    found = F.regexp_extract(
        fragment, rf"""(?is)<(\w+)[^>]*class=["'][^"']*\b{cls}(?![\w-])[^"']*["'][^>]*>(.*?)</\1>""", 2
    )
    return _plain(found)


def cards(pages: DataFrame) -> DataFrame:
    """One row per card: a card reaches to the next card or the page end."""
    card = r"""(?is)(<\w+[^>]*class=["'][^"']*\bcard__menu(?![\w-])[^"']*["'][^>]*>.*?)(?=<\w+[^>]*class=["'][^"']*\bcard__menu(?![\w-])|\z)"""
    return pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(card), 1)).alias("pos", "card"))


def _images(card: Column) -> Column:
    return F.regexp_extract_all(card, F.lit(r"(?is)(<img[^>]*>)"), 1)


def _image_source(img: Column) -> Column:
    return F.coalesce(blank_to_null(_attr(img, "src")), _attr(img, "data-src"))


def star_distinction(card: Column) -> Column:
    """Stars by icon count, else the value icon, else plain selection."""
    sources = F.transform(_images(card), _image_source)
    n = F.size(F.filter(sources, lambda s: F.contains(s, F.lit("michelin-star"))))
    bib = F.exists(sources, lambda s: F.contains(F.lower(s), F.lit("bibendum")) | F.contains(s, F.lit("bib-gourmand")))
    return (
        F.when(n >= 3, F.lit("3_star")).when(n == 2, F.lit("2_star")).when(n == 1, F.lit("1_star"))
        .when(bib, F.lit("bib_gourmand")).otherwise(F.lit("selected"))
    )


def key_distinction(card: Column) -> Column:
    n = F.size(F.filter(
        _images(card),
        lambda i: F.contains(_image_source(i), F.lit("key")) | F.contains(_attr(i, "class"), F.lit("michelin-award")),
    ))
    return (
        F.when(n >= 3, F.lit("3_key")).when(n == 2, F.lit("2_key")).when(n == 1, F.lit("1_key"))
        .otherwise(F.lit("selected"))
    )


_GUIDE_BASE = "https://guide.michelin.com"


def card_entries(pages: DataFrame, venue_type: str = "restaurant") -> DataFrame:
    """Cards with a title to entries; the first entry per url counts later."""
    card = F.col("card")
    head = F.regexp_extract(card, r"(?is)^(<[^>]*>)", 1)
    title = F.regexp_extract(
        card, r"""(?is)card__menu-content--title[^>]*>.*?(<a[^>]*>.*?</a>)""", 1
    )
    href = _attr(title, "href")
    place = text.strip(F.split(_by_class(card, "card__menu-footer--location"), ",")[0])
    price_text = _by_class(card, "card__menu-footer--price")
    none = F.lit(None).cast("double")
    hotel = venue_type == "hotel"
    guest = F.regexp_extract(_by_class(card, "card__menu-footer--score"), r"(\d+\.?\d*)", 1)

    def coordinate(name: str) -> Column:
        value = text.leading_double(_attr(head, name))
        return F.when(value != 0, value)

    return cards(pages).select(
        F.col("url").alias("page"), "pos",
        _plain(title).alias("name"),
        F.lit("").alias("address") if hotel else _attr(head, "data-dtm-address").alias("address"),
        (F.coalesce(blank_to_null(_attr(head, "data-dtm-city")), place) if hotel else place).alias("city"),
        (key_distinction(card) if hotel else star_distinction(card)).alias("distinction"),
        F.lit("").alias("cuisine") if hotel
        else text.strip(F.regexp_extract(price_text, r"[€$]+\s*·?\s*(.*)", 1)).alias("cuisine"),
        F.lit("").alias("price_range") if hotel
        else F.regexp_extract(price_text, r"^[€$]+", 0).alias("price_range"),
        F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(_GUIDE_BASE), href)).alias("url"),
        F.lit(venue_type).alias("venue_type"),
        (coordinate("data-lat") if hotel else none).alias("lat"),
        (coordinate("data-lng") if hotel else none).alias("lng"),
        (guest.try_cast("double") if hotel else none).alias("guest_score"),
    ).where("name <> ''")


def first_cards(entries: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First entry of each venue address, in the order of pages and cards."""
    return keep_first(entries, ["url"], order or ["page", "pos"])


def enrich_entries(entries: DataFrame, details: DataFrame) -> DataFrame:
    """Entries with the data of their detail pages ``(url, html)``.

    The last text block that ends in the country is the address; the last
    ``price · cuisine`` block wins, a heading fills a missing price."""
    price = r"^([€$]+)\s*[·•-]\s*(.+)\z"

    def blocks(cls: str) -> Column:
        found = F.regexp_extract_all(
            "html", F.lit(rf"""(?is)<(?:\w+)[^>]*class=["'][^"']*\b{cls}(?![\w-])[^"']*["'][^>]*>(.*?)</(?:div|p|span|li|h\d)>"""), 1
        )
        return F.transform(found, _plain)

    sheet = blocks("data-sheet__block--text")
    lead = blocks("(?:restaurant-details__description|data-sheet__description|restaurant-details__heading--text)")
    paragraphs = F.transform(
        F.regexp_extract_all("html", F.lit(
            r"""(?is)class=["'][^"']*\b(?:data-sheet__body|restaurant-details__description)[^"']*["'][^>]*>\s*<p[^>]*>(.*?)</p>"""), 1), _plain)
    heading = blocks("(?:restaurant-details__heading-price|data-sheet__heading)")
    first_lead = F.try_element_at(lead, F.lit(1))
    facts = details.select(
        "url",
        _last(F.filter(sheet, lambda t: t.rlike(r"(?i)Sweden\s*\z"))).alias("_address"),
        _last(F.filter(sheet, lambda t: t.rlike(price))).alias("_price"),
        F.coalesce(
            F.when(F.length(first_lead) > 20, first_lead),
            F.try_element_at(F.filter(paragraphs, lambda t: F.length(t) > 50), F.lit(1)),
        ).alias("body_text"),
        F.try_element_at(F.filter(heading, lambda t: t.rlike(price)), F.lit(1)).alias("_heading"),
    )
    dining = F.col("venue_type") == "restaurant"
    line = F.when(dining, F.coalesce(F.col("_price"), F.when(~present(F.col("price_range")), F.col("_heading"))))
    return entries.join(facts, "url", "left").withColumns({
        "address": F.coalesce("_address", "address"),
        "price_range": F.when(line.isNotNull(), F.regexp_extract(line, price, 1)).otherwise(F.col("price_range")),
        "cuisine": F.when(line.isNotNull(), text.strip(F.regexp_extract(line, price, 2))).otherwise(F.col("cuisine")),
    }).drop("_address", "_price", "_heading")
