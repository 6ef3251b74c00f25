"""Records of each guide to articles.

Every mapper is a projection; ``_article`` fills the columns a guide lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill import schemas
from venuemill.functions import text
from venuemill.functions.text import blank_to_null, present
from venuemill.operators.incremental import keep_first, until_cutoff


def _article(df: DataFrame, **columns: Column) -> DataFrame:
    """Project to the article schema, with NULL for what is not given."""
    out = [
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ARTICLE.fields
    ]
    keep = [c for c in ("pos",) if c in df.columns]
    return df.select(*out, *keep)


def _sub_scores(**values: Column) -> Column:
    return F.struct(*[
        values.get(f.name, F.lit(None)).cast("double").alias(f.name) for f in schemas.SUB_SCORES.fields
    ])


# --- column headers and row matrix ---------------------------------------


def decode_matrix(payload: DataFrame) -> DataFrame:
    """``cols array<string>, rows array<array<string>>`` to named records.

    A repeated header keeps its last column.  Rows need a name and a numeric
    total; other integers default to 0."""
    name_of = V.DI_COLUMNS
    rows = payload.select("cols", F.posexplode("rows").alias("pos", "row"))

    def cell(field: str) -> Column:
        # position of the last column with this header
        at = F.size("cols") - F.array_position(F.reverse("cols"), F.lit(name_of[field])) + 1
        return F.when(F.array_contains("cols", name_of[field]), F.try_element_at(F.col("row"), at.cast("int")))

    def trimmed(field: str) -> Column:
        return F.coalesce(text.strip(cell(field)), F.lit(""))

    def integer(field: str) -> Column:
        return F.coalesce(text.leading_int(cell(field)), F.lit(0))

    parts = F.split(cell("coordinates"), ",")
    lat, lng = (text.leading_double(F.try_element_at(parts, F.lit(i))) for i in (1, 2))
    both = (F.size(parts) == 2) & lat.isNotNull() & lng.isNotNull()
    return rows.select(
        "pos",
        trimmed("name").alias("name"), trimmed("address").alias("address"), trimmed("city").alias("city"),
        text.leading_int(cell("total")).alias("total_score"),
        integer("food").alias("food_score"), integer("ambiance").alias("ambiance_score"),
        integer("service").alias("service_score"),
        trimmed("price").alias("price_class"),
        F.coalesce(blank_to_null(cell("retest_url")), blank_to_null(cell("url")), F.lit("")).alias("url"),
        F.coalesce(blank_to_null(cell("retest_date")), blank_to_null(cell("date")), F.lit("")).alias("published_at"),
        F.when(both, lat).alias("lat"), F.when(both, lng).alias("lng"),
    ).where((F.col("name") != "") & F.col("total_score").isNotNull())


def matrix_articles(entries: DataFrame, collected_at: str) -> DataFrame:
    def positive(field: str) -> Column:
        score = F.col(f"{field}_score")
        return F.when(score > 0, text.sub_score(score, V.DI_SUB_SCORE_MAX[field]))

    subs = {f: positive(f) for f in V.DI_SUB_SCORE_MAX}
    any_sub = F.coalesce(*subs.values()).isNotNull()
    key = F.coalesce(blank_to_null(F.col("url")), F.concat(F.lit("di:"), "name"))
    return _article(
        entries,
        id=text.record_id(F.lit("di"), key, 12), source_id=F.lit("di"), url=F.col("url"),
        title=F.concat(F.lit("DI Weekend: "), "name"), published_at=F.col("published_at"),
        content_type=F.lit("review"), body_text=F.lit(""), venue_type=F.lit("restaurant"),
        venue_name=text.normalize_venue_name(F.col("name")),
        venue_address=text.normalize_address(F.col("address")),
        venue_city=text.normalize_city(F.col("city")), score=F.col("total_score"),
        explicit_sub_scores=F.when(any_sub, _sub_scores(**subs)),
        price_range=text.normalize_price(F.col("price_class")),
        lat=F.col("lat"), lng=F.col("lng"), collected_at=F.lit(collected_at),
    )


# --- guide API records ----------------------------------------------------


def guide_articles(items: DataFrame, as_of: str) -> DataFrame:
    """API records (venue_type, place_id, place_title, title, address,
    classification, scores, tag_names, lat, lng, pos) to articles; the first
    record per type and place counts."""
    first = keep_first(items, ["venue_type", "place_id"], ["pos"])
    name = text.normalize_venue_name(F.coalesce("place_title", "title", F.lit("")))
    label = F.coalesce("classification", F.lit(""))
    url = F.concat(F.lit("https://whiteguide.com/se/sv/"), "venue_type", F.lit("s/"), F.col("place_id").cast("string"))
    address = F.coalesce("address", F.lit(""))
    native = {"food": "food", "service": "service", "ambiance": "environment", "drinks": "drink"}
    subs = {k: text.sub_score(F.coalesce(F.col(f"scores.{native[k]}"), F.lit(0.0)), m) for k, m in V.GUIDE_SUB_SCORE_MAX.items()}
    return _article(
        first,
        id=text.record_id(F.lit("whiteguide-review"), url), source_id=F.lit("whiteguide-review"), url=url,
        title=F.concat(name, F.lit(" — "), label), published_at=F.lit(as_of), content_type=F.lit("review"),
        body_text=F.lit(""), venue_type=F.col("venue_type"), venue_name=name,
        venue_address=text.normalize_address(address),
        venue_city=text.normalize_city(text.city_after_postcode(address)),
        explicit_sub_scores=F.when(F.col("scores").isNotNull(), _sub_scores(**subs)),
        cuisine=F.when(F.size("tag_names") > 0, text.clean_tags(F.col("tag_names"))),
        tags=F.filter(F.array(label), lambda t: t != ""),
        lat=F.col("lat"), lng=F.col("lng"), collected_at=F.lit(as_of),
    )


def news_articles(items: DataFrame, collected_at: str, cutoff: str = V.CUTOFF_DATE) -> DataFrame:
    """News records (id, slug, title, tagline, body, publish_date, pos), newest
    first, up to the first one before the cutoff."""
    titled = items.where(present(F.col("title"))).withColumn("publish_date", F.coalesce("publish_date", F.lit("")))
    url = F.concat(F.lit("https://whiteguide.com/se/sv/news/"), F.coalesce("slug", "id", F.lit("")))
    return _article(
        until_cutoff(titled, "pos", "publish_date", cutoff),
        id=text.record_id(F.lit("whiteguide-news"), url), source_id=F.lit("whiteguide-news"), url=url,
        title=F.col("title"), published_at=F.col("publish_date"), content_type=F.lit("news"),
        body_text=text.strip_html(F.coalesce("body", "tagline", F.lit(""))),
        venue_name=F.lit(""), collected_at=F.lit(collected_at),
    )


# --- cached raw records and older imports ---------------------------------


def points_articles(raw: DataFrame, collected_at: str) -> DataFrame:
    """Raw records (name, url, score, address, cuisine, sub_scores, body_text)
    of the 100-point guide; only scores from 80 to 100 count."""

    def ratio(name: str) -> Column:
        part = F.try_element_at(F.col("sub_scores"), F.lit(name))
        return F.when(part.isNotNull(), text.sub_score(part["score"], part["max"]))

    address = F.coalesce("address", F.lit(""))
    street = text.street_from_first_part(address)
    city = text.city_from_last_part(address)
    return _article(
        raw,
        id=text.record_id(F.lit("falstaff"), F.coalesce(blank_to_null(F.col("url")), F.col("name"))),
        source_id=F.lit("falstaff"), url=F.col("url"), title=F.col("name"), published_at=F.lit(""),
        content_type=F.lit("review"), body_text=F.coalesce("body_text", F.lit("")),
        venue_type=F.when(F.contains(F.col("url"), F.lit("/bars/")), F.lit("bar")).otherwise(F.lit("restaurant")),
        venue_name=text.normalize_venue_name(F.col("name")), venue_address=blank_to_null(street),
        venue_city=F.when(city != "", text.normalize_city(city)),
        score=F.when(F.col("score").between(80, 100), F.col("score")),
        explicit_sub_scores=F.when(
            F.col("sub_scores").isNotNull(),
            _sub_scores(food=ratio("food"), service=ratio("service"), ambiance=ratio("style"),
                        drinks=F.coalesce(ratio("wine"), ratio("drinks"))),
        ),
        cuisine=F.when(F.size("cuisine") > 0, F.col("cuisine")), collected_at=F.lit(collected_at),
    )


def listing_articles(entries: DataFrame, collected_at: str) -> DataFrame:
    """Entries (slug, name, address, city, region, price_range, cuisine,
    rating, url) of the user-rated restaurant list."""
    rating = F.col("rating")
    return _article(
        entries,
        id=text.record_id(F.lit("krogguiden"), F.col("slug"), 12), source_id=F.lit("krogguiden"),
        url=F.col("url"), title=F.col("name"), published_at=F.lit(""), content_type=F.lit("review"),
        body_text=F.lit(""), venue_type=F.lit("restaurant"),
        venue_name=text.normalize_venue_name(F.col("name")),
        venue_address=text.normalize_address(F.col("address")),
        venue_city=text.normalize_city(F.col("city")), score=F.when(rating > 0, rating),
        price_range=text.normalize_price(F.col("price_range")),
        cuisine=F.when(present(F.col("cuisine")), text.split_list(F.col("cuisine"))),
        tags=F.when(present(F.col("region")), F.array("region")), collected_at=F.lit(collected_at),
    )


def import_listing(raw: DataFrame, collected_at: str) -> DataFrame:
    """Older raw list; rows need a name and an address."""
    complete = raw.where(present(F.col("name")) & present(F.col("address")))
    filled = complete.withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in ("city", "region", "price_range", "cuisine")}
    ).withColumn("url", F.coalesce(
        blank_to_null(F.col("url")), F.concat(F.lit("https://www.krogguiden.se/restauranger/view/"), "slug")))
    return listing_articles(filled, collected_at)


def distinction_articles(entries: DataFrame, collected_at: str) -> DataFrame:
    """Entries (name, address, city, distinction, cuisine, price_range, url,
    venue_type, lat, lng, body_text); hotels without any place are foreign."""
    local = entries.where(
        ~((F.col("venue_type") == "hotel") & ~present(F.col("address")) & ~present(F.col("city")))
    )
    address, raw_city = F.col("_address"), F.col("_city")
    # each step is a column of its own, so that the patterns behind it run once a row
    local = local.withColumn("_address", F.coalesce("address", F.lit(""))).withColumn("_found", text.city_before_postcode(address))
    local = local.withColumn("_city", F.coalesce(blank_to_null(F.col("_found")), F.col("city"), F.lit("")))
    local = local.withColumns({
        "_cleaned": F.when(present(address), text.clean_guide_address(address, raw_city)), "_city": text.normalize_city(raw_city)})
    return _article(
        local,
        id=text.record_id(F.lit("michelin"), F.col("url")), source_id=F.lit("michelin"), url=F.col("url"),
        title=F.col("name"), published_at=F.lit(""), content_type=F.lit("review"),
        body_text=F.coalesce("body_text", F.lit("")), venue_type=F.col("venue_type"),
        venue_name=text.normalize_venue_name(F.col("name")), venue_address=blank_to_null(F.col("_cleaned")),
        venue_city=blank_to_null(raw_city),
        score=text.lookup(V.DISTINCTION_LEVELS, F.col("distinction")),
        cuisine=F.when(present(F.col("cuisine")), text.split_list(F.col("cuisine"))),
        price_range=F.when(present(F.col("price_range")), text.euro_price_tier(F.col("price_range"))),
        tags=F.array("distinction"), lat=F.col("lat"), lng=F.col("lng"),
        collected_at=F.lit(collected_at), enriched_at=F.lit(collected_at),
    )


def import_guide(raw: DataFrame, collected_at: str) -> DataFrame:
    """Older raw guide entries (name, address, city, distinction, cuisine, price_range, url): all are restaurants, and all stay."""
    absent = {"lat": "double", "lng": "double", "body_text": "string"}
    whole = raw.withColumns({"venue_type": F.lit("restaurant")} | {c: F.lit(None).cast(t) for c, t in absent.items()})
    return distinction_articles(whole, collected_at)


# --- feeds and review pages -----------------------------------------------


def rss_items(items: DataFrame) -> DataFrame:
    """Feed items (link, title, pubDate, description), culture section only."""
    out = items.select(
        text.strip(F.col("link")).alias("url"), text.strip(F.col("title")).alias("title"),
        text.strip(F.col("pubDate")).alias("pub_date"), text.strip(F.col("description")).alias("description"),
    )
    return out.where(F.contains(F.col("url"), F.lit("/kultur/")))


def read_rss(spark, path: str) -> DataFrame:
    schema = "link string, title string, pubDate string, description string"
    return rss_items(spark.read.schema(schema).format("xml").option("rowTag", "item").load(path))


def rfc822_timestamp(c: Column) -> Column:
    """``Fri, 13 Mar 2026 15:15:17 +0100``; the day name is skipped."""
    return F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def new_feed_items(items: DataFrame, known: DataFrame, cutoff: str = V.CUTOFF_DATE) -> DataFrame:
    recent = items.where(rfc822_timestamp(F.col("pub_date")) >= F.lit(cutoff).cast("timestamp"))
    return recent.join(known.select("url"), "url", "left_anti")


def feed_articles(items: DataFrame, metadata: DataFrame, collected_at: str) -> DataFrame:
    """Feed items with page metadata (url, og_title, published_at,
    og_description); a venue name in the title makes a review."""
    joined = items.join(metadata, "url", "left")
    name = text.name_from_title(F.col("title"))
    iso = F.date_format(rfc822_timestamp(F.col("pub_date")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    summary = text.strip_html(F.coalesce("og_description", F.lit("")), V.ENTITIES_NEWSPAPER)
    return _article(
        joined,
        id=text.record_id(F.lit("dn-review"), F.col("url")), source_id=F.lit("dn-review"), url=F.col("url"),
        title=F.coalesce(blank_to_null(F.col("og_title")), F.col("title")),
        published_at=F.coalesce(blank_to_null(F.col("published_at")), iso),
        content_type=F.when(name.isNotNull(), F.lit("review")).otherwise(F.lit("listing")),
        body_text=F.coalesce(blank_to_null(summary), text.strip_html(F.col("description"), V.ENTITIES_NEWSPAPER)),
        venue_name=F.coalesce(text.normalize_venue_name(name), F.lit("")), collected_at=F.lit(collected_at),
    )


# --- re-normalising stored articles ---------------------------------------


def normalize_articles(articles: DataFrame) -> DataFrame:
    """Normalise venue fields; sub-articles that are city headers go."""

    def when_present(c: Column, fn) -> Column:
        return F.when(present(c), fn(c)).otherwise(c)

    def sub(s: Column) -> Column:
        def optional(name: str, fn) -> Column:
            return F.when(present(s[name]), fn(s[name])).alias(name)

        return F.struct(
            text.normalize_venue_name(s["venue_name"]).alias("venue_name"),
            optional("venue_address", text.normalize_address),
            optional("venue_city", text.normalize_city),
            s["score"].alias("score"),
            optional("price_range", text.normalize_price),
            s["body_text"].alias("body_text"),
        )

    kept = F.filter("sub_articles", lambda s: ~F.coalesce(text.is_city_header(s["venue_name"]), F.lit(False)))
    return articles.withColumns({
        "venue_name": when_present(F.col("venue_name"), text.normalize_venue_name),
        "venue_address": when_present(F.col("venue_address"), text.normalize_address),
        "venue_city": when_present(F.col("venue_city"), text.normalize_city),
        "price_range": when_present(F.col("price_range"), text.normalize_price),
        "sub_articles": F.transform(kept, sub),
    })
