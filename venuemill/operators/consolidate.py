"""Fold resolved mentions into one row per venue.

Every "first present" rule is ``min(struct(ord, value))`` over the qualifying
rows.  Such minima combine on the map side and merge in two steps, first per
(venue, source) and then per venue, so a venue with very many mentions never
meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.functions.text import present, present_number, strip_plain
from venuemill.session import TASK_ROWS, dealt

NUMERIC_KEYS = ["svd", "dn", "di", "krogguiden", "falstaff", "thatsup"]


def _first(when: Column, **values: Column) -> Column:
    fields = [c.alias(name) for name, c in values.items()]
    return F.min(F.when(when, F.struct(F.col("ord"), F.struct(*fields).alias("v"))))


def _last(when: Column, **values: Column) -> Column:
    fields = [c.alias(name) for name, c in values.items()]
    return F.max(F.when(when, F.struct(F.col("ord"), F.struct(*fields).alias("v"))))


def consolidate(resolved: DataFrame, lie_by: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``venue_ord`` with fields, ratings, sources and quotes.

    ``lie_by`` names columns that are equal for all rows of a venue and by which the rows are dealt to tasks
    already.  They are then folded where they lie and not sent again, so all rows of such a key pass one task, sorted."""
    founder = F.col("ord") == F.col("venue_ord")
    guide = F.col("source_id") == "whiteguide-review"
    michelin = F.col("source_id") == "michelin"
    sub = F.col("is_sub")
    always = F.lit(True)
    has_tags = F.coalesce(F.size("tags") > 0, F.lit(False))
    first_tag = F.try_element_at(F.col("tags"), F.lit(1))
    numeric = ~guide & ~michelin & F.coalesce(F.col("score") > 0, F.lit(False))
    pair = present_number(F.col("lat")) & present_number(F.col("lng"))
    no_count = F.lit(None).cast("int")
    body = strip_plain(F.col("body_text"))
    city = F.when(founder, F.col("match_city")).otherwise(F.col("fill_city"))
    typed = present(F.col("venue_type")) & (F.col("venue_type") != "restaurant")

    per_source = resolved.groupBy(*lie_by, "venue_ord", "source_id").agg(
        _first(always, url=F.col("url"), content_type=F.col("content_type"),
               published_at=F.when(present(F.col("published_at")), F.col("published_at"))).alias("ref"),
        F.count(F.lit(1)).alias("mentions"),
        F.max(sub).alias("any_sub"),
        _last(~sub, name=F.col("name")).alias("last_name"),
        _first(~sub, name=F.col("name")).alias("first_named"),
        _first(founder, name=F.col("name")).alias("founder_name"),
        _first(present(F.col("address")), value=F.col("address")).alias("address"),
        _first(present(city), value=city).alias("city"),
        _first(present(F.col("price_range")), value=F.col("price_range")).alias("price"),
        _first(pair | (founder & guide & present_number(F.col("lat"))), lat=F.col("lat"), lng=F.col("lng")).alias("geo"),
        _first(founder & guide, lat=F.col("lat"), lng=F.col("lng")).alias("founder_geo"),
        _first(~sub & typed & (founder | ~michelin), value=F.col("venue_type")).alias("kind"),
        F.max(michelin & F.coalesce(F.col("venue_type") == "hotel", F.lit(False))).alias("hotel"),
        _first(michelin & has_tags, distinction=first_tag, score=F.coalesce("score", F.lit(0.0))).alias("michelin"),
        _first(guide, classification=first_tag, venue_type=F.col("venue_type"),
               sub_scores=F.col("explicit_sub_scores")).alias("whiteguide"),
        _first(numeric, score=F.col("score"), scale_min=F.col("scale_min"), scale_max=F.col("scale_max"),
               sub_scores=F.when(~sub, F.col("explicit_sub_scores")),
               published_at=F.when(present(F.col("published_at")), F.col("published_at")),
               review_count=F.when(present_number(F.col("review_count")), F.col("review_count")).otherwise(no_count),
               ).alias("numeric"),
        _first(F.col("source_id").isin(V.QUOTE_SOURCES) & F.coalesce(F.length(body) >= V.QUOTE_MIN_CHARS, F.lit(False)),
               text=body, published_at=F.when(present(F.col("published_at")), F.col("published_at")),
               url=F.col("url")).alias("quote"),
        F.first("rating_key").alias("rating_key"),
    )

    def merged(name: str) -> Column:
        return F.min(name)["v"]

    def of_source(column: Column, source_id: str) -> Column:
        return F.min(F.when(F.col("source_id") == source_id, column))

    ratings = F.struct(
        merged("michelin").alias("michelin"),
        merged("whiteguide").alias("whiteguide"),
        *[F.min(F.when(F.col("rating_key") == k, F.col("numeric")))["v"].alias(k) for k in NUMERIC_KEYS],
    )
    # at most one entry per source, so these lists are bounded
    sources = F.array_sort(F.collect_list(F.struct(
        F.col("ref.ord").alias("ord"), "source_id", F.col("ref.v.url").alias("url"),
        F.col("ref.v.content_type").alias("content_type"), F.col("ref.v.published_at").alias("published_at"),
        "mentions",
    )))
    quotes = F.array_sort(F.collect_list(F.when(F.col("quote").isNotNull(), F.struct(
        F.col("quote.ord").alias("ord"), "source_id", F.col("quote.v.text").alias("text"),
        F.col("quote.v.published_at").alias("published_at"), F.col("quote.v.url").alias("url"),
        F.lit(None).cast("string").alias("excerpt"),
    ))))
    best_name = F.coalesce(
        *[of_source(F.col("last_name.v.name"), s) for s in V.NAME_PRIORITY],
        F.min(F.when(F.col("first_named").isNotNull(),
                     F.struct(F.col("first_named.ord").alias("ord"), F.col("last_name.v.name").alias("name"))))["name"],
        F.min("founder_name")["v"]["name"],
    )
    geo, founder_geo = F.min("geo")["v"], F.min("founder_geo")["v"]
    return per_source.groupBy(*lie_by, "venue_ord").agg(
        best_name.alias("name"),
        F.coalesce(merged("address")["value"], F.lit("")).alias("address"),
        F.coalesce(merged("city")["value"], F.lit("")).alias("city"),
        F.when(F.max("hotel"), F.lit("hotel"))
        .otherwise(F.coalesce(merged("kind")["value"], F.lit("restaurant"))).alias("venue_type"),
        F.coalesce(geo, founder_geo)["lat"].alias("lat"),
        F.coalesce(geo, founder_geo)["lng"].alias("lng"),
        F.coalesce(merged("price")["value"], F.lit("")).alias("price_range"),
        ratings.alias("ratings"),
        F.transform(sources, lambda s: s.dropFields("ord")).alias("sources"),
        F.count(F.lit(1)).cast("int").alias("source_count"),
        F.transform(quotes, lambda q: q.dropFields("ord")).alias("quotes"),
    ).drop(*lie_by)


def article_refs(resolved: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Long table of the articles behind each venue and source.

    Kept long on purpose: the list of one venue has no bound.  The rows, read once more to be counted, are
    dealt by article too, to tasks whose number grows with them."""
    keys = ["venue_ord", "source_id", "article_id"]
    return dealt(resolved, *keys, task_rows=task_rows).groupBy(*keys).agg(F.min("ord").alias("ord"))
