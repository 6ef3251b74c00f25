"""The whole chain as lazily composed stages: merge, refine, score, serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill import schemas
from venuemill.functions.score import PIPELINE_POLICY, composite_score, inputs_from_nested
from venuemill.functions.geo import venue_category
from venuemill.operators import dedup, enrich, incremental, ranking, resolve, serve
from venuemill.operators.consolidate import consolidate
from venuemill.operators.slugs import unique_slugs
from venuemill.session import cut_lineage, stored


def merge(articles: DataFrame, known_merges: DataFrame | None = None) -> DataFrame:
    """Articles of all sources (with ``pos``) to venues with unique ids.

    ``idx`` is the founding order and stays the tie-breaker of later steps."""
    mentions = resolve.articles_to_mentions(articles)
    # founding and matching read the aliases several times
    aliases = cut_lineage(resolve.alias_keys(known_merges)) if known_merges is not None else None
    # one row per venue from here on; slugs read it several times
    venues = cut_lineage(consolidate(resolve.resolve(mentions, aliases)))
    return unique_slugs(venues).withColumnRenamed("venue_ord", "idx")


def with_place_columns(venues: DataFrame) -> DataFrame:
    """Venues that were never looked up."""
    kinds = {
        "place_id": "string", "google_rating": "double", "google_rating_count": "int", "maps_uri": "string",
        "primary_type": "string", "business_status": "string", "website": "string", "phone": "string",
    }
    out = venues.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    return out.withColumn("hours", F.lit(None).cast(schemas.HOURS))


def refine(venues: DataFrame, places: DataFrame, keep_unplaced: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(refined venues, alias rows for the next merge, rejected rows)."""
    enriched = enrich.enrich(with_place_columns(venues), places).drop("enriched")
    return finish_refine(cut_lineage(enriched), keep_unplaced)


def refine_again(
    venues: DataFrame, places: DataFrame, previous: DataFrame | None = None, lookups: DataFrame | None = None,
    fingerprint: str | None = None, mode: str = "default", keep_unplaced: bool = False, queried_at: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(refined venues, alias rows, rejected rows, lookup cache) of an incremental run.

    ``previous`` are the refined venues of the last run.  While the merged ``venues`` still have the ``fingerprint`` that was
    stored then, they are taken as they are; otherwise new venues get their place columns by id.
    Only what ``mode`` asks for is looked up among ``places``; hits and misses enter ``lookups``.
    """
    now = F.lit(queried_at) if queried_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    blank = with_place_columns(venues)
    if previous is not None and fingerprint is not None and not incremental.is_stale(venues, fingerprint):
        start = previous.select(*blank.columns)
    else:
        start = enrich.carry_over(blank, previous).drop("carried") if previous is not None else blank
    if lookups is None:
        lookups = venues.sparkSession.createDataFrame([], "id string, place_id string, queried_at string")
    # every join is by id, so wide rows are sent once and stored once
    asked = enrich.enrich(enrich.with_todo(start, lookups, mode), places, F.col("todo"))
    asked = stored(asked.select(*start.columns, "todo"), "enriched")
    cache = incremental.update_lookups(lookups, asked.where("todo").select("id", "place_id", now.alias("queried_at")))
    return (*finish_refine(asked.drop("todo"), keep_unplaced), cache)


def finish_refine(enriched: DataFrame, keep_unplaced: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    aliases = dedup.known_merges(enriched)
    kept, rejected = enrich.cleanup(dedup.dedup_by_place(enriched), keep_unplaced)
    return enrich.classify(kept), aliases, rejected


def score(refined: DataFrame, as_of: Column) -> DataFrame:
    scored = composite_score(refined, PIPELINE_POLICY, inputs_from_nested(), as_of)
    return ranking.assign_ranks(scored)


def serve_table(scored: DataFrame) -> DataFrame:
    return serve.serving_rows(scored)


def recategorize(refined: DataFrame) -> DataFrame:
    """Only the category again, from stored rows."""
    return refined.withColumn("category", venue_category(F.col("venue_type"), F.col("primary_type")))

