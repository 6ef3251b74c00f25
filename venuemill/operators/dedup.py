"""Dedup of enriched venues by place id, and the alias table it feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill.functions.text import present
from venuemill.operators.consolidate import NUMERIC_KEYS
from venuemill.operators.ranking import row_number_in_groups
from venuemill.session import cut_lineage

RATING_KEYS = ["michelin", "whiteguide", *NUMERIC_KEYS]


def dedup_by_place(venues: DataFrame, idx: str = "idx") -> DataFrame:
    """Fold venues with one place id into the one with most sources.

    The keeper (most sources, then first) keeps its own columns; donors, in
    the same order, fill missing ratings, sources, quotes, address, city and
    price range.  Works on minima over the donor order, so a place id shared
    by very many venues combines on the map side.  Venues alone with their place stay where they are.
    """
    rank = F.struct((-F.col("source_count")).alias("less"), F.col(idx).alias("idx"))
    sharing, others = _sharing(venues)
    placed = sharing.withColumn("_rank", rank)

    def fill(column: Column) -> Column:
        return F.min(F.when(present(column), F.struct("_rank", column.alias("v"))))["v"]

    def fill_rating(key: str) -> Column:
        r = F.col(f"ratings.{key}")
        return F.min(F.when(r.isNotNull(), F.struct("_rank", r.alias("v"))))["v"].alias(key)

    folded = placed.groupBy("place_id").agg(
        F.min("_rank").alias("_rank"),
        F.count(F.lit(1)).alias("_copies"),
        *[fill(F.col(c)).alias(f"_f_{c}") for c in ("address", "city", "price_range")],
        F.struct(*[fill_rating(k) for k in RATING_KEYS]).alias("_f_ratings"),
    )
    sources = _first_per_source(placed, "sources")
    quotes = _first_per_source(placed, "quotes")
    keepers = placed.join(folded, ["place_id", "_rank"]).join(sources, "place_id", "left").join(quotes, "place_id", "left")
    merged = F.col("_copies") > 1
    kept = keepers.withColumns({
        **{c: F.when(merged, F.coalesce(F.col(f"_f_{c}"), F.col(c))).otherwise(F.col(c)) for c in ("address", "city", "price_range")},
        "ratings": F.when(merged, F.col("_f_ratings")).otherwise(F.col("ratings")),
        "sources": F.when(merged, F.coalesce("_all_sources", "sources")).otherwise(F.col("sources")),
        "quotes": F.when(merged, F.coalesce("_all_quotes", "quotes")).otherwise(F.col("quotes")),
        "source_count": F.when(merged, F.size(F.coalesce("_all_sources", "sources"))).otherwise(F.col("source_count")),
    }).select(*venues.columns)
    return kept.unionByName(others)


#: Place ids of several venues that go to the tasks; with more of them all placed venues are folded.
FEW_SHARED = 100_000


def _sharing(venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the venues that share a place id, all others); the former may hold venues alone with their place too."""
    placed = present(F.col("place_id"))
    shared = venues.where(placed).groupBy("place_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place_id")
    shared = cut_lineage(shared)
    if shared.count() > FEW_SHARED:
        return venues.where(placed), venues.where(~placed)
    return tuple(venues.join(F.broadcast(shared), "place_id", how).select(*venues.columns) for how in ("left_semi", "left_anti"))


def _first_per_source(placed: DataFrame, column: str) -> DataFrame:
    """First entry of each source over the donor order, as one short list."""
    entries = placed.select("place_id", "_rank", F.posexplode(column).alias("_pos", "_entry"))
    first = entries.groupBy("place_id", F.col("_entry.source_id").alias("_source")).agg(
        F.min(F.struct("_rank", "_pos", "_entry")).alias("_first")
    )
    listed = first.groupBy("place_id").agg(F.array_sort(F.collect_list("_first")).alias("_l"))
    return listed.select("place_id", F.transform("_l", lambda e: e["_entry"]).alias(f"_all_{column}"))


def known_merges(venues: DataFrame, idx: str = "idx") -> DataFrame:
    """Long alias table ``(place_id, canonical_name, alias, pos)`` of a dedup run.

    ``pos`` counts the aliases by (fewer sources later, ``idx``), the order in which they are found."""
    rank = F.struct((-F.col("source_count")).alias("less"), F.col(idx).alias("idx"))
    placed = _sharing(venues)[0].select("place_id", "name", rank.alias("rank"))
    keeper = placed.groupBy("place_id").agg(F.min(F.struct("rank", "name")).alias("k"))
    found = (
        placed.join(keeper, "place_id")
        .where(F.col("rank") != F.col("k.rank"))
        .select("place_id", F.col("k.name").alias("canonical_name"), F.col("name").alias("alias"), "rank")
    )
    return _numbered(found, ["rank"]).select(*ALIAS_COLUMNS)


ALIAS_COLUMNS = ["place_id", "canonical_name", "alias", "pos"]


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    return row_number_in_groups(rows, [], [F.asc(c) for c in order], "pos").withColumn("pos", F.col("pos").cast("long"))


def donor_keepers(venues: DataFrame, idx: str = "idx") -> DataFrame:
    """``(donor, keeper)`` of every venue that dedup folds into another."""
    rank = F.struct((-F.col("source_count")).alias("less"), F.col(idx).alias("idx"))
    placed = venues.where(present(F.col("place_id"))).select("place_id", F.col(idx).alias("donor"), rank.alias("rank"))
    keeper = placed.groupBy("place_id").agg(F.min("rank")["idx"].alias("keeper"))
    return placed.join(keeper, "place_id").where("donor != keeper").select("donor", "keeper")


def rekey_article_refs(refs: DataFrame, keepers: DataFrame) -> DataFrame:
    """Article references (``article_refs``) with donors' rows under their keeper, each article once per source."""
    moved = refs.join(keepers, refs["venue_ord"] == keepers["donor"], "left").withColumn(
        "venue_ord", F.coalesce("keeper", "venue_ord")
    )
    return moved.groupBy("venue_ord", "source_id", "article_id").agg(F.min("ord").alias("ord"))


def with_mentions(venues: DataFrame, refs: DataFrame, idx: str = "idx") -> DataFrame:
    """Venues whose sources count the articles that ``refs`` now hold for them."""
    counts = refs.groupBy("venue_ord", "source_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    by_venue = counts.groupBy("venue_ord").agg(F.map_from_entries(F.collect_list(F.struct("source_id", "n"))).alias("_n"))
    counted = F.transform("sources", lambda s: s.withField("mentions", F.coalesce(F.try_element_at("_n", s["source_id"]), s["mentions"])))
    return venues.join(by_venue, venues[idx] == by_venue["venue_ord"], "left").withColumn("sources", counted).select(*venues.columns)


def upsert_known_merges(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Append unseen aliases per place id; the newest canonical name wins.

    Both inputs and the result: ``(place_id, canonical_name, alias, pos)`` with
    numeric ``pos``.  Old aliases keep their order, new ones follow."""
    rows = existing.select("place_id", "canonical_name", "alias", F.lit(0).alias("run"), "pos").unionByName(
        fresh.select("place_id", "canonical_name", "alias", F.lit(1).alias("run"), "pos")
    )
    names = rows.groupBy("place_id").agg(F.max_by("canonical_name", "run").alias("canonical_name"))
    aliases = rows.groupBy("place_id", "alias").agg(F.min(F.struct("run", "pos")).alias("at"))
    merged = aliases.join(names, "place_id").select("place_id", "canonical_name", "alias", "at.run", F.col("at.pos").alias("found"))
    return _numbered(merged, ["run", "found", "place_id", "alias"]).select(*ALIAS_COLUMNS)
