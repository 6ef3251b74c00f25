"""Entity resolution: which articles mean the same venue.

The reference order is one sequence: passes by source, rows by file position,
sub-articles by list position.  A row either matches a venue founded earlier
in that sequence (same key, alias, or similar name) or founds one.

A row founds exactly when it may found and no earlier *founder* matches it, so
the founders are the lexicographically first maximal independent set of the
"matches" graph.  The first nodes of the order are decided, and their founders strike out all later nodes
they match before the next ones are looked at, so of a dense cluster few nodes are left; where names are sparse, parallel rounds
over longer prefixes settle them.  No edge is stored.  Copies of a name need one node each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.functions.text import lookup, name_key, present
from venuemill.operators.fuzzy import best_fuzzy_match, near_names
from venuemill.operators.name_index import NameIndex, alike as _alike  # noqa: F401
from venuemill.operators.ranking import row_number_in_groups
from venuemill.session import cut_lineage, spread


def articles_to_mentions(articles: DataFrame) -> DataFrame:
    """Articles (with ``pos``, their place in the source file) to mentions.

    A mention is one row that can match or found a venue: an article of a
    merged source, or a sub-article of the listing source.
    """
    source = F.col("source_id")
    merged = V.SOURCE_PASSES
    rows = articles.where(source.isin([p[1] for p in merged])).withColumns({
        "pass": lookup({p[1]: p[0] for p in merged}, source),
        "rating_key": lookup({p[1]: p[2] for p in merged}, source),
        "scale_min": lookup({p[1]: p[3] for p in merged if p[3] is not None}, source),
        "scale_max": lookup({p[1]: p[4] for p in merged if p[4] is not None}, source),
    })
    simple = ~F.col("source_id").isin("whiteguide-review", "michelin")
    skipped = simple & F.coalesce(F.col("content_type").isin("listing", "news"), F.lit(False))
    addressed = present(F.col("venue_address"))
    strict = (F.col("source_id") == "svd-review") | ~addressed

    direct = rows.where(present(F.col("venue_name")) & ~skipped).select(
        F.struct(F.col("pass"), F.col("pos"), F.lit(0).alias("sub")).alias("ord"),
        "source_id", "rating_key", "scale_min", "scale_max", F.lit(False).alias("is_sub"),
        F.col("venue_name").alias("name"), F.col("venue_address").alias("address"),
        F.col("venue_city").alias("match_city"), F.col("venue_city").alias("fill_city"),
        "venue_type", "score", "price_range", "lat", "lng",
        F.when(simple & strict, F.lit(V.NAME_THRESHOLD_NO_ADDRESS)).otherwise(F.lit(V.NAME_THRESHOLD)).alias("threshold"),
        (~simple | addressed | present(F.col("venue_city"))).alias("can_found"),
        F.col("id").alias("article_id"), "url", "content_type", "published_at", "body_text",
        "tags", "explicit_sub_scores", "review_count",
    )
    sub = (
        rows.where(F.col("source_id") == "dn-review")
        .select("*", F.posexplode("sub_articles").alias("sub_pos", "part"))
        .where(present(F.col("part.venue_name")))
        .withColumn("sub_city", F.when(present(F.col("part.venue_city")), F.col("part.venue_city")).otherwise(F.col("venue_city")))
        .select(
            F.struct(F.lit(V.SUB_ARTICLE_PASS).alias("pass"), F.col("pos"), F.col("sub_pos").alias("sub")).alias("ord"),
            "source_id", "rating_key", "scale_min", "scale_max", F.lit(True).alias("is_sub"),
            F.col("part.venue_name").alias("name"), F.col("part.venue_address").alias("address"),
            F.col("sub_city").alias("match_city"), F.col("part.venue_city").alias("fill_city"),
            F.lit(None).cast("string").alias("venue_type"), F.col("part.score").alias("score"),
            F.col("part.price_range").alias("price_range"),
            F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
            F.lit(V.NAME_THRESHOLD).alias("threshold"),
            (present(F.col("part.venue_address")) | present(F.col("sub_city"))).alias("can_found"),
            F.col("id").alias("article_id"), "url", "content_type", "published_at", "body_text",
            F.lit(None).cast("array<string>").alias("tags"),
            F.lit(None).cast(articles.schema["explicit_sub_scores"].dataType).alias("explicit_sub_scores"),
            F.lit(None).cast("int").alias("review_count"),
        )
    )
    return direct.unionByName(sub).withColumn("key", name_key(F.col("name")))


def alias_keys(known_merges: DataFrame) -> DataFrame:
    """Alias table ``(canonical_name, alias, pos)`` to ``(key, canonical_key)``.

    The last entry of an alias wins; an empty canonical key is no alias.  Copies of an entry fold before keys are made of the names."""
    return (
        known_merges.groupBy("alias", "canonical_name").agg(F.max("pos").alias("pos"))
        .select(
            name_key(F.col("alias")).alias("key"),
            F.struct("pos", name_key(F.col("canonical_name")).alias("canonical_key")).alias("entry"),
        )
        .groupBy("key")
        .agg(F.max("entry").alias("entry"))
        .select("key", F.col("entry.canonical_key").alias("canonical_key"))
        .where("canonical_key <> ''")
    )


#: Nodes that one task decides in order; a fixed number, whatever the input.
SMALL = 16384
#: Founders that tasks look names up among at a time, and such lots at most: more of them meet later names in a join.
LOT, LOTS = 32768, 2
#: Names that a task looks up, about, as each prepares the founders.
TASK_NAMES = 8192
#: A prefix with at most so many edges a node is followed by a longer one, by this factor; others by a shorter one.
SPARSE, GROWTH = 0.2, 8


def _matches(later: DataFrame, earlier: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges ``(src, dst)``: nodes of ``later`` that match an earlier node by key, alias or similar name.

    ``later`` has (no, key, threshold), ``earlier`` (no, key).  An edge may come more than once."""
    dst = later.select(F.col("key").alias("dst_key"), F.col("no").alias("dst"))
    src = earlier.select(F.col("key").alias("src_key"), F.col("no").alias("src"))
    same = dst.join(src, F.col("dst_key") == F.col("src_key"))
    via = dst.join(aliases, F.col("dst_key") == aliases["key"]).join(src, F.col("canonical_key") == F.col("src_key"))
    near = near_names(
        later.select("key", F.struct("no", "threshold").alias("left"), F.col("no").alias("at")),
        earlier.select("key", F.struct("no").alias("right"), F.col("no").alias("at")), earlier=True,
    ).where("name_similarity >= left.threshold").select(F.col("right.no").alias("src"), F.col("left.no").alias("dst"))
    return same.select("src", "dst").unionByName(via.select("src", "dst")).unionByName(near).where("src < dst")


def _not_struck(later: DataFrame, founders: DataFrame, aliases: DataFrame) -> DataFrame:
    """The nodes of ``later`` that none of ``founders`` matches.

    Up to ``LOT * LOTS`` founders go to the tasks, a fixed number, and later names stay where they are."""
    first = founders.select("no", "key").orderBy("no").limit(LOT * LOTS + 1).collect()
    if len(first) > LOT * LOTS:
        struck = _matches(later, founders, aliases).select(F.col("dst").alias("no")).distinct()
        return later.join(struck, "no", "left_anti")
    for at in range(0, len(first), LOT):
        lot = [r["key"] for r in first[at : at + LOT]]

        def keep(batches: Iterator[pa.RecordBatch], lot: list[str] = lot) -> Iterator[pa.RecordBatch]:
            names, known = None, set(lot)
            for batch in batches:
                names = names or NameIndex(lot)
                keys, aliases = (batch[c].to_pylist() for c in ("key", "canonical_key"))
                here, _, similarity = names.near(keys)
                struck = np.array([key in known or (alias != "" and alias in known) for key, alias in zip(keys, aliases)], bool)
                struck[here[similarity >= batch["threshold"].to_numpy()[here]]] = True
                yield batch.filter(pa.array(~struck))

        later = later.mapInArrow(keep, later.schema)
    return later


def _in_order(nodes: DataFrame) -> DataFrame:
    """The founders (no, key) among at most ``SMALL`` nodes, taken one after the other in one task; each strikes out the names it resembles."""

    def decide(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("no", "key", "canonical_key", "threshold"))))
        names, known, founders = NameIndex([key for _, key, _, _ in rows]), set(), []
        least = np.array([threshold for *_, threshold in rows])
        struck = np.zeros(len(rows), bool)
        for at, (no, key, alias, _) in enumerate(rows):
            if struck[at] or key in known or (alias and alias in known):
                continue
            known.add(key)
            founders.append((no, key))
            _, others, similarity = names.near([key])
            struck[others[similarity >= least[others]]] = True
        return pa.table({"no": pa.array([no for no, _ in founders], pa.int64()), "key": pa.array([key for _, key in founders], pa.string())})

    return nodes.groupBy((F.col("no") * 0).alias("prefix")).applyInArrow(decide, "no long, key string")


def _in_round(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """The numbers of the nodes with an earlier neighbour, for any number of nodes; edges are counted, never stored."""
    return _matches(nodes, nodes, aliases).groupBy(F.col("dst").alias("no")).agg(F.count("*").alias("edges"))


def _settled(nodes: DataFrame, aliases: DataFrame) -> list[DataFrame]:
    """The founders (no, key) among ``n`` open nodes (no, key, threshold, canonical_key): the lexicographically first maximal independent set.

    The order is halved until a stretch can be decided; the founders of a first half strike out nodes of the second one
    before that is looked at (greedy sets by prefixes, Blelloch, Fineman, Shun, SPAA 2012), so a name meets founders as often as the order
    is halved, not once for each stretch.  ``SMALL`` nodes are decided in order by one task.  While nodes have few
    neighbours in their stretch, the next one may be ``GROWTH`` times as long and is settled by rounds, in which nodes without an earlier
    neighbour found; where they have many, stretches shrink, so that names of a dense cluster are struck out by its first
    founders before they are compared with one another.
    """
    length = SMALL

    def decided(part: DataFrame, n: int) -> list[DataFrame]:
        nonlocal length
        few = n <= SMALL
        if few:
            new = cut_lineage(_in_order(part))
            edges = n - new.count()
        else:
            seen = cut_lineage(_in_round(part, aliases))
            edges = seen.agg(F.coalesce(F.sum("edges"), F.lit(0))).first()[0]
        length = length * GROWTH if edges <= SPARSE * n else max(SMALL, length // GROWTH)
        if few:
            return [new]
        new = cut_lineage(part.join(seen, "no", "left_anti").select("no", "key"))
        # what a round leaves open stays open, unless a new founder strikes it out
        rest = cut_lineage(_not_struck(part.join(new, "no", "left_anti"), new, aliases))
        return [new, *settle(rest)]

    def settle(part: DataFrame) -> list[DataFrame]:
        n, low, high = part.agg(F.count("*"), F.min("no"), F.max("no")).first()
        if n == 0:
            return []
        if n <= length:
            return decided(part, n)
        middle = (low + high) // 2
        part = part.coalesce(-(-n // TASK_NAMES))
        founders = settle(part.where(F.col("no") <= middle))
        rest = part.where(F.col("no") > middle)
        if founders:
            rest = cut_lineage(_not_struck(rest, functools.reduce(DataFrame.unionByName, founders), aliases))
        return founders + settle(rest)

    return settle(nodes) or [nodes.select("no", "key")]


def found(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """The nodes ``(key, threshold, node)`` that found a venue; ``node`` gives the order."""
    numbered = row_number_in_groups(nodes, [], [F.asc("node"), F.asc("key"), F.asc("threshold")], "no")
    numbered = cut_lineage(numbered.withColumn("no", F.col("no").cast("long")))
    # an empty name stands for no alias, as no canonical key is empty
    named = numbered.join(aliases, "key", "left").select("no", "key", "threshold", F.coalesce("canonical_key", F.lit("")).alias("canonical_key"))
    founders = functools.reduce(DataFrame.unionByName, _settled(cut_lineage(spread(named, "no")), aliases))
    return numbered.join(founders, "no", "left_semi").select("node")


def resolve(mentions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Add ``venue_ord`` (the founder's ``ord``) and ``match_kind`` to mentions.

    Rows that match nothing and may not found are dropped, as their venue
    would be ambiguous.
    """
    spark = mentions.sparkSession
    if aliases is None:
        aliases = spark.createDataFrame([], "key string, canonical_key string")
    # only these columns decide; texts and ratings join back once at the end
    deciding = ["ord", "key", "address", "match_city", "threshold", "can_found"]
    slim = cut_lineage(mentions.select(*deciding))
    nodes = slim.where("can_found").groupBy("key", "threshold").agg(F.min("ord").alias("node"))
    founders = found(nodes, aliases)
    venues = cut_lineage(
        slim.join(founders.withColumnRenamed("node", "ord"), "ord", "left_semi").select(
            F.col("ord").alias("venue_ord"), "key", "address", F.col("match_city").alias("city")
        )
    )
    matches = match_to_venues(slim, venues, aliases)
    return mentions.join(matches.select("ord", "venue_ord", "match_kind"), "ord")


def match_to_venues(mentions: DataFrame, venues: DataFrame, aliases: DataFrame) -> DataFrame:
    """Final choice per mention among venues founded up to it.

    Founded keys are unique, because a row never founds when its key exists.
    """
    by_key = venues.select(F.col("key").alias("direct_key"), F.col("venue_ord").alias("direct_ord"))
    by_alias = venues.select(F.col("key").alias("alias_target"), F.col("venue_ord").alias("alias_ord"))
    staged = (
        mentions.join(by_key, (F.col("key") == F.col("direct_key")) & (F.col("direct_ord") <= F.col("ord")), "left")
        .join(aliases, "key", "left")
        .join(by_alias, (F.col("canonical_key") == F.col("alias_target")) & (F.col("alias_ord") < F.col("ord")), "left")
        .withColumn("exact_ord", F.coalesce("direct_ord", "alias_ord"))
    )
    staged = cut_lineage(staged)
    open_rows = staged.where("exact_ord is null").select(
        F.col("ord").alias("row_id"), "ord", "key", "address", F.col("match_city").alias("city"), "threshold"
    )
    fuzzy = best_fuzzy_match(open_rows, venues, earlier_only=True).select(
        F.col("row_id").alias("fuzzy_row"), F.col("venue_ord").alias("fuzzy_ord"), "name_similarity"
    )
    kind = (
        F.when(F.col("direct_ord") == F.col("ord"), F.lit("founded"))
        .when(F.col("direct_ord").isNotNull(), F.lit("exact"))
        .when(F.col("alias_ord").isNotNull(), F.lit("alias"))
        .otherwise(F.lit("fuzzy"))
    )
    return (
        staged.join(fuzzy, F.col("ord") == F.col("fuzzy_row"), "left")
        .withColumns({"venue_ord": F.coalesce("exact_ord", "fuzzy_ord"), "match_kind": kind})
        .where("venue_ord is not null")
        .drop("direct_key", "direct_ord", "canonical_key", "alias_target", "alias_ord",
              "exact_ord", "fuzzy_row", "fuzzy_ord", "name_similarity")
    )


def exact_match(
    rows: DataFrame, venues: DataFrame, aliases: DataFrame, prefer_city: Column | bool = True
) -> DataFrame:
    """Exact and alias matching of rows against any venue table.

    ``rows``: row_id, key, city.  ``venues``: venue_ord, key, city.  Several
    venues may share a key; the first one in the row's city wins, else the
    first one.  Venues are reduced to one row per key, and one per key and
    city, before the join, so a hot key never multiplies.
    """
    prefer_city = prefer_city if isinstance(prefer_city, Column) else F.lit(prefer_city)
    first = venues.groupBy("key").agg(F.min("venue_ord").alias("first_ord"))
    in_city = (
        venues.where(present(F.col("city")))
        .groupBy("key", F.lower("city").alias("venue_city"))
        .agg(F.min("venue_ord").alias("city_ord"))
    )

    def probe(df: DataFrame, key: str, prefix: str) -> DataFrame:
        f = first.select(F.col("key").alias(f"{prefix}_k"), F.col("first_ord").alias(f"{prefix}_first"))
        c = in_city.select(
            F.col("key").alias(f"{prefix}_ck"), "venue_city", F.col("city_ord").alias(f"{prefix}_city")
        )
        out = df.join(f, df[key] == f[f"{prefix}_k"], "left")
        out = out.join(c, (out[key] == c[f"{prefix}_ck"]) & (F.lower(out["city"]) == c["venue_city"]), "left")
        return out.drop(f"{prefix}_k", f"{prefix}_ck", "venue_city")

    staged = probe(rows, "key", "direct").join(aliases, "key", "left")
    staged = probe(staged, "canonical_key", "alias")
    def pick(prefix: str) -> Column:
        return F.when(prefer_city, F.coalesce(f"{prefix}_city", f"{prefix}_first")).otherwise(F.col(f"{prefix}_first"))

    return (
        staged.withColumns({
            "venue_ord": F.coalesce(pick("direct"), pick("alias")),
            "match_kind": F.when(F.col("direct_first").isNotNull(), F.lit("exact"))
            .when(F.col("alias_first").isNotNull(), F.lit("alias")),
        })
        .drop("canonical_key", "direct_first", "direct_city", "alias_first", "alias_city")
    )
