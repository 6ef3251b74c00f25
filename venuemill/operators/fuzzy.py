"""Lossless similarity join of name keys, without comparing all pairs.

``1 - d / longer >= t`` bounds the edit distance ``d``, so the lengths of two names tell how many edits they may have.

* Up to ``FEW_EDITS`` edits, both names share a variant: what is left of either after deleting at most as many
  letters.  All variants of the whole name are keys (Bocek et al., Fast Similarity Search in Large Dictionaries,
  2007), so text that all names share makes no key hot by itself.
* Longer names are cut on the indexed side into ``k + 1`` segments, where ``k`` is the largest distance any
  partner may have; ``k`` edits can spoil at most ``k`` segments, so every match
  keeps one (the PassJoin partition scheme, Li et al., PVLDB 5(3), 2011).  A kept
  segment shifts by some ``s`` with ``|s| + |length difference - s| <= k``, as the
  edits left and right of it add up.

Two parity bitmaps, of a name's letters and of its pairs of letters, rule out most candidates before a distance is
computed: an edit flips at most two bits of the one and four of the other.

Distinct names are compared, and candidates are never stored: the join on keys computes the bounded distance, and only pairs
that are similar enough leave it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuemill import fixed_values as V
from venuemill.functions.similarity import (
    address_similarity,
    combined_score,
    similarity_ratio,
)
from venuemill.functions.text import street_number
from venuemill.operators.name_index import FEW_EDITS, NameIndex, ranges
from venuemill.operators.ranking import row_number_in_groups
from venuemill.session import cut_lineage, spread

_EPS = 1e-9
#: Venues that every task may look names up among, some 90 MB; more of them meet the names in a join.
IN_TASKS = 65536


def _max_edits(length: Column, threshold: float) -> Column:
    """Largest distance between a name of this length and any partner."""
    longest = F.floor(length / F.lit(threshold) + F.lit(_EPS))
    return F.floor(F.lit(1.0 - threshold) * longest + F.lit(_EPS)).cast("int")


def _segment_start(i: Column, length: Column, parts: Column) -> Column:
    """First position (from 1) of segment ``i`` of ``parts`` near-equal ones."""
    return (F.floor(i * length / parts) + 1).cast("int")


def _signature(no: Column, text: Column) -> Column:
    return F.xxhash64(no, text)


def _few_edits_length(threshold: float) -> int:
    """The longest name that has at most ``FEW_EDITS`` edits to any partner that is not longer."""
    n = 1
    while math.floor((1.0 - threshold) * (n + 1) + _EPS) <= FEW_EDITS:
        n += 1
    return n


def _parity(letters: Column) -> Column:
    """A bitmap in which each element flips one of 64 bits."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    return F.aggregate(letters, F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(bit(c)))


def _with_bitmaps(names: DataFrame) -> DataFrame:
    """Each name's two bitmaps, computed once and then carried as plain columns."""
    letters = F.split("key", "")
    pairs = F.zip_with(letters, F.slice(letters, 2, F.greatest(F.length("key"), F.lit(1))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return names.withColumn("bits", F.struct(_parity(letters).alias("one"), _parity(pairs).alias("two"), F.length("key").alias("n")))


def _variants(names: DataFrame, threshold: float) -> DataFrame:
    """The names with one row for each distinct variant, by its hash."""
    n = F.length("key")
    without = lambda text, i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("at"), without(F.col("key"), i).alias("text")))
    # the second letter deleted stands at or after the place of the first
    two = F.flatten(F.transform(F.col("once"), lambda x: F.when(
        x["at"] <= F.length(x["text"]), F.transform(F.sequence(x["at"], F.length(x["text"])), lambda j: without(x["text"], j))
    ).otherwise(F.array().cast("array<string>"))))
    once = F.transform("once", lambda x: x["text"])
    edits = _max_edits(n, threshold)
    texts = F.when(edits >= 2, F.concat(F.array("key"), once, two)).otherwise(F.concat(F.array("key"), once))
    return names.where(edits >= 1).withColumn("once", one).withColumn(
        "variant", F.explode(F.array_distinct(F.transform(texts, lambda x: F.xxhash64(x))))
    ).drop("once")


def _shifts(threshold: float) -> dict[str, Column]:
    """Edit bound and shift bounds of a query key of length ``own`` against
    indexed keys of length ``len``."""
    k = F.floor(F.lit(1.0 - threshold) * F.greatest("own", "len") + F.lit(_EPS)).cast("int")
    diff = F.col("own") - F.col("len")
    return {
        "k": k, "diff": diff, "back": F.floor((k - diff) / 2).cast("int"), "ahead": F.floor((k + diff) / 2).cast("int"),
    }


def _segments(keys: DataFrame, threshold: float) -> DataFrame:
    """One row per indexed name and segment: (key, right, len, sig)."""
    n = F.length("key")
    base = keys.select("key", "at", "bits", n.alias("len"), (_max_edits(n, threshold) + 1).alias("parts"))
    base = base.where(F.col("parts") > FEW_EDITS + 1)  # others only have partners that meet by variants

    def cut(i: Column) -> Column:
        start = _segment_start(i, F.col("len"), F.col("parts"))
        end = _segment_start(i + 1, F.col("len"), F.col("parts"))
        return _signature(i, F.substring(F.col("key"), start, end - start))

    return base.select(
        F.col("key").alias("right_key"), F.col("at").alias("right_at"), F.col("bits").alias("right_bits"), "len",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cut)).alias("sig"),
    )


def _probes(keys: DataFrame, threshold: float) -> DataFrame:
    """Substrings of each query key that could be a segment of a partner."""
    n = F.length("key")
    base = (
        keys.select("key", "at", "bits", n.alias("own"))
        .withColumn("shortest", F.ceil(F.col("own") * F.lit(threshold) - F.lit(_EPS)).cast("int"))
        .withColumn("longest", F.floor(F.col("own") / F.lit(threshold) + F.lit(_EPS)).cast("int"))
        .where("own > 0")
        .select("key", "at", "bits", "own", F.explode(F.sequence("shortest", "longest")).alias("len"))
        .withColumn("parts", _max_edits(F.col("len"), threshold) + 1)
        .withColumns(_shifts(threshold))
        .where(F.col("k") > FEW_EDITS)
    )

    def windows(i: Column) -> Column:
        start = _segment_start(i, F.col("len"), F.col("parts"))
        width = _segment_start(i + 1, F.col("len"), F.col("parts")) - start
        first = F.greatest(F.lit(1), start - F.col("back"))
        last = F.least(F.col("own") - width + 1, start + F.col("ahead"))
        spots = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda p: _signature(i, F.substring(F.col("key"), p, width)))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), windows))
    return base.select(F.col("key").alias("left_key"), F.col("at").alias("left_at"), F.col("bits").alias("left_bits"), "len", F.explode(F.array_distinct(found)).alias("sig"))


def _most_edits(longest: Column, threshold: float) -> Column:
    """The largest ``d`` for which ``1 - d / longest >= threshold`` holds in doubles."""
    near = F.floor(F.lit(1.0 - threshold) * longest + F.lit(_EPS)).cast("int")
    return F.when(F.lit(1.0) - near / longest >= F.lit(threshold), near).otherwise(near - 1)


def near_names(left: DataFrame, right: DataFrame, threshold: float = V.NAME_THRESHOLD, earlier: bool = False) -> DataFrame:
    """Rows of both sides whose *different* keys have a similarity of at least ``threshold``.

    ``left`` has (key, left), ``right`` has (key, right); the second columns are
    whatever the caller wants to keep of a row.  Returns (left_key, left, right_key, right,
    name_similarity).  Distinct names are compared, each pair that is similar enough is kept once, and then meets its rows.

    With ``earlier`` both sides have an ``at`` too, and only right rows with a smaller one than the left row count; names
    none of whose rows can are not compared.
    """
    rows = left, right
    last, first = (F.max("at"), F.min("at")) if earlier else (F.lit(1), F.lit(0))
    left, right = (_with_bitmaps(spread(side.where("key <> ''").groupBy("key").agg(at.alias("at")), "key")) for side, at in zip(rows, (last, first)))
    short = F.length("key") <= _few_edits_length(threshold)
    sides = [f"{side}_{c}" for side in ("left", "right") for c in ("key", "at", "bits")]
    name = lambda side, df: df.withColumnsRenamed({c: f"{side}_{c}" for c in ("key", "at", "bits")})
    by_variant = name("left", _variants(left.where(short), threshold)).join(name("right", _variants(right.where(short), threshold)), "variant")
    by_segment = _probes(left, threshold).join(_segments(right, threshold), ["len", "sig"])

    bound = _most_edits(F.greatest("left_bits.n", "right_bits.n"), threshold)
    flips = lambda c: F.bit_count(F.col(f"left_bits.{c}").bitwiseXOR(F.col(f"right_bits.{c}")))
    # the bounded distance stops early and is -1 beyond the bound
    edits = F.call_function("levenshtein", F.col("left_key"), F.col("right_key"), bound)

    def matches(met: DataFrame) -> DataFrame:
        plausible = (flips("two") <= bound * 4) & (flips("one") <= bound * 2) & (F.abs(F.col("left_bits.n") - F.col("right_bits.n")) <= bound)
        order = F.col("right_at") < F.col("left_at")
        return met.select(*sides).where(order & plausible & (F.col("left_key") != F.col("right_key")) & (edits >= 0)).select("left_key", "right_key")

    pairs = matches(by_variant).unionByName(matches(by_segment)).distinct()
    similarity = F.lit(1.0) - F.levenshtein("left_key", "right_key") / F.greatest(F.length("left_key"), F.length("right_key"))
    one, two = (side.withColumnsRenamed({"key": f"{name}_key", "at": f"{name}_at"}) for side, name in zip(rows, ("left", "right")))
    met = pairs.withColumn("name_similarity", similarity).join(one, "left_key").join(two, "right_key")
    if earlier:
        met = met.where(F.col("right_at") < F.col("left_at"))
    return met.select("left_key", "left", "right_key", "right", "name_similarity")


def similar_name_keys(left: DataFrame, right: DataFrame, threshold: float = V.NAME_THRESHOLD) -> DataFrame:
    """Distinct pairs ``(left_key, right_key, name_similarity)`` of different keys.

    For inspection and small sides: the result has a row for every similar pair."""
    one = left.select("key").distinct().withColumn("left", F.lit(0))
    two = right.select("key").distinct().withColumn("right", F.lit(0))
    return near_names(one, two, threshold).select("left_key", "right_key", "name_similarity").distinct()


_RANK_STEP = 10**13  # above any number of venues


def _rank(name_similarity: Column, place_sim: Column, venue_no: Column) -> Column:
    """Score and venue number as one decimal, the best first."""
    worse = F.floor((F.lit(2.0) - combined_score(name_similarity, place_sim)) * F.lit(1e12)).cast("decimal(38,0)")
    return (worse * F.lit(_RANK_STEP).cast("decimal(38,0)") + venue_no).cast("decimal(38,0)")


def _best_apart(rows: DataFrame, venues: DataFrame) -> DataFrame:
    """(row_id, here, any): the least ranks in the row's city and anywhere, for rows and venues that are all different.

    A place counts by its street and by whether numbers are equal, so a row asks for the first venue of each street, once with its
    own number and once with any, for which an equal number is not counted: what that ranks too low, the first question ranks
    right.  So a row meets the streets of a name and not its venues, and without city and number rows of one name and street ask together.
    """
    names = cut_lineage(similar_name_keys(rows, venues)).withColumnRenamed("left_key", "key")
    v = venues.select(F.col("key").alias("right_key"), "venue_city", F.col("venue_place.street").alias("venue_street"), F.col("venue_place.number").alias("number"), "venue_no")
    r = rows.select("row_id", "key", "threshold", F.col("row_city").alias("venue_city"), F.col("row_place.street").alias("street"), F.col("row_place.number").alias("number"))

    def asked(who: DataFrame, by: list[str], here: bool, own: bool) -> DataFrame:
        first = v.groupBy("right_key", *by, "venue_street").agg(F.min("venue_no").alias("venue_no"))
        met = who.join(names, "key").where("name_similarity >= threshold").join(first, ["right_key", *by])
        place = similarity_ratio(F.col("street"), F.col("venue_street")) * F.lit(V.STREET_WEIGHT) + F.lit(float(own)) * F.lit(V.NUMBER_WEIGHT)
        rank = _rank(F.col("name_similarity"), F.coalesce(place, F.lit(0.0)), F.col("venue_no"))
        none = F.lit(None).cast("decimal(38,0)")
        return met.select(*[c for c in who.columns if c not in by], (rank if here else none).alias("here"), rank.alias("any"))

    shared = ["key", "threshold", "street"]
    anywhere = asked(spread(r.select(*shared).distinct(), *shared), [], False, False).groupBy(*shared).agg(F.min("any").alias("any"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in shared]
    answers = [r.alias("r").join(anywhere.alias("a"), same).select("row_id", F.lit(None).cast("decimal(38,0)").alias("here"), "any")]
    local = r.where("venue_city <> ''")
    for who, by, here in ((r, ["number"], False), (local, ["venue_city", "number"], True), (local, ["venue_city"], True)):
        answers.append(asked(who, by, here, "number" in by).select("row_id", "here", "any"))
    return functools.reduce(DataFrame.unionByName, answers).groupBy("row_id").agg(F.min("here").alias("here"), F.min("any").alias("any"))


def _near_in_tasks(left: DataFrame, right: DataFrame, few: list[Row]) -> DataFrame:
    """(left, right, name_similarity) as ``near_names`` gives them with ``earlier``, for few right rows: each task looks its names up among these.

    Rows of one name lie together, so a name is looked up once a batch, and a row carries the venues it meets as numbers."""
    numbers, keys = np.array([r["venue_no"] for r in few], np.int64), [r["key"] for r in few]
    left = spread(left.where("key <> ''"), "key").sortWithinPartitions("key")
    found = T.ArrayType(T.StructType([T.StructField("venue_no", T.LongType()), T.StructField("name_similarity", T.DoubleType())]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch in batches:
            names = names or NameIndex(keys)
            coded = batch["key"].dictionary_encode()
            one, two, similarity = names.near(coded.dictionary.to_pylist())
            bounds = np.searchsorted(one, np.arange(len(coded.dictionary) + 1))
            name = coded.indices.to_numpy()
            counts = np.diff(bounds)[name]
            at = ranges(bounds[name], counts)
            values = pa.StructArray.from_arrays([pa.array(numbers[two][at]), pa.array(similarity[at])], ["venue_no", "name_similarity"])
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], [*batch.schema.names, "found"])

    met = left.mapInArrow(look_up, T.StructType([*left.schema.fields, T.StructField("found", found)]))
    met = met.select("left", F.col("at").alias("left_at"), F.inline("found"))
    venues = right.select(F.col("right.venue_no").alias("venue_no"), "right", F.col("at").alias("right_at"))
    return met.join(F.broadcast(venues), "venue_no").where("right_at < left_at").select("left", "right", "name_similarity")


def best_fuzzy_match(rows: DataFrame, venues: DataFrame, earlier_only: bool = False) -> DataFrame:
    """Best fuzzy partner of each row.

    ``rows``: row_id, key, address, city, threshold (and ``ord`` when
    ``earlier_only``).  ``venues``: venue_ord, key, address, city.  Venues in
    the row's city go first; any venue counts only for rows that found none
    there.  Highest combined score wins, then the earliest venue.

    Score and venue number make one decimal, so both minima (in the city, anywhere) are kept by one
    hash aggregation that combines on the map side, straight from the join.  Unless ``earlier_only``, a name may have any number
    of venues; rows then ask for street, number and city apart.
    """
    r = rows.withColumns({
        "row_place": F.when(F.coalesce(F.col("address") != "", F.lit(False)), street_number(F.col("address"))),
        "row_city": F.lower("city"),
    }).drop("address", "city")
    v = venues.select(
        F.col("venue_ord"), "key", F.lower("city").alias("venue_city"),
        F.when(F.coalesce(F.col("address") != "", F.lit(False)), street_number(F.col("address"))).alias("venue_place"),
    )
    if not earlier_only:
        # copies of a venue (same key, city, place) can only win by being
        # first, and copies of a row get the same answer
        v = v.groupBy("key", "venue_city", "venue_place").agg(F.min("venue_ord").alias("venue_ord"))
        alike = F.to_json(F.struct("key", "row_place", "row_city", "threshold"))
        members = r.select("row_id", alike.alias("alike"))
        r = r.select(alike.alias("alike"), "key", "row_place", "row_city", "threshold").dropDuplicates(["alike"])
        r = cut_lineage(spread(r, "alike").withColumn("row_id", F.monotonically_increasing_id()))
    v = cut_lineage(row_number_in_groups(v, [], [F.asc("venue_ord")], "venue_no").withColumn("venue_no", F.col("venue_no").cast("long")))

    if earlier_only:
        left = r.select("key", F.struct(*[c for c in r.columns if c != "key"]).alias("left"), F.col("ord").alias("at"))
        right = v.select("key", F.struct(*[c for c in v.columns if c != "key"]).alias("right"), F.col("venue_ord").alias("at"))
        few = right.select("right.venue_no", "key").limit(IN_TASKS + 1).collect()
        met = _near_in_tasks(left, right, few) if len(few) <= IN_TASKS else near_names(left, right, earlier=True)
        met = met.where("name_similarity >= left.threshold")
        place_sim = F.coalesce(address_similarity(F.col("left.row_place"), F.col("right.venue_place")), F.lit(0.0))
        in_city = F.coalesce((F.col("left.row_city") != "") & (F.col("left.row_city") == F.col("right.venue_city")), F.lit(False))
        ranked = met.select(F.col("left.row_id").alias("row_id"), in_city.alias("near"), _rank(F.col("name_similarity"), place_sim, F.col("right.venue_no")).alias("rank"))
        best = ranked.groupBy("row_id").agg(F.min(F.when(F.col("near"), F.col("rank"))).alias("here"), F.min("rank").alias("any"))
    else:
        best = _best_apart(r, v)
    winners = best.select("row_id", (F.coalesce("here", "any") % F.lit(_RANK_STEP).cast("decimal(38,0)")).cast("long").alias("venue_no"))

    full = winners.join(r.withColumnRenamed("key", "left_key"), "row_id").join(v.withColumnRenamed("key", "right_key"), "venue_no")
    scored = full.withColumns({
        "name_similarity": similarity_ratio(F.col("left_key"), F.col("right_key")),
        "address_similarity": F.coalesce(address_similarity(F.col("row_place"), F.col("venue_place")), F.lit(0.0)),
    }).withColumn("combined_score", combined_score(F.col("name_similarity"), F.col("address_similarity")))
    if not earlier_only:
        scored = members.join(scored.drop("row_id"), "alike").drop("alike")
    return scored.select("row_id", "venue_ord", "name_similarity", "address_similarity", "combined_score")
