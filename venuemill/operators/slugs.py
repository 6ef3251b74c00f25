"""Unique slugs in venue order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuemill.functions.text import present, slugify
from venuemill.operators.ranking import row_number_in_groups, running_sum_in_groups
from venuemill.session import cut_lineage


def unique_slugs(
    venues: DataFrame, order: str = "venue_ord", out: str = "id",
    default_city: str = "sweden",
) -> DataFrame:
    """``base``, ``base-2``, ``base-3`` ... by order within the base.

    A counter is skipped when that very slug is already taken by a venue whose
    base it literally is (city "Area 2" next to two venues in "Area").  Each
    such contested slug goes to whoever reaches it first; the outcome shifts
    the counters behind it.  Outcomes depend only on shorter bases and lower
    counters, so repeating the decision until nothing changes is exact.
    """
    text = F.concat_ws(" ", F.col("name"), F.when(present(F.col("city")), F.col("city")).otherwise(F.lit(default_city)))
    based = venues.withColumn("_base", slugify(text))
    numbered = row_number_in_groups(based, ["_base"], [F.asc(order)], "_n")

    bases = based.groupBy("_base").agg(F.min(order).alias("first_ord"))
    suffix = r"^(.+)-([2-9]|[1-9][0-9]+)\z"
    literal = bases.where(F.col("_base").rlike(suffix)).select(
        F.col("_base").alias("literal"), "first_ord",
        F.regexp_extract("_base", suffix, 1).alias("root"),
        F.regexp_extract("_base", suffix, 2).try_cast("long").alias("slot"),
    )
    contested = literal.join(bases.select(F.col("_base").alias("root")), "root", "left_semi")
    contested = cut_lineage(contested)
    if contested.isEmpty():
        return _with_slug(numbered, F.col("_n"), out)

    numbered = cut_lineage(numbered)
    # counters of a base: slot 1 is the bare base, then 2, 3, ...; ``held``
    # marks the contested slots that the literal venue took
    arrivals = numbered.select(F.col("_base").alias("root"), F.col("_n").cast("long").alias("n"), F.col(order).alias("arrives"))
    held = contested.select("literal", F.lit(False).alias("held"))
    while True:
        slots = contested.join(held, "literal")
        own = slots.select(F.col("literal").alias("root"), (~F.col("held")).alias("lost"))
        taken = F.col("held").cast("long")
        judged = (
            running_sum_in_groups(slots, ["root"], [F.asc("slot")], taken, "skips")
            .withColumn("skips", F.col("skips") - taken)
            .join(own, "root", "left")
            # a base that lost its bare slug starts one slot later
            .withColumn("n", F.col("slot") - F.col("skips") - F.when(F.coalesce("lost", F.lit(False)), 1).otherwise(0))
            .join(arrivals, ["root", "n"], "left")
            .select("literal", F.col("held").alias("was"),
                    F.coalesce(F.col("first_ord") < F.col("arrives"), F.lit(True)).alias("held"))
        )
        judged = cut_lineage(judged)
        held = judged.select("literal", "held")
        if judged.where("was <> held").isEmpty():
            break

    # counter of arrival n: n plus the blocked slots at or below it
    blocked = contested.join(held.where("held"), "literal", "left_semi").select(F.col("root").alias("_base"), "slot")
    lost = held.where("not held").select(F.col("literal").alias("_base"), F.lit(1).alias("_lost"))
    touched = blocked.select("_base").unionByName(lost.select("_base")).distinct()
    plain = _with_slug(numbered.join(touched, "_base", "left_anti"), F.col("_n"), out)

    # the j-th blocked slot shifts every arrival from slot - j + 1 on: in one
    # order of arrivals and steps, an arrival's place counts the steps up to it
    late = F.coalesce("_lost", F.lit(0))
    steps = (
        row_number_in_groups(blocked, ["_base"], [F.asc("slot")], "_j")
        .join(lost, "_base", "left")
        .select("_base", (F.col("slot") - F.col("_j") + 1 - late).alias("_spot"), F.lit(0).alias("_kind"), "slot", F.lit(None).alias("_row"))
    )
    moved = numbered.join(touched, "_base", "left_semi").join(lost, "_base", "left").withColumn("_late", late).drop("_lost")
    arrivals = moved.select(
        "_base", F.col("_n").cast("long").alias("_spot"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("slot"),
        F.struct(*moved.columns).alias("_row"),
    )
    events = steps.withColumn("_row", F.lit(None).cast(arrivals.schema["_row"].dataType)).unionByName(arrivals)
    placed = row_number_in_groups(events, ["_base"], [F.asc("_spot"), F.asc("_kind"), F.asc("slot")], "_place")
    shifted = placed.where("_kind = 1").select("_row.*", "_place")
    counter = F.col("_place") + F.col("_late")
    return plain.unionByName(_with_slug(shifted, counter, out).select(*plain.columns))


def _with_slug(df: DataFrame, counter, out: str) -> DataFrame:
    slug = F.when(counter == 1, F.col("_base")).otherwise(F.concat_ws("-", F.col("_base"), counter.cast("string")))
    return df.withColumn(out, slug).drop("_base", "_n")
