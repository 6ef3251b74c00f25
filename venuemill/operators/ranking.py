"""Running sums and row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above these


def _sorted_once(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """The rows sorted over the whole cluster by (groups, order) and stored, with their place, partition and group."""
    ordered = df.sort(*groups, *order).withColumn("_at", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)  # the positions must not be recomputed
    # NULL is a group, also for the joins below
    group = F.struct(F.lit(0), *[F.col(g) for g in groups])
    return ordered.withColumns({"_part": F.shiftright("_at", _LOCAL_BITS), "_group": group})


def _ahead_of(runs: DataFrame, value: str) -> DataFrame:
    """Of each group in each sorted partition the sum of ``value`` in earlier partitions; one row per partition and group."""
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_ahead", F.coalesce(F.sum(value).over(before), F.lit(0)))


def _with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    return rows.alias("s").join(
        runs.alias("r"), F.col("s._group").eqNullSafe(F.col("r._group")) & (F.col("s._part") == F.col("r._part"))
    )


def running_sum_in_groups(df: DataFrame, groups: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """``sum(value) over (partition by groups order by order rows up to this one)``, whatever the groups' sizes.

    ``order`` must be total within a group.  The rows are sorted over the whole
    cluster by (groups, order) and stored.  A running sum is then one inside the row's sorted
    partition, plus the group's sums in earlier partitions.
    """
    keyed = _sorted_once(df.withColumn("_v", value), groups, order)
    local = Window.partitionBy("_group", "_part").orderBy("_at")
    runs = _ahead_of(keyed.groupBy("_group", "_part").agg(F.sum("_v").alias("_sum")), "_sum")
    joined = _with_runs(keyed.withColumn("_local", F.sum("_v").over(local)), runs)
    return joined.select("s.*", "r._ahead").withColumn(out, F.col("_local") + F.col("_ahead")).select(*df.columns, out)


def row_number_in_groups(df: DataFrame, groups: list[str], order: list[Column], out: str) -> DataFrame:
    """``row_number() over (partition by groups order by order)``, whatever the groups' sizes.

    A group lies in one run of places of a sorted partition, so a row's number follows from its place, the first
    place of the run and the rows of the group in earlier partitions.  Only the table of runs is
    aggregated and joined; where the groups are few it is broadcast by its size and the sorted rows stay where they are.
    """
    keyed = _sorted_once(df, groups, order)
    runs = _ahead_of(keyed.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "_n")
    number = F.col("s._at") - F.col("r._first") + F.col("r._ahead") + 1
    return _with_runs(keyed, runs.drop("_n")).select(*[F.col(f"s.`{c}`") for c in df.columns], number.cast("int").alias(out))


def assign_ranks(df: DataFrame, idx: str = "idx") -> DataFrame:
    """National rank per category and rank per metro region.

    Only scored rows of the four public categories get a rank; the others get
    0 nationally and NULL regionally.  Ties keep the order of ``idx``, which is unique.
    ``df`` is stored once; only the ranked rows' keys are sorted.
    """
    stored = cut_lineage(df)
    ranked = F.col("category").isin(V.RANKED_CATEGORIES) & (F.col("composite_score") > 0)
    metro = F.col("metro_region").isin([m[0] for m in V.METRO_CENTRES])
    order = [F.desc("composite_score_raw"), F.asc(idx)]
    # a row stands once in its category and once in its region, so both ranks come from one sort
    scopes = F.array(F.lit(None).cast("string"), F.when(metro, F.col("metro_region")))
    slim = stored.where(ranked).select(idx, "category", "composite_score_raw", F.posexplode(scopes).alias("scope", "region"))
    slim = slim.where("scope = 0 OR region IS NOT NULL")
    numbered = row_number_in_groups(slim, ["scope", "category", "region"], order, "rank")
    ranks = numbered.groupBy(idx).agg(
        F.max(F.when(F.col("scope") == 0, F.col("rank"))).alias("rank_national"), F.max(F.when(F.col("scope") == 1, F.col("rank"))).alias("rank_region")
    )
    return stored.join(ranks, idx, "left").withColumn(
        "rank_national", F.coalesce("rank_national", F.lit(0))
    ).select(*df.columns, "rank_national", "rank_region")
