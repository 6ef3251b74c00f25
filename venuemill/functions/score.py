"""Composite 0-100 score.

One builder serves two policies that differ in weights, label maps, guards
and ceilings.  Sources are added in a fixed order, so sums are bit-stable.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.functions.staging import settled
from venuemill.functions.text import lookup, present, present_number, round_half_up


@dataclass(frozen=True)
class ScorePolicy:
    order: list[str]
    weights: dict[str, float]
    classification_scores: dict[str, float]
    starred: list[str]
    uppercase_labels: bool
    decay: bool
    positive_only: bool
    prestige_scale: float | None
    open_ceiling: float | None
    basic_ceiling: float
    prestige_numeric: list[str] = field(default_factory=list)
    diversity: tuple[float, float] | None = None
    visited_ceiling: float | None = None
    empty_is_zero: bool = True


PIPELINE_POLICY = ScorePolicy(
    order=["michelin", "whiteguide", "svd", "di", "krogguiden", "falstaff", "dn", "thatsup", "google"],
    weights=V.PIPELINE_WEIGHTS,
    classification_scores=V.CLASSIFICATION_SCORES,
    starred=V.STARS + V.KEYS,
    uppercase_labels=True,
    decay=True,
    positive_only=False,
    prestige_scale=7.5,
    open_ceiling=None,
    basic_ceiling=9.5,
    prestige_numeric=["falstaff"],
)
LEGACY_POLICY = ScorePolicy(
    order=["michelin", "whiteguide", "svd", "krogguiden", "di", "falstaff", "dn", "google"],
    weights=V.LEGACY_WEIGHTS,
    classification_scores=V.LEGACY_CLASSIFICATION_SCORES,
    starred=V.STARS,
    uppercase_labels=False,
    decay=False,
    positive_only=True,
    prestige_scale=None,
    open_ceiling=8.0,
    basic_ceiling=9.5,
    diversity=(0.88, 0.95),
    visited_ceiling=7.0,
    empty_is_zero=False,
)


def time_decay(published_at: Column, as_of: Column) -> Column:
    """Weight factor by review age; 1 for young, undated or unreadable dates.

    Dates without a zone are in UTC, whatever zone the session has."""
    text = F.trim(published_at)
    day = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{1,2}$"), F.concat(text, F.lit("-01"))).otherwise(text)
    zoned = F.when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(day, F.lit("T00:00:00Z"))).when(
        day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ][\d:.]+$"), F.concat(day, F.lit("Z"))
    ).otherwise(day)
    published = F.try_to_timestamp(zoned)
    millis = F.unix_millis(as_of) - F.unix_millis(published)
    years = millis / F.lit(V.MILLIS_PER_YEAR)
    over = F.lit(1.0) - (years - F.lit(V.DECAY_START_YEARS)) * F.lit(V.DECAY_PER_YEAR)
    return (
        F.when(published.isNull() | (years <= V.DECAY_START_YEARS), F.lit(1.0))
        .otherwise(F.greatest(F.lit(V.DECAY_FLOOR), over))
    )


def scaled(score: Column, source: str) -> Column:
    """Native score on the 0-10 scale."""
    return score / F.lit(V.SCALE_MAX[source]) * F.lit(10.0)


def crowd_score(rating: Column, count: Column) -> Column:
    """Crowd rating pulled toward the prior when few people voted."""
    confidence = F.least(F.lit(1.0), count / F.lit(V.CROWD_FULL_CONFIDENCE))
    return confidence * scaled(rating, "google") + (F.lit(1.0) - confidence) * F.lit(V.CROWD_PRIOR)


def distinction_score(label: Column) -> Column:
    return lookup(V.DISTINCTION_SCORES, label)


def classification_score(label: Column, policy: ScorePolicy = PIPELINE_POLICY) -> Column:
    return lookup(policy.classification_scores, F.upper(label) if policy.uppercase_labels else label)


@dataclass(frozen=True)
class ScoreInputs:
    """Columns of one venue as the policies see them."""

    distinction: Column
    has_michelin: Column
    classification: Column
    has_whiteguide: Column
    numeric: dict[str, Column]
    published: dict[str, Column]
    google: Column
    google_count: Column
    krogguiden_link: Column


def inputs_from_nested(ratings: str = "ratings") -> ScoreInputs:
    """Nested rating structs next to flat place columns."""
    r = F.col(ratings)
    sources = ["svd", "di", "krogguiden", "falstaff", "dn", "thatsup"]
    return ScoreInputs(
        distinction=r["michelin"]["distinction"],
        has_michelin=r["michelin"].isNotNull(),
        classification=r["whiteguide"]["classification"],
        has_whiteguide=r["whiteguide"].isNotNull(),
        numeric={s: r[s]["score"] for s in sources},
        published={s: r[s]["published_at"] for s in sources},
        google=F.col("google_rating"),
        google_count=F.col("google_rating_count"),
        krogguiden_link=F.lit(None).cast("string"),
    )


def inputs_from_flat(ratings: str = "ratings", count: str = "google_rating_count", links: str = "links") -> ScoreInputs:
    """One plain column per source, as in the serving rows."""
    r = F.col(ratings)
    sources = ["svd", "di", "krogguiden", "falstaff", "dn"]
    return ScoreInputs(
        distinction=r["michelin"],
        has_michelin=present(r["michelin"]),
        classification=r["whiteguide"],
        has_whiteguide=present(r["whiteguide"]),
        numeric={s: r[s] for s in sources},
        published={s: F.lit(None).cast("string") for s in sources},
        google=r["google"],
        google_count=F.coalesce(F.col(count), F.lit(0)),
        krogguiden_link=F.try_element_at(F.col(links), F.lit("krogguiden")),
    )


def composite_score(df: DataFrame, policy: ScorePolicy, inputs: ScoreInputs, as_of: Column | None = None) -> DataFrame:
    """Add ``normalized_ratings``, ``composite_score`` and ``composite_score_raw``."""
    scores: dict[str, Column] = {}
    weights: dict[str, Column] = {}
    for source in policy.order:
        weight = F.lit(policy.weights[source])
        if source == "michelin":
            scores[source] = distinction_score(inputs.distinction)
        elif source == "whiteguide":
            scores[source] = classification_score(inputs.classification, policy)
        elif source == "google":
            known = inputs.google.isNotNull()
            known = known & ((inputs.google > 0) if policy.positive_only else present_number(inputs.google_count))
            scores[source] = F.when(known, crowd_score(inputs.google, inputs.google_count))
        else:
            raw = inputs.numeric[source]
            scores[source] = scaled(F.when(raw > 0, raw) if policy.positive_only else raw, source)
            if policy.decay:
                weight = weight * time_decay(inputs.published[source], as_of)
        weights[source] = weight

    work = df.withColumns(
        {f"_s_{s}": scores[s] for s in policy.order}
        | {f"_w_{s}": weights[s] for s in policy.order}
        | {
            "_starred": F.coalesce(inputs.distinction.isin(policy.starred), F.lit(False)),
            "_prestige": inputs.has_michelin | inputs.has_whiteguide | _any_numeric(inputs, policy),
            "_visited": F.coalesce(present(inputs.krogguiden_link), F.lit(False))
            & ~present_number(inputs.numeric["krogguiden"]),
        }
    )

    def sum_over(value) -> Column:
        total = F.lit(0.0)
        for s in policy.order:
            total = total + F.when(F.col(f"_s_{s}").isNotNull(), value(s)).otherwise(F.lit(0.0))
        return total

    work = work.withColumns({
        "_weighted": sum_over(lambda s: F.col(f"_w_{s}") * F.col(f"_s_{s}")),
        "_weight": sum_over(lambda s: F.col(f"_w_{s}")),
        "_n": sum(F.col(f"_s_{s}").isNotNull().cast("int") for s in policy.order),
    })
    mean = F.try_divide(F.col("_weighted"), F.col("_weight"))
    if policy.diversity:
        one, two = policy.diversity
        mean = mean * F.when(F.col("_n") == 1, F.lit(one)).when(F.col("_n") == 2, F.lit(two)).otherwise(F.lit(1.0))
    if policy.visited_ceiling is not None:
        mean = F.when(F.col("_visited"), F.least(mean, F.lit(policy.visited_ceiling))).otherwise(mean)
    if policy.prestige_scale is not None:
        plain = mean / F.lit(10.0) * F.lit(policy.prestige_scale)
    else:
        plain = F.least(mean, F.lit(policy.open_ceiling))
    capped = (
        F.when(F.col("_starred"), mean)
        .when(F.col("_prestige"), F.least(mean, F.lit(policy.basic_ceiling)))
        .otherwise(plain)
    )
    perfect = F.lit(True)
    for s in policy.order:
        perfect = perfect & F.coalesce(F.col(f"_s_{s}") >= V.PERFECTION_THRESHOLD, F.lit(True))

    work = work.withColumn("_raw", F.when(F.col("_n") > 0, capped * F.lit(10.0)))
    rounded = round_half_up(F.col("_raw"))
    shown = F.when((rounded >= 100) & ~(F.col("_starred") & perfect), F.lit(99)).otherwise(rounded)
    if policy.empty_is_zero:
        shown = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(shown, F.lit(0))))
        raw = F.coalesce(F.col("_raw"), F.lit(0.0))
    else:
        raw = F.col("_raw")

    entries = F.filter(
        F.array(*[
            F.struct(F.lit(s).alias("key"), round_half_up(F.col(f"_s_{s}"), 2).alias("value"))
            for s in policy.order
        ]),
        lambda e: e["value"].isNotNull(),
    )
    return settled(work, df.columns, {
        "normalized_ratings": F.map_from_entries(entries),
        "composite_score": shown.cast("int"),
        "composite_score_raw": raw,
    })


def _any_numeric(inputs: ScoreInputs, policy: ScorePolicy) -> Column:
    found = F.lit(False)
    for s in policy.prestige_numeric:
        found = found | present_number(inputs.numeric[s])
    return found
