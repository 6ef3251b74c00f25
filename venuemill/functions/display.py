"""Values shaped for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.functions.text import blank_to_null, present, round_half_up


def gradient_color(score: Column, lightness_offset: int = 0) -> Column:
    """Piecewise-linear colour over the fixed stops."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score.cast("double")))

    def part(lo: tuple, hi: tuple) -> Column:
        t = (s - F.lit(float(lo[0]))) / F.lit(float(hi[0] - lo[0]))
        hue, sat, light = (
            round_half_up(F.lit(float(lo[i])) + t * F.lit(float(hi[i] - lo[i]))) for i in (1, 2, 3)
        )
        return F.format_string("hsl(%d, %d%%, %d%%)", hue, sat, light + F.lit(lightness_offset))

    stops = V.SCORE_GRADIENT
    chain = F.when(s <= stops[1][0], part(stops[0], stops[1]))
    for lo, hi in zip(stops[1:-2], stops[2:-1]):
        chain = chain.when(s <= hi[0], part(lo, hi))
    return chain.otherwise(part(stops[-2], stops[-1]))


def score_color(score: Column) -> Column:
    return F.when(score >= 100, F.lit(V.GOLD)).otherwise(gradient_color(score))


def score_stroke_color(score: Column) -> Column:
    return gradient_color(score, -10)


def icon_bucket(score: Column) -> Column:
    """Nearest multiple of five."""
    return round_half_up(score / F.lit(5)) * 5


def best_numeric_rating(google: Column, krogguiden: Column) -> Column:
    return F.coalesce(google, krogguiden)


def stars(rating: Column) -> Column:
    """``struct(full, half, empty)`` out of five; half from 0.3 up."""
    full = F.floor(rating).cast("int")
    half = (rating - full) >= F.lit(0.3)
    return F.struct(
        full.alias("full"),
        half.alias("half"),
        (F.lit(5) - full - half.cast("int")).alias("empty"),
    )


def venue_description(
    cuisine: Column, address: Column, city: Column, score: Column, rank: Column,
    score_label: str = "Poäng", country: str = "Sverige",
) -> Column:
    """Dot-separated summary; absent parts are left out."""
    place = F.when(present(address) & present(city), F.concat_ws(", ", address, city)).when(
        present(city), city
    )
    return F.concat_ws(
        " · ",
        blank_to_null(cuisine),
        place,
        F.concat(F.lit(f"{score_label}: "), score.cast("string"), F.lit("/100")),
        F.concat(F.lit("#"), rank.cast("string"), F.lit(f" i {country}")),
    )


def venue_head(name: Column, venue_id: Column, category: Column, description: Column,
               site_name: str, base_url: str) -> Column:
    """Title, description, url and page kind of a detail page."""
    prefix = F.create_map(*[F.lit(x) for kv in V.CATEGORY_PREFIX.items() for x in kv])
    return F.when(
        venue_id.isNull(), F.struct(
            F.lit(site_name).alias("title"), F.lit(None).cast("string").alias("description"),
            F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("kind"),
        )
    ).otherwise(
        F.struct(
            F.concat(name, F.lit(f" | {site_name}")).alias("title"),
            description.alias("description"),
            F.concat_ws("/", F.lit(base_url), F.try_element_at(prefix, category), venue_id).alias("url"),
            F.when(category == "restaurant", F.lit("restaurant")).otherwise(F.lit("website")).alias("kind"),
        )
    )
