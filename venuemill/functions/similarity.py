"""Edit-distance similarity of names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuemill import fixed_values as V


def similarity_ratio(a: Column, b: Column) -> Column:
    """``1 - distance / longer length``; 1 when equal, 0 when one is empty."""
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    )


def address_similarity(a: Column, b: Column) -> Column:
    """Similarity of two ``struct(street, number)``."""
    return similarity_ratio(a["street"], b["street"]) * F.lit(V.STREET_WEIGHT) + F.when(
        a["number"] == b["number"], F.lit(1.0)
    ).otherwise(F.lit(0.0)) * F.lit(V.NUMBER_WEIGHT)


def combined_score(name_similarity: Column, address_sim: Column) -> Column:
    return name_similarity * F.lit(V.NAME_WEIGHT) + address_sim * F.lit(V.ADDRESS_WEIGHT)
