"""Keep costly columns from being copied into later expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``df.select(keep..., columns...)`` as one evaluation per row.

    A later filter or grouping on a projected column is rewritten on top of
    the column's expression, which copies large expressions many times.  A
    generator over a one-element array stops that and costs one row copy.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
