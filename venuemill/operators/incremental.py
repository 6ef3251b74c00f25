"""Incremental ingest: new rows, carry-over, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuemill.functions.text import present


def unseen(candidates: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not known yet; the anti-join needs no distinct."""
    return candidates.join(known.select(key), key, "left_anti")


def append_unseen(known: DataFrame, candidates: DataFrame, key: str = "url") -> DataFrame:
    return known.unionByName(unseen(candidates, known, key), allowMissingColumns=True)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key; only ``order`` is compared, so rows may hold maps."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def carry_body_text(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """A snapshot refresh keeps the body text and its date, by url.

    With several previous rows per url the last one counts."""
    old = previous.groupBy("url").agg(
        F.max(F.struct("pos", "body_text", "enriched_at")).alias("_old")
    )
    has_text = F.coalesce(present(F.col("_old.body_text")), F.lit(False))
    return fresh.join(old, "url", "left").withColumns({
        "body_text": F.when(has_text, F.col("_old.body_text")).otherwise(F.col("body_text")),
        "enriched_at": F.when(has_text & present(F.col("_old.enriched_at")), F.col("_old.enriched_at")).otherwise(F.col("enriched_at")),
    }).drop("_old")


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One-row, order-free fingerprint: 16 hex digits.

    Two decimal sums of row hashes plus the count, hashed; equal tables give
    equal values wherever the rows lie."""
    cols = sorted(columns or df.columns)
    h = F.xxhash64(*cols)
    g = F.xxhash64(F.lit(1), *cols)
    total = [F.sum(x.cast("decimal(28,0)")).cast("string") for x in (h, g)]
    parts = F.concat_ws(":", *total, F.count(F.lit(1)).cast("string"))
    return df.agg(F.substring(F.sha2(parts, 256), 1, 16).alias("fingerprint"))


def is_stale(current: DataFrame, stored_fingerprint: str) -> bool:
    return table_fingerprint(current).first()["fingerprint"] != stored_fingerprint


def update_lookups(cache: DataFrame, results: DataFrame) -> DataFrame:
    """Upsert of lookup results; a miss is kept as a NULL place id so that it
    is never asked again."""
    rows = cache.select("id", "place_id", "queried_at").unionByName(results.select("id", "place_id", "queried_at"))
    newest = rows.groupBy("id").agg(F.max(F.struct("queried_at", "place_id")).alias("r"))
    return newest.select("id", F.col("r.place_id").alias("place_id"), F.col("r.queried_at").alias("queried_at"))


def until_cutoff(items: DataFrame, pos: str, date: str, cutoff: str) -> DataFrame:
    """Rows before the first one dated past the cutoff; undated rows never
    stop the scan.  One global minimum finds the stop, so nothing is sorted."""
    past = present(F.col(date)) & (F.col(date) < F.lit(cutoff))
    stop = items.where(past).agg(F.min(pos)).scalar()
    return items.where(F.coalesce(F.col(pos) < stop, F.lit(True)))
