"""Incremental ingest as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from venuemill.operators.incremental import keep_first, unseen, update_lookups


def first_seen(articles: DataFrame, key: str = "url", event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Streamed articles whose key was not seen before.

    With ``event_time`` and ``delay`` a key is remembered for that long, which bounds the
    state.  Without, every key is kept (one entry each, hash-partitioned), as a
    url may come back after any time."""
    if event_time is None:
        return articles.dropDuplicates([key])
    return articles.withWatermark(event_time, delay or "7 days").dropDuplicatesWithinWatermark([key])


def append_new(
    articles: DataFrame, read_known: Callable[[], DataFrame], path: str, checkpoint: str, key: str = "url",
    order: str = "pos",
) -> StreamingQuery:
    """Append unseen articles to a Parquet table, batch by batch.

    Within a batch the first row of a key by ``order`` counts.  Each batch is
    one anti-join against the table's keys (no other column is read), so a
    replayed batch adds nothing and no state grows."""

    def write(batch: DataFrame, _: int) -> None:
        unseen(keep_first(batch, [key], [order]), read_known(), key).write.mode("append").parquet(path)

    return (
        articles.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def maintain_lookups(
    results: DataFrame, read_cache: Callable[[], DataFrame], write_cache: Callable[[DataFrame, int], None],
    checkpoint: str,
) -> StreamingQuery:
    """Upsert streamed lookup results, misses included, into the cache table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_cache(update_lookups(read_cache(), batch), batch_id)

    return (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
