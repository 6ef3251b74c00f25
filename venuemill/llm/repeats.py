"""Removal of word windows that occur more than once (count-min prefilter, exact second pass)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuemill.llm import blocks
from venuemill.llm.blocks import as_array
from venuemill.llm.rolling import (
    Powers, PrefixHash, covered, first_of_runs, mix, sliding_argmin, starts_inside,
)

WINDOW = 35
#: Counters of one row of the sketch, as a power of two, and rows.  The merged sketch is one bit per counter.
WIDTH_BITS, DEPTH = 25, 2
PIECES = 64
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 12 << 20


class Windows:
    """The windows of a block of texts.

    A window's anchor is its leftmost least half-window gram; equal windows
    have equal anchors in equal places, so counting anchors bounds the
    windows' counts from above at a tenth of the entries.
    """

    def __init__(self, window: int):
        self.window, self.gram = window, (window + 1) // 2
        self.powers = Powers()

    def of(self, bodies: list[bytes | None]):
        """(window starts, anchor hashes, window hashes, places of anchors): all by window, in word positions."""
        one, two, counts = blocks.word_codes(bodies)
        grams = mix(PrefixHash(one, self.powers).windows(self.gram))
        anchor = sliding_argmin(grams, self.window - self.gram + 1)
        at = np.flatnonzero(starts_inside(counts, self.window)[: len(anchor)])
        whole = PrefixHash(two, self.powers).windows(self.window)[at]
        return at, grams[anchor[at]], mix(whole), anchor[at]


def _cells(anchors: np.ndarray, width_bits: int) -> list[np.ndarray]:
    """The counter of each anchor in each row of the sketch; rows lie one after the other."""
    return [
        (mix(anchors + np.uint64(77 * (i + 1))) >> np.uint64(64 - width_bits)).astype(np.int64) + (i << width_bits)
        for i in range(DEPTH)
    ]


def sketch(docs: DataFrame, window: int = WINDOW, text: str = "text", width_bits: int = WIDTH_BITS) -> DataFrame:
    """The merged count-min sketch, as (piece, bits): one bit per counter, set where the count is two or more.

    Each task counts the anchors of its own texts and sends the counters it
    touched, cut into pieces by counter number; pieces are added apart.
    """
    size = (DEPTH << width_bits) // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, once, twice = Windows(window), [], []
        for batch in batches:
            for some in blocks.slices(batch.column(0).to_pylist(), 4 << 20):
                _, anchors, _, place = maker.of(some)
                cells = np.concatenate(_cells(anchors[first_of_runs(place)], width_bits))
                cells, n = np.unique(cells, return_counts=True)
                once.append(cells.astype(np.uint32))
                twice.append(cells[n > 1].astype(np.uint32))
        if not once:
            return
        cells, n = np.unique(np.concatenate(once), return_counts=True)
        many = np.union1d(cells[n > 1], np.concatenate(twice))
        for p in range(PIECES):
            lo, hi = (np.searchsorted(x, [p * size, (p + 1) * size]) for x in (cells, many))
            if lo[1] > lo[0]:
                steps = np.diff(cells[lo[0] : lo[1]], prepend=np.uint32(p * size)).astype(np.uint32)
                yield pa.RecordBatch.from_pydict({
                    "piece": pa.array([p], pa.int32()), "steps": [steps.tobytes()],
                    "many": [(many[hi[0] : hi[1]] - np.uint32(p * size)).astype(np.uint32).tobytes()],
                })

    def add(table: pa.Table) -> pa.Table:
        piece = table["piece"][0].as_py()
        counts = np.zeros(size, np.uint8)
        for steps, many in zip(table["steps"], table["many"]):
            cells = np.cumsum(as_array(steps.as_py(), np.uint32), dtype=np.int64)
            counts[cells] = np.minimum(counts[cells] + 1, 2)
            counts[as_array(many.as_py(), np.uint32)] = 2
        return pa.table({"piece": pa.array([piece], pa.int32()), "bits": [np.packbits(counts > 1).tobytes()]})

    counted = docs.select(F.col(text).cast("string").cast("binary").alias("body")).mapInArrow(blocks.frugal(count), "piece int, steps binary, many binary")
    return counted.groupBy("piece").applyInArrow(blocks.frugal(add), "piece int, bits binary")


def remove_repeated_windows(
    docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
    width_bits: int = WIDTH_BITS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Drop every word covered by a window of ``window`` words that starts in more than one place.

    Returns (doc_id, n_words, n_removed, kept_text), one row per input row.
    A null or empty text has no words and an empty ``kept_text``; repeated
    rows are documents of their own, so they remove each other; a null id is
    kept as it is.  Windows are judged on the input.

    The sketch is ``DEPTH * 2**width_bits`` bits (8 MB), whatever the input, and
    the only thing that goes to all tasks; with far more than 2**width_bits
    anchors it lets more through, which the exact pass then sorts out.
    """
    total = blocks.text_bytes(docs, text)
    session = docs.sparkSession
    size = (DEPTH << width_bits) // PIECES // 8
    merged = bytearray(size * PIECES)
    for row in sketch(docs, window, text, width_bits).toLocalIterator():
        merged[row["piece"] * size : (row["piece"] + 1) * size] = row["bits"]
    shared = session.sparkContext.broadcast(bytes(merged))
    n_blocks, n_shards = blocks.parts_for(docs, total, block_bytes), blocks.parts_for(docs, total, SHARD_BYTES)
    schema = "shard int, block int, one binary, two binary, place binary, n binary, known binary"

    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        at, anchors, whole, _ = Windows(window).of(blocks.ordered(table)["body"].to_pylist())
        bits = np.frombuffer(shared.value, np.uint8)
        maybe = np.ones(len(at), bool)
        for cell in _cells(anchors, width_bits):
            maybe &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
        at, anchors, whole = at[maybe], anchors[maybe], whole[maybe]
        order = np.lexsort((whole, anchors))
        at, anchors, whole = at[order], anchors[order], whole[order]
        first = first_of_runs(anchors) | first_of_runs(whole)
        runs = np.flatnonzero(first)
        n = np.diff(np.append(runs, len(at)))
        again = np.repeat(n > 1, n)  # repeated inside the block: known already
        shard = (anchors[runs] % np.uint64(n_shards)).astype(np.int64)
        out = {k: [] for k in ("shard", "block", "one", "two", "place", "n", "known")}
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(n_shards + 1))
        known = np.sort(at[again]).astype(np.uint32)
        for s in range(n_shards):
            k = by[cuts[s] : cuts[s + 1]]
            own = known if s == block % n_shards else known[:0]
            if len(k) or len(own):
                r = runs[k]
                for name, value in zip(out, (
                    s, block, anchors[r].tobytes(), whole[r].tobytes(), at[r].astype(np.uint32).tobytes(),
                    np.minimum(n[k], 2).astype(np.uint8).tobytes(), np.diff(own, prepend=np.uint32(0)).astype(np.uint32).tobytes(),
                )):
                    out[name].append(value)
        return pa.table(out, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32())] + [(k, pa.binary()) for k in list(out)[2:]]))

    def answer(table: pa.Table) -> pa.Table:
        cells = {k: table[k].to_pylist() for k in table.column_names}
        sizes = [len(x) // 8 for x in cells["one"]]
        one, two = (np.concatenate([as_array(x, np.uint64) for x in cells[k]]) for k in ("one", "two"))
        place, n = np.concatenate([as_array(x, np.uint32) for x in cells["place"]]), np.concatenate([as_array(x, np.uint8) for x in cells["n"]])
        order = np.lexsort((two, one))
        first = first_of_runs(one[order]) | first_of_runs(two[order])
        group = np.cumsum(first) - 1
        total_n = np.bincount(group, n[order]) if len(order) else np.zeros(0)
        repeated = np.zeros(len(one), bool)
        repeated[order] = (total_n > 1)[group]
        repeated &= n == 1
        places, start = [], 0
        for size_, known in zip(sizes, cells["known"]):
            stop = start + size_
            places.append(np.concatenate([place[start:stop][repeated[start:stop]], np.cumsum(as_array(known, np.uint32), dtype=np.uint32)]).astype(np.uint32).tobytes())
            start = stop
        return pa.table({"block": pa.array(cells["block"], pa.int32()), "places": pa.array(places, pa.binary())})

    def apply(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table = blocks.ordered(table)
        split = [(b or b"").split() for b in table["body"].to_pylist()]
        counts = [len(w) for w in split]
        places = [as_array(x, np.uint32) for x in answers["places"].to_pylist()]
        gone = covered(np.concatenate([*places, np.zeros(0, np.uint32)]).astype(np.int64), window, sum(counts))
        kept, removed, start = [], [], 0
        for words in split:
            mine = gone[start : start + len(words)]
            start += len(words)
            removed.append(int(mine.sum()))
            if removed[-1]:
                words = [words[i] for i in np.flatnonzero(~mine)]
            kept.append(b" ".join(words))
        return pa.table({
            "doc_id": table["id"], "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    blocked = blocks.in_blocks(docs, n_blocks, doc_id, text)
    asked = blocked.groupBy("block").applyInArrow(blocks.frugal(ask), schema)
    answers = asked.groupBy("shard").applyInArrow(blocks.frugal(answer), "block int, places binary")
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        blocks.frugal(apply), "doc_id long, n_words long, n_removed long, kept_text string"
    )
