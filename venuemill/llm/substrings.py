"""Removal of byte strings that occur earlier, by sorted suffixes around content-defined anchors.

Of the grams in a string of the wanted length, the leftmost least one is its anchor; equal strings have equal anchors in the same place.
So only suffixes at anchors are sorted, about one in 35 positions.  An anchor's chunk is what
its strings cover.  Anchors found once are dropped, equal chunks are folded into the first,
and what is left meets by anchor: with the suffixes to the right and the reversed ones to the left
sorted, two strings around an anchor are equal where both common lengths reach far enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from venuemill.llm import blocks
from venuemill.llm.blocks import as_array
from venuemill.llm.rolling import Powers, PrefixHash, first_of_runs, mix, sliding_argmin, symbol_codes
from venuemill.llm.suffixes import SuffixOrder

LENGTH = 100
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
NO_ID = np.iinfo(np.int64).min
_ANCHOR = symbol_codes(51)

ASKS = "shard int, block int, anchor binary, chunk binary, id binary, at binary, n binary, off binary, known binary"
FOUND = "block int, gone binary, wanted binary"
CONTEXTS = "shard int, block int, anchor binary, id binary, at binary, n binary, off binary, bytes binary"
GONE = "block int, gone binary"


def gram_of(length: int) -> int:
    return max(1, length * 8 // 25)


def anchors(bodies: list[bytes], length: int, powers: Powers):
    """Runs of string starts with one anchor: (anchor hash, chunk hash, first start, starts, anchor's distance), in place order."""
    gram, parts, base = gram_of(length), [], 0
    for some in blocks.slices(bodies, 2 << 20):
        sizes = np.array([len(b) for b in some], np.int64)
        data = np.frombuffer(b"".join(some), np.uint8)
        sums = PrefixHash(data, powers, _ANCHOR)
        grams = mix(sums.windows(gram))
        least = sliding_argmin(grams, length - gram + 1)
        ends = np.cumsum(sizes)
        usable = np.maximum(sizes - length + 1, 0)
        keep = np.zeros(len(data) + 1, np.int32)
        np.add.at(keep, ends - sizes, (usable > 0).astype(np.int32))
        np.add.at(keep, ends - sizes + usable, -(usable > 0).astype(np.int32))
        starts = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        if len(starts):
            place = least[starts]
            first = first_of_runs(place)
            first[1:] |= np.diff(starts) > 1
            at = np.flatnonzero(first)
            low, n = starts[at], np.diff(np.append(at, len(starts)))
            spot = place[at]
            joined = data.tobytes()
            names = [xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(low.tolist(), (low + n - 1 + length).tolist())]
            chunk = np.array(names, np.uint64) ^ mix(((spot - low) * 4096 + n).astype(np.uint64))
            parts.append((grams[spot], chunk, low + base, n, spot - low))
        base += len(data)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _ids(table: pa.Table) -> list[int]:
    return [NO_ID if i is None else i for i in table["id"].to_pylist()]


def _bodies(table: pa.Table) -> list[bytes]:
    return [b or b"" for b in table["body"].to_pylist()]


def ranges_to_bytes(starts: np.ndarray, n: np.ndarray) -> bytes:
    return np.stack([starts, n], 1).astype(np.uint32).tobytes()


def covered_by_earlier(data: np.ndarray, anchor: np.ndarray, low: np.ndarray, n: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, start) pairs of the strings that an earlier chunk has too.

    Chunks come in the order in which "earlier" is meant; chunk i's text begins at ``low[i]`` in
    ``data``, its ``n[i]`` strings start at its first bytes, its anchor is ``off[i]`` bytes in.
    """
    _, group = np.unique(anchor, return_inverse=True)
    right = SuffixOrder(data, low + off, length - off + n - 1, group)
    backward = data[::-1].copy()
    left = SuffixOrder(backward, len(data) - low - off, off, group)
    rank_r, rank_l = np.empty(len(low), np.int64), np.empty(len(low), np.int64)
    rank_r[right.order] = rank_l[left.order] = np.arange(len(low))
    new_group = first_of_runs(right.groups)
    whose, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in range(length - gram_of(length) + 1):  # bytes of the string to the left of the anchor
        valid = np.flatnonzero((x <= off) & (x > off - n))
        if len(valid) < 2:
            continue
        class_r = np.cumsum(new_group | (right.lcp < length - x))[rank_r[valid]]
        class_l = np.cumsum(new_group | (left.lcp < x))[rank_l[valid]]
        _, first = np.unique(class_r * (len(low) + 1) + class_l, return_index=True)
        again = np.ones(len(valid), bool)
        again[first] = False
        whose.append(valid[again])
        where.append(off[valid[again]] - x)
    return np.concatenate(whose), np.concatenate(where)


def remove_earlier_strings(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop every byte covered by a ``length``-byte string that also starts earlier.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept), one row per input
    row; ``kept`` is binary, as a removal may begin inside a character.  Earlier: smaller id (null first), or
    the same id and an earlier start; rows that share an id are taken in the order of their texts.
    A null text is empty.  Strings are judged on the input and do not cross rows.
    """
    total = blocks.text_bytes(docs, text)
    n_blocks, n_shards = blocks.parts_for(docs, total, BLOCK_BYTES), blocks.parts_for(docs, total, SHARD_BYTES)
    blocked = blocks.in_blocks(docs, n_blocks, doc_id, text)

    def to_shards(block: int, shard: np.ndarray, columns: list[np.ndarray], extra=None) -> list[tuple]:
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(n_shards + 1))
        rows = []
        for s in range(n_shards):
            k = by[cuts[s] : cuts[s + 1]]
            more = extra(s, k) if extra else ()
            if len(k) or (more and len(more[0])):
                rows.append((s, block, *(c[k].tobytes() for c in columns), *more))
        return rows

    def table_of(rows: list[tuple], schema: str) -> pa.Table:
        fields = [c.split() for c in schema.split(", ")]
        columns = list(zip(*rows)) if rows else [[]] * len(fields)
        return pa.table([pa.array(c, pa.int32() if kind == "int" else pa.binary()) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])

    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        table = blocks.ordered(table)
        bodies = _bodies(table)
        anchor, chunk, low, n, off = anchors(bodies, length, Powers())
        ends = np.cumsum([len(b) for b in bodies])
        ids = np.array(_ids(table), np.int64)[np.searchsorted(ends, low, "right")]
        # equal chunks of this block: the first stands for all, the others are covered
        order = np.lexsort((np.arange(len(low)), chunk, anchor))
        head = first_of_runs(anchor[order]) | first_of_runs(chunk[order])
        again = np.sort(order[~head])
        keep = np.sort(order[head])
        known = ranges_to_bytes(low[again], n[again])
        k = keep
        shard = (anchor[k] % np.uint64(n_shards)).astype(np.int64)
        columns = [anchor[k], chunk[k], ids[k], low[k].astype(np.uint32), n[k].astype(np.uint16), off[k].astype(np.uint16)]
        return table_of(to_shards(block, shard, columns, lambda s, _: (known if s == block % n_shards else b"",)), ASKS)

    def first_pass(table: pa.Table) -> pa.Table:
        cells = {c: [as_array(x, k) for x in table[c].to_pylist()] for c, k in (
            ("anchor", np.uint64), ("chunk", np.uint64), ("id", np.int64), ("at", np.uint32), ("n", np.uint16), ("off", np.uint16))}
        source = np.repeat(np.arange(table.num_rows), [len(x) for x in cells["anchor"]])
        anchor, chunk, ids, at, n, off = (np.concatenate(x) for x in cells.values())
        order = np.lexsort((at, ids, chunk, anchor))
        new_anchor = first_of_runs(anchor[order])
        new_chunk = new_anchor | first_of_runs(chunk[order])
        group = np.cumsum(new_anchor) - 1
        kinds = np.bincount(group[new_chunk], minlength=group[-1] + 1) if len(group) else np.zeros(0)
        gone, wanted = np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
        gone[order] = ~new_chunk
        wanted[order] = new_chunk & (kinds[group] > 1)
        rows = []
        for r, (block, known) in enumerate(zip(table["block"].to_pylist(), table["known"].to_pylist())):
            mine = source == r
            g, w = mine & gone, np.flatnonzero(mine & wanted)
            if g.any() or len(w) or known:
                rows.append((block, ranges_to_bytes(at[g], n[g]) + known, np.stack([at[w], n[w], off[w]], 1).astype(np.uint32).tobytes()))
        return table_of(rows, FOUND)

    def send(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        block = key[0].as_py()
        table = blocks.ordered(table)
        bodies = _bodies(table)
        wanted = np.concatenate([np.zeros((0, 3), np.int64), *(as_array(x, np.uint32).reshape(-1, 3) for x in found["wanted"].to_pylist())]).astype(np.int64)
        wanted = wanted[np.argsort(wanted[:, 0])]
        low, n, off = wanted.T
        data = b"".join(bodies)
        ids = np.array(_ids(table), np.int64)[np.searchsorted(np.cumsum([len(b) for b in bodies]), low, "right")]
        grams = [data[a : a + gram_of(length)] for a in (low + off).tolist()]
        flat = np.frombuffer(b"".join(grams), np.uint8)
        anchor = mix(PrefixHash(flat, Powers(), _ANCHOR).windows(gram_of(length))[:: gram_of(length)]) if grams else np.zeros(0, np.uint64)
        shard = (anchor % np.uint64(n_shards)).astype(np.int64)
        columns = [anchor, ids, low.astype(np.uint32), n.astype(np.uint16), off.astype(np.uint16)]

        def text_of(s: int, k: np.ndarray) -> tuple[bytes]:
            return (b"".join(data[a:b] for a, b in zip(low[k].tolist(), (low + n - 1 + length)[k].tolist())),)

        return table_of(to_shards(block, shard, columns, text_of), CONTEXTS)

    def second_pass(table: pa.Table) -> pa.Table:
        cells = {c: [as_array(x, k) for x in table[c].to_pylist()] for c, k in (
            ("anchor", np.uint64), ("id", np.int64), ("at", np.uint32), ("n", np.uint16), ("off", np.uint16))}
        source = np.repeat(np.arange(table.num_rows), [len(x) for x in cells["anchor"]])
        anchor, ids, at, n, off = (np.concatenate(x) for x in cells.values())
        at, n, off = (x.astype(np.int64) for x in (at, n, off))
        data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        size = n - 1 + length
        low = np.cumsum(size) - size
        order = np.lexsort((at, ids))
        whose, where = covered_by_earlier(data, anchor[order], low[order], n[order], off[order], length)
        whose = order[whose]
        starts = at[whose] + where
        rows, owner = [], source[whose]
        for r, block in enumerate(table["block"].to_pylist()):
            own = np.sort(starts[owner == r])
            if len(own):
                first = np.flatnonzero(np.concatenate([[True], np.diff(own) > 1]))
                rows.append((block, ranges_to_bytes(own[first], np.diff(np.append(first, len(own))))))
        return table_of(rows, GONE)

    def apply(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        table = blocks.ordered(table)
        bodies = _bodies(table)
        sizes = np.array([len(b) for b in bodies], np.int64)
        ranges = np.concatenate([np.zeros((0, 2), np.int64), *(as_array(x, np.uint32).reshape(-1, 2) for x in found["gone"].to_pylist())]).astype(np.int64)
        step = np.zeros(int(sizes.sum()) + 1, np.int32)
        np.add.at(step, ranges[:, 0], 1)
        np.add.at(step, ranges[:, 0] + ranges[:, 1] - 1 + length, -1)
        hit = np.cumsum(step[:-1]) > 0
        removed, spans, kept, start = [], [], [], 0
        for body in bodies:
            mine = hit[start : start + len(body)]
            start += len(body)
            removed.append(int(mine.sum()))
            spans.append(int((mine[1:] & ~mine[:-1]).sum() + (len(mine) > 0 and mine[0])))
            kept.append(np.frombuffer(body, np.uint8)[~mine].tobytes() if removed[-1] else body)
        return pa.table({
            "doc_id": table["id"], "n_bytes": pa.array(sizes), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()),
        })

    asked = blocked.groupBy("block").applyInArrow(blocks.frugal(ask), ASKS)
    found = asked.groupBy("shard").applyInArrow(blocks.frugal(first_pass), FOUND)
    contexts = blocked.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(blocks.frugal(send), CONTEXTS)
    more = contexts.groupBy("shard").applyInArrow(blocks.frugal(second_pass), GONE)
    gone = found.select("block", "gone").unionByName(more)
    return blocked.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(
        blocks.frugal(apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
