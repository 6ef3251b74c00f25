"""Line deduplication over an index that can grow and shrink.

The index is a table of shards.  A shard owns the line keys of one range of hashes: a cuckoo filter
of its keys and, behind it, the exact number of documents that hold each key.  Documents
are inserted and deleted in batches; a key leaves the filter when its last document does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from venuemill.llm import blocks
from venuemill.llm.blocks import as_array
from venuemill.llm.cuckoo import Cuckoo
from venuemill.llm.rolling import first_of_runs

MIN_CHARS, MIN_DOCS = 40, 5
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 32 << 20

SHARDS = "shard int, filter binary, high binary, low binary, documents binary"
ASKS = "shard int, block int, high binary, low binary, n binary, last binary"
NO_ID = np.iinfo(np.int64).min


def line_keys(body: bytes | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The key of each line: stripped and lower-cased (ASCII), None below ``min_chars`` code points."""
    keys = []
    for line in (body or b"").split(b"\n"):
        key = line.strip().lower() if len(line) >= min_chars else b""
        keys.append(key if len(key) >= min_chars and len(key.decode()) >= min_chars else None)
    return keys


def _of_block(table: pa.Table, min_chars: int) -> tuple[pa.Table, list[list], dict[bytes, int], list[int], list[int]]:
    """The ordered rows, their line keys, and of each distinct key its number, documents and last document."""
    table = blocks.ordered(table)
    ids = [NO_ID if i is None else i for i in table["id"].to_pylist()]
    number: dict[bytes, int] = {}
    n: list[int] = []
    last: list[int] = []
    keys = [line_keys(b, min_chars) for b in table["body"].to_pylist()]
    for i, own in zip(ids, keys):
        for key in dict.fromkeys(own):
            if key is not None:
                k = number.setdefault(key, len(n))
                if k == len(n):
                    n.append(0)
                    last.append(i)
                n[k] += 1
                last[k] = i  # rows come by id
    return table, keys, number, n, last


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_references(blocked: DataFrame, n_shards: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """Of each block and shard: distinct line keys with their numbers of documents and last document."""

    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        _, _, number, n, last = _of_block(table, min_chars)
        high, low = _hashes(list(number))
        shard = (low >> np.uint64(32)) % np.uint64(n_shards)
        n, last = np.array(n, np.int64), np.array(last, np.int64)
        rows = []
        for s in np.unique(shard).tolist():
            own = shard == s
            rows.append((s, block, *(x[own].tobytes() for x in (high, low, n, last))))
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.int32()] * 2 + [pa.binary()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in ASKS.split(", ")])

    return blocked.groupBy("block").applyInArrow(blocks.frugal(ask), ASKS)


def _merged(asks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with sums of documents and last documents, and each asked key's place among them."""
    high, low, n, last = (
        np.concatenate([np.zeros(0, kind), *(as_array(x, kind) for x in asks[c].to_pylist())])
        for c, kind in (("high", np.uint64), ("low", np.uint64), ("n", np.int64), ("last", np.int64))
    )
    order = np.lexsort((low, high))
    first = first_of_runs(high[order]) | first_of_runs(low[order])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    if not len(at):
        return high, low, n, last, place
    return high[order][at], low[order][at], np.add.reduceat(n[order], at), np.maximum.reduceat(last[order], at), place


class Shard:
    """A cuckoo filter and the exact table behind it."""

    def __init__(self, cuckoo: Cuckoo, high: np.ndarray, low: np.ndarray, documents: np.ndarray):
        self.filter, self.high, self.low, self.documents = cuckoo, high, low, documents

    @classmethod
    def of(cls, state: pa.Table) -> Shard:
        if not state.num_rows:
            none = np.zeros(0, np.uint64)
            return cls(Cuckoo.sized(0), none, none, np.zeros(0, np.int64))
        row = state.slice(0, 1).to_pylist()[0]
        return cls(Cuckoo.of(row["filter"]), as_array(row["high"], np.uint64), as_array(row["low"], np.uint64), as_array(row["documents"], np.int64))

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each key's row in the exact table, -1 if it has none; only keys that the filter lets through are looked up."""
        out = np.full(len(high), -1, np.int64)
        maybe = np.flatnonzero(self.filter.contains(high, low))
        if len(self.high) and len(maybe):
            left = np.searchsorted(self.high, high[maybe])
            for step in range(4):  # keys alike in their high half are next to each other
                at = np.minimum(left + step, len(self.high) - 1)
                hit = (self.high[at] == high[maybe]) & (self.low[at] == low[maybe])
                out[maybe[hit]] = at[hit]
        return out

    def change(self, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        """Add ``n`` documents (negative: take away) to distinct keys."""
        at = self.places(high, low)
        known = at >= 0
        documents = self.documents.copy()
        documents[at[known]] += n[known]
        gone = documents <= 0
        if gone.any():
            self.filter.delete(self.high[gone], self.low[gone])
        fresh = ~known & (n > 0)
        every = [np.concatenate([a[~gone], b[fresh]]) for a, b in ((self.high, high), (self.low, low), (documents, n))]
        order = np.lexsort((every[1], every[0]))
        self.high, self.low, self.documents = (x[order] for x in every)
        room = self.filter.buckets.size * 0.9 >= len(self.high)
        if not (room and self.filter.insert(high[fresh], low[fresh])):
            size = len(self.high)
            while True:
                self.filter = Cuckoo.sized(size)
                if self.filter.insert(self.high, self.low):
                    break
                size = size * 2 + 8

    def row(self, shard: int) -> pa.Table:
        cells = [self.filter.to_bytes(), self.high.tobytes(), self.low.tobytes(), self.documents.tobytes()]
        return pa.table([pa.array([shard], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], [c.split()[0] for c in SHARDS.split(", ")])


def changed(shards: DataFrame, references: DataFrame, sign: int = 1) -> DataFrame:
    """The index after the documents behind ``references`` are inserted (1) or deleted (-1)."""

    def change(key: tuple, state: pa.Table, asks: pa.Table) -> pa.Table:
        shard = Shard.of(state)
        high, low, n, _, _ = _merged(asks)
        shard.change(high, low, sign * n)
        return shard.row(key[0].as_py())

    return shards.groupBy("shard").cogroup(references.groupBy("shard")).applyInArrow(blocks.frugal(change), SHARDS)


def empty_index(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], SHARDS)


def remove_common_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text",
    rest: bool = False, earlier: DataFrame | None = None, shards: int | None = None,
) -> DataFrame:
    """Lines whose key is in at least ``min_docs`` documents go, except in the largest id that holds it.

    Returns (doc_id, n_lines, n_dropped, kept_text[, rest]), one row per input
    row.  A null or empty text is one empty line; a null text stays null in ``rest``.  Every row
    is a document; a null id is the smallest; rows that share the largest id all keep the line.
    ``earlier`` is an index (with its number of ``shards``) of documents seen before:
    they count, and the largest id among ``docs`` still keeps its lines.
    """
    total = blocks.text_bytes(docs, text)
    n_shards = shards or blocks.parts_for(docs, total, SHARD_BYTES)
    blocked = blocks.in_blocks(docs, blocks.parts_for(docs, total, BLOCK_BYTES), doc_id, text, rest)
    asks = line_references(blocked.select("block", "id", "body"), n_shards, min_chars)
    index = changed(empty_index(docs) if earlier is None else earlier, asks)

    def decide(key: tuple, state: pa.Table, asked: pa.Table) -> pa.Table:
        shard = Shard.of(state)
        high, low, _, last, place = _merged(asked)
        at = shard.places(high, low)
        drop = at >= 0
        drop[drop] = shard.documents[at[drop]] >= min_docs
        sizes = [len(x) // 8 for x in asked["high"].to_pylist()]
        out, start = [], 0
        ours = np.concatenate([np.zeros(0, np.uint64), *(as_array(x, np.uint64) for x in asked["low"].to_pylist())])
        theirs = np.concatenate([np.zeros(0, np.uint64), *(as_array(x, np.uint64) for x in asked["high"].to_pylist())])
        for block, size in zip(asked["block"].to_pylist(), sizes):
            own = slice(start, start + size)
            hit = drop[place[own]]
            if hit.any():
                out.append((block, theirs[own][hit].tobytes(), ours[own][hit].tobytes(), last[place[own]][hit].tobytes()))
            start += size
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * 3)], ["block", "high", "low", "last"])

    answers = index.groupBy("shard").cogroup(asks.groupBy("shard")).applyInArrow(blocks.frugal(decide), "block int, high binary, low binary, last binary")

    def apply(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        table, keys, number, _, _ = _of_block(table, min_chars)
        high, low, last = (
            np.concatenate([np.zeros(0, kind), *(as_array(x, kind) for x in found[c].to_pylist())])
            for c, kind in (("high", np.uint64), ("low", np.uint64), ("last", np.int64))
        )
        keeper_of = dict(zip(zip(high.tolist(), low.tolist()), last.tolist()))
        own_high, own_low = _hashes(list(number))
        keeper = {k: keeper_of[h] for k, h in zip(number, zip(own_high.tolist(), own_low.tolist())) if h in keeper_of}
        lines, dropped, texts = [], [], []
        for i, body, own in zip(table["id"].to_pylist(), table["body"].to_pylist(), keys):
            i = NO_ID if i is None else i
            parts = (body or b"").split(b"\n")
            kept = [p for p, k in zip(parts, own) if keeper.get(k, i) == i]
            lines.append(len(parts))
            dropped.append(len(parts) - len(kept))
            texts.append(b"\n".join(kept).decode())
        columns = {
            "doc_id": table["id"], "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()),
            "kept_text": pa.array(texts, pa.string()),
        }
        return pa.table(columns | ({"rest": table["rest"]} if rest else {}))

    schema = StructType().add("doc_id", "long").add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")
    if rest:
        schema = schema.add("rest", blocked.schema["rest"].dataType)
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(blocks.frugal(apply), schema)
