"""Scores of texts by prediction by partial matching over bytes, beside a word unigram base.

The byte-context trie of the training texts is held by shards, each with all contexts that end in some
runs of ``SUFFIX`` bytes, so a shard can follow a context down to these.  Counts of the shorter contexts
are summed in a table of their own, and each shard gets the part below its contexts; only runs of
three bytes go to all.  A block asks for the code length of each distinct run of bytes once, and sends its
training counts along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill.llm import blocks
from venuemill.llm.rolling import first_of_runs, mix
from venuemill.llm.store import stored

#: Longest context, in bytes (7 at most, for a key of 64 bits).  Texts begin with as many zero bytes, which are context only.
ORDER = 6
#: Last bytes of a context that name its shard.
SUFFIX = 4
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
#: Distinct runs that a task holds before it passes them on.
HELD_RUNS = 1 << 20
SMOOTHING = 0.1
_END = np.uint64(0)


def is_held_out(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 10, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _grams(bodies: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte the number made of its context and itself, and the bytes of each text."""
    pad = bytes(order)
    data = np.frombuffer(b"".join(x for b in bodies for x in (pad, b)), np.uint8).astype(np.uint64)
    sizes = np.array([len(b) for b in bodies], np.int64)
    key = np.zeros(max(0, len(data) - order), np.uint64)
    for k in range(order + 1):
        key = key << np.uint64(8) | data[k : len(data) - order + k]
    inside = np.ones(len(data), bool)
    heads = np.cumsum(sizes + order) - sizes - order
    for k in range(order):
        inside[heads + k] = False
    return key[inside[order:]], sizes


def _lower(table: pa.Table) -> list[bytes]:
    return [(b or b"").lower() for b in table["body"].to_pylist()]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(first_of_runs(keys))
    return (keys[at], np.add.reduceat(counts, at)) if len(at) else (keys, counts)


def _counted(bodies: list[bytes], train: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``order`` + 1 bytes of a block, with their counts in training texts."""
    keys, counts, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for some in blocks.slices(bodies):
        key, sizes = _grams(some, order)
        taught = np.repeat(train[start : start + len(some)], sizes)
        start += len(some)
        for part, weight in ((key[taught], 1), (key[~taught], 0)):
            u, n = np.unique(part, return_counts=True)
            keys.append(u)
            counts.append(n * weight)
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _turned(keys: np.ndarray) -> np.ndarray:
    """Keys with the bytes of their contexts in reverse, so that contexts of one shard lie close together; its own inverse."""
    return (keys >> np.uint64(8)).byteswap() >> np.uint64(8 * (8 - ORDER)) << np.uint64(8) | keys & np.uint64(0xFF)


def _packed(x: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpacked(cell: bytes | None, kind) -> np.ndarray:
    if not cell:
        return np.zeros(0, kind)
    n, size = int.from_bytes(cell[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(cell[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(size, n).T.copy().view(kind).reshape(n)


def shard_of_contexts(ends: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each context, by its last ``SUFFIX`` bytes."""
    return (mix(ends & np.uint64((1 << 8 * SUFFIX) - 1)) % np.uint64(n_shards)).astype(np.int64)


def short_runs(docs: DataFrame, learn: Column, n_shards: int, text: str = "text") -> DataFrame:
    """(run, shard, n): runs of ``SUFFIX`` bytes of all texts, their counts in training texts, and the shard of contexts that end so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [(np.zeros(1, np.uint64), np.zeros(1, np.int64))], 1  # every text begins after zero bytes

        def out() -> pa.RecordBatch:
            keys, counts = held[0]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64)), pa.array(shard_of_contexts(keys, n_shards).astype(np.int32)), pa.array(counts)], ["run", "shard", "n"]
            )

        for batch in batches:
            bodies = [(b or b"").lower() for b in batch.column(0).to_pylist()]
            held.append(_counted(bodies, np.array(batch.column(1).to_pylist(), bool), SUFFIX - 1))
            size += len(held[-1][0])
            if size > 2 * HELD_RUNS:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > HELD_RUNS:
                    yield out()
                    held, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        held = [_summed(*map(np.concatenate, zip(*held)))]
        yield out()

    bodies = docs.select(F.col(text).cast("string").cast("binary").alias("body"), learn.alias("learn"))
    return bodies.mapInArrow(blocks.frugal(run), "run long, shard int, n long").groupBy("run", "shard").agg(F.sum("n").alias("n"))


def below_shards(runs: DataFrame) -> DataFrame:
    """(shard, runs, counts): of each context one byte shorter than the shards' suffixes, the seen runs, for every shard that can fall back to it.

    A context has at most 256 symbols and 256 bytes before it, so no group grows with the input.
    """
    none = lambda kind: F.lit(None).cast(kind)
    begins = F.struct(F.shiftright("run", 8).alias("context"), none("int").alias("shard"), F.col("run"), F.col("n"))
    ends = F.struct(F.col("run").bitwiseAND((1 << 8 * (SUFFIX - 1)) - 1).alias("context"), F.col("shard"), none("long").alias("run"), none("long").alias("n"))
    by_context = runs.select(F.inline(F.array(begins, ends))).groupBy("context").agg(
        F.collect_set("shard").alias("shards"), F.collect_list(F.when(F.col("n") > 0, F.struct("run", "n"))).alias("seen")
    )
    return by_context.filter(F.size("seen") > 0).select(F.explode("shards").alias("shard"), F.col("seen.run").alias("runs"), F.col("seen.n").alias("counts"))


def triples(runs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs of three bytes in the training texts and their counts, summed in the cluster; at most 2^24 whatever the input."""
    table = runs.filter("n > 0").groupBy(F.col("run").bitwiseAND(0xFFFFFF).alias("run")).agg(F.sum("n").alias("n")).toArrow()
    return _summed(table["run"].to_numpy().astype(np.uint64), table["n"].to_numpy().astype(np.int64))


def byte_pairs(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of (byte before, byte), 256 by 256, from those of longer runs."""
    out = np.zeros(65536, np.int64)
    np.add.at(out, (keys & np.uint64(0xFFFF)).astype(np.int64), counts)
    return out.reshape(256, 256)


class Trie:
    """Context counts of orders 0 to ORDER; keys are the bytes of a context and of a symbol as one number.

    ``below`` holds the keys and counts of orders 2 and up that ``keys`` do not cover, as they are those of one shard only.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, below: dict[int, tuple] | None = None):
        seen = counts > 0
        keys, counts = keys[seen], counts[seen]
        self.levels: dict[int, tuple] = {}
        for order in range(ORDER, -1, -1):
            if below and order in below:
                keys, counts = below[order]
            if order >= 2:
                keys, counts = _summed(keys & np.uint64((1 << 8 * (order + 1)) - 1), counts)
                level = keys, counts
            else:
                flat = pairs.reshape(-1) if order else pairs.sum(0)
                at = np.flatnonzero(flat)
                level = at.astype(np.uint64), flat[at]
            self.levels[order] = level
        # of each context: its sum, its number of symbols, and the sum of these symbols one order below
        self.contexts = {}
        for order, (keys, counts) in self.levels.items():
            context = keys >> np.uint64(8)
            at = np.flatnonzero(first_of_runs(context))
            shorter = self.count(order - 1, keys) if order else np.zeros(len(keys), np.int64)
            sums = [np.add.reduceat(x, at) if len(at) else x for x in (counts, np.ones(len(keys), np.int64), shorter)]
            self.contexts[order] = (context[at], *sums)

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return at, table[at] == wanted

    def count(self, order: int, keys: np.ndarray) -> np.ndarray:
        table, counts = self.levels[order]
        at, found = self._find(table, keys & np.uint64((1 << 8 * (order + 1)) - 1))
        return np.where(found, counts[at] if len(counts) else 0, 0)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's last byte after the bytes before.

        Escape estimate: symbols seen by (sum + symbols).  Symbols of the longer context are
        excluded below it.  After order 0 the unseen bytes are alike.
        """
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        less_sum, less_symbols = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for order in range(ORDER, -1, -1):
            context, sums, symbols, below = self.contexts[order]
            at, found = self._find(context, (keys & np.uint64((1 << 8 * (order + 1)) - 1)) >> np.uint64(8))
            pick = lambda x: np.where(found, x[at] if len(x) else 0, 0)
            total, number = pick(sums) - less_sum, pick(symbols) - less_symbols
            count = self.count(order, keys)
            live = open_ & found & (number > 0)
            hit, miss = live & (count > 0), live & (count == 0)
            out[hit] += np.log10(count[hit] / (total[hit] + number[hit]))
            out[miss] += np.log10(number[miss] / (total[miss] + number[miss]))
            open_ &= ~hit
            less_sum, less_symbols = pick(below), pick(symbols)
        out[open_] -= np.log10(256 - less_symbols[open_])
        return out


ASKS = "shard int, block int, words binary, taught binary, grams binary, counts binary"
ANSWERS = "block int, shard int, n long, v long, words binary, logs binary, places binary"


def score(docs: DataFrame, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base and byte-model scores of all texts; the model learns from those that are not held out.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, sum_log,
    vocabulary, base_score, score, n_bytes), one row per input row.  ``score`` is log10 of the probability of the lower-cased text's bytes,
    so ``-score * log2(10)`` is its code length in bits.  A null text is empty: one end token, score 0.
    Repeated rows count as often as they stand; a null id is held out by default.

    Distinct entries grow with the training text: the number of shards follows its bytes, and a shard holds
    the contexts that end in its runs of ``SUFFIX`` bytes.
    """
    held_out = is_held_out(F.col(doc_id)) if held_out is None else held_out
    total = blocks.text_bytes(docs, text)
    n_blocks, n_shards = blocks.parts_for(docs, total, BLOCK_BYTES), blocks.parts_for(docs, total, SHARD_BYTES)
    runs = stored(short_runs(docs, ~held_out, n_shards, text), "short-runs")
    short = docs.sparkSession.sparkContext.broadcast(triples(runs))
    blocked = docs.select(
        blocks.block_number(F.col(doc_id), n_blocks).alias("block"), F.col(doc_id).cast("long").alias("id"),
        F.col(text).cast("string").cast("binary").alias("body"), held_out.alias("out"),
    )

    def shard_of_words(words: np.ndarray) -> np.ndarray:
        return ((words >> np.uint64(20)) % np.uint64(n_shards)).astype(np.int64)

    def by_shard(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of runs by shard, then turned; and where each shard begins in it."""
        shards = shard_of_contexts(grams >> np.uint64(8), n_shards)
        order = np.argsort(_turned(grams))
        order = order[np.argsort(shards[order], kind="stable")]
        return order, np.searchsorted(shards[order], np.arange(n_shards + 1))

    def words_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        codes, _, counts = blocks.word_codes(bodies)
        return codes, counts

    def asked(table: pa.Table):
        """A block's distinct words and runs in the order in which they are asked for."""
        table = blocks.ordered(table)
        bodies = _lower(table)
        train = ~np.array(table["out"].to_pylist(), bool)
        codes, counts = words_of(bodies)
        distinct, inverse = np.unique(np.append(codes, _END), return_inverse=True)
        taught = np.bincount(inverse[:-1], np.repeat(train, counts), len(distinct)).astype(np.int64)
        taught[inverse[-1]] += int(train.sum())
        return table, bodies, train, counts, inverse, distinct, taught

    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        _, bodies, train, _, _, words, taught = asked(table)
        grams, counts = _counted(bodies, train)
        by_word, (order, first) = shard_of_words(words), by_shard(grams)
        turned, counts = _turned(grams)[order], counts[order].astype(np.uint32)
        rows = []
        for s in range(n_shards):  # every shard hears of every block and tells it its part of the totals
            w, g = by_word == s, slice(first[s], first[s + 1])
            steps = np.diff(turned[g], prepend=np.uint64(0))
            rows.append((s, block, _packed(np.diff(words[w], prepend=np.uint64(0))), _packed(taught[w].astype(np.uint32)), _packed(steps), _packed(counts[g])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 2 + [pa.binary()] * 4)], [c.split()[0] for c in ASKS.split(", ")])

    def answer(key: tuple, table: pa.Table, below: pa.Table) -> pa.Table:
        asked_words = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in table["words"].to_pylist()]
        taught = np.concatenate([_unpacked(x, np.uint32) for x in table["taught"].to_pylist()]).astype(np.int64)
        words, n = _summed(np.concatenate(asked_words), taught)
        asked_grams = [_turned(np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64)) for x in table["grams"].to_pylist()]
        counts = np.concatenate([_unpacked(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64)
        grams, counts = _summed(np.concatenate(asked_grams), counts)
        flat = [below[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("runs", "counts")]
        lower = {SUFFIX - 1: (flat[0].astype(np.uint64), flat[1].astype(np.int64)), SUFFIX - 2: short.value}
        logs = Trie(grams, counts, byte_pairs(*short.value), lower).log10(grams)
        shard, rows = table["shard"][0].as_py(), []
        for b, w, g in zip(table["block"].to_pylist(), asked_words, asked_grams):
            values, places = np.unique(logs[np.searchsorted(grams, g)], return_inverse=True)
            rows.append((b, shard, int(n.sum()), int((n > 0).sum()), _packed(n[np.searchsorted(words, w)]), _packed(values), _packed(places.astype(np.uint32))))
        types = [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.binary()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in ANSWERS.split(", ")])

    def apply(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table, bodies, train, counts, inverse, words, _ = asked(table)
        found = {r["shard"]: r for r in answers.to_pylist()}
        tokens, vocabulary = sum(r["n"] for r in found.values()), sum(r["v"] for r in found.values())
        known = np.zeros(len(words), np.int64)
        by_word = shard_of_words(words)
        for s, r in found.items():
            known[by_word == s] = _unpacked(r["words"], np.int64)
        grams, _ = _counted(bodies, train)
        logs, (order, first) = np.zeros(len(grams)), by_shard(grams)
        for s, r in found.items():
            logs[order[first[s] : first[s + 1]]] = _unpacked(r["logs"], np.float64)[_unpacked(r["places"], np.uint32)]
        # words: each text's own, then one end
        per_word, end = known[inverse[:-1]], int(known[inverse[-1]])
        ends = np.cumsum(counts)
        sum_of = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        n_known = sum_of((per_word > 0).astype(np.int64)) + (end > 0)
        texts = np.repeat(np.arange(len(bodies)), counts)
        sums = np.bincount(texts, np.log10(per_word + SMOOTHING), len(bodies)) + np.log10(end + SMOOTHING)
        base = sums - (counts + 1) * np.log10(tokens + SMOOTHING * (vocabulary + 1))
        scores, start = np.zeros(len(bodies)), 0
        for some in blocks.slices(bodies):
            key_, sizes = _grams(some)
            u, place = np.unique(key_, return_inverse=True)
            owner = np.repeat(np.arange(len(some)), sizes)
            scores[start : start + len(some)] = np.bincount(owner, logs[np.searchsorted(grams, u)][place], len(some))
            start += len(some)
        same = lambda x: pa.array(np.full(len(bodies), x, np.int64))
        return pa.table({
            "doc_id": table["id"], "held_out": pa.array(~train), "n_tokens": pa.array((counts + 1).astype(np.int64)),
            "n_known": pa.array(n_known.astype(np.int64)), "train_tokens": same(tokens), "vocabulary": same(vocabulary),
            "base_score": pa.array(base), "score": pa.array(scores), "n_bytes": pa.array([len(b) for b in bodies], pa.int64()),
        })

    asks = blocked.groupBy("block").applyInArrow(blocks.frugal(ask), ASKS)
    answers = asks.groupBy("shard").cogroup(below_shards(runs).groupBy("shard")).applyInArrow(blocks.frugal(answer), ANSWERS)
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        blocks.frugal(apply), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, vocabulary long, base_score double, score double, n_bytes long"
    )
