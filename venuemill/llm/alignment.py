"""Alignment of the tokens of two tokenizers over the bytes of each text, by galloping intersection.

Both tokenizers cut the same bytes, so a text has two ascending lists of token ends.  Every end of the shorter list is
looked up in the longer one by steps of doubling width from where it should be and then by bisection.  Ends found
in both cut the text into groups; differences of the ranks tell which tokens overlap.  How many documents link two
ids is counted over the corpus and brought back to the documents that hold the pair.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuemill.llm import blocks
from venuemill.llm.blocks import as_array
from venuemill.llm.packing import Encoder, byte_letters
from venuemill.llm.rolling import first_of_runs
from venuemill.llm.store import stored

#: Parts of texts whose ids of A a process keeps (about 100 MB).
MOST_CACHED = 600_000
#: Text that is aligned at a time, and text whose pairs of ids are asked for together.
SLICE_BYTES, CHUNK_BYTES = 1 << 19, 8 << 20


def ranks(wanted: np.ndarray, guess: np.ndarray, low: np.ndarray, high: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each wanted number how many of ``table[low:high]`` (ascending) are less, by galloping from ``guess``; from the start of the table."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    at = np.clip(guess, low, np.maximum(high - 1, low))
    right = table[np.minimum(at, len(table) - 1)] < wanted  # the answer lies to the right of the guess
    left_end, right_end = np.where(right, at + 1, low), np.where(right, high, at)
    open_, step = np.arange(len(wanted)), 1
    while len(open_):  # doubling steps until the answer is enclosed
        going = right[open_]
        probe = np.where(going, at[open_] + step, at[open_] - step)
        inside = (probe >= left_end[open_]) & (probe < right_end[open_])
        open_, probe, going = open_[inside], probe[inside], going[inside]
        less = table[probe] < wanted[open_]
        left_end[open_] = np.where(less, probe + 1, left_end[open_])
        right_end[open_] = np.where(less, right_end[open_], probe)
        open_ = open_[less == going]
        step *= 2
    open_ = np.flatnonzero(left_end < right_end)
    while len(open_):
        middle = (left_end[open_] + right_end[open_]) >> 1
        less = table[middle] < wanted[open_]
        left_end[open_] = np.where(less, middle + 1, left_end[open_])
        right_end[open_] = np.where(less, right_end[open_], middle)
        open_ = open_[left_end[open_] < right_end[open_]]
    return left_end


class Tokens(NamedTuple):
    """Tokens of several texts end to end: ids, ends (bytes from the first text on) and the number of tokens of each text."""

    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


class Aligned(NamedTuple):
    common_a: np.ndarray  # by common end, the token of A and of B that ends there
    common_b: np.ndarray
    link_a: np.ndarray  # by link, the token of A and of B
    link_b: np.ndarray


def aligned(a: Tokens, b: Tokens) -> Aligned:
    """Common ends and overlapping tokens, text by text; in each the shorter list of ends is looked up in the longer one."""
    starts = [np.cumsum(x.counts) - x.counts for x in (a, b)]
    whose = [np.repeat(np.arange(len(x.counts)), x.counts) for x in (a, b)]
    found, links = [], []
    for short, long, s, l, swapped in ((a, b, 0, 1, False), (b, a, 1, 0, True)):
        mine = (short.counts < long.counts) | ((short.counts == long.counts) & (not swapped))
        own = np.flatnonzero(mine[whose[s]])
        text = whose[s][own]
        low, size = starts[l][text], long.counts[text]
        place = own - starts[s][text]
        guess = low + place * size // np.maximum(short.counts[text], 1)
        rank = ranks(short.ends[own], guess, low, low + size, long.ends)
        both = long.ends[np.minimum(rank, len(long.ends) - 1)] == short.ends[own] if len(own) else np.zeros(0, bool)
        found.append((own[both], rank[both]) if not swapped else (rank[both], own[both]))
        # a token overlaps those from the first end beyond its start to the first end at or beyond its end
        first = low.copy()
        later = np.flatnonzero(place > 0)
        first[later] = (rank + both)[later - 1]
        n = rank - first + 1
        one = np.repeat(own, n)
        other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        links.append((one, other) if not swapped else (other, one))
    common = [np.concatenate(x) for x in zip(*found)]
    order = np.argsort(common[0], kind="stable")
    return Aligned(common[0][order], common[1][order], *(np.concatenate(x) for x in zip(*links)))


class Pair:
    """Both tokenizers, with the bytes and the decimal digits of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.encoder = Encoder(path_a, MOST_CACHED, plain=True)
        self.a = self.encoder.library
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, added = {c: b for b, c in byte_letters().items()}, {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        size_a = max(max(self.a.get_vocab().values()), max(added, default=0)) + 1
        self.bytes_a = [b""] * size_a
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = added[i] if i in added else bytes(letters[c] for c in entry)
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.table_a, self.table_b = (
            (n, np.cumsum(n) - n, np.frombuffer(b"".join(t), np.uint8)) for n, t in ((self.size_a, self.bytes_a), (self.size_b, self.bytes_b))
        )
        self.text_a, self.text_b = (np.array([[b"%d%c" % (i, mark) for mark in marks] for i in range(n)], object) for n, marks in ((size_a, b",|"), (len(self.bytes_b), b",;")))

    @staticmethod
    def _spells(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, spelling: np.ndarray, whole: bytes) -> bool:
        """Whether the bytes of the ids are those of the text; ``spelling`` has the bytes of all ids end to end."""
        n = sizes[ids]
        ends = np.cumsum(n)
        if not len(ids) or ends[-1] != len(whole):
            return False
        return spelling[np.repeat(starts[ids] - ends + n, n) + np.arange(len(whole))].tobytes() == whole

    def _tokens(self, ids: list[np.ndarray], sizes: np.ndarray) -> Tokens:
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *ids])
        return Tokens(flat, np.cumsum(sizes[flat]), counts)

    def encode(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Tokens of the texts; none where the tokens of either do not spell a space and the text."""
        ids_a = [np.frombuffer(x, "<u4").astype(np.int64) for x in self.encoder.encode([" " + t for t in texts])]
        ids_b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]
        for k, text in enumerate(texts):
            whole = b" " + text.encode()
            if not (text and self._spells(ids_a[k], *self.table_a, whole) and self._spells(ids_b[k], *self.table_b, whole)):
                ids_a[k] = ids_b[k] = np.zeros(0, np.int64)
        return self._tokens(ids_a, self.size_a), self._tokens(ids_b, self.size_b)

    def groups(self, a: Tokens, b: Tokens, found: Aligned) -> tuple[np.ndarray, list[str]]:
        """Of each text the number of groups and the SHA-256 of their ids, as ``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
        last_a[found.common_a] = last_b[found.common_b] = True
        # a token comes after the tokens of its own list and those of the other one that stand in earlier groups (of B also its own)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ends_a, ends_b = np.append(found.common_a + 1, 0), np.append(0, found.common_b + 1)
        out = np.empty(len(a.ids) + len(b.ids), object)
        out[np.arange(len(a.ids)) + ends_b[group_a]] = self.text_a[a.ids, last_a.astype(np.int64)]
        out[np.arange(len(b.ids)) + ends_a[group_b]] = self.text_b[b.ids, last_b.astype(np.int64)]
        counts, names, start = [], [], 0
        at = np.searchsorted(found.common_a, np.cumsum(np.append(0, a.counts)))
        for k, n in enumerate((a.counts + b.counts).tolist()):
            counts.append(at[k + 1] - at[k])
            names.append(hashlib.sha256(b"".join(out[start : start + n].tolist())[:-1]).hexdigest() if n else "")
            start += n
        return np.array(counts, np.int64), names


CHUNKS = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, pairs binary, seen binary, holds binary, places binary, times binary"


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    ``path_a`` is a byte-level file of the tokenizers library, which gets a space before the text; ``path_b`` a sentencepiece
    model that adds one itself.  A null or empty text, or one that the tokens of either do not spell,
    has no tokens: zeros and an empty string.  Repeated rows are documents of their own; a null id is kept.

    ``n_links``: pairs of tokens whose bytes overlap.  The count of a pair of ids is the number of documents that hold it linked;
    ``count_sum`` adds it over the links, ``n_best`` counts the links at the highest count of their id of A.

    Texts are tokenised where they are read.  A task keeps chunks of them as compressed arrays and sends each distinct pair of a chunk
    once, so a pair that all documents hold is one row a chunk and is summed before the shuffle.
    """
    blocks.small_batches(docs)
    size_b = 1 << 20  # a pair is one number: the id of A and, below, that of B

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = blocks.held(f"aligned {path_a} {path_b}", lambda: Pair(path_a, path_b))
        chunk, number, size, held = TaskContext.get().partitionId(), 0, 0, []

        def packed() -> pa.RecordBatch:
            nonlocal number, size, held
            rows, pairs, times = zip(*held)
            holds = np.array([len(p) for p in pairs], np.int64)
            distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
            seen = np.bincount(place, minlength=len(distinct))
            columns = list(zip(*rows))
            cell = lambda x: pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b""], pa.binary())
            out = pa.RecordBatch.from_arrays([
                pa.array([chunk << 24 | number], pa.int64()), *(pa.array([c], pa.list_(pa.int64())) for c in columns[:4]), pa.array([columns[4]], pa.list_(pa.string())),
                pa.array([distinct.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary()),
                cell(holds), cell(place.astype(np.uint32)), cell(np.concatenate(times).astype(np.uint32)),
            ], [c.strip().split(" ")[0] for c in CHUNKS.split(", ")])
            number, size, held = number + 1, 0, []
            return out

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            start = 0
            for some in blocks.slices([t.encode() for t in texts], SLICE_BYTES):
                a, b = pair.encode(texts[start : start + len(some)])
                found = aligned(a, b)
                n_groups, shas = pair.groups(a, b, found)
                linked = a.ids[found.link_a] * size_b + b.ids[found.link_b]
                whose = np.repeat(np.arange(len(some)), a.counts)[found.link_a]
                order = np.lexsort((linked, whose))
                linked, whose = linked[order], whose[order]
                at = np.flatnonzero(first_of_runs(linked) | first_of_runs(whose))
                times, linked, whose = np.diff(np.append(at, len(order))), linked[at], whose[at]
                cuts = np.searchsorted(whose, np.arange(len(some) + 1)).tolist()
                for k in range(len(some)):
                    row = names[start + k], int(a.counts[k]), int(b.counts[k]), int(n_groups[k]), shas[k]
                    held.append((row, linked[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]]))
                start += len(some)
                size += sum(map(len, some))
                if size >= chunk_bytes:
                    yield packed()
        if held:
            yield packed()

    whole = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    chunks = stored(whole.mapInArrow(blocks.frugal(run, holds=True), CHUNKS), "chunks")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, pairs, seen in zip(*(batch.column(i).to_pylist() for i in range(3))):
                pairs, seen = as_array(pairs, np.int64), as_array(seen, np.int64)
                for at in range(0, len(pairs), 10_000):
                    some = pairs[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name)), pa.array(some), pa.array(seen[at : at + 10_000])], ["chunk", "pair", "seen"])

    asked = chunks.select("chunk", "pairs", "seen").mapInArrow(blocks.frugal(spread), "chunk long, pair long, seen long")
    counts = asked.groupBy("pair").agg(F.sum("seen").alias("n"))
    counts = stored(counts, "pairs").withColumn("a", F.shiftright("pair", 20))
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    known = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    answers = asked.select("chunk", "pair").join(known, "pair").select("chunk", "pair", "n", "is_best")

    def finish(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            raise ValueError("pairs of an unknown chunk")
        row = table.to_pylist()[0]
        pairs = found["pair"].to_numpy()
        order = np.argsort(pairs)
        n, is_best = found["n"].to_numpy()[order], np.array(found["is_best"].to_pylist(), bool)[order]
        docs_n = len(row["doc_id"])
        holds = _opened(row["holds"], docs_n, np.int64)
        place, times = (_opened(row[c], int(holds.sum()), np.uint32).astype(np.int64) for c in ("places", "times"))
        ends = np.cumsum(np.append(0, holds))
        summed = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
        long = lambda x: pa.array(x, pa.int64())
        return pa.table({
            "doc_id": long(row["doc_id"]), "n_a": long(row["n_a"]), "n_b": long(row["n_b"]), "n_groups": long(row["n_groups"]),
            "n_links": long(summed(times)), "n_best": long(summed(times * is_best[place])), "count_sum": long(summed(times * n[place])),
            "groups_sha256": pa.array(row["groups_sha256"], pa.string()),
        })

    return chunks.drop("pairs", "seen").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        blocks.frugal(finish), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def _opened(cell: bytes, n: int, kind) -> np.ndarray:
    return as_array(pa.decompress(cell, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if cell else np.zeros(0, kind)
