"""Packing of tokenised documents into sequences of bounded length.

The packing is planned on the histogram of lengths, which has as many entries as a sequence has
tokens, however many documents there are.  A bin takes the longest piece left and, by
subset sums over a bitset, the fullest combination of the lengths that remain; the same
combination then fills as many bins as the counts allow (minimum bin slack).
Pieces are numbered within their length, which tells their bin.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuemill.llm import blocks
from venuemill.llm.store import stored

CAPACITY = 2048
END_ID = 0
#: Parts whose ids a process keeps (about 200 MB); beyond that it starts anew.
MOST_CACHED = 1_200_000
_SPACE_AHEAD, _CUTS = re.compile(r" (?=\s|\Z)"), re.compile(r"(?= \S)")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level BPE of the tokenizers library, as little-endian bytes.

    The split before the merges ends a token in front of every space that a
    non-space follows, so a text is cut there and the ids of the parts are
    kept.  New parts without a space go to the library side by side, where only their first tokens begin with a space; others in one
    text with an added token between them, which it takes out before it splits.  A text with an added token in it goes to the library whole.
    With ``plain`` an added token that is special is text as any other.
    """

    def __init__(self, path: str, cached: int = MOST_CACHED, plain: bool = False):
        from tokenizers import Tokenizer

        self.cached = cached
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        added = self.library.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        marks = [(t.content, i) for i, t in added.items() if not (plain or t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark, self.mark_id = marks[0] if marks else (None, None)
        vocabulary = self.library.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for piece, i in vocabulary.items() if piece.startswith("Ġ")]] = True  # how byte-level vocabularies write a space
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}  # by the part without its leading space

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _side_by_side(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that begin with their only space and go on with no white space."""
        out = []
        for at in range(0, len(parts), 500):
            some = parts[at : at + 500]
            ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [*np.flatnonzero(self.begins[ids]).tolist(), len(ids)]
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for _, a, b in zip(some, cuts[:-1], cuts[1:], strict=True)]
        return out

    def _apart(self, parts: list[str]) -> list[bytes]:
        if self.mark is None:
            return self.whole(parts)
        out = []
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            ids = np.array(self.library.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            data = ids.tobytes()
            out += [data[4 * a + 4 : 4 * b] for a, b in zip(cuts, cuts[1:])]
        return out

    @staticmethod
    def parts(text: str) -> tuple[str, list[str]]:
        """What stands before the first cut, and the other parts without their leading spaces."""
        if _SPACE_AHEAD.search(text):  # a space before white space stays with it
            first, *others = _CUTS.split(text)
            return first, [x[1:] for x in others]
        first, *others = text.split(" ")
        return first, others

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.later) > self.cached:
            self.later.clear()
        if len(self.first) > self.cached // 10:
            self.first.clear()
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        skip = set(odd)
        parts = [("", []) if i in skip else self.parts(t) for i, t in enumerate(texts)]
        later, first = self.later, self.first
        new = list({x for _, p in parts for x in p if x not in later})
        spaced = [x for x in new if not x or " " in x or x[0].isspace()]
        skip = set(spaced)
        new = [x for x in new if x not in skip]
        later.update(zip(new, self._side_by_side([" " + x for x in new])))
        later.update(zip(spaced, self._apart([" " + x for x in spaced])))
        new = list({x for x, _ in parts if x not in first})
        first.update(zip(new, self.whole(new)))
        get = later.__getitem__
        out = [first[x] + b"".join(map(get, p)) for x, p in parts]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = ids
        return out


def encoder(path: str, cached: int = MOST_CACHED) -> Encoder:
    """One per process, so that ids stay known over batches."""
    return blocks.held(f"encoder {cached} {path}", lambda: Encoder(path, cached))


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False, cached: int = MOST_CACHED) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32[, ids]).

    A document is its ids and ``END_ID``; a null text is empty, so every row has at least
    one piece.  Only longer documents are cut, into pieces of ``capacity`` with the shorter one first.
    """
    blocks.small_batches(docs)
    schema = PIECES + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cached).encode
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            start = 0
            for some in blocks.slices([t.encode() for t in texts], 2 << 20):
                rows = []
                own = texts[start : start + len(some)]
                for name, ids in zip(names[start : start + len(some)], encode(own)):
                    ids += end
                    n, at, piece = len(ids) // 4, 0, 0
                    while at < n:
                        length = (n - at - 1) % capacity + 1
                        part = ids[at * 4 : (at + length) * 4]
                        rows.append((name, piece, at, length, zlib.crc32(part), part)[: 6 if keep_ids else 5])
                        at, piece = at + length, piece + 1
                start += len(some)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(blocks.frugal(run, holds=True), schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the greatest sum of at most ``room``.

    Bit s of the bitset says that sum s can be made.  Longer lengths come first; ``steps`` has the
    bitset before each group of equal pieces, to read the combination back.
    """
    bits, most, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left:
            take = min(group, left)
            steps.append((bits, length, take))
            bits |= (bits << (take * length)) & most
            left, group = left - take, group * 2
        if bits >> room & 1:
            break
    total, used = bits.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= take * length
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, past the last rank, first bin, pieces a bin, offset) of every use of a length."""
    left, used, bins, out = {n: c for n, c in counts.items() if c}, {}, 0, []
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = fullest(left, capacity - longest)
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[n] // k for n, k in combination.items())
        offset = 0
        for n, k in sorted(combination.items(), reverse=True):
            first = used.get(n, 0)
            out.append((n, first, first + times * k, bins, k, offset))
            used[n] = first + times * k
            offset += n * k
            left[n] -= times * k
            if not left[n]:
                del left[n]
        bins += times
    return sorted(out)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any table with ``doc_id``, ``piece`` and ``length``, read more than once) with (sequence_id, offset).

    Pieces of one length are numbered over a square root of all pieces' number of buckets, so that a length
    that very many have is not one group.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    uses = plan(histogram, capacity)
    buckets = max(1, math.isqrt(sum(histogram.values())))
    dealt = pieces.withColumn("bucket", blocks.block_number(F.struct("doc_id", "piece"), buckets))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    )
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    within = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = dealt.withColumn("rank", F.row_number().over(within).cast("long")).join(ahead, ["length", "bucket"])
    table = np.array(uses, np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = int(table[:, 2].max(initial=0)) + 1
        firsts = table[:, 0] * stride + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            use = table[np.searchsorted(firsts, length * stride + rank, "right") - 1]
            j = rank - use[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(use[:, 3] + j // use[:, 4]), pa.array(use[:, 5] + j % use[:, 4] * length)], ["row", "sequence_id", "offset"]
            )

    row = F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row")
    shaped = ranked.select(row, F.col("length").cast("long").alias("n"), (F.col("ahead") + F.col("rank") - 1).alias("r"))
    schema = shaped.select("row").schema.add("sequence_id", "long").add("offset", "long")
    return shaped.mapInArrow(blocks.frugal(place), schema).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", cached: int = MOST_CACHED) -> DataFrame:
    """Pieces of all documents with their sequence and place; tokenised once, into a stored table."""
    return pack(stored(token_pieces(docs, tokenizer, capacity, doc_id, text, cached=cached), "token-pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the filled sequences, from placed pieces that kept their ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.unhex(F.array_join(F.transform("parts", lambda x: x["ids"]), "")).alias("ids")
    )
