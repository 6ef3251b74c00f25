"""Token counts by distinct pre-token, for a sentencepiece BPE model.

No piece of such a model holds a word mark after another character, so merges never
cross the start of a run of spaces, nor a line break, which is no piece: a text is cut there, and its count is
the sum over its pre-tokens.  Each distinct pre-token is counted once in the
whole corpus, ids are never kept.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuemill.llm import blocks
from venuemill.llm.blocks import as_array
from venuemill.llm.store import stored

#: Pre-tokens with at least about this share of all occurrences are frequent; there are at most 2 / FREQUENT of them.
FREQUENT = 1e-6
#: Longer pre-tokens never count as frequent, so the list of frequent ones has a fixed bound in bytes as well.
FREQUENT_LENGTH = 48
SLICE_BYTES, SHARD_BYTES = 8 << 20, 24 << 20
MOST_COUNTED = 500_000

_RUNS = re.compile(" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text: each begins at a word mark, which is left out, or at a line break."""
    if not text:
        return []
    text = text.replace("▁", " ")
    if "  " in text or " \n" in text or text[0] in " \n":
        out = []
        for run in _RUNS.findall(" " + text):
            first, *others = run[1:].split("\n")
            out.append(first)
            out += ["\n" + x for x in others]
        return out
    return text.replace("\n", " \n").split(" ")


class Counts(dict):
    """pre-token -> number of pieces, counted when first asked for."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the model has pieces that cross word marks or line breaks")
        self[""] = 1  # the word mark alone

    def count(self, keys: list[str]) -> list[int]:
        """The count of each, with one call of the model for all new ones."""
        new = [k for k in dict.fromkeys(keys) if k not in self]
        # the model puts a word mark in front, which a line break does not have
        self.update((k, len(ids) - (k[0] == "\n")) for k, ids in zip(new, self.model.encode(new, num_threads=1)))
        return [self[k] for k in keys]


def frequent_pre_tokens(docs: DataFrame, model: str, text: str = "text", share: float = FREQUENT) -> dict[str, int]:
    """Frequent pre-tokens and their piece counts: each with share / 2 of all occurrences at least.

    A task reports what holds share / 2 of its own occurrences, so every
    pre-token with the given share is found, and no task reports more than
    2 / share.  Which ones are found decides only how a count travels.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Counter(), 0

        def report() -> pa.RecordBatch:
            rows = [(k, n) for k, n in seen.items() if n >= total * share / 2 and n > 1 and len(k) <= FREQUENT_LENGTH]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows] + [None], pa.string()), pa.array([r[1] for r in rows] + [total], pa.int64())], ["key", "n"]
            )

        for batch in batches:
            for some in batch.column(0).to_pylist():
                keys = pre_tokens(some or "")
                seen.update(keys)
                total += len(keys)
                if len(seen) > MOST_COUNTED:  # a task of many texts reports in turns
                    yield report()
                    seen, total = Counter(), 0
        yield report()

    # the row without a key holds the number of all occurrences
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "key string, n long")
    sums = stored(counted.groupBy("key").agg(F.sum("n").alias("n")), "pre-tokens")
    total = (sums.filter("key IS NULL").first() or {"n": 0})["n"]
    kept = sums.filter("key IS NOT NULL").filter(F.col("n") >= total * share / 2).select("key")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(model)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.count(keys), pa.int64())], ["key", "pieces"])

    return {r["key"]: r["pieces"] for r in kept.mapInArrow(pieces, "key string, pieces long").collect()}


def count_tokens(
    docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", share: float = FREQUENT
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row under the sentencepiece model at path ``model``.

    Frequent pre-tokens (bounded in number and bytes) are counted once and their counts sent to all
    tasks.  The rest go, with their frequencies in each document, to the shards that own them; a
    shard counts each of its distinct pre-tokens once and returns sums by document.

    A null or empty text has 0 bytes and 0 tokens.  Repeated rows each get
    their row; a null id is kept.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(docs, model, text, share))
    n_shards = blocks.parts_for(docs, blocks.text_bytes(docs, text), SHARD_BYTES)
    sent_schema = "shard int, slice long, head binary, keys binary, sizes binary, often binary, owner binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value.get
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = 0
            for some in blocks.slices(texts, SLICE_BYTES):
                yield pack(ids[start : start + len(some)], some, known)
                start += len(some)

    def pack(ids: list, texts: list, known) -> pa.RecordBatch:
        keys, often, owner, head, mark = defaultdict(list), defaultdict(list), defaultdict(list), [], xxhash.xxh3_64()
        for d, (i, text_) in enumerate(zip(ids, texts)):
            body = (text_ or "").encode()
            mark.update(f"{i} {len(body)} ".encode() + body)
            total = 0
            for k, n in Counter(pre_tokens(text_ or "")).items():
                pieces = known(k)
                if pieces is not None:
                    total += n * pieces
                    continue
                b = k.encode()
                s = xxhash.xxh32_intdigest(b) % n_shards
                keys[s].append(b)
                often[s].append(n)
                owner[s].append(d)
            head.append((i is not None, i or 0, len(body), total))
        name = mark.intdigest() >> 1
        rows = []
        for s in sorted(keys.keys() | {name % n_shards}):
            packed = np.array(head, np.int64).tobytes() if s == name % n_shards else None
            rows.append((s, name, packed, b"".join(keys[s]), narrow([len(k) for k in keys[s]]), narrow(often[s]), narrow(np.diff(owner[s], prepend=0))))
        types = [pa.int32(), pa.int64()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in sent_schema.split(", ")])

    def count(table: pa.Table) -> pa.Table:
        counts = Counts(model)
        rows = []
        for row in table.to_pylist():
            ends = np.cumsum(wide(row["sizes"]))
            keys = [row["keys"][a:b].decode() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            sums = np.array(counts.count(keys), np.int64) * wide(row["often"])
            owner = np.cumsum(wide(row["owner"]))
            rows.append((row["slice"], row["head"], narrow(np.bincount(owner, sums) if len(owner) else [])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.binary(), pa.binary()])], ["slice", "head", "sums"])

    def finish(table: pa.Table) -> pa.Table:
        heads = [as_array(h, np.int64).reshape(-1, 4) for h in table["head"].to_pylist() if h is not None]
        there, ids, sizes, tokens = heads[0].T.copy()
        rest = np.zeros(len(ids), np.int64)
        for sums in map(wide, table["sums"].to_pylist()):
            rest[: len(sums)] += sums
        tokens = tokens + rest // len(heads)  # slices alike in all texts have one name, and each sent its own
        one = pa.table({"doc_id": pa.array(ids, mask=there == 0), "n_bytes": pa.array(sizes), "n_tokens": pa.array(tokens)})
        return pa.concat_tables([one] * len(heads))

    sent = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(send, sent_schema)
    sums = sent.groupBy("shard").applyInArrow(count, "slice long, head binary, sums binary")
    return sums.groupBy("slice").applyInArrow(finish, "doc_id long, n_bytes long, n_tokens long")


def narrow(values) -> bytes:
    """Numbers from 0 in the fewest bytes each that hold them all, after a byte with that width."""
    values = np.asarray(values, np.int64)
    width = next(w for w in (1, 2, 4, 8) if not len(values) or w == 8 or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)
