"""Blocks of whole texts, and questions they put to key shards.

Several operators need a fact about each key of a text that depends on the
whole corpus (is this window repeated, how often does this word occur).  They
work in blocks: documents are dealt by a hash of their id into blocks of
bounded bytes, each block asks the shards that own its keys once per distinct
key, and the answers meet the same texts again.  Nothing is gathered beyond a
block or a shard, and a key held by every document costs a shard one entry
for each block.

The rows of a block are put in the order of (id, text), so positions in a block
mean the same in every pass, also for repeated rows and null ids (first).
"""

from __future__ import annotations

import ctypes
import functools
import inspect
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill.llm.rolling import ASCII_SPACE


#: Rows of an Arrow batch, at most: whole texts can be long, and a worker holds a batch several times over.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


_held: dict[str, object] = {}


def held(name: str, make: Callable):
    """A large object that a worker keeps between tasks; it keeps one at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def _give_back() -> None:
    """Return freed memory to the system: workers live on, and what they hold adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def frugal(function: Callable, holds: bool = False) -> Callable:
    """A function for Arrow batches or groups that leaves no memory behind; ``holds``: it uses what ``held`` keeps."""

    def start() -> None:
        if not holds and _held:
            _held.clear()
            _give_back()

    if inspect.isgeneratorfunction(function):

        @functools.wraps(function)
        def stream(batches):
            start()
            try:
                yield from function(batches)
            finally:
                _give_back()

        return stream

    @functools.wraps(function)
    def group(*tables):
        start()
        try:
            return function(*tables)
        finally:
            _give_back()

    group.__signature__ = inspect.signature(function)
    return group


def small_batches(docs: DataFrame) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS``; plans read it when they run, so it stays."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, BATCH_ROWS)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts (one scan of one column)."""
    small_batches(docs)
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0]


def parts_for(docs: DataFrame, total: int, each: int) -> int:
    """How many parts of about ``each`` bytes there are, enough to keep the cluster busy."""
    return max(math.ceil(total / each), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def block_number(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def in_blocks(docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text", rest: bool = False) -> DataFrame:
    """(block, id, body[, rest]); ``rest`` holds the whole row under one name, so that no name can clash."""
    columns = [
        block_number(F.col(doc_id), n).alias("block"), F.col(doc_id).cast("long").alias("id"),
        F.col(text).cast("string").cast("binary").alias("body"),
    ]
    if rest:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"))
    return docs.select(*columns)


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a block in the order of (id, text)."""
    ids, bodies = table["id"].to_pylist(), table["body"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, bodies[i] or b""))
    return table.take(pa.array(order, pa.int64()))


_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True


@dataclass
class Text:
    """Texts laid end to end with a line break after each."""

    bodies: list[bytes]
    data: np.ndarray
    first: np.ndarray  # of each text, in ``data``

    @classmethod
    def of(cls, bodies: list[bytes | None]) -> Text:
        bodies = [b or b"" for b in bodies]
        sizes = np.array([len(b) + 1 for b in bodies], np.int64)
        data = np.frombuffer(b"\n".join([*bodies, b""]), np.uint8)
        return cls(bodies, data, np.cumsum(sizes) - sizes)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words between ASCII white space, and the number of words of each text."""
        space = np.concatenate([[True], _SPACE[self.data], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edge[0::2], edge[1::2]
        at = np.searchsorted(starts, np.append(self.first, len(self.data)))
        return starts, ends, np.diff(at)


def slices(bodies: list[bytes | None], limit: int = 1 << 20):
    """Runs of texts of about ``limit`` bytes, so that arrays by byte stay small."""
    first = size = 0
    for i, body in enumerate(bodies):
        size += len(body or b"")
        if size >= limit:
            yield bodies[first : i + 1]
            first, size = i + 1, 0
    if first < len(bodies):
        yield bodies[first:]


def word_codes(bodies: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit codes of each word (the halves of a 128-bit hash of its bytes), and the number of words of each text."""
    digest = xxhash.xxh3_128_digest
    parts, counts = [np.zeros((0, 2), np.uint64)], []
    for body in bodies:
        words = (body or b"").split()
        counts.append(len(words))
        if words:
            parts.append(np.frombuffer(b"".join(map(digest, words)), np.uint64).reshape(-1, 2))
    both = np.concatenate(parts)
    return both[:, 0].copy(), both[:, 1].copy(), np.array(counts, np.int64)


def as_array(cell: bytes | None, kind) -> np.ndarray:
    return np.frombuffer(cell or b"", kind)
