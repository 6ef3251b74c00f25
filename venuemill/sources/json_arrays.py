"""Reading of JSON array files by byte ranges.

A file that is one array cannot be cut at lines.  But whether a byte range begins inside a string, and how deep, follows
from what stands before it: a first pass finds, for each range and for both beginnings (inside a string or not), how much
deeper it ends.  Joined in order that tells every range where it begins, and a second pass reads
the objects that begin in each range.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a range, and of what is held of it at a time.
RANGE_BYTES, BLOCK_BYTES = 32 << 20, 1 << 20
_STEP = 1 << 16
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1


def _uri(path: str) -> str:
    return f"file://{path.removeprefix('file:')}" if path.startswith("file:/") and not path.startswith("file://") else path


def _open(path: str) -> pa.NativeFile:
    system, inside = fs.FileSystem.from_uri(_uri(path))
    return system.open_input_file(inside)


def _backslashes_before(file: pa.NativeFile, start: int) -> int:
    """How many backslashes stand directly before a place."""
    n = 0
    while start > n:
        size = min(_STEP, start - n)
        file.seek(start - n - size)
        block = file.read(size)
        own = len(block) - len(block.rstrip(b"\\"))
        n += own
        if own < size:
            break
    return n


class Marks(NamedTuple):
    """Brackets and braces of a range: places, depth steps, and the number of quotes before each."""

    at: np.ndarray
    step: np.ndarray
    quotes: np.ndarray
    n_quotes: int


def marks(data: bytes, backslashes: int) -> Marks:
    """``backslashes``: how many stand directly before the range."""
    x = np.frombuffer(data, np.uint8)
    quote = np.flatnonzero(x == _QUOTE)
    if len(quote):
        # a quote after an odd run of backslashes is part of a string
        place = np.arange(len(x))
        last = np.maximum.accumulate(np.where(x != _BACKSLASH, place, -1))
        before = np.where(quote > 0, last[quote - 1], -1)
        run = quote - 1 - before + np.where(before < 0, backslashes, 0)
        quote = quote[run % 2 == 0]
    at = np.flatnonzero(_DEPTH[x])
    return Marks(at, _DEPTH[x[at]], np.searchsorted(quote, at), len(quote))


def _deeper(m: Marks, inside: bool) -> int:
    return int(m.step[m.quotes % 2 == int(inside)].sum())


def _objects(file: pa.NativeFile, start: int, stop: int, end: int, inside: bool, depth: int, base: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the objects at depth ``base`` that begin in a range, the last one read on to its end."""
    at, held, first = start, b"", None
    while at < end and (at < stop or first is not None):
        size = min(BLOCK_BYTES, stop - at) if at < stop else min(_STEP, end - at)
        before = _backslashes_before(file, at)
        file.seek(at)
        data = file.read(size)
        m = marks(data, before)
        live = m.quotes % 2 == int(inside)
        place, step = m.at[live], m.step[live]
        now = depth + np.cumsum(step)
        edge = np.flatnonzero(((step > 0) & (now == base + 1)) | ((step < 0) & (now == base)))
        for p, opens in zip(place[edge].tolist(), (step[edge] > 0).tolist()):
            if opens:
                if at >= stop:  # begins in the next range
                    return
                if data[p : p + 1] == b"{":
                    first, held = at + p, b""
                    from_ = p
            elif first is not None:
                yield first, held + data[(from_ if not held else 0) : p + 1]
                first, held = None, b""
                if at >= stop:
                    return
        if first is not None:
            held += data[from_:] if not held else data
        depth, inside = int(now[-1]) if len(now) else depth, inside ^ bool(m.n_quotes % 2)
        at += size


def reachable(path: str) -> bool:
    """Whether tasks can read byte ranges of files at this path."""
    try:
        fs.FileSystem.from_uri(_uri(path))
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects of JSON array files with ``schema``, ``_file`` and ``_place`` (their first byte in the file).

    A file that holds one object, or several one after the other, gives these.  Elements that are not objects are left out; an object
    that is not valid JSON has null fields.  Of each range three numbers come to the driver.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = []
    ranges = [(r["path"], k, at, min(at + range_bytes, r["length"]), r["length"]) for r in files for k, at in enumerate(range(0, r["length"], range_bytes))]
    if not ranges:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_file", T.StringType()), T.StructField("_place", T.LongType())]))
    table = spark.createDataFrame(ranges, "file string, k long, start long, stop long, size long").repartition(len(ranges), "file", "k")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                quotes, deeper, head = 0, [0, 0], b""  # by whether the range begins inside a string
                with _open(r["file"]) as file:
                    for at in range(r["start"], r["stop"], BLOCK_BYTES):
                        before = _backslashes_before(file, at)
                        file.seek(at)
                        data = file.read(min(BLOCK_BYTES, r["stop"] - at))
                        m = marks(data, before)
                        for inside in (0, 1):
                            deeper[inside] += _deeper(m, bool((inside + quotes) % 2))
                        quotes += m.n_quotes
                        head = head or data.removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
                rows.append({"file": r["file"], "k": r["k"], "quotes": quotes, "out": deeper[0], "in_": deeper[1], "head": head.decode("utf-8", "replace")})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("k", pa.int64()), ("quotes", pa.int64()), ("out", pa.int64()), ("in_", pa.int64()), ("head", pa.string())]))

    found = {(r["file"], r["k"]): r for r in table.mapInArrow(scan, "file string, k long, quotes long, out long, in_ long, head string").collect()}
    begins = []
    for file, k, start, stop, size in ranges:
        if k == 0:
            inside, depth, base = False, 0, None
        r = found[file, k]
        base = int(r["head"] == "[") if base is None and r["head"] else base  # ranges of white space come before
        begins.append((file, start, stop, size, inside, depth, base or 0))
        depth, inside = depth + (r["in_"] if inside else r["out"]), inside ^ bool(r["quotes"] % 2)
    placed = spark.createDataFrame(begins, "file string, start long, stop long, size long, inside boolean, depth long, base long").repartition(len(begins), "file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["file"]) as file:
                    texts, places, size = [], [], 0
                    for place, text in _objects(file, r["start"], r["stop"], r["size"], r["inside"], r["depth"], r["base"]):
                        texts.append(text)
                        places.append(place)
                        size += len(text)
                        if size > 1 << 22:
                            yield _batch(r["file"], places, texts)
                            texts, places, size = [], [], 0
                    if texts:
                        yield _batch(r["file"], places, texts)

    objects = placed.mapInArrow(read, "file string, place long, text string")
    return objects.select(F.from_json("text", schema).alias("row"), "file", "place").select(
        *[F.col(f"row.`{c}`") for c in schema.fieldNames()], F.col("file").alias("_file"), F.col("place").alias("_place")
    )


def _batch(file: str, places: list[int], texts: list[bytes]) -> pa.RecordBatch:
    decoded = [t.decode("utf-8", "replace") for t in texts]
    return pa.RecordBatch.from_arrays([pa.array([file] * len(texts), pa.string()), pa.array(places, pa.int64()), pa.array(decoded, pa.string())], ["file", "place", "text"])
