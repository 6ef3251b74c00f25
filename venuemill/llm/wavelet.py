"""Token files: a wavelet matrix per shard, with rank and select over its bit planes.

The ids of a shard's documents lie end to end.  Plane by plane, from the highest bit, the ids are split stably by
that bit, zeros first.  With counts of ones at every 512th place a plane answers how many ones come before a place and where the
k-th one lies, so a single token, the number of times an id occurs in a range and the places where it does are found without
decoding the file.  Planes are compressed apart and opened when they are first asked for.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuemill.llm import blocks
from venuemill.llm.packing import byte_letters

MAGIC = b"WVM1"
END_ID = 2
#: Ids in a shard, at most, unless one document alone has more.
SHARD_IDS = 2_000_000
#: Bytes of text to a task that writes shards.
TASK_BYTES = 16 << 20
#: Words whose ids a process keeps.
MOST_CACHED = 800_000
#: A word whose last character is a mark after a letter or digit.
_ENDS_WORD = re.compile(rb"(?:(?<=[a-z0-9])|(?<=\xc3[\xa0-\xb6\xb8-\xbf]))[.,;:!?]\Z")
#: Letters below are composed and of a settled category, so no normalizer or Unicode version changes what they are.
_LATIN_ENDS = "\u0250"
#: Writing tasks whose sizes are summed before they come to the driver.
PARTS_SUMMED = 1024
NO_ID = np.iinfo(np.int64).min
_STEP = 512


class Plane:
    """Bits with rank and select."""

    def __init__(self, packed: bytes, n: int):
        self.n = n
        self.bytes = np.frombuffer(packed, np.uint8)
        ones = np.bitwise_count(np.pad(self.bytes, (0, -len(self.bytes) % (_STEP // 8)))).reshape(-1, _STEP // 8).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])  # ones before each stretch

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.bytes, count=self.n).view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place (0 to n)."""
        out = self.before[at // _STEP].copy()
        first, whole = at // _STEP * (_STEP // 8), at >> 3
        for k in range(_STEP // 8):
            more = first + k < whole
            if not more.any():
                break
            out[more] += np.bitwise_count(self.bytes[(first + k)[more]])
        part = (at & 7) > 0
        out[part] += np.bitwise_count(self.bytes[whole[part]] >> (8 - (at[part] & 7)).astype(np.uint8))
        return out

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Where the k-th (from 0) one or zero stands, by bisection over ranks."""
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            ones = self.ones(middle + 1)
            enough = (ones if bit else middle + 1 - ones) > k
            low, high = np.where(open_ & ~enough, middle + 1, low), np.where(open_ & enough, middle, high)
        return low


class Shard:
    """One file: documents in ascending order and the wavelet matrix of their ids."""

    def __init__(self, n: int, depth: int, doc_ids: np.ndarray, lengths: np.ndarray, zeros: list[int], planes: list[bytes]):
        self.n, self.depth, self.doc_ids, self.lengths, self.zeros = n, depth, doc_ids, lengths, zeros
        self._packed, self._open = planes, {}

    @classmethod
    def of(cls, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> Shard:
        depth = max(1, int(ids.max(initial=0)).bit_length())
        ids = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        zeros, planes = [], []
        for bit in range(depth - 1, -1, -1):
            ones = (ids >> bit & 1).astype(bool)
            planes.append(pa.compress(np.packbits(ones).tobytes(), codec="zstd", asbytes=True))
            low = ids[~ones]
            zeros.append(len(low))
            ids = np.concatenate([low, ids[ones]])
        return cls(len(ids), depth, doc_ids, lengths, zeros, planes)

    def to_bytes(self) -> bytes:
        """Magic, sizes, then document ids, lengths and planes, each compressed by itself."""
        tables = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in (self.doc_ids.astype("<i8"), self.lengths.astype("<i8"))]
        parts = [*tables, *self._packed]
        head = struct.pack("<4sqqi", MAGIC, self.n, len(self.doc_ids), self.depth)
        sizes = np.array([len(p) for p in parts], "<i8").tobytes()
        return b"".join([head, np.array(self.zeros, "<i8").tobytes(), sizes, *parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, n, docs, depth = struct.unpack_from("<4sqqi", data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize("<4sqqi")
        zeros = np.frombuffer(data, "<i8", depth, at).tolist()
        sizes = np.frombuffer(data, "<i8", depth + 2, at + 8 * depth)
        ends = at + 8 * (2 * depth + 2) + np.cumsum(sizes)
        parts = [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
        table = lambda p: np.frombuffer(pa.decompress(p, 8 * docs, codec="zstd", asbytes=True), "<i8") if docs else np.zeros(0, np.int64)
        return cls(n, depth, table(parts[0]), table(parts[1]), zeros, parts[2:])

    def plane(self, level: int) -> Plane:
        if level not in self._open:
            size = -(-self.n // 8)
            self._open[level] = Plane(pa.decompress(self._packed[level], size, codec="zstd", asbytes=True) if size else b"", self.n)
        return self._open[level]

    def ids(self) -> np.ndarray:
        """All ids, by undoing the splits from the lowest plane up."""
        kind = np.uint16 if self.depth <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(self.depth - 1, -1, -1):
            ones = self.plane(level).bits()
            now = np.empty_like(out)
            now[~ones] = out[: self.zeros[level]]
            now[ones] = out[self.zeros[level] :] | kind(1 << (self.depth - 1 - level))
            out = now
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(self.depth):
            plane = self.plane(level)
            bit, ones = plane.get(at).astype(bool), plane.ones(at)
            out = out << 1 | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, low: int, high: int) -> np.ndarray:
        """Where the occurrences of ``token`` between two places lie below the lowest plane."""
        ends = np.array([low, high], np.int64)
        if token < 0 or token >> self.depth:
            return ends * 0
        for level in range(self.depth):
            ones = self.plane(level).ones(ends)
            ends = self.zeros[level] + ones if token >> (self.depth - 1 - level) & 1 else ends - ones
        return ends

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often ``token`` occurs in the places low to high."""
        a, b = self._range(token, low, self.n if high is None else high)
        return int(b - a)

    def places(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """The places, ascending, at which ``token`` occurs."""
        a, b = self._range(token, low, self.n if high is None else high)
        at = np.arange(a, b)
        for level in range(self.depth - 1, -1, -1):
            bit = token >> (self.depth - 1 - level) & 1
            at = self.plane(level).select(at - self.zeros[level] * bit, bit)
        return at


class WordEncoder:
    """Ids of texts by a tokenizer that looks at nothing beyond ASCII white space, as little-endian bytes.

    So a text is cut there, and the ids of words are kept for the next texts.  With a tokenizer that lower-cases and ends a
    piece where letters or digits end, words are kept in lower case, a word with a mark behind it has the ids of
    both, and words of letters go to the library side by side, as each has exactly one last piece.  Where its model takes bytes as
    letters, words of Latin letters, which stay as they are until then, go to the model one by one.
    """

    def __init__(self, path: str, cached: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library, self.cached, self.known = Tokenizer.from_file(path), cached, {}
        added = self.library.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in added.values()]
        self.mark_id, self.mark = next((i, t.content.encode()) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized))
        self.lower = self.library.normalizer is not None and b'"Lowercase"' in self.library.normalizer.__getstate__()
        suffix = getattr(self.library.model, "end_of_word_suffix", None) or ""
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if suffix and piece.endswith(suffix)]] = True
        steps = self.library.pre_tokenizer
        self.letters = byte_letters() if steps is not None and b'"ByteLevel","add_prefix_space":false' in steps.__getstate__().replace(b" ", b"") else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, new: list[bytes]) -> None:
        """Add words to those known, many in one text."""
        odd, letters, rest = [], [], []
        lowered = self.lower and bool(self.ends.any())
        tokenize, known = self.library.model.tokenize, self.known
        for w in new:
            text = w.decode()
            plain = lowered and text.isalpha() and text == text.lower()
            if plain and self.letters is not None and max(text) < _LATIN_ENDS:
                known[w] = np.array([t.id for t in tokenize(w.decode("latin-1").translate(self.letters))], "<u4").tobytes()
                continue
            (odd if any(a in w for a in self.added) else letters if plain else rest).append(w)
        for w in odd:
            self.known[w] = self._ids(w.decode()).tobytes()
        for words, between in ((letters, b" "), (rest, self.mark)):
            for at in range(0, len(words), 2000):
                some = words[at : at + 2000]
                ids = self._ids(between.join(some).decode())
                data = ids.tobytes()
                if between == b" ":
                    cuts = np.flatnonzero(self.ends[ids]) + 1
                    first, stop = [0, *cuts[:-1].tolist()], cuts.tolist()
                else:  # an added token, which the library takes out before it looks at the words
                    cuts = np.flatnonzero(ids == self.mark_id).tolist()
                    first, stop = [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]
                self.known.update((w, data[4 * x : 4 * y]) for w, x, y in zip(some, first, stop, strict=True))

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        """The ids of each text, given as UTF-8."""
        known = self.known
        if len(known) > self.cached:
            known.clear()
        split = [b.lower().split() for b in bodies] if self.lower else [b.split() for b in bodies]
        found = [list(map(known.get, words)) for words in split]
        open_ = [[i for i, f in enumerate(ids) if f is None] if None in ids else [] for ids in found]
        new = {words[i] for words, places in zip(split, open_) for i in places}
        marked = {w for w in new if self.lower and _ENDS_WORD.search(w) and not any(a in w for a in self.added)}
        self._learn([w for w in (new - marked) | {x for w in marked for x in (w[:-1], w[-1:])} if w not in known])
        known.update([(w, known[w[:-1]] + known[w[-1:]]) for w in marked])
        for words, ids, places in zip(split, found, open_):
            for i in places:
                ids[i] = known[words[i]]
        return [b"".join(ids) for ids in found]


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _saved(folder: str, name: str, data: bytes) -> None:
    """Written beside its place and then moved there, so that a task that is repeated or lost leaves no half file."""
    system, path = _file_system(folder)
    beside = f"{path}/_{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as out:
        out.write(data)
    system.move(beside, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS, task_bytes: int = TASK_BYTES) -> None:
    """Write the token files of ``docs`` to ``folder``, a URI that pyarrow reaches from every executor (file, hdfs, s3, gs).

    Documents follow one another by id, nulls first; rows that share an id by a hash of their text, and equal rows as they come.
    A document is its ids and ``END_ID``; a null text is empty.  File names sort as their documents do.

    Texts are dealt out in order of their ids, so a third of all rows under one id still goes to many tasks.
    """
    total = blocks.text_bytes(docs, text)
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    key = [F.col("id").asc_nulls_first(), F.col("name").asc_nulls_first(), F.col("row").asc()]
    own = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("name"), F.monotonically_increasing_id().alias("row"),
        F.col(text).cast("string").cast("binary").alias("body"),
    )
    ordered = own.repartitionByRange(blocks.parts_for(docs, total, task_bytes), *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encode = blocks.held(f"words {tokenizer}", lambda: WordEncoder(tokenizer, MOST_CACHED)).encode
        end = np.array([END_ID], "<u4").tobytes()
        names, bodies, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, bodies, size, number
            lengths = np.array([len(b) // 4 for b in bodies], np.int64)
            shard = Shard.of(np.frombuffer(b"".join(bodies), "<u4"), np.array(names, np.int64), lengths)
            _saved(folder, f"tokens-{part:08d}-{number:06d}-{shard.n}.wm", shard.to_bytes())
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n": pa.array([shard.n], pa.int64())})
            names, bodies, size, number = [], [], 0, number + 1
            return out

        for batch in batches:
            ids, start = batch.column(0).to_pylist(), 0
            for some in blocks.slices(batch.column(1).to_pylist(), 1 << 20):
                for name, found in zip(ids[start : start + len(some)], encode([b or b"" for b in some])):
                    if size and size + len(found) // 4 + 1 > shard_ids:
                        yield flush()
                    names.append(NO_ID if name is None else name)
                    bodies.append(found + end)
                    size += len(found) // 4 + 1
                start += len(some)
        if names:
            yield flush()

    written = ordered.select("id", "body").mapInArrow(blocks.frugal(run, holds=True), "part int, number int, n long")
    written.agg(F.count(F.lit(1))).collect()  # the files are the result


_NAME = r"tokens-(\d+)-(\d+)-(\d+)\.wm$"


def _files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """(part, number, n[, content]) of the files, from their names; one file is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.wm").load(folder)
    return files.select(*[F.regexp_extract("path", _NAME, k + 1).cast("long").alias(c) for k, c in enumerate(("part", "number", "n"))], *columns)


def _empty(spark: SparkSession, folder: str) -> bool:
    system, path = _file_system(folder)
    return not any(f.base_name.startswith("tokens-") for f in system.get_file_info(fs.FileSelector(path)))


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files, decoded from their bit planes.

    ``start`` counts the ids of all documents before: running sums over the names of the files, of which one number for
    ``PARTS_SUMMED`` writing tasks comes to the driver.
    """
    schema = DOCUMENTS + (", ids binary" if keep_ids else "")
    if _empty(spark, folder):
        return spark.createDataFrame([], schema)

    group = (F.col("part") / PARTS_SUMMED).cast("long")
    files = _files(spark, folder).withColumn("some", group)
    totals = sorted((r["some"], r["n"]) for r in files.groupBy("some").agg(F.sum("n").alias("n")).collect())
    first, firsts = 0, []
    for some, n in totals:
        firsts.append((some, first))
        first += n
    in_order = Window.partitionBy("some").orderBy("part", "number")
    starts = files.select("part", "number", "some", (F.sum("n").over(in_order) - F.col("n")).alias("inside")).join(
        F.broadcast(spark.createDataFrame(firsts, "some long, base long")), "some"  # as many rows as came to the driver
    ).select("part", "number", (F.col("base") + F.col("inside")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard.from_bytes(content)
                data = shard.ids().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths)
                bodies = [data[4 * (e - n) : 4 * e] for n, e in zip(shard.lengths.tolist(), ends.tolist())]
                columns = [
                    pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID), pa.array(first + ends - shard.lengths), pa.array(shard.lengths),
                    pa.array([zlib.crc32(b) for b in bodies], pa.int64()),
                ]
                names = [c.split()[0] for c in DOCUMENTS.split(", ")]
                if keep_ids:
                    columns, names = [*columns, pa.array(bodies, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return _files(spark, folder, "content").join(starts, ["part", "number"]).select("content", "first").mapInArrow(blocks.frugal(run), schema)


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, n) over all files, from ranks alone; a token that is asked for twice has one row."""
    tokens = list(dict.fromkeys(tokens))
    if _empty(spark, folder):
        return spark.createDataFrame([(t, 0) for t in tokens], "token long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                shard = Shard.from_bytes(content)
                yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array([shard.count(t) for t in tokens], pa.int64())})

    found = _files(spark, folder, "content").select("content").mapInArrow(blocks.frugal(run), "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """(doc_id, place): every occurrence of ``token``, with its place within its document."""
    schema = "doc_id long, place long"
    if _empty(spark, folder):
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                shard = Shard.from_bytes(content)
                at = shard.places(token)
                ends = np.cumsum(shard.lengths)
                doc = np.searchsorted(ends, at, "right")
                ids = shard.doc_ids[doc]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(at - (ends - shard.lengths)[doc])], ["doc_id", "place"])

    return _files(spark, folder, "content").select("content").mapInArrow(blocks.frugal(run), schema)
