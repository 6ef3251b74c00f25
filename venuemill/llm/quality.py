"""Quality rules: repetition counts, and divergence from what a language looks like.

A document's histogram of character classes and of common words is compared with
its language's reference by the Jensen-Shannon distance.  References come from
all documents labelled good.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuemill.llm.blocks import frugal, small_batches
from venuemill.llm.store import stored

#: Labelled documents of each language that its reference is made from, at most: no bound.
REFERENCE_DOCS = math.inf
#: Bits of the sieve of labelled ids that goes to all tasks, whatever the input, and those of a piece of it.
SIEVE_BITS, SIEVE_PIECE = 1 << 26, 1 << 15
#: Common words that a reference holds.
COMMON_WORDS = 100
#: Shortest text that is judged by its characters and by its words.
MIN_CHARS, MIN_WORDS = 200, 50
CHAR_LIMIT = 0.3
#: Limit of the word distance: a constant and an allowance for the noise of a text of n words and a reference of m, times the root of 1/n + 1/m.
WORD_LIMIT, WORD_NOISE = 0.2, 2.4
#: The same allowance of the character distance, for the reference's characters.
CHAR_NOISE = 8.0

SYMBOLS = b"#*$%&|<>"
_WORDY = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _char_class(c: int) -> int:
    if 97 <= c <= 122:
        return 0
    if 65 <= c <= 90:
        return 1
    if 48 <= c <= 57:
        return 2
    if c in b" ":
        return 3
    if c in b"\n":
        return 4
    if c in b".,":
        return 5
    if c in b";:!?'\"()-":
        return 6
    if c < 128:
        return 7
    return 8 if c >= 192 else 9  # the last are later bytes of a character and do not count


CLASSES = 9
_CLASS = np.array([_char_class(c) for c in range(256)])
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_FIRST = (np.arange(256) < 128) | (np.arange(256) >= 192)


def char_histogram(body: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(body, np.uint8)], minlength=CLASSES + 1)[:CLASSES].astype(float)


def plain_words(body: bytes) -> list[bytes]:
    return body.translate(_WORDY).split()


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (root of the divergence in bits) of two histograms, 0 to 1."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    parts = [a[a > 0] @ np.log2(a[a > 0] / m[a > 0]) for a in (p, q)]
    return math.sqrt(max(0.0, sum(parts) / 2))


def _sieve(ids: DataFrame) -> dict[int, bytes]:
    """A bit for each hash of an id, as compressed pieces by their number; a piece without ids is left out."""

    def piece(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(SIEVE_PIECE, bool)
        bits[table["bit"].to_numpy() % SIEVE_PIECE] = True
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(np.packbits(bits).tobytes())], pa.binary())})

    bits = ids.select(_sieve_bit(F.col("id")).alias("bit")).withColumn("piece", F.floor(F.col("bit") / SIEVE_PIECE))
    return {r["piece"]: bytes(r["bits"]) for r in bits.groupBy("piece").applyInArrow(frugal(piece), "piece long, bits binary").collect()}


def _sieve_bit(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SIEVE_BITS))


def language_references(docs: DataFrame, good: DataFrame) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """lang -> (character classes, common words, their counts and the count of the rest).

    ``good`` holds the doc_id of documents labelled good.  All of them count, each text once, and of texts that begin
    with the same passage in the order of hashes, near copies mostly, the least.  A sieve of fixed size keeps back most other texts where they
    are read, a join by id the rest.  Words are counted over the cluster; the driver gets ``COMMON_WORDS``
    of them for each language.  Every language with a labelled
    word has a reference; a small one is held to less, as its noise is allowed for.
    """
    small_batches(docs)
    wanted = good.select(F.col("doc_id").cast("long").alias("id")).filter("id IS NOT NULL")
    sieve = _sieve(wanted)
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("id"), "lang", F.col("text").cast("string").alias("text"), _sieve_bit(doc).alias("bit")).filter(
        "id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"
    )

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE_BITS // 8, np.uint8)
        for k, piece in sieve.items():
            bits[k * SIEVE_PIECE // 8 : (k + 1) * SIEVE_PIECE // 8] = np.frombuffer(zlib.decompress(piece), np.uint8)
        for batch in batches:
            at = batch.column(3).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            leads = []
            for text in batch.column(2).to_pylist():
                own = plain_words(text.encode())
                leads.append(b" ".join(min(set(zip(own, own[1:], own[2:])), key=lambda g: (hash_of(g), g), default=())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leads, pa.binary())], ["id", "lang", "text", "lead"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = text.encode()
                counts.update((lang, -1, word) for word in plain_words(body))
                for i, n in enumerate(char_histogram(body).astype(int).tolist()):
                    counts[lang, i, b""] += n
            columns = list(zip(*counts)) or [[]] * 3
            types = pa.string(), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, t) for c, t in zip(columns, types)], pa.array(counts.values(), pa.int64())], ["lang", "kind", "word", "n"])

    led = rows.mapInArrow(frugal(lead), "id long, lang string, text string, lead binary")
    labelled = led.join(wanted.hint("merge"), "id", "left_semi")  # labels may be many: no broadcast at any size
    one_of_each = labelled.groupBy("lang", "lead").agg(F.min("text").alias("text"))
    counted = one_of_each.select("lang", "text").mapInArrow(frugal(count), "lang string, kind int, word binary, n long")
    counts = stored(counted.groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "language_counts")
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.filter("kind = -1").withColumn("at", F.row_number().over(first)).filter(F.col("at") <= COMMON_WORDS)
    chars: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES))
    words: dict[str, list] = defaultdict(list)
    for r in counts.filter("kind >= 0").select("lang", "kind", "n").collect():
        chars[r["lang"]][r["kind"]] = r["n"]
    for r in top.orderBy("lang", "at").collect():
        words[r["lang"]].append((bytes(r["word"]), r["n"]))
    out = {}
    for lang, total in counts.filter("kind = -1").groupBy("lang").agg(F.sum("n")).collect():
        common = [n for _, n in words[lang]]
        out[lang] = chars[lang], {w: i for i, (w, _) in enumerate(words[lang])}, np.array([*common, total - sum(common)], float)
    return out


def hash_of(words: tuple[bytes, ...]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words))


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, n = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    starts = n[which] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(words) - 2 + k] |= starts
    return int(hit.sum())


def _dup_lines(body: bytes) -> int:
    seen, n = set(), 0
    for line in body.split(b"\n"):
        if line.strip():  # bytes: ASCII white space
            n += line in seen
            seen.add(line)
    return n


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "char_distance double, word_distance double, kept boolean"
)


def measure(body: bytes | None, lang: str | None, references: dict) -> tuple:
    """The values of ``COLUMNS`` for one text."""
    body = body or b""
    words = body.split()
    data = np.frombuffer(body, np.uint8)
    repeats = _repeat_words(words)
    chars = int(_FIRST[np.frombuffer(b"".join(words), np.uint8)].sum())
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    by_char = by_word = None
    kept = not failed
    if lang in references:
        reference, common, counts = references[lang]
        if int(_FIRST[data].sum()) >= MIN_CHARS:
            by_char = distance(char_histogram(body), reference)
            kept = kept and by_char <= CHAR_LIMIT + CHAR_NOISE / math.sqrt(max(1.0, reference.sum()))
        own = plain_words(body)
        if len(own) >= MIN_WORDS:
            rest = len(counts) - 1
            by_word = distance(np.bincount([common.get(w, rest) for w in own], minlength=rest + 1).astype(float), counts)
            kept = kept and by_word <= WORD_LIMIT + WORD_NOISE * math.sqrt(1 / len(own) + 1 / max(1.0, counts.sum()))
    return len(words), chars, int(_SYMBOL[data].sum()), _dup_lines(body), repeats, failed, by_char, by_word, kept


def quality_rules(docs: DataFrame, references: dict, doc_id: str = "doc_id") -> DataFrame:
    """Counts, distances and verdict of every document, one row per input row.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated 3-word windows.  ``kept`` is false then, or where a distance is over
    its limit, which allows for the noise of short texts and small references.  Distances are null, and do not count, for a language without
    a labelled word (null included) and for texts below the minimum lengths.  A null text
    counts as empty.
    """
    schema = f"doc_id long, {COLUMNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [measure(b, g, references) for b, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = list(zip(*values)) if values else [[]] * 9
            types = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 2 + [pa.bool_()]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    return docs.select(
        F.col(doc_id).cast("long"), F.col("text").cast("string").cast("binary"), F.col("lang").cast("string")
    ).mapInArrow(frugal(run), schema)


def rejected_rows_removed(docs: DataFrame, references: dict) -> DataFrame:
    """The documents that the rules keep, all columns as they were.

    A null or empty text has fewer than 50 words and goes; each repeated row is judged by itself; a row without id or language is judged by its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            kept = [measure(b, g, references)[-1] for b, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([row.filter(pa.array(kept, pa.bool_()))], ["row"])

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    shaped = docs.select(whole, F.col("text").cast("string").cast("binary").alias("b"), F.col("lang").cast("string").alias("g"))
    return shaped.mapInArrow(frugal(run), shaped.select("row").schema).select("row.*")
