"""Near-duplicates by banded MinHash with odd sketches.

A document's MinHash samples are folded into a parity bitmap, in which each sample flips one
bit.  Equal samples cancel in the XOR of two bitmaps, so its population count tells how
many samples differ, most exactly where similarity is high.  Band buckets
propose pairs, the bitmaps dismiss most of the wrong ones, full sets decide.  A second parity bitmap, of
the whole set, bounds from below how many shingles differ, and so rules out without error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill.llm import blocks
from venuemill.llm.blocks import as_array
from venuemill.llm.components import components
from venuemill.llm.rolling import Powers, PrefixHash, first_of_runs, mix, symbol_codes
from venuemill.llm.store import stored

SHINGLE = 5
#: Percent of the union that the intersection must reach.
PERCENT = 75
#: A pair of similarity 0.75 shares no band with a probability below 1e-5; links of its group find it all the same.
BANDS, ROWS = 32, 4
#: Samples in a bitmap (the first BANDS * ROWS make the bands) and its bits.
SAMPLES, BITS = 256, 1024
#: Bits of the parity bitmap of a whole set.
SET_BITS = 2048
#: A pair is dismissed where the bitmaps put its similarity below this, over four standard deviations under 0.75.
DISMISS = 0.62
#: Rounds in which members outside a bucket's main component are put to a representative of it, before what is left is compared in full.
ROUNDS = 2
MOST_DIFFERENT = int(BITS / 2 * (1 - np.exp(-(1 - DISMISS) * 4 * SAMPLES / BITS)))
SHARD_ENTRIES = 1_000_000
#: Bits of the bitmap of ids whose sets are wanted.
MARKS = 1 << 26

_FACTORS = symbol_codes(22, SAMPLES)
_SHIFTS = symbol_codes(23, SAMPLES)
_PLACES = symbol_codes(24, SAMPLES)


def shingle_sets(bodies: list[bytes | None], powers: Powers, size: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit shingles; a shorter text is one shingle, one without words none."""
    out = []
    for some in blocks.slices(bodies):
        codes, _, counts = blocks.word_codes([(b or b"").lower() for b in some])
        sums = PrefixHash(codes, powers)
        windows = mix(sums.windows(size))
        start = 0
        for n in counts.tolist():
            if n >= size:
                out.append(np.unique(windows[start : start + n - size + 1]))
            elif n:
                out.append(mix(sums.ranges(np.array([start]), np.array([start + n]))) + np.uint64(n))
            else:
                out.append(np.zeros(0, np.uint64))
            start += n
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * _FACTORS + _SHIFTS
        np.minimum(least, part.min(0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples[: BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(_PLACES[:BANDS], rows.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key + rows[:, :, r])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples, as longs."""
    return _parity(mix(samples ^ _PLACES), BITS)


def _parity(values: np.ndarray, bits: int) -> np.ndarray:
    flips = np.bincount((values >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, high, low, bands, bits, whole): size, 128-bit name, band keys, bitmap of the samples and of the whole of each row's shingle set."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            names, n, bands, bits, whole = [], [], [], [], []
            for shingles in shingle_sets(batch.column(1).to_pylist(), powers):
                n.append(len(shingles))
                names.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                if len(shingles):
                    samples = min_hashes(shingles)
                    bands.append(band_keys(samples)[0])
                    bits.append(odd_sketch(samples))
                    whole.append(_parity(mix(shingles), SET_BITS))
                else:
                    bands.append(None)
                    bits.append(None)
                    whole.append(None)
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(bands, longs), pa.array(bits, longs), pa.array(whole, longs)],
                ["doc_id", "n", "high", "low", "bands", "bits", "whole"],
            )

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string").cast("binary")).mapInArrow(
        blocks.frugal(run), "doc_id long, n long, high long, low long, bands array<long>, bits array<long>, whole array<long>"
    )


def _star_pairs(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each bucket: its key and least node; and pairs (least node, other node)."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = first_of_runs(keys)
    heads = np.flatnonzero(first)
    least = np.repeat(nodes[heads], np.diff(np.append(heads, len(keys))))
    other = ~first & (least != nodes)
    return keys[heads], nodes[heads], least[other], nodes[other]


def star_candidates(nodes: DataFrame, n_shards: int) -> DataFrame:
    """Distinct pairs (a, b), a < b: in each band bucket the least node with every other.

    A task first forms the stars of its own rows and sends on only their centres, so a
    bucket that holds a third of all documents reaches its shard as one entry a task.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)
            bands = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), BANDS)
            keys, centres, a, b = _star_pairs(bands.ravel(), np.repeat(own, BANDS))
            pairs = np.unique(np.stack([a, b], 1), axis=0)
            shard = (keys.view(np.uint64) >> np.uint64(20)) % np.uint64(n_shards)
            for s in range(n_shards):
                mine = shard == s
                some = pairs[s::n_shards]
                if mine.any() or len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys[mine], centres[mine], some[:, 0], some[:, 1]))],
                        ["shard", "keys", "nodes", "a", "b"],
                    )

    def meet(table: pa.Table) -> pa.Table:
        cells = {c: np.concatenate([as_array(x, np.int64) for x in table[c].to_pylist()]) for c in ("keys", "nodes", "a", "b")}
        _, _, a, b = _star_pairs(cells["keys"], cells["nodes"])
        pairs = np.unique(np.stack([np.append(a, cells["a"]), np.append(b, cells["b"])], 1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    sent = nodes.select("node", "bands").mapInArrow(blocks.frugal(local), "shard int, keys binary, nodes binary, a binary, b binary")
    return sent.groupBy("shard").applyInArrow(blocks.frugal(meet), "a long, b long").distinct()


def _plausible(x: str, y: str) -> Column:
    """Sizes and bitmaps do not rule the pair out.

    Sets of n and m shingles are similar enough where at most (n + m) * (100 - PERCENT) / (100 + PERCENT) differ."""

    differing = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(BITS // 64)), F.lit(0))
    # a loop, as that many more terms would make a method too long to be compiled; few pairs come this far
    flips = F.zip_with(f"{x}.whole", f"{y}.whole", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(flips, F.lit(0), lambda total, n: total + n)
    few = apart * (100 + PERCENT) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - PERCENT)
    low, high = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (low * 100 >= high * PERCENT) & (differing <= MOST_DIFFERENT) & few


def plausible_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps leave."""
    one = nodes.select(F.col("node").alias("a"), F.struct("n", "bits", "whole").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.struct("n", "bits", "whole").alias("y"))
    return pairs.join(one, "a").join(two, "b").filter(_plausible("x", "y")).select("a", "b")


def open_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, component, main) of the buckets that hold several components; main is the one of most members.

    ``members`` has (key, node); ``found`` the component of linked nodes.
    """
    placed = members.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    return placed.join(several.filter("parts > 1").select("key", "main"), "key").select("key", "node", "component", "main")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node) of the buckets with two nodes at least."""
    entries = nodes.select(F.explode("bands").alias("key"), "node")
    crowded = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return entries.join(crowded, "key")


def representatives(members: DataFrame, judged: DataFrame) -> DataFrame:
    """(key, node) of each open bucket: the member of its main component whose tested pairs were links most often."""
    tries = judged.select(F.explode(F.array("a", "b")).alias("node"), "linked").groupBy("node").agg(
        ((F.count_if("linked") + 1) / (F.count(F.lit(1)) + 2)).alias("share")
    )
    main = members.filter("component = main").join(tries, "node", "left")
    return main.groupBy("key").agg(F.max_by("node", F.struct(F.coalesce("share", F.lit(0.0)), "node")).alias("node"))


def asked_candidates(members: DataFrame, judged: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): in each open bucket the members outside the main component with its representative."""
    x = members.filter("component != main").select("key", F.col("node").alias("x"))
    met = x.join(representatives(members, judged), "key")
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def cross_candidates(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Plausible pairs (a, b) of different components in one bucket.

    In each open bucket the members outside its main component meet all members.
    """
    with_bits = members.join(nodes.select("node", "n", "bits", "whole"), "node")
    whole = F.struct("node", "component", "n", "bits", "whole")
    x = with_bits.filter("component != main").select("key", whole.alias("x"))
    y = with_bits.select("key", whole.alias("y"))
    met = x.join(y, (x["key"] == y["key"]) & (F.col("x.component") != F.col("y.component")) & _plausible("x", "y"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _marked(ids: DataFrame) -> bytes:
    """A bitmap of MARKS bits (fixed size) in which the hashes of ``ids`` are set."""
    place = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    chunks = ids.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("chunk")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits"))
    out = bytearray(MARKS // 8)
    for r in chunks.collect():
        out[r["chunk"] * 4096 : (r["chunk"] + 1) * 4096] = r["bits"]
    return bytes(out)


def judged_pairs(pairs: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, linked): whether full shingle sets of the pair reach the similarity; a and b are ids of ``docs``.

    A bitmap of fixed size keeps most other documents from being cut into shingles; the joins decide.
    """
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    marks = docs.sparkSession.sparkContext.broadcast(_marked(needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0))
            for at in range(0, some.num_rows, 500):
                part = some.slice(at, 500)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist(), powers)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("body")).filter("id IS NOT NULL")
    sets = keyed.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(MARKS))).mapInArrow(blocks.frugal(run), "id long, shingles array<long>")
    with_b = pairs.join(sets.withColumnsRenamed({"id": "b", "shingles": "y"}), "b")
    both = with_b.join(sets.withColumnsRenamed({"id": "a", "shingles": "x"}), "a")
    common = F.size(F.array_intersect("x", "y"))
    counted = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y") - common).alias("either"))
    return counted.groupBy("a", "b").agg(F.bool_or(F.col("common") * 100 >= F.col("either") * PERCENT).alias("linked"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Rows of one shingle set are folded into the least id that has it.  Stars of the band buckets
    are confirmed first.  Where that leaves several components in one bucket, the members outside the main one are
    put to a representative of it, one that most of its tested partners link with, for some rounds.  Members that are still
    outside are then compared with all others, so no link between components is missed.

    Texts without words (null, empty) have no shingles and are alone.  Rows that
    share an id are one document.  Sets of rows without an id are not compared; their ``component_id`` is null.
    """
    blocks.small_batches(docs)
    rows = stored(signatures(docs, doc_id, text), "signatures")
    sets = rows.filter("n > 0").groupBy("high", "low").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL")
    sets = stored(sets, "sets")
    own = rows.join(sets.withColumnRenamed("node", "doc_id"), ["high", "low", "doc_id"])
    nodes = stored(own.select(F.col("doc_id").alias("node"), "n", "bands", "bits", "whole").dropDuplicates(["node", "n", "bands"]), "nodes")
    n_shards = max(-(-nodes.count() * BANDS // SHARD_ENTRIES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    links = lambda judged: judged.filter("linked").select("a", "b")
    judged = stored(judged_pairs(stored(plausible_pairs(star_candidates(nodes, n_shards), nodes), "pairs"), docs, doc_id, text), "judged")
    found = components(links(judged))
    buckets = stored(shared_buckets(nodes), "buckets")
    for r in range(ROUNDS + 1):
        members = stored(open_members(buckets, found), "members")
        if members.isEmpty():
            break
        if r == ROUNDS:
            pairs = cross_candidates(members, nodes)
        else:
            pairs = plausible_pairs(asked_candidates(members, judged), nodes)
        pairs = stored(pairs.join(judged, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        new = stored(judged_pairs(pairs, docs, doc_id, text), "judged")
        judged = judged.unionByName(new)
        if not links(new).isEmpty():
            known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = components(known.unionByName(links(new)))
    labels = sets.join(found, "node", "left").select("high", "low", F.coalesce("component", "node").alias("component"))
    return rows.select("doc_id", "n", "high", "low").join(labels, ["high", "low"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the least id of their group, all columns as they were; rows without an id stay."""
    gone = near_duplicates(docs, doc_id, text).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")
