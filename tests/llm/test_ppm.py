import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import pairs

from venuemill.llm import ppm

KEY = lambda r: tuple((v is not None, v) for v in r)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def contexts(body):
    padded = bytes(ppm.ORDER) + body
    for i in range(ppm.ORDER, len(padded)):
        yield padded[i - ppm.ORDER : i], padded[i]


def trained(rows):
    trie = defaultdict(Counter)
    for i, t in rows:
        if not held(i):
            for c, s in contexts((t or "").encode().lower()):
                for k in range(ppm.ORDER + 1):
                    trie[c[ppm.ORDER - k :]][s] += 1
    return trie


def log_of(trie, context, symbol):
    total, gone = 0.0, set()
    for k in range(ppm.ORDER, -1, -1):
        left = {s: n for s, n in trie.get(context[ppm.ORDER - k :], {}).items() if s not in gone}
        if not left:
            continue
        everything = sum(left.values()) + len(left)
        if symbol in left:
            return total + math.log10(left[symbol] / everything)
        total += math.log10(len(left) / everything)
        gone |= left.keys()
    return total - math.log10(256 - len(gone))


def brute(rows):
    words = {k: (t or "").encode().lower().split() for k, (_, t) in enumerate(rows)}
    counts = Counter()
    for k, (i, _) in enumerate(rows):
        if not held(i):
            counts.update([*words[k], None])
    n, v = sum(counts.values()), len(counts)
    trie = trained(rows)
    out = []
    for k, (i, t) in enumerate(rows):
        tokens = [*words[k], None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        score = sum(log_of(trie, c, s) for c, s in contexts((t or "").encode().lower()))
        out.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, score))
    return sorted(out, key=KEY)


def test_equals_counting(awkward, given):
    for docs in (awkward, given.limit(60)):
        docs = docs.cache()
        got = sorted((tuple(r) for r in ppm.score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=KEY)
        want = brute(pairs(docs))
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_probabilities_add_up():
    rows = [(k, t) for k, t in enumerate(["abracadabra", "abrakadabra ab", "banana", "cabbage"])]
    keys, counts = ppm._counted([t.encode() for _, t in rows], np.ones(4, bool))
    pairs_ = np.zeros((256, 256), np.int64)
    for _, t in rows:
        padded = b"\0" + t.encode()
        for a, b in zip(padded, padded[1:]):
            pairs_[a, b] += 1
    trie = ppm.Trie(keys, counts, pairs_)
    for context in (b"abra", b"zzzz", b"\0\0\0\0", b"zzab", b"cada"):
        every = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** trie.log10(every)).sum() == pytest.approx(1)


def test_model_predicts_held_out_text_better_than_noise(given):
    rows = ppm.score(given).filter("held_out AND n_bytes > 200").collect()
    bits = [-r["score"] / r["n_bytes"] / math.log10(2) for r in rows]
    assert rows and float(np.median(bits)) < 3.2  # uniform bytes take 8


def test_no_rows_and_nothing_to_learn_from(spark, nothing):
    assert ppm.score(nothing).collect() == []
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = ppm.score(docs, F.lit(True)).first()
    assert (r["n_known"], r["train_tokens"]) == (0, 0) and r["score"] == pytest.approx(-2 * math.log10(256))


def test_more_training_text_predicts_better(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bits = []
    for taught in (docs.filter("doc_id % 4 = 0"), docs):
        r = ppm.score(taught.unionByName(docs.filter(ppm.is_held_out(F.col("doc_id")))).dropDuplicates(["doc_id"])).filter("held_out")
        r = r.agg(F.sum("score"), F.sum("base_score"), F.sum("n_bytes")).first()
        bits.append([-x / r[2] / math.log10(2) for x in r[:2]])
    (few, _), (many, base) = bits
    assert many < few - 0.05 and many < base


def test_shards_with_the_runs_below_them_equal_one_trie():
    bodies = [b"abracadabra abrakadabra", b"the cat sat on the mat, the bat", b"\0\0ab\0"]
    keys, counts = ppm._counted(bodies, np.array([True, True, False]))
    runs, count = ppm._counted(bodies, np.array([True, True, False]), ppm.SUFFIX - 1)
    ends, seen = np.append(runs, np.uint64(0)), count > 0
    runs, count = runs[seen], count[seen]
    short = ppm._summed(runs & np.uint64(0xFFFFFF), count)
    whole = ppm.Trie(keys, counts, ppm.byte_pairs(*short)).log10(keys)
    shards, owners = ppm.shard_of_contexts(keys >> np.uint64(8), 5), ppm.shard_of_contexts(ends, 5)
    for s in range(5):
        own = shards == s
        needed = np.isin(runs >> np.uint64(8), ends[owners == s] & np.uint64(0xFFFFFF))
        part = ppm.Trie(keys[own], counts[own], ppm.byte_pairs(*short), {3: (runs[needed], count[needed]), 2: short})
        assert np.allclose(part.log10(keys[own]), whole[own], rtol=1e-12)
    assert (ppm._turned(ppm._turned(keys)) == keys).all() and (ppm._unpacked(ppm._packed(keys), np.uint64) == keys).all()
