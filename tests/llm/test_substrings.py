import random

import numpy as np
import pytest
from conftest_llm import SCHEMA, pairs, rows_of

from venuemill.llm import substrings
from venuemill.llm.suffixes import SuffixOrder

KEY = lambda r: tuple((v is not None, v) for v in r)


def brute(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        b = (t or "").encode()
        hit = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if x in seen:
                hit[s : s + length] = True
            seen.add(x)
        hit = hit[: len(b)]
        spans = int((hit[1:] & ~hit[:-1]).sum() + (len(hit) > 0 and hit[0]))
        out.append((i, len(b), int(hit.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~hit])))
    return sorted(out, key=KEY)


def got(df):
    return [(*r[:4], bytes(r[4])) for r in rows_of(df)]


def patchwork(spark):
    """Texts made of shared pieces, so that edges of common passages meet in many ways."""
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcé ") for _ in range(rng.randint(5, 300))) for _ in range(25)] + ["xy" * 150, "z" * 250]
    rows = [(rng.randint(0, 60), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))), None, None, None, None, None) for _ in range(80)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("length", [100, 25])
def test_equals_comparing(spark, awkward, given, length):
    for docs in (awkward, given, patchwork(spark)):
        assert got(substrings.remove_earlier_strings(docs, length)) == brute(pairs(docs), length)


def test_no_rows(nothing):
    assert substrings.remove_earlier_strings(nothing).collect() == []


def test_suffix_order_equals_sorting():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(400)] + [b"a" * 40] * 5
    groups = np.array([rng.randint(0, 9) for _ in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    s = SuffixOrder(data, np.cumsum(lengths) - lengths, lengths, groups)
    assert [(groups[i], texts[i]) for i in s.order] == sorted(zip(groups, texts))
    for k in range(1, len(texts)):
        i, j = s.order[k - 1], s.order[k]
        n = next((m for m, (p, q) in enumerate(zip(texts[i], texts[j])) if p != q), min(len(texts[i]), len(texts[j])))
        assert s.lcp[k] == (n if groups[i] == groups[j] else 0)


def test_a_collision_is_noticed(monkeypatch):
    texts = [b"qa1", b"qb2", b"qa3", b"qb0"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    codes = np.arange(1, 512, 2, dtype=np.uint64)
    codes[ord("a")] = codes[ord("b")]
    monkeypatch.setattr("venuemill.llm.suffixes._CODES", codes)
    s = SuffixOrder(data, np.arange(4) * 3, np.full(4, 3), np.zeros(4, int))
    assert [texts[i] for i in s.order] == sorted(texts) and s.lcp.tolist() == [0, 2, 1, 2]
