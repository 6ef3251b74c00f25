from collections import Counter

import pytest
from conftest_llm import pairs, rows_of

from venuemill.llm import repeats


def brute(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[s : s + window]) for _, w in docs for s in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("window", [35, 7])
def test_equals_counting(spark, awkward, given, window):
    for docs in (awkward, given):
        assert rows_of(repeats.remove_repeated_windows(docs, window)) == brute(pairs(docs), window)


def test_small_blocks_and_full_sketch(given):
    """Many blocks and a sketch that lets everything through change nothing."""
    out = repeats.remove_repeated_windows(given, width_bits=9, block_bytes=10_000)
    assert rows_of(out) == brute(pairs(given), 35)


def test_no_rows(nothing):
    assert repeats.remove_repeated_windows(nothing).collect() == []
