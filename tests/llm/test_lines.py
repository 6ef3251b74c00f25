from collections import defaultdict

import numpy as np
from conftest_llm import pairs, rows_of

from venuemill.llm import blocks, lines
from venuemill.llm.cuckoo import Cuckoo

KEY = lambda r: tuple((v is not None, v) for v in r)
WHITE = " \t\n\r\x0b\x0c"


def brute(rows, min_docs=5, before=()):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(WHITE))
    rank = lambda i: (i is not None, i or 0)
    holders, earlier = defaultdict(list), defaultdict(int)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(i)
    for _, t in before:
        for k in {key(x) for x in (t or "").split("\n")}:
            earlier[k] += 1
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = []
        for x in parts:
            k = key(x)
            common = len(k) >= 40 and len(holders[k]) + earlier[k] >= min_docs
            if not common or max(holders[k], key=rank) == i:
                kept.append(x)
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=KEY)


def test_equals_counting(awkward, given, nothing):
    for docs in (awkward, given):
        for n in (2, 5):
            got = rows_of(lines.remove_common_lines(docs, n), "doc_id", "n_lines", "n_dropped", "kept_text")
            assert got == brute(pairs(docs), n)
    assert lines.remove_common_lines(nothing).collect() == []


def references(docs, n):
    return lines.line_references(blocks.in_blocks(docs, 3), n)


def test_index_is_reversible(given, spark):
    n = 3
    old, new = given.filter("doc_id < 120"), given.filter("doc_id >= 120")
    base = lines.changed(lines.empty_index(given), references(old, n)).cache()
    both = lines.changed(base, references(new, n)).cache()
    back = lines.changed(both, references(new, n), -1)
    table = lambda df: sorted((r["shard"], bytes(r["high"]), bytes(r["low"]), bytes(r["documents"])) for r in df.collect())
    assert table(back) == table(base)
    at_once = lines.changed(lines.empty_index(given), references(given, n))
    assert table(both) == table(at_once)
    empty = lines.changed(base, references(old, n), -1).collect()
    assert all(not len(r["high"]) and not any(r["filter"]) for r in empty)
    got = rows_of(lines.remove_common_lines(new, earlier=base, shards=n), "doc_id", "n_lines", "n_dropped", "kept_text")
    assert got == brute(pairs(new), before=pairs(old))


def test_cuckoo_holds_what_was_put_in():
    rng = np.random.default_rng(5)
    high, low = rng.integers(0, 2**63, (2, 20_000), dtype=np.uint64)
    low[:40] = low[0]  # crowded buckets
    table = Cuckoo.sized(20_000)
    assert table.insert(high, low) and table.contains(high, low).all()
    others = rng.integers(0, 2**63, (2, 20_000), dtype=np.uint64)
    assert table.contains(*others).mean() < 0.01
    table.delete(high[:9000], low[:9000])
    assert table.contains(high[9000:], low[9000:]).all()
    assert np.count_nonzero(table.buckets) == 11_000
    table.delete(high[9000:], low[9000:])
    assert not table.buckets.any()
