import re
from collections import defaultdict

import pytest
from conftest_llm import SF, pairs, rows_of

from venuemill.llm import decontaminate

KEY = lambda r: tuple((v is not None, v) for v in r)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window=10):
    where = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if w else ():
            where[tuple(w[s : s + n])].add("" if item is None else str(item))
    sizes = {len(k) for k in where}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in where:
                    hit.update(range(s, s + n))
                    found |= where[k]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=lambda r: KEY(r[:3]))


ITEMS = [
    (1, "tick tock tick tock tick tock tick tock tick tock tick"), (2, "w5x5 w6x6 w7x7"), (3, "More TEXT"), (3, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11"),
    (4, ""), (None, "lead"), (5, None), (6, " ".join(f"passage{i}" for i in range(20, 45))), (7, "passage41 passage42 passage43 other"), (8, "漢字 nbsp"),
]


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_equals_comparing(spark, awkward, given, most):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows_of(decontaminate.find_contamination(awkward, benchmark, most_words=most), "doc_id", "n_words", "n_hit", "items")
    assert sorted(got, key=lambda r: KEY(r[:3])) == brute(pairs(awkward), ITEMS)
    real = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = rows_of(decontaminate.find_contamination(given, real, most_words=most * 10), "doc_id", "n_words", "n_hit", "items")
    assert got == brute(pairs(given), [(r["item_id"], r["text"]) for r in real.collect()])


def test_no_rows(spark, awkward, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(awkward, none).filter("n_hit > 0 OR size(items) > 0").count() == 0
    assert decontaminate.remove_contamination(nothing, none).collect() == []


def test_removal(spark, awkward):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.remove_contamination(awkward, benchmark)
    assert out.schema.fieldNames() == awkward.schema.fieldNames()
    # what is left has no window of ten in it, and clean texts are as they were
    long_items = spark.createDataFrame([i for i in ITEMS if len(words(i[1])) >= 10], "item_id long, text string")
    cleaned = decontaminate.remove_contamination(awkward, long_items)
    assert decontaminate.find_contamination(cleaned, long_items).filter("n_hit > 0").count() == 0
    before = {tuple(r) for r in decontaminate.find_contamination(awkward, long_items).filter("n_hit = 0").select("doc_id").collect()}
    texts = {(r["doc_id"], r["text"]) for r in cleaned.collect()}
    assert {(r["doc_id"], r["text"]) for r in awkward.collect() if (r["doc_id"],) in before} <= texts
