import random
import re

from conftest_llm import SCHEMA, pairs, rows_of

from venuemill.llm import neardup
from venuemill.llm.components import components

KEY = lambda r: tuple((v is not None, v) for v in r)


def sets_of(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        out.append((i, s))
    return out


def brute(rows):
    sets = sets_of(rows)
    parent = {i: i for i, _ in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in sets:
        if i is not None:
            for x in s:
                holders.setdefault(x, set()).add(i)
    by_id = {}
    for i, s in sets:
        by_id.setdefault(i, []).append(s)
    for i, s in sets:
        if i is None:
            continue
        for j in set().union(*(holders[x] for x in s)) if s else ():
            for other in by_id[j]:
                if j > i and 100 * len(s & other) >= 75 * len(s | other):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    named = {frozenset(s): i for i, s in sets if i is not None}
    out = []
    for i, s in sets:
        at = i if i is not None else named.get(frozenset(s)) if s else None
        out.append((i, len(s), None if at is None else find(at)))
    return sorted(out, key=KEY)


def families(spark):
    """Chains, stars and dense groups of edited copies around the threshold."""
    rng = random.Random(8)
    rows, n = [], 5000
    for f in range(12):
        words = [f"f{f}w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 30, 120, 300]))]
        for _ in range(rng.choice([2, 8, 25])):
            if rng.random() < 0.5:  # the next copy differs from this one, not from the first
                words = list(words)
                target = words
            else:
                target = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                target[rng.randrange(len(target))] = f"new{rng.random()}"
            rows.append((n, " ".join(target), None, None, None, None, None))
            n += rng.randint(1, 3)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_equals_all_pairs(spark, awkward, given):
    for docs in (awkward, given, families(spark), awkward.unionByName(families(spark)).repartition(7)):
        assert rows_of(neardup.near_duplicates(docs)) == brute(pairs(docs))


def test_no_rows(nothing):
    assert neardup.near_duplicates(nothing).collect() == []


def test_one_of_each_stays(given):
    kept = neardup.keep_one_of_each(given)
    assert kept.columns == given.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in brute(pairs(given)) if i == c}


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (5, 5)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100}
