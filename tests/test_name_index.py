"""Names looked up in one task equal brute force, and the venue of a row is the same in tasks and in a join."""

import random

import pytest
import sequential
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.operators import fuzzy, name_index, resolve


def typo(rng, text):
    for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
        at, letter = rng.randrange(len(text) + 1), rng.choice("abåc")
        text = rng.choice([text[:at] + letter + text[at:], text[:at] + text[at + 1:], text[:at] + letter + text[at + 1:]])
    return text


@pytest.mark.parametrize("rows, pairs, bits", [(1024, 1 << 20, 24), (7, 9, 4)])
def test_near_names_equal_brute_force(monkeypatch, rows, pairs, bits):
    for name, value in {"_ROWS": rows, "_PAIRS": pairs, "_TABLE_BITS": bits}.items():
        monkeypatch.setattr(name_index, name, value)
    rng = random.Random(3)
    base = ["".join(rng.choice("abåc") for _ in range(rng.randrange(32))) for _ in range(60)]
    one, two = ([*(typo(rng, rng.choice(base)) for _ in range(250)), "", *base[:20], *base[:5]] for _ in range(2))
    left, right, similarity = name_index.NameIndex(two).near(one)
    assert sorted(left) == list(left)
    want = {(i, j): sequential.ratio(a, b) for i, a in enumerate(one) for j, b in enumerate(two) if a and b and a != b}
    want = {pair: s for pair, s in want.items() if s >= V.NAME_THRESHOLD}
    assert dict(zip(zip(left.tolist(), right.tolist()), similarity.tolist())) == want
    assert len(left) == len(want) > 300


def test_hashes_that_collide_link_nothing(monkeypatch):
    monkeypatch.setattr(name_index, "_LETTER", 0)
    names = ["abcdefghijkl", "mnopqrstuvwx", "abcdefghijkx"]
    left, right, _ = name_index.NameIndex(names).near(names)
    assert list(zip(left, right)) == [(0, 2), (2, 0)]


def test_no_names():
    assert [len(x) for x in name_index.NameIndex([]).near(["abcdefgh", "", "q" * 40])] == [0, 0, 0]
    assert [len(x) for x in name_index.NameIndex(["abcdefgh"]).near([])] == [0, 0, 0]


def _resolved(spark):
    rng = random.Random(4)
    numbers = [rng.randrange(3000) for _ in range(150)]
    rows = [((1, i, 0), f"customer#{n:09d}" if i % 7 else f"the very long name of customer#{n:09d}", f"Gatan {n % 3}" if n % 2 else None,
             rng.choice(["Lund", "lund", "Malmö", None]), rng.choice([0.85, 0.9]), i % 10 > 0) for i, n in enumerate(numbers)]
    mentions = spark.createDataFrame(rows, "ord struct<pass:int,pos:long,sub:int>, key string, address string, match_city string, threshold double, can_found boolean")
    return {r["pos"]: (r["venue"], r["match_kind"]) for r in resolve.resolve(mentions).select(F.col("ord.pos"), F.col("venue_ord.pos").alias("venue"), "match_kind").collect()}


def test_few_venues_are_met_in_the_tasks_and_more_in_a_join(spark, monkeypatch):
    joins = []
    real = fuzzy.near_names
    monkeypatch.setattr(fuzzy, "near_names", lambda *a, **k: joins.append(1) or real(*a, **k))
    in_tasks = _resolved(spark)
    assert not joins and {kind for _, kind in in_tasks.values()} >= {"founded", "fuzzy"}
    monkeypatch.setattr(fuzzy, "IN_TASKS", 5)
    assert _resolved(spark) == in_tasks and joins
