"""Founders by prefixes equal those of the plain sequence, for dense and for sparse names, also where many prefixes and rounds are needed."""

import random

import pytest

from venuemill.operators import resolve


def distance(one, two):
    row = list(range(len(two) + 1))
    for i, a in enumerate(one, 1):
        row, before = [i], row
        for j, b in enumerate(two, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return row[-1]


def in_sequence(names, aliases):
    founders = []
    for name, threshold in names:
        near = (1.0 - distance(name, other) / max(len(name), len(other)) >= threshold for other in founders if name)
        if not (name in founders or aliases.get(name) in founders or any(near)):
            founders.append(name)
    return set(founders)


def dense(rng):
    return [f"customer {rng.randrange(10**5):09d}" for _ in range(120)]


def sparse(rng):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 30))) for _ in range(120)]


def mixed(rng):
    found = [*dense(rng)[:60], *sparse(rng)[:60]]
    rng.shuffle(found)
    return found


@pytest.mark.parametrize("kind", [dense, sparse, mixed])
def test_founders_equal_the_sequence(spark, monkeypatch, kind):
    monkeypatch.setattr(resolve, "SMALL", 8)
    monkeypatch.setattr(resolve, "GROWTH", 3)
    rng = random.Random(5)
    names = [(n, rng.choice([0.85, 0.9])) for n in dict.fromkeys(kind(rng))]
    aliases = {names[90][0]: names[3][0], names[50][0]: "nobody"}
    nodes = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(names)], "key string, threshold double, node long")
    pairs = spark.createDataFrame(list(aliases.items()), "key string, canonical_key string")
    got = {r["key"] for r in resolve.found(nodes, pairs).join(nodes, "node").select("key").collect()}
    assert got == in_sequence(names, aliases)


def test_no_names(spark):
    nodes = spark.createDataFrame([], "key string, threshold double, node long")
    assert resolve.found(nodes, spark.createDataFrame([], "key string, canonical_key string")).count() == 0


@pytest.mark.parametrize("one, two, threshold", [("a", "b", 0.85), ("", "b", 0.85), ("abcdefghijklm", "abcdefghijkl", 0.85), ("åäöåäöåäö", "åäöåäöåä", 0.85)])
def test_alike(one, two, threshold):
    want = bool(one and two) and 1.0 - distance(one, two) / max(len(one), len(two)) >= threshold
    assert resolve._alike(one, two, threshold) == want


@pytest.mark.parametrize("lots", [2, 100])
def test_founders_by_lots_and_by_join(spark, monkeypatch, lots):
    """Later names meet the founders of a first half in lots of four, or in a join where there are more than two lots."""
    for name, value in {"SMALL": 12, "GROWTH": 2, "LOT": 4, "LOTS": lots}.items():
        monkeypatch.setattr(resolve, name, value)
    names = [(n, 0.85) for n in list(dict.fromkeys(mixed(random.Random(8))))[:40]] + [("", 0.85), ("q" * 40, 0.85), ("q" * 36 + "abcd", 0.85)]
    nodes = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(names)], "key string, threshold double, node long")
    none = spark.createDataFrame([], "key string, canonical_key string")
    got = {r["key"] for r in resolve.found(nodes, none).join(nodes, "node").select("key").collect()}
    assert got == in_sequence(names, {})


def test_a_name_meets_founders_as_often_as_the_order_is_halved(spark, monkeypatch):
    """Not once for each stretch: 16 names that resemble none meet them three times at most."""
    met = []
    real = resolve._not_struck

    def counted(later, founders, aliases):
        met.append(later.count())
        return real(later, founders, aliases)

    monkeypatch.setattr(resolve, "_not_struck", counted)
    for name, value in {"SMALL": 2, "GROWTH": 1}.items():
        monkeypatch.setattr(resolve, name, value)
    nodes = spark.createDataFrame([(chr(97 + i % 26) * (3 + i // 26), 0.85, i) for i in range(16)], "key string, threshold double, node long")
    found = resolve.found(nodes, spark.createDataFrame([], "key string, canonical_key string"))
    assert found.count() == 16 and sum(met) <= 16 * 3
