"""Matching, founding, slugs and ranks against brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import sequential
from venuemill import schemas
from venuemill.functions import text
from venuemill.operators import fuzzy, ranking, resolve, slugs

WORDS = ["krogen", "pizza", "sushi", "hot", "old", "stora", "lilla", "ringen", "bolt", "aster", "harald", "backen"]


def typo(rng, s):
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
        at = rng.randrange(len(s) + 1)
        kind = rng.choice("idr")
        if kind == "i":
            s = s[:at] + rng.choice("abcdeå") + s[at:]
        elif kind == "d":
            s = s[:at] + s[at + 1:]
        elif at < len(s):
            s = s[:at] + rng.choice("abcdeå") + s[at + 1:]
    return " ".join(s.split())


def names(rng, n):
    return [typo(rng, " ".join(rng.sample(WORDS, rng.choice([1, 2, 2, 3, 4])))) for _ in range(n)]


@pytest.mark.parametrize("threshold,seed", [(0.85, 16), (0.85, 1), (0.90, 1), (0.6, 3)])
def test_similarity_join_is_lossless(spark, threshold, seed):
    rng = random.Random(seed)
    left = sorted(set(names(rng, 220) + ["pizza " + w for w in WORDS] + ["aa", "ab", "a", "abcdef", "abcdeg"]))
    right = sorted(set(names(rng, 220) + left[::2]))
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks + ks[:9]], "key string")
    got = fuzzy.similar_name_keys(frame(left), frame(right), threshold).collect()
    want = {(a, b): sequential.ratio(a, b) for a in left for b in right if a and b and a != b}
    want = {k: v for k, v in want.items() if v >= threshold}
    assert {(r.left_key, r.right_key): r.name_similarity for r in got} == want
    assert len(want) > 20


def test_similarity_join_compares_no_cross_product(spark):
    keys = spark.createDataFrame([(w,) for w in WORDS], "key string")
    plan = fuzzy.similar_name_keys(keys, keys)._jdf.queryExecution().optimizedPlan().toString()
    physical = fuzzy.similar_name_keys(keys, keys)._jdf.queryExecution().sparkPlan().toString()
    assert "Cross" not in plan and "NestedLoop" not in physical and "Cartesian" not in physical


def mentions_frame(spark, rows):
    ratings = {p[1]: p for p in __import__("venuemill.fixed_values", fromlist=["x"]).SOURCE_PASSES}
    data = [
        (f"a{i}", r["source"], f"u{i}", r["name"], r["city"], r["address"], r.get("content", "review"), r.get("score"), i)
        for i, r in enumerate(rows)
    ]
    assert all(r["source"] in ratings for r in rows)
    df = spark.createDataFrame(data, "id string, source_id string, url string, venue_name string, venue_city string, venue_address string, content_type string, score double, pos long")
    given = {f.name: (F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.ARTICLE.fields}
    return df.select(*given.values(), "pos")


@pytest.mark.parametrize("seed", range(3))
def test_resolve_equals_sequential(spark, seed):
    rng = random.Random(seed)
    pool = names(rng, 25)
    sources = ["whiteguide-review", "krogguiden", "michelin", "di", "dn-review", "svd-review", "falstaff", "thatsup"]
    rows = []
    for _ in range(110):
        base = rng.choice(pool)
        rows.append({
            "source": rng.choice(sources), "name": typo(rng, base) or "x", "city": rng.choice([None, "", "Lund", "lund", "Malmö"]),
            "address": rng.choice([None, "", "Storgatan 1", "Storgatan 2", "Stora gatan 1 b"]), "content": rng.choice(["review"] * 6 + ["listing", "news"]),
        })
    known = [(pool[0], pool[1], 1), (pool[2], pool[3], 2), (pool[4], "nowhere", 3), (pool[5], pool[1], 4)]
    aliases = resolve.alias_keys(spark.createDataFrame(known, "canonical_name string, alias string, pos int"))
    mentions = resolve.articles_to_mentions(mentions_frame(spark, rows))
    got = {tuple(r["ord"]): tuple(r.venue_ord) for r in resolve.resolve(mentions, aliases).select("ord", "venue_ord").collect()}

    place = F.when(F.coalesce(F.col("address") != "", F.lit(False)), text.street_number(F.col("address")))
    plain = [
        {"ord": tuple(r["ord"]), "key": r.key, "city": r.match_city, "threshold": r.threshold, "can_found": r.can_found, "place": tuple(r.place) if r.place else None}
        for r in mentions.select("*", place.alias("place")).collect()
    ]
    alias_map = {r.key: r.canonical_key for r in aliases.collect()}
    assert got == sequential.resolve(plain, alias_map)
    assert 5 < len(set(got.values())) < len(got)


def test_thresholds_and_founding_rules(spark):
    base = {"name": "abc", "city": None, "address": None}
    rows = [{**base, "source": s, "address": a} for s in ("whiteguide-review", "krogguiden", "svd-review") for a in (None, "Gatan 1")]
    got = resolve.articles_to_mentions(mentions_frame(spark, rows)).orderBy("article_id").collect()
    assert [(r.threshold, r.can_found) for r in got] == [(0.85, True), (0.85, True), (0.9, False), (0.85, True), (0.9, False), (0.9, True)]


@pytest.mark.parametrize("seed", range(4))
def test_slugs_equal_sequential(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice(["Ås", "Ås-2", "Bö & Co"]), rng.choice(["", "2", "3", "2 2", "10", "Lund", "1", "02"])) for _ in range(60)]
    df = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(pairs)], "venue_ord int, name string, city string")
    bases = [r.s for r in df.select(text.slugify(F.concat_ws(" ", "name", F.when(F.col("city") == "", "x").otherwise(F.col("city")))).alias("s"), "venue_ord").orderBy("venue_ord").collect()]
    got = slugs.unique_slugs(df, default_city="x").orderBy("venue_ord").collect()
    assert [r.id for r in got] == sequential.slugs(bases)


def test_row_numbers_of_large_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaaaaab"), rng.choice([None, "n", "n", "m"]), rng.choice([70.0, 70.0, 70.0, float(i % 50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "idx int, g string, h string, raw double").repartition(7)
    order = [F.desc("raw"), F.asc("idx")]
    for groups in (["g", "h"], ["g"], []):
        window = Window.partitionBy(*groups).orderBy(*order)
        want = {r.idx: (r.n, r.s) for r in df.select("idx", F.row_number().over(window).alias("n"), F.sum("idx").over(window).alias("s")).collect()}
        numbers = {r.idx: r.n for r in ranking.row_number_in_groups(df, groups, order, "n").collect()}
        sums = {r.idx: r.s for r in ranking.running_sum_in_groups(df, groups, order, F.col("idx"), "s").collect()}
        assert {i: (numbers[i], sums[i]) for i in numbers} == want and len(want) == 400


def test_ranks(spark):
    rows = [
        (0, "bar", "malmo", 50, 50.0), (1, "bar", "malmo", 50, 50.0), (2, "bar", "sweden", 90, 90.4), (3, "bar", "stockholm", 0, 0.0),
        (4, "exclude", "malmo", 99, 99.0), (5, "hotel", "gothenburg", 10, 10.0), (6, None, "malmo", 10, 10.0),
    ]
    df = spark.createDataFrame(rows, "idx int, category string, metro_region string, composite_score int, composite_score_raw double")
    got = {r.idx: (r.rank_national, r.rank_region) for r in ranking.assign_ranks(df).collect()}
    assert got == {0: (2, 1), 1: (3, 2), 2: (1, None), 3: (0, None), 4: (0, None), 5: (1, 1), 6: (0, None)}


def test_multi_hit_prefers_city_then_first(spark):
    venues = spark.createDataFrame([(1, "k", "Lund"), (2, "k", "Malmö"), (3, "other", None)], "venue_ord int, key string, city string")
    rows = spark.createDataFrame([(1, "k", "MALMÖ"), (2, "k", "x"), (3, "k", None), (4, "al", "malmö"), (5, "none", None)], "row_id int, key string, city string")
    aliases = spark.createDataFrame([("al", "k")], "key string, canonical_key string")
    pick = lambda prefer: {r.row_id: (r.venue_ord, r.match_kind) for r in resolve.exact_match(rows, venues, aliases, prefer).collect()}
    assert pick(True) == {1: (2, "exact"), 2: (1, "exact"), 3: (1, "exact"), 4: (2, "alias"), 5: (None, None)}
    assert pick(False)[1] == (1, "exact") and pick(False)[4] == (1, "alias")
