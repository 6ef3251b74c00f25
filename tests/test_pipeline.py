"""Consolidation, dedup, enrichment and the whole chain."""

import random

import pytest
from pyspark.sql import functions as F

import sequential
from venuemill import schemas
from venuemill.operators import consolidate, dedup, enrich, resolve, serve, stats
from venuemill.plans import pipeline

SOURCES = ["whiteguide-review", "krogguiden", "michelin", "di", "dn-review", "svd-review", "falstaff", "thatsup"]
NAMES = ["Krogen", "Kroogen", "Pizza Hörnan", "Pizza Hornan Ett", "Sushi Palace", "Stora Hotellet", "Lilla Baren"]


def random_articles(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sub = None
        if rng.random() < 0.4:
            sub = [(rng.choice(NAMES + [""]), rng.choice([None, "Gatan 1"]), rng.choice([None, "Lund"]), rng.choice([None, 0.0, 3.0]), rng.choice([None, "lyx"]), None) for _ in range(2)]
        given = {
            "id": f"a{i}", "source_id": rng.choice(SOURCES), "url": f"u{i}", "published_at": rng.choice(["", "2020-01-01"]),
            "content_type": rng.choice(["review", "review", "listing"]), "body_text": rng.choice(["", "short", " a text that is long enough " + str(i)]),
            "venue_type": rng.choice([None, "restaurant", "bar", "hotel", "cafe"]), "venue_name": rng.choice(NAMES + [""]), "venue_address": rng.choice([None, "", "Gatan 1", "Gatan 2"]),
            "venue_city": rng.choice([None, "", "Lund", "Visby"]), "score": rng.choice([None, 0.0, 4.0, 5.0]), "sub_articles": sub, "price_range": rng.choice([None, "", "budget"]),
            "tags": rng.choice([None, [], [f"t{i}"]]), "lat": rng.choice([None, 0.0, 59.0 + i]), "lng": rng.choice([None, 0.0, 18.0]),
        }
        rows.append(tuple(given.get(f.name) for f in schemas.ARTICLE.fields) + (i,))
    return spark.createDataFrame(rows, _with_pos())


def _with_pos():
    from pyspark.sql import types as T

    return T.StructType([*schemas.ARTICLE.fields, T.StructField("pos", T.LongType())])


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_sequential(spark, seed):
    mentions = resolve.articles_to_mentions(random_articles(spark, seed, 70)).cache()
    resolved = resolve.resolve(mentions)
    plain = [{**r.asDict(), "ord": tuple(r["ord"]), "source": r.source_id} for r in mentions.collect()]
    founder_of = {tuple(r["ord"]): tuple(r.venue_ord) for r in resolved.select("ord", "venue_ord").collect()}
    want = sequential.merge(plain, founder_of)
    got = {tuple(r.venue_ord): r for r in consolidate.consolidate(resolved).collect()}
    assert set(got) == set(want)
    for at, w in want.items():
        g = got[at]
        assert (g.address, g.city, g.venue_type, g.lat, g.lng, g.price_range) == (w["address"], w["city"], w["type"], w["lat"], w["lng"], w["price"])
        assert g["name"] == sequential.best_name(w)
        assert [(s.source_id, s.url) for s in g.sources] == list(w["sources"].items()) and g.source_count == len(w["sources"])
        assert [(q.source_id, q.text) for q in g.quotes] == list(w["quotes"].items())
        ratings = {k: g.ratings[k].score for k in sequential.NUMERIC if g.ratings[k]}
        if g.ratings.whiteguide:
            ratings["whiteguide"] = g.ratings.whiteguide.classification
        if g.ratings.michelin:
            ratings["michelin"] = g.ratings.michelin.distinction
        assert ratings == w["ratings"]


def test_whole_chain(spark):
    venues = pipeline.merge(random_articles(spark, 9, 60)).cache()
    ids = [r.id for r in venues.select("id").collect()]
    assert len(set(ids)) == len(ids) > 3
    ok = "Gatan 1, 111 22 Borås, Sverige"
    places = []
    for i, vid in enumerate(sorted(ids)):
        places.append((vid, "first", 1, f"p{i // 2}", ok, "bar" if i % 2 else "restaurant", None if i % 3 else "OPERATIONAL", 4.5, 80, 59.3, 18.0))
    schema = "venue_id string, attempt string, position int, place_id string, formatted_address string, primary_type string, business_status string, rating double, rating_count int, lat double, lng double"
    cols = {f.name for f in schemas.PLACE.fields}
    frame = spark.createDataFrame(places, schema)
    frame = frame.select("*", *[F.lit(None).cast(schemas.PLACE[c].dataType).alias(c) for c in cols - set(frame.columns)])
    refined, aliases, rejected = pipeline.refine(venues, frame)
    refined = refined.cache()
    assert refined.count() == (len(ids) + 1) // 2 and aliases.count() == len(ids) // 2 and rejected.count() == 0
    scored = pipeline.score(refined, F.lit("2025-01-01").cast("timestamp")).cache()
    for row in scored.groupBy("category").agg(F.sort_array(F.collect_list("rank_national")).alias("r"), F.count_if(F.col("composite_score") > 0).alias("n")).collect():
        assert [x for x in row.r if x > 0] == list(range(1, row.n + 1))
    serving = pipeline.serve_table(scored)
    assert serving.count() == scored.count() and serving.where("links['google'] is not null").count() == 0
    assert pipeline.recategorize(refined).where("category <> 'exclude'").count() == refined.count()
    assert stats.merge_stats(venues).first().venues == len(ids)
    assert serve.located(serving).count() == serving.count()


def test_enrichment_retry_and_country(spark):
    base = pipeline.with_place_columns(spark.createDataFrame([(i, str(i), "", None, None) for i in range(6)], "idx int, id string, city string, lat double, lng double"))
    ok = "G 1, 111 22 Borås, Sverige"
    rows = [
        ("0", "first", 2, "late", "bar", ok, 59.0, 18.0), ("0", "first", 1, "early", "bar", ok, 59.0, 18.0),
        ("1", "first", 1, "museum", "museum", ok, 59.0, 18.0), ("1", "retry", 1, "bar", "bar", ok, 59.0, 18.0),
        ("2", "first", 1, "museum", "museum", ok, 59.0, 18.0), ("2", "retry", 1, "shop", "shop", ok, 59.0, 18.0),
        ("3", "retry", 1, "bar", "bar", ok, 59.0, 18.0),  # nothing found first: no retry
        ("4", "first", 1, "abroad", "bar", "Gade, København", 55.6, 12.5), ("5", "first", 1, "nowhere", "bar", ok, None, None),
    ]
    places = spark.createDataFrame(rows, "venue_id string, attempt string, position int, place_id string, primary_type string, formatted_address string, lat double, lng double")
    cols = [f for f in schemas.PLACE.fields if f.name not in places.columns]
    places = places.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in cols])
    got = {r.id: (r.enriched, r.place_id, r.city) for r in enrich.enrich(base, places).collect()}
    assert got == {"0": (True, "early", "Borås"), "1": (True, "bar", "Borås"), "2": (True, "museum", "Borås"), "3": (False, None, ""), "4": (False, None, ""), "5": (False, None, "")}


def test_dedup_leaves_one_row_per_place(spark):
    rows = [(i, f"n{i}", "p" if i < 4 else None, 2 if i == 2 else 1, f"addr{i}" if i in (0, 3) else "") for i in range(6)]
    df = spark.createDataFrame(rows, "idx int, name string, place_id string, source_count int, address string")
    source = F.array(F.struct(F.concat(F.lit("s"), (F.col("idx") % 2).cast("string")).alias("source_id"), F.lit("u").alias("url")))
    df = df.select("*", F.lit(None).cast("string").alias("city"), F.lit("").alias("price_range"), F.lit(None).cast(schemas.RATINGS).alias("ratings"), source.alias("sources"), source.alias("quotes"))
    df = df.withColumn("ratings", F.struct(*[F.when((F.col("idx") == 3) & F.lit(k == "svd"), F.struct(*[F.lit(1).cast(f.dataType).alias(f.name) if f.name == "score" else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.NUMERIC_RATING.fields])).alias(k) if k in sequential.NUMERIC else F.lit(None).cast(schemas.RATINGS[k].dataType).alias(k) for k in schemas.RATINGS.fieldNames()]))
    got = {r.idx: r for r in dedup.dedup_by_place(df).collect()}
    assert sorted(got) == [2, 4, 5]
    assert got[2].address == "addr0" and got[2].source_count == 2 and got[2].ratings.svd.score == 1.0 and [s.source_id for s in got[2].sources] == ["s0", "s1"]
    assert sorted(r.alias for r in dedup.known_merges(df).collect()) == ["n0", "n1", "n3"]


def test_cleanup_order(spark):
    df = spark.createDataFrame([
        ("a", None, 48.0, 2.0, "X", "CLOSED_PERMANENTLY"), ("b", "p", 48.0, 2.0, "", "CLOSED_PERMANENTLY"), ("c", "p", 59.0, 18.0, "X", "CLOSED_TEMPORARILY"), ("d", "p", 0.0, 18.0, None, None), ("e", "p", 59.0, 18.0, "Oslo", None),
    ], "name string, place_id string, lat double, lng double, city string, business_status string")
    kept, rejected = enrich.cleanup(df)
    assert [r.name for r in kept.collect()] == ["d"]
    assert {r.name: r.reason for r in rejected.collect()} == {"a": "no place data", "b": "not in country (unknown)", "c": "closed temporarily", "e": "not in country (Oslo)"}
    assert sorted(r.name for r in enrich.cleanup(df, keep_unplaced=True)[0].collect()) == ["a", "d"]
