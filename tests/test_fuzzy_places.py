"""The best venue among many of one name: the choice, and how many rows a join gives for it."""

import random

import pytest
import sequential
from pyspark.sql import functions as F

from venuemill.operators import fuzzy

NAMES = ["pizza krogen", "pizza krogan", "pizzakrogen", "stora bolten", "stora bolte"]
ROWS, VENUES = "row_id long, key string, address string, city string, threshold double", "venue_ord long, key string, address string, city string"


def joined_rows(spark, first):
    """The most rows that a join of the executions from ``first`` on gave."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions, most = store.executionsList(), 0
    for i in range(executions.size()):
        own = executions.apply(i).executionId()
        nodes = store.planGraph(own).allNodes() if own >= first else None
        values = store.executionMetrics(own) if own >= first else None
        for n in range(nodes.size() if nodes is not None else 0):
            node = nodes.apply(n)
            for m in range(node.metrics().size() if "Join" in node.name() else 0):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_join_does_not_grow_with_rows_times_venues(spark):
    n = 300
    rows = spark.createDataFrame([(i, "pizza krogen", f"Storgatan {i}", "Lund", 0.85) for i in range(1, n + 1)], ROWS)
    venues = spark.createDataFrame([(i, "pizza krogan", f"Storgatan {i}", ["Lund", "Malmö"][i % 2]) for i in range(1, n + 1)], VENUES)
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r.row_id: r.venue_ord for r in fuzzy.best_fuzzy_match(rows, venues).collect()}
    # the first venue in the city, unless one there has the number too
    assert got == {i: 2 if i % 2 else i for i in range(1, n + 1)}
    assert 0 < joined_rows(spark, before) <= 4 * n


@pytest.mark.parametrize("seed", range(2))
def test_best_place_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    place = lambda: rng.choice([None, "", "Storgatan 1", "Storgatan 2", "Storgatan", "Stora gatan 1", "Lilla torg 2", "5"])
    city = lambda: rng.choice([None, "", "Lund", "lund", "Malmö", "Åhus"])
    rows = [(i, rng.choice(NAMES), place(), city(), rng.choice([0.85, 0.9])) for i in range(150)]
    venues = [(i, rng.choice(NAMES), place(), city()) for i in range(120)]
    parts = F.when(F.col("address") != "", fuzzy.street_number(F.col("address")))
    parsed = {r.address: r.p for r in spark.createDataFrame(venues + [x[:4] for x in rows], VENUES).select("address", parts.alias("p")).distinct().collect()}

    def near(a, b):
        a, b = parsed[a], parsed[b]
        return 0.0 if a is None or b is None else sequential.ratio(a.street, b.street) * 0.7 + (1.0 if a.number == b.number else 0.0) * 0.3

    want = {}
    for row_id, key, address, town, threshold in rows:
        found = []
        for venue_ord, other, there, venue_town in venues:
            name = sequential.ratio(key, other)
            if key != other and name >= threshold:
                score = name * 0.8 + near(address, there) * 0.2
                found.append((not (town and venue_town and town.lower() == venue_town.lower()), int((2.0 - score) * 1e12), venue_ord))
        if found:
            want[row_id] = min(found)[2]
    got = {r.row_id: r.venue_ord for r in fuzzy.best_fuzzy_match(spark.createDataFrame(rows, ROWS), spark.createDataFrame(venues, VENUES)).collect()}
    assert got == want and len(want) > 50
