"""Pairs within a radius: exact at all sizes, dealt over many tasks, and first places without all pairs."""

import math
import random

from roadlens.operators import joins as J
from roadlens.operators.joins import EARTH_MILES


def _miles(a, b):
    lat, lon, rlat, rlon = (math.radians(x) for x in (*a, *b))
    h = math.sin((rlat - lat) / 2) ** 2 + math.cos(lat) * math.cos(rlat) * math.sin((rlon - lon) / 2) ** 2
    return EARTH_MILES * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _places(spark, n, m):
    rng = random.Random(4)
    some = lambda k: [(i, rng.uniform(50, 53) if i % 4 else rng.uniform(-90, 90), rng.uniform(178, 182)) for i in range(k)]
    wrap = lambda rows: [(i, lat, lon - 360 if lon > 180 else lon) for i, lat, lon in rows]
    left, right = wrap(some(n)), wrap(some(m))
    garages = spark.createDataFrame(right, "rid long, rlat double, rlon double").selectExpr("*", "rid % 3 as kind")
    return left, right, spark.createDataFrame(left, "id long, lat double, lon double"), garages


def test_pairs_are_dealt_over_many_tasks_and_exact(spark):
    left, right, leads, garages = _places(spark, 400, 300)
    for miles in (5, 60, 900):
        pairs = J.within_radius(leads, garages, miles)
        want = {(i, j) for i, *a in left for j, *b in right if _miles(a, b) <= miles}
        assert {(r.id, r.rid) for r in pairs.collect()} == want and want
    assert pairs.rdd.getNumPartitions() >= 16  # inputs of a few KB


def test_first_places_equal_those_of_all_pairs_and_need_few(spark, monkeypatch):
    left, right, leads, garages = _places(spark, 200, 1500)
    made, whole = [], J.within_radius
    monkeypatch.setattr(J, "within_radius", lambda a, b, miles: made.append(whole(a, b, miles)) or made[-1])
    got = {(r.id, r.rid): r.place for r in J.nearest_within(leads, garages, 60, 3, "kind").collect()}
    want = {}
    for i, *a in left:
        near = sorted((j % 3, _miles(a, b), j) for j, *b in right if _miles(a, b) <= 60)
        want |= {(i, j): place + 1 for place, (_, _, j) in enumerate(near[:3])}
    assert got == want
    assert sum(df.count() for df in made) * 4 < whole(leads, garages, 60).count()
