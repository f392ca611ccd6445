"""Ranks inside skewed keys, shares at a cut score and nearest values, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.operators import joins as J
from roadlens.operators import metrics as M


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(8)
    rows = [("hot" if i % 2 else f"k{i % 97}", float(np.round(rng.normal(), 2)), i, int(rng.random() < 0.3)) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "key string, v double, id long, y int").repartition(6)


@pytest.mark.parametrize("one_task", [M.ONE_TASK, 500])
def test_percent_ranks_of_a_hot_key(spark, skewed, monkeypatch, one_task):
    monkeypatch.setattr(M, "ONE_TASK", one_task)
    rows, frame = skewed
    got = {r.id: r.p for r in M.percent_ranks(frame, "v", ["key"], "p").collect()}
    values = {}
    for key, v, _, _ in rows:
        values.setdefault(key, []).append(v)
    for own in values.values():
        own.sort()
    for key, v, i, _ in rows:
        own = values[key]
        assert got[i] == pytest.approx(np.searchsorted(own, v) / (len(own) - 1) if len(own) > 1 else 0.0)


def test_a_hot_key_spreads_over_all_ranges(spark, skewed, monkeypatch):
    monkeypatch.setattr(M, "ONE_TASK", 500)
    rows, frame = skewed
    slotted = M.with_keyed_slots(frame, "v", ["key"], 32)
    sizes = {(r.key, r._slot): r["count"] for r in slotted.groupBy("key", "_slot").count().collect()}
    hot = [n for (key, _), n in sizes.items() if key == "hot"]
    assert len(hot) == 32 and max(hot) < 3000 / 32 * 3 and {slot for key, slot in sizes if key != "hot"} == {0}
    ends = slotted.where("key = 'hot'").groupBy("_slot").agg(F.min("v"), F.max("v")).orderBy("_slot").collect()
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:], strict=False))  # ranges don't overlap


@pytest.mark.parametrize("one_task", [M.ONE_TASK, 20])
def test_auc_by_key(spark, skewed, monkeypatch, one_task):
    monkeypatch.setattr(M, "ONE_TASK", one_task)
    rows, frame = skewed
    got = {r.key: r.auc for r in M.auc(frame, "v", "y", ["key"]).collect()}
    for key in ("hot", "k4", "k10"):
        p, q = ([v for k, v, _, y in rows if k == key and y == label] for label in (1, 0))
        want = np.mean([(a > b) + 0.5 * (a == b) for a in p for b in q]) if p and q else None
        assert got[key] == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("values", [3, 1000])
def test_lift_of_the_top_share(spark, values):
    rng = np.random.default_rng(values)
    rows = [(i, int(rng.integers(values)), int(rng.random() < 0.2)) for i in range(1003)] + [(2000, values, 1)] * 3
    got = M.top_share_lift(spark.createDataFrame(rows, "id long, s long, y int"), "s", "y", "id").first()
    top = sorted(rows, key=lambda r: (-r[1], r[0]))[: len(rows) // 10]
    assert got.n == len(top) and got.lift == pytest.approx(np.mean([r[2] for r in top]) / np.mean([r[2] for r in rows]), abs=1e-6)
    assert M.top_share_lift(spark.createDataFrame([], "id long, s long, y int"), "s", "y", "id").first().lift is None


def plain_nearest(rows, k):
    out = {}
    for e, g, v in rows:
        best = {}
        for other, og, ov in rows:
            if og != g:
                best[og] = min(best.get(og, (9e9, "")), (round(abs(v - ov), 9), other))
        out[e] = [(i + 1, og, other, gap) for i, (gap, og, other) in enumerate(sorted((gap, og, other) for og, (gap, other) in best.items())[:k])]
    return out


@pytest.mark.parametrize("slots", [1, 7])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_values_equal_brute_force(spark, monkeypatch, slots, k):
    """Ties, equal values in many groups, and few values; ranges hand on what later ones need."""
    monkeypatch.setattr(J, "with_slots", lambda rows, order: M.with_slots(rows, order, slots))
    rng = np.random.default_rng(slots)
    rows = [(f"e{i:03d}", f"g{rng.integers(12)}", float(np.round(rng.normal(), 1 + i % 3))) for i in range(160)] + [(f"f{i}", f"g{i}", 0.5) for i in range(12)]
    found = J.nearest_values(spark.createDataFrame(rows, "e string, g string, v double"), "e", "g", "v", k)
    got = {}
    for r in found.collect():
        got.setdefault(r.e, []).append((r.place, r.g, r.similar, r.gap))
    want = plain_nearest(rows, k)
    for e in want:
        assert [x[:2] + x[3:] for x in sorted(got[e])] == [x[:2] + x[3:] for x in want[e]], e
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_values_of_few_rows(spark):
    schema = "e string, g string, v double"
    assert J.nearest_values(spark.createDataFrame([], schema), "e", "g", "v", 3).count() == 0
    assert J.nearest_values(spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", None)], schema), "e", "g", "v", 3).count() == 0
