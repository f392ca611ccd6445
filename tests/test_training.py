"""The training table: point-in-time histories, rates of the training span, no sight of later or own outcomes."""

import datetime

import pytest
from pyspark.sql import functions as F

from roadlens.operators import features as FE
from roadlens.operators import training as TR
from roadlens.plans.base import Tables
from roadlens.plans.flows import flat_tests

CUT = "2024-01-20"


@pytest.fixture(scope="module")
def tests(spark, folder):
    return flat_tests(Tables(spark, folder)).cache()


@pytest.fixture(scope="module")
def table(tests):
    return {(r.vehicle_id, r.test_id): r.asDict() for r in TR.training_table(tests, CUT).collect()}


def test_histories_end_the_day_before(spark, tests):
    rows = TR.point_in_time(tests).select("vehicle_id", "test_id", "test_date", F.transform("tests", lambda t: t["test_date"]).alias("seen")).collect()
    dates = {}
    for r in rows:
        dates.setdefault(r.vehicle_id, []).append(r.test_date)
    for r in rows:
        assert sorted(r.seen) == sorted(d for d in dates[r.vehicle_id] if d < r.test_date)


def test_features_are_those_of_the_history_known_then(spark, tests, table):
    fitted = {n for n in FE.FEATURE_NAMES if any(w in n for w in ("rate_smoothed", "fail_rate", "unified", "cohort", "corrosion_", "station", "profile", "normalized"))}
    fitted -= {"prior_fail_rate_smoothed", "has_corrosion_history", "text_corrosion_index", "text_corrosion_index_log"}
    nested = TR.point_in_time(tests)
    for day in (datetime.date(2024, 1, 9), datetime.date(2024, 1, 25)):
        own = FE.history_features(nested.where(F.col("test_date") == F.lit(day)), str(day), None, ("vehicle_id", "test_id")).collect()
        assert own
        for r in own:
            for name in set(FE.FEATURE_NAMES) - fitted:
                assert table[r.vehicle_id, r.test_id][name] == r[name], name


def test_rates_come_from_the_training_span(table):
    dev = [r for r in table.values() if r["part"] == "dev"]
    assert all((r["test_date"] < datetime.date(2024, 1, 20)) == (r["part"] == "dev") for r in table.values()) and len(dev) < len(table)
    overall = sum(r["target"] for r in dev) / len(dev)
    for make in {r["make"] for r in dev}:
        own = [r["target"] for r in dev if r["make"] == make]
        want = (sum(own) + TR.K_MAKE * overall) / (len(own) + TR.K_MAKE)
        assert all(r["make_fail_rate_smoothed"] == pytest.approx(want) for r in table.values() if r["make"] == make)


def test_later_outcomes_change_nothing_and_own_ones_not_the_prior(spark, tests, table):
    flipped = F.when(F.col("test_date") >= F.lit(CUT).cast("date"), 1 - F.col("target")).otherwise(F.col("target"))
    later = TR.training_table(tests.withColumn("target", flipped), CUT).collect()
    for r in later:
        assert {n: r[n] for n in FE.FEATURE_NAMES} == pytest.approx({n: table[r.vehicle_id, r.test_id][n] for n in FE.FEATURE_NAMES})
    one = next(r for r in table.values() if r["part"] == "dev")
    here = F.col("vehicle_id") == one["vehicle_id"]
    own = TR.training_table(tests.withColumn("target", F.when(here, 1 - F.col("target")).otherwise(F.col("target"))), CUT).where(here & (F.col("part") == "dev")).collect()
    for r in own:  # the overall rate is the other folds' own too
        assert r.eb_unified_prior == pytest.approx(table[r.vehicle_id, r.test_id]["eb_unified_prior"])


def test_odd_tables(spark, tests):
    assert TR.training_table(tests.limit(0), CUT).count() == 0
    all_late = TR.training_table(tests, "2000-01-01").where("part = 'dev' OR make_fail_rate_smoothed <> 0")
    assert all_late.count() == 0
    assert TR.training_table(tests, CUT, veterans_only=True).where("n_prior_tests = 0").count() == 0
