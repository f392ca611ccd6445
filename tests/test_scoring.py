"""Ensembles, calibration, batch scores and importances on data with a known answer."""

import math

import pytest
from pyspark.sql import functions as F

from roadlens.operators import metrics as M
from roadlens.operators import scoring as S


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.range(3000).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0).alias("noise"),
        F.when(F.col("id") % 3 == 0, "red").otherwise("blue").alias("kind"),
    )
    chance = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000.0
    rows = rows.withColumn("label", (chance < 0.1 + 0.6 * F.col("x") + F.when(F.col("kind") == "red", 0.2).otherwise(0.0)).cast("double"))
    rows = rows.withColumns({"weight": F.lit(1.0), "holdout": F.col("id") % 5 == 0})
    prepared = S.matrix(["kind"], ["x", "noise"]).fit(rows)
    ready = prepared.transform(rows)
    return rows, prepared, ready, S.fit_ensemble(ready, "label", "weight", "holdout", [1, 2, 3], 8, 32)


def test_mean_of_seeds_ranks_better_than_chance(fitted):
    _, _, ready, models = fitted
    scored = S.mean_probability(ready, models)
    assert scored.where("raw < 0 or raw > 1").count() == 0
    assert M.auc(scored, "raw", "label").first().auc > 0.68
    own = [S.mean_probability(ready, [m]).select("id", "raw") for m in models]
    joined = scored.select("id", "raw").join(
        own[0].withColumnRenamed("raw", "a"), "id"
    ).join(own[1].withColumnRenamed("raw", "b"), "id").join(own[2].withColumnRenamed("raw", "c"), "id")
    assert joined.where("abs(raw - (a + b + c) / 3) > 1e-12").count() == 0


def test_platt_fit_calibrates(fitted):
    _, _, ready, models = fitted
    scored = S.mean_probability(ready, models)
    a, b = S.fit_platt(scored, "raw", "label")
    means = scored.agg(F.avg(1 / (1 + F.exp(-(a * F.col("raw") + b)))).alias("p"), F.avg("label").alias("y")).first()
    assert a > 0 and means.p == pytest.approx(means.y, abs=0.01)


def test_batch_scores_and_unknown_categories(spark, fitted):
    _, prepared, _, models = fitted
    asked = spark.createDataFrame([(1, "green", 0.5, 0.5), (2, "red", 0.9, 0.1)], "id int, kind string, x double, noise double")
    for r in S.score(asked, prepared, models, 2.0, -1.0).collect():
        assert r.calibrated == pytest.approx(1 / (1 + math.exp(-(2 * r.raw - 1))), abs=5e-5)


def test_importances_name_the_cause(spark, fitted):
    found = {r.feature: r for r in S.importances(fitted[3], ["kind", "x", "noise"], {"kind": "paint"}, spark).collect()}
    assert found["x"].place == 1 and found["kind"].part == "paint" and found["x"].part == "other"
    assert sum(r.importance for r in found.values()) == pytest.approx(1.0)
