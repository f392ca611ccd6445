"""Feature contracts, the persisted scorer, importances by group and the audit of component risks."""

import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from roadlens.operators import metrics as M
from roadlens.operators import relational as O
from roadlens.operators import scorer as SC
from roadlens.operators import scoring as S
from roadlens.operators.contracts import Contract, Feature, read_matrix, write_matrix


def test_contract_rules():
    ok = (Feature("a", "float"), Feature("b", "categorical", "UNKNOWN"), Feature("n_observed", "int", window_bounded=True))
    contract = Contract("v1", ok, "2019-01-01", ("gone",))
    assert Contract.from_json(contract.to_json()) == contract and contract.categories == ["b"]
    for features, window, dropped in (
        (ok + (Feature("a", "int"),), "2019-01-01", ()),
        ((Feature("a", "text"),), None, ()),
        (ok, None, ()),
        (ok, "2019-01-01", ("b",)),
    ):
        with pytest.raises(ValueError, match="feature"):
            Contract("v1", features, window, dropped)


def test_gate_and_selection(spark):
    contract = Contract("v1", (Feature("a", "float"), Feature("b", "categorical", "UNKNOWN")))
    good = spark.createDataFrame([(1, 0.5, None)], "id int, a double, b string")
    contract.check(good, ["id"])
    for bad, why in (
        (good.drop("b"), "missing"), (good.withColumn("c", F.lit(1)), "extra"), (good.select("id", "b", "a"), "misplaced"),
        (good.withColumn("a", F.col("a").cast("string")), "not float"),
    ):
        with pytest.raises(ValueError, match=why):
            contract.check(bad, ["id"])
    assert contract.select(good.select("b", "id", "a"), ["id"]).first() == (1, 0.5, "UNKNOWN")
    late = Contract("v2", (Feature("a", "float", prediction_time_available=False),))
    with pytest.raises(ValueError, match="prediction"):
        late.select(good)
    assert late.select(good, at_prediction=False).columns == ["a"]


def test_strict_selection(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert O.select_contract(rows, ["a", "b"], extra=["c"]).columns == ["a", "b"]
    for names, extra in ((["a", "b"], []), (["b", "a", "c"], []), (["a", "b", "c", "d"], [])):
        with pytest.raises(ValueError, match="contract"):
            O.select_contract(rows, names, extra)


def test_matrix_and_contract_stay_together(spark, tmp_path):
    rows = spark.createDataFrame([(2020, 1, 0.5, "x"), (2021, 0, 1.5, "y")], "year int, y int, a double, b string")
    contract = Contract.of(rows.select("a", "b"), "v3")
    write_matrix(rows, contract, ["year", "y"], f"{tmp_path}/m", "year")
    read, loaded = read_matrix(spark, f"{tmp_path}/m", ["year", "y"])
    assert loaded == contract and sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError, match="missing"):
        write_matrix(rows.drop("a"), contract, ["year", "y"], f"{tmp_path}/n", "year")


@pytest.fixture(scope="module")
def parts(spark):
    rows = spark.range(1500).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x"), F.when(F.col("id") % 3 == 0, "red").otherwise("blue").alias("kind"),
    )
    chance = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000.0
    rows = rows.withColumn("label", (chance < 0.1 + 0.6 * F.col("x") + F.when(F.col("kind") == "red", 0.2).otherwise(0.0)).cast("double"))
    rows = rows.withColumns({"weight": F.lit(1.0), "holdout": F.col("id") % 5 == 0}).cache()
    prepared = S.matrix(["kind"], ["x"]).fit(rows)
    return rows, prepared, S.fit_ensemble(prepared.transform(rows), "label", "weight", "holdout", [1, 2], 4, 32)


def test_saved_scorer_gives_the_same_scores(spark, tmp_path, parts):
    rows, prepared, models = parts
    asked = rows.select("id", "kind", "x").withColumn("kind", F.when(F.col("kind") == "red", "ROT").otherwise(F.col("kind")))
    contract = Contract.of(asked.select("kind", "x"), "v1")
    scorer = SC.build_scorer(contract, ["id"], {"kind": {"ROT": "red"}}, prepared, models, 2.0, -1.0)
    scorer.write().save(f"{tmp_path}/scorer")
    loaded = PipelineModel.load(f"{tmp_path}/scorer")
    got = {r.id: (r.raw, r.calibrated) for r in loaded.transform(asked).collect()}
    assert got == {r.id: (r.raw, r.calibrated) for r in scorer.transform(asked).collect()}
    want = {r.id: (r.raw, r.calibrated) for r in S.score(rows.select("id", "kind", "x"), prepared, models, 2.0, -1.0).collect()}
    assert all(got[i] == pytest.approx(want[i]) for i in want)
    assert not [c for c in loaded.transform(asked).columns if c.startswith(("_p", "_r", "_y"))]
    for bad in (asked.drop("x"), asked.select("id", "x", "kind"), asked.withColumn("more", F.lit(1))):
        with pytest.raises(ValueError, match="contract v1"):
            loaded.transform(bad)
    twice = SC.VocabularyRemap(vocabulary=json.dumps({"kind": {"ROT": "red"}}))
    assert twice.transform(twice.transform(asked)).select("kind").distinct().count() == 2


def test_importances_by_group(spark, parts):
    found = S.importances(parts[2], ["kind", "x"], {"kind": "paint"}, spark)
    groups = {r.part: r for r in S.group_importances(found).collect()}
    assert groups["other"].place == 1 and groups["paint"].features == 1
    assert sum(r.share for r in groups.values()) == pytest.approx(1) and S.top_importances(found, 1).first().feature == "x"


def test_falls_of_components_are_listed(spark):
    cells = [("m", "new", 200, 0.10, 0.05), ("m", "mid", 150, 0.20, 0.04), ("m", "old", 90, 0.15, 0.06), ("k", "new", 10, 0.1, 0.1), ("m", "odd", 9, 0.0, 0.0)]
    cube = spark.createDataFrame(cells, "model string, age string, n int, risk double, risk_b double")
    found = M.fall_list(cube, "age", ["new", "mid", "old"], {"all": "risk", "b": "risk_b"}, "model").collect()
    got = {(r.component, r.scope, r.lower_band, r.higher_band): (round(r.fall_pct, 6), r.hard) for r in found}
    assert got == {("all", "m", "mid", "old"): (25.0, False), ("b", "m", "new", "mid"): (20.0, True)}
