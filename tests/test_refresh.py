"""Versioned tables, encoders refreshed by batches, and fitted prior weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.operators import refresh as RF
from roadlens.operators.encoders import Encoder
from roadlens.sources import files as IO
from roadlens.sources.versions import ConflictError, VersionedTable


def test_a_write_that_fails_leaves_the_old_table(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(spark.range(10))
    bad = spark.range(1000).repartition(8).select(F.when(F.col("id") == 777, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        table.write(bad)
    assert table.versions() == [1] and table.read().count() == 10
    table.write(spark.range(20), note="again")
    assert table.read().count() == 20 and table.read(1).count() == 10 and table.commit_info(2)["note"] == "again"


def test_of_two_writers_one_commits(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    table.write(spark.range(1))
    table.write(spark.range(2), base=1)
    with pytest.raises(ConflictError):
        table.write(spark.range(3), base=1)
    assert table.versions() == [1, 2] and table.read().count() == 2


def test_readers_keep_their_version_until_it_is_vacuumed(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    for n in (1, 2, 3):
        table.write(spark.range(n))
    held = table.read(2)
    assert table.vacuum(keep=2) == [1] and held.count() == 2 and table.versions() == [2, 3]
    with pytest.raises(FileNotFoundError):
        table.read(1)


def test_full_refresh_is_partitioned(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 3).alias("p"), F.col("id").alias("s"))
    assert IO.full_refresh(rows, f"{tmp_path}/t", "p", "s") == 1
    read = VersionedTable(spark, f"{tmp_path}/t").read().where("p = 1")
    assert read.count() == 33 and "PartitionFilters: [isnotnull(p" in read._jdf.queryExecution().executedPlan().toString().replace("\n", " ")


def rows_of(spark, seed, n=2000):
    rng = np.random.default_rng(seed)
    made = [(f"m{rng.integers(3)}", f"x{rng.integers(9)}", int(rng.random() < 0.3), f"2024-{rng.integers(1, 13):02d}-15") for _ in range(n)]
    return spark.createDataFrame(made, "make string, model string, y int, day string").withColumn("day", F.to_date("day"))


def test_two_increments_are_one_fit_and_a_repeat_changes_nothing(spark, tmp_path):
    first, second = rows_of(spark, 1), rows_of(spark, 2)
    encoder = Encoder([["make"], ["make", "model"]], [10.0, 20.0])
    sums = RF.RunningSums(spark, f"{tmp_path}/sums", ["make", "model"])
    want = [sorted(map(tuple, t.collect())) for t in encoder.fit(first.unionByName(second), "y")]
    read = lambda *span: [sorted(map(tuple, t.collect())) for t in sums.fit(encoder, *span)]
    sums.upsert(first, "y", F.col("day"), 0)
    sums.upsert(second, "y", F.col("day"), 1)
    assert [[r[:-1] for r in t] for t in read()] == [[r[:-1] for r in t] for t in want]
    assert np.allclose([r[-1] for t in read() for r in t], [r[-1] for t in want for r in t])
    before = read()
    sums.upsert(second, "y", F.col("day"), 1)
    assert read() == before
    sums.merge_before(1)
    assert read() == before
    sums.upsert(first, "y", F.col("day"), 0)  # merged: it can't be counted twice
    assert read() == before and sums.table.read().where("batch = 0").count() == 0
    part = encoder.fit(first.unionByName(second).where("day BETWEEN date'2024-03-01' AND date'2024-05-31'"), "y")
    assert np.allclose([r[-1] for t in read("2024-03-01", "2024-05-01") for r in t], [r[-1] for t in part for r in sorted(map(tuple, t.collect()))])


def test_psi_functions(spark):
    xs = [0.001, 0.3, 1.0, 2.5, 40.0, 1e5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(RF.digamma(F.col("x")), RF.trigamma(F.col("x"))).collect()
    known = {1.0: (-0.5772156649015329, np.pi**2 / 6), 2.5: (0.7031566406452432, 0.4903577561002348)}
    for x, (a, b) in zip(xs, rows, strict=True):
        if x in known:
            assert a == pytest.approx(known[x][0], abs=1e-9) and b == pytest.approx(known[x][1], abs=1e-8)
        h = x * 1e-3
        up, down = (float(v) for v in spark.range(1).select(RF.digamma(F.lit(x + h)), RF.digamma(F.lit(x - h))).first())
        assert (up - down) / (2 * h) == pytest.approx(b, rel=1e-3)


@pytest.mark.parametrize("k", [6.0, 60.0])
def test_fitted_weight_recovers_the_simulated_one(spark, k):
    rng = np.random.default_rng(int(k))
    n = rng.integers(20, 400, 4000)
    p = np.where(np.arange(4000) % 2 == 0, 0.2, 0.5)
    f = rng.binomial(n, rng.beta(k * p, k * (1 - p)))
    counts = spark.createDataFrame(list(zip(f.tolist(), n.tolist(), p.tolist(), strict=True)), "f long, n long, parent double")
    for start in (1.0, 500.0):
        assert RF.fit_weight(counts, start=start) == pytest.approx(k, rel=0.1)


def test_fitted_weight_at_its_bounds(spark):
    equal = spark.createDataFrame([(30, 100, 0.3)] * 50, "f long, n long, parent double")
    assert RF.fit_weight(equal) > 1e4
    assert RF.fit_weight(spark.createDataFrame([], "f long, n long, parent double"), start=7.0) == 7.0
    split = spark.createDataFrame([(0, 100, 0.5), (100, 100, 0.5)] * 20, "f long, n long, parent double")
    assert RF.fit_weight(split) < 0.2


def test_fitted_encoder_shrinks_by_its_own_weights(spark):
    encoder, tables = RF.fit_encoder(rows_of(spark, 5), "y", [["make"], ["make", "model"]])
    want = Encoder([["make"], ["make", "model"]], encoder.k).fit(rows_of(spark, 5), "y")
    assert len(encoder.k) == 2 and sorted(map(tuple, tables[2].collect())) == sorted(map(tuple, want[2].collect()))
