"""Sketches that merge over levels, days and streams, and bucketed tables that join without a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.operators import sketches as SK
from roadlens.plans.joins import co_located
from roadlens.sources import files as IO
from roadlens.streaming import jobs as J


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200_000).select(
        (F.col("id") % 4).cast("string").alias("kind"), (F.col("id") % 10).alias("day"), F.pmod(F.xxhash64("id"), F.lit(30_000)).alias("vehicle"),
        F.pow(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)) / 10_000.0, 3).alias("value"),
    )


def test_levels_come_from_the_sketches_within_their_bounds(rows):
    sketches = SK.sketch(rows, ["kind", "day"], "vehicle", "value").cache()
    found = {(r.level, r.key): r for r in SK.levels(sketches, {"all": [], "kind": ["kind"], "kind_day": ["kind", "day"]}, {"p95": 0.95}).collect()}
    assert len(found) == 1 + 4 + 20  # a day has one parity
    local = rows.toPandas()
    for (level, key), r in found.items():
        own = local if level == "all" else local[local.kind == key.split("/")[0]]
        own = own[own.day == int(key.split("/")[1])] if level == "kind_day" else own
        n = own.vehicle.nunique()
        assert r.n == len(own) and abs(r.distinct - n) <= 3 * SK.HLL_ERROR * n
        assert abs((own.value <= r.p95).mean() - 0.95) <= SK.KLL_ERROR + 1e-3
    some = SK.read(SK.merge(sketches.where("day < 3"), []), {"p50": 0.5}).first()
    assert some.n == (local.day < 3).sum() and abs(some.distinct - local[local.day < 3].vehicle.nunique()) <= 1000


def test_sketches_of_a_stream_merge_with_those_of_batches(spark, folder):
    build = lambda e: SK.sketch(
        e.withWatermark("ts", "2 days") if e.isStreaming else e, [F.window("ts", "1 day").alias("w"), F.col("event_type")], "user_id", "value"
    ).select(F.col("w.start").cast("string").alias("day"), "event_type", "n", "distinct_sketch", "value_sketch")
    batch = build(spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    stream, _ = J.run_to_close(J.read_events(spark, folder), build)
    one, both = (SK.read(SK.merge(df, ["event_type"]), {"p50": 0.5}).orderBy("event_type").collect() for df in (batch, batch.unionByName(stream)))
    assert [r.distinct for r in one] == [r.distinct for r in both] and [2 * r.n for r in one] == [r.n for r in both]


def test_empty_and_null_values(spark):
    empty = SK.sketch(spark.createDataFrame([], "k string, v long, x double"), ["k"], "v", "x")
    assert SK.read(empty, {"p50": 0.5}).count() == 0
    nulls = SK.read(SK.sketch(spark.createDataFrame([("a", None, None), ("a", 1, 2.0)], "k string, v long, x double"), ["k"], "v", "x"), {"p50": 0.5}).first()
    assert (nulls.n, nulls.distinct, nulls.p50) == (2, 1, 2.0)


def test_bucketed_facts_are_not_shuffled(spark, folder):
    line = IO.bucketed(spark.read.parquet(f"{folder}/lineitem.parquet"), ["l_orderkey"], 4)
    orders = IO.bucketed(spark.read.parquet(f"{folder}/orders.parquet").withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"], 4)
    joined = co_located(line, orders)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == line.count() and joined.where("lines is null or o_orderstatus is null").count() == 0
    assert np.isclose(joined.agg(F.sum("l_quantity")).first()[0], line.agg(F.sum("l_quantity")).first()[0])
