"""Sketches kept at the grain of a cube and merged upwards: distinct counts (HyperLogLog) and quantiles (KLL), in batch and in streams.

A table of sketches is written once for each day; any coarser level and any span of days comes from merging its rows, without the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the HyperLogLog registers, and KLL's size. Distinct counts have a standard error of HLL_ERROR, quantiles are off by at most
#: KLL_ERROR of the rows with a probability of 99 per cent.
HLL_LOG, KLL_SIZE = 14, 400
HLL_ERROR, KLL_ERROR = 1.04 / (1 << HLL_LOG) ** 0.5, 0.008


def sketch(rows: DataFrame, keys: list[str | Column], distinct: str, value: str) -> DataFrame:
    """keys, n, distinct_sketch, value_sketch: one row for each combination of keys; nulls count in n alone. Streams need a window key."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, HLL_LOG).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("value_sketch"),
    )


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of a coarser level; no keys give one row for all."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch", KLL_SIZE).alias("value_sketch")
    )


def read(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """sketches with `distinct` (an estimate) and one estimated quantile for each name, instead of the sketches."""
    found = sketches.withColumn("distinct", F.hll_sketch_estimate("distinct_sketch"))
    found = found.withColumns({name: F.kll_sketch_get_quantile_double("value_sketch", F.lit(q)) for name, q in quantiles.items()})
    return found.drop("distinct_sketch", "value_sketch")


def levels(sketches: DataFrame, wanted: dict[str, list[str]], quantiles: dict[str, float]) -> DataFrame:
    """level, key (its values joined by /), n, distinct and the quantiles of every wanted level, all from one table of sketches."""
    out = None
    for name, keys in wanted.items():
        key = F.concat_ws("/", *keys) if keys else F.lit("all")
        one = read(merge(sketches, keys), quantiles).select(F.lit(name).alias("level"), key.alias("key"), "n", "distinct", *quantiles)
        out = one if out is None else out.unionByName(one)
    return out
