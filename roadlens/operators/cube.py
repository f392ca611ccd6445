"""The risk cube and what is read from it: weighted rates, rankings, breakdowns, lookups with fallbacks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import rules as R


def risk_cube(rows: DataFrame, keys: list[str], target: str, components: dict[str, str], k: float) -> DataFrame:
    """keys, n, failures, risk and risk_<component>: rates shrunk to the overall rate with weight k. One aggregation and a one-row join."""
    sums = [F.sum(target).alias("failures"), *[F.sum(c).alias(f"sum_{name}") for name, c in components.items()]]
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    overall = grouped.agg(F.sum("n").alias("all_n"), F.sum("failures").alias("all_f"), *[F.sum(f"sum_{c}").alias(f"all_{c}") for c in components])
    shrunk = lambda s, a: F.try_divide(F.col(s) + k * (F.col(a) / F.col("all_n")), F.col("n") + k)
    joined = grouped.join(F.broadcast(overall))  # one row
    return joined.select(
        *keys, "n", "failures", shrunk("failures", "all_f").alias("risk"), *[shrunk(f"sum_{c}", f"all_{c}").alias(f"risk_{c}") for c in components]
    )


def weighted(rate: str, weight: str = "n", digits: int = 6) -> Column:
    """Weighted mean of a rate, null without weight."""
    return F.round(F.try_divide(F.sum(F.col(rate) * F.col(weight)), F.sum(weight)), digits)


def weighted_rates(cube: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """keys, n, risk and component risks, weighted by n; no keys give one row."""
    return cube.groupBy(*keys).agg(F.sum("n").alias("n"), weighted("risk").alias("risk"), *[weighted(f"risk_{c}").alias(f"risk_{c}") for c in components])


def ranking(rates: DataFrame, key: str, least: int, top: int, worst_first: bool, components: list[str]) -> DataFrame:
    """The top entities by risk with at least so many tests, numbered, with their worst component; ties by key."""
    order = [F.desc("risk") if worst_first else F.asc("risk"), F.asc(key)]
    best = rates.where(F.col("n") >= least).orderBy(*order).limit(top)
    worst = R.first_argmax({c: F.col(f"risk_{c}") for c in components})
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), key, "n", "risk", worst.alias("worst"))  # over `top` rows


def breakdown(rates: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """One row for each component: keys, component, risk."""
    return rates.unpivot(keys, [F.col(f"risk_{c}").alias(c) for c in components], "component", "risk")


def band_order(band: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in order]), band)


def base_model_list(cells: DataFrame, curated: dict[str, list[str]], most: int = 30, shortest: int = 3) -> DataFrame:
    """make, model, support, variants: the base models to offer for each maker, from cells (make, model, n) of its full names.

    A maker with a curated list offers those of it that there are; another one its models of letters alone, `shortest` or more of them,
    the first `most` by name. support is the largest n of a base model's variants.
    """
    named = cells.groupBy("make", "model").agg(F.max("n").alias("support"), F.count(F.lit(1)).alias("variants"))
    listed = cells.sparkSession.createDataFrame([(m, x) for m, models in curated.items() for x in models], "make string, model string")
    known = named.join(listed, ["make", "model"], "left_semi")
    open_ = named.where(~F.col("make").isin(list(curated)) & F.col("model").rlike(rf"^\p{{L}}{{{shortest},}}$"))
    first = Window.partitionBy("make").orderBy("model")
    return known.unionByName(open_.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).drop("_r"))


def lookup_cascade(requests: DataFrame, cube: DataFrame, keys: list[str]) -> DataFrame:
    """requests with the cube's n and risk at the finest level of keys that has rows: all keys, all but the last, ... none; level counts from 0.

    Levels are rolled up from each other, so the cube's own rows are aggregated once.
    """
    out, found = requests, []
    sums = cube.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.col("risk") * F.col("n")).alias("_r"))
    for i in range(len(keys), -1, -1):
        sums = sums.groupBy(*keys[:i]).agg(F.sum("_n").alias("_n"), F.sum("_r").alias("_r"))
        level = sums.select(*keys[:i], F.col("_n").alias(f"n_{i}"), F.try_divide("_r", "_n").alias(f"risk_{i}"))
        out = out.join(level, keys[:i], "left") if i else out.join(F.broadcast(level))  # one row
        found.append(i)
    levels = reduce(lambda rest, i: F.when(F.col(f"n_{i}").isNotNull(), F.lit(len(keys) - i)).otherwise(rest), sorted(found), F.lit(None))
    pick = lambda name: F.coalesce(*[F.col(f"{name}_{i}") for i in found])
    return out.select(*requests.columns, levels.alias("level"), pick("n").alias("n"), F.round(pick("risk"), 6).alias("risk"))


def _models(cube: DataFrame, least: int = 100) -> DataFrame:
    return cube.groupBy("model_id").agg(F.sum("n").alias("n"), weighted("risk").alias("risk")).where(F.col("n") >= least)


def _ends(cube: DataFrame, order: Callable[[str], Column], top: int = 10) -> DataFrame:
    return _models(cube).orderBy(order("risk"), "model_id").limit(top).select(F.col("model_id").alias("key"), F.col("risk").alias("value"))


#: Named questions to a risk cube; each gives key and value.
STORIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "volume": lambda cube: _models(cube).select(F.col("model_id").alias("key"), F.col("n").alias("value")),
    "worst": lambda cube: _ends(cube, F.desc),
    "best": lambda cube: _ends(cube, F.asc),
    "age": lambda cube: cube.groupBy(F.col("age_band").alias("key")).agg(weighted("risk").alias("value")),
}
