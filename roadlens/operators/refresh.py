"""Encoders that are refreshed: sums by key and month arrive in batches, merge, and give the rates of any span of months at reading.

Also the weight of a prior as the data want it: k of beta-binomial counts, by Newton steps whose sums Spark aggregates.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.operators.encoders import Encoder
from roadlens.operators.metrics import stored
from roadlens.sources.versions import VersionedTable


class RunningSums:
    """Failures f and tests n by keys and month, in a versioned table of sums by batch.

    A batch that is sent again replaces its own sums, so it changes nothing if its rows are the same. The table has one row for each batch,
    key and month; `merge_before` folds old batches into one that cannot be sent again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.keys, self.table = spark, keys, VersionedTable(spark, path)

    def _held(self) -> DataFrame | None:
        return self.table.read() if self.table.versions() else None

    def merged_up_to(self) -> int:
        versions = self.table.versions()
        return self.table.commit_info(versions[-1]).get("merged", -1) if versions else -1

    def upsert(self, rows: DataFrame, target: str, month: Column, batch: int) -> int:
        """Add the rows of a batch (or replace those it had); returns the table's new version."""
        merged = self.merged_up_to()
        if batch <= merged:
            return self.table.versions()[-1]  # it is part of the merged sums
        sums = rows.groupBy(*self.keys, F.trunc(month, "MM").alias("month")).agg(F.sum(target).cast("double").alias("f"), F.count(target).alias("n"))
        sums = sums.withColumn("batch", F.lit(batch).cast("long"))
        held = self._held()
        base = max(self.table.versions(), default=0)
        return self.table.write(sums if held is None else held.where(F.col("batch") != batch).unionByName(sums), base=base, merged=merged)

    def merge_before(self, batch: int) -> int:
        """Fold all batches before this one into the sums of batch -1; they can't be sent again."""
        base = self.table.versions()[-1]
        old = F.col("batch") < batch
        folded = F.when(old, F.lit(-1).cast("long")).otherwise(F.col("batch")).alias("batch")
        sums = self.table.read().groupBy(*self.keys, "month", folded).agg(F.sum("f").alias("f"), F.sum("n").alias("n"))
        return self.table.write(sums.select(*self.keys, "month", "f", "n", "batch"), base=base, merged=max(batch - 1, self.merged_up_to()))

    def sums(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """keys, f, n over months from first to last."""
        rows = self.table.read()
        if first:
            rows = rows.where(F.col("month") >= F.lit(first).cast("date"))
        if last:
            rows = rows.where(F.col("month") <= F.lit(last).cast("date"))
        return rows.groupBy(*self.keys).agg(F.sum("f").alias("f"), F.sum("n").alias("n"))

    def fit(self, encoder: Encoder, first: str | None = None, last: str | None = None) -> list[DataFrame]:
        """The encoder's tables over a span of months, from the sums alone."""
        return encoder.from_sums(self.sums(first, last))


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: six steps up, then the asymptotic series; errors below 1e-9."""
    y = x + 6
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, 4)) - 1 / (252 * F.pow(y, 6))
    return series - reduce(lambda a, b: a + b, [1 / (x + i) for i in range(6)])


def trigamma(x: Column) -> Column:
    y = x + 6
    series = 1 / y + 1 / (2 * y * y) + 1 / (6 * F.pow(y, 3)) - 1 / (30 * F.pow(y, 5)) + 1 / (42 * F.pow(y, 7))
    return series + reduce(lambda a, b: a + b, [1 / F.pow(x + i, 2) for i in range(6)])


def weight_step(counts: DataFrame, k: float, parent: str = "parent") -> DataFrame:
    """k, slope, curve, next_k: one Newton step in log k of the likelihood of beta-binomial counts (f, n) around their parent's rate.

    Where the likelihood isn't curved downwards the step goes uphill by one unit; steps are held within two units. Parents' rates are
    held inside 0.001 and 0.999.
    """
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col(parent)))
    a, b, f, g, n = k * p, k * (1 - p), F.col("f"), F.col("n") - F.col("f"), F.col("n")
    first = digamma(F.lit(k)) - digamma(n + k) + p * (digamma(f + a) - digamma(a)) + (1 - p) * (digamma(g + b) - digamma(b))
    second = trigamma(F.lit(k)) - trigamma(n + k) + p * p * (trigamma(f + a) - trigamma(a)) + (1 - p) * (1 - p) * (trigamma(g + b) - trigamma(b))
    sums = counts.where("n > 0").select((k * first).alias("s"), (k * first + k * k * second).alias("c"))
    sums = sums.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("slope"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("curve"))
    move = F.when(F.col("curve") < 0, -F.col("slope") / F.col("curve")).otherwise(F.signum("slope"))
    return sums.select(F.lit(float(k)).alias("k"), "slope", "curve", (k * F.exp(F.least(F.lit(2.0), F.greatest(F.lit(-2.0), move)))).alias("next_k"))


def fit_weight(counts: DataFrame, parent: str = "parent", start: float = 10.0, steps: int = 30, least: float = 0.01, most: float = 1e6) -> float:
    """k of counts (f, n, the parent's rate), within bounds: equal rates of all keys want an endless k. Groups of equal counts go as one."""
    counts = counts.cache()
    try:
        k = start
        for _ in range(steps):  # one small aggregate each
            new = min(max(weight_step(counts, k, parent).first()["next_k"], least), most)
            if abs(math.log(new / k)) < 1e-4:
                return new
            k = new
        return k
    finally:
        counts.unpersist()


def fit_encoder(rows: DataFrame, target: str, levels: list[list[str]], start: float = 10.0) -> tuple[Encoder, list[DataFrame]]:
    """An encoder whose weight at each level is fitted to the counts around the level above, and its tables."""
    keys = list(dict.fromkeys(c for level in levels for c in level))
    base = stored(rows.groupBy(*keys).agg(F.sum(target).alias("f"), F.count(target).alias("n")))  # every level and step reads the sums, not the rows
    weights: list[float] = []
    for i, level in enumerate(levels):
        tables = Encoder(levels[:i], weights).from_sums(base)
        up = [c for c in levels[i - 1] if c in level] if i else []
        parent = (tables[i] if up else tables[0]).select(*up, F.col("rate").alias("parent"))
        counts = base.na.drop(subset=level).groupBy(*level).agg(F.sum("f").alias("f"), F.sum("n").alias("n"))
        counts = counts.join(parent, up) if up else counts.join(F.broadcast(parent))  # one row
        weights.append(fit_weight(counts.select("f", "n", "parent"), start=start))
    encoder = Encoder(levels, weights)
    return encoder, encoder.from_sums(base)
