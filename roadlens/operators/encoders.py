"""Empirical-Bayes encoders: rates of nested keys, each shrunk towards its parent, fitted once and joined by level."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.operators.metrics import stored


@dataclass
class Encoder:
    """levels: key columns of each level, coarse to fine, each containing the ones before it or not; k: shrinkage weight of each level."""

    levels: list[list[str]]
    k: list[float]
    least: int = 0
    k_overrides: dict[int, float] = field(default_factory=dict)

    def fit(self, rows: DataFrame, target: str, store: bool = False) -> list[DataFrame]:
        """One table for each level, the overall rate first: keys, n, rate. Rows with a null key are left out of a level.

        All levels come from the counts at the union of their keys, so the base is aggregated once. With `store` it is
        written first: tables that are used one by one, in several jobs, then read the sums and not the rows.
        """
        keys = list(dict.fromkeys(c for level in self.levels for c in level))
        base = rows.groupBy(*keys).agg(F.sum(target).alias("f"), F.count(target).alias("n"))
        return self.from_sums(stored(base) if store else base)

    def from_sums(self, base: DataFrame) -> list[DataFrame]:
        """The tables of fit from failures f and tests n at the union of the levels' keys, which may have several rows for one key."""
        tables = [base.agg(F.sum("n").alias("n"), F.try_divide(F.sum("f"), F.sum("n")).alias("rate"))]
        for i, level in enumerate(self.levels):
            k = self.k_overrides.get(i, self.k[i])
            grouped = base.na.drop(subset=level).groupBy(*level).agg(F.sum("f").alias("f"), F.sum("n").alias("n")).where(F.col("n") >= self.least)
            parent_keys = [c for c in (self.levels[i - 1] if i else []) if c in level]
            parent = tables[i].select(*parent_keys, F.col("rate").alias("parent"))
            if not parent_keys:
                parent = tables[0].select(F.col("rate").alias("parent"))
            joined = grouped.join(parent, parent_keys, "left") if parent_keys else grouped.join(F.broadcast(parent))  # one row
            joined = joined.withColumn("parent", F.coalesce("parent", F.lit(0.0)))
            tables.append(joined.select(*level, "n", F.try_divide(F.col("f") + k * F.col("parent"), F.col("n") + k).alias("rate")))
        return tables

    def transform(self, rows: DataFrame, tables: list[DataFrame], name: str) -> DataFrame:
        """rows with the finest rate known for them, down to the overall rate.

        Levels are written first: Spark sees how small they are before it plans the joins and broadcasts those that are small enough. Else
        rows would be shuffled by each level's keys, and a coarse level has few of them, so that one task reads half of all rows.
        """
        out = rows
        for i, level in enumerate(self.levels):
            out = out.join(stored(tables[i + 1].select(*level, F.col("rate").alias(f"_rate_{i}"))), level, "left")
        out = out.join(F.broadcast(tables[0].select(F.col("rate").alias("_rate"))))  # one row
        fine_first = [F.col(f"_rate_{i}") for i in reversed(range(len(self.levels)))]
        return out.withColumn(name, F.coalesce(*fine_first, F.col("_rate"))).drop("_rate", *[f"_rate_{i}" for i in range(len(self.levels))])


def regime_hierarchy(
    rows: DataFrame, target: str, segment: list[str], regimes: list[str], powertrains: list[str], k=(10.0, 10.0, 10.0, 5.0)
) -> dict[str, DataFrame]:
    """Rates of regime, powertrain (both dense: a missing one has its parent's rate), make and segment, each shrunk towards the level above.

    rows: regime, powertrain, make, the segment columns and the target. A make with several powertrains takes the rate of the last one by
    name. All levels come from one aggregation at the union of their keys.
    """
    spark = rows.sparkSession
    shrunk = lambda k, parent: F.try_divide(F.col("f") + k * F.col(parent), F.col("n") + k)
    base = rows.groupBy("regime", "powertrain", "make", *segment).agg(F.sum(target).alias("f"), F.count(F.lit(1)).alias("n"))
    sums = lambda keys: base.groupBy(*keys).agg(F.sum("f").alias("f"), F.sum("n").alias("n"))
    overall = base.agg(F.coalesce(F.try_divide(F.sum("f"), F.sum("n")), F.lit(0.0)).alias("overall"))

    def dense(names: list[str], keys: list[tuple], parent: DataFrame, on: list[str], up: str, k: float) -> DataFrame:
        every = spark.createDataFrame(keys, ", ".join(f"{c} string" for c in names))
        joined = every.join(sums(names), names, "left").na.fill(0, ["f", "n"])
        joined = joined.join(parent, on) if on else joined.join(F.broadcast(parent))  # one row
        return joined.select(*names, "n", shrunk(k, up).alias("rate"))

    regime = dense(["regime"], [(r,) for r in regimes], overall, [], "overall", k[0])
    up = regime.select("regime", F.col("rate").alias("up"))
    power = dense(["regime", "powertrain"], [(r, p) for r in regimes for p in powertrains], up, ["regime"], "up", k[1])
    up = power.select("regime", "powertrain", F.col("rate").alias("up"))
    makes = sums(["make", "regime", "powertrain"]).join(up, ["regime", "powertrain"]).withColumn("rate", shrunk(k[2], "up"))
    make = makes.groupBy("make").agg(
        F.max(F.struct("regime", "powertrain", "rate")).alias("last"), F.sum("n").alias("n")
    ).select("make", "n", F.col("last.rate").alias("rate"))
    segments = sums(["make", *segment]).join(make.select("make", F.col("rate").alias("up")), "make")
    return {
        "overall": overall,
        "regime": regime,
        "powertrain": power,
        "make": make,
        "segment": segments.select("make", *segment, "n", shrunk(k[3], "up").alias("rate")),
    }


def regime_transform(rows: DataFrame, tables: dict[str, DataFrame], segment: list[str]) -> DataFrame:
    """rows (regime, powertrain, make, the segment columns, prev_outcome) with the rates of all levels and two interaction keys.

    An unseen make takes its powertrain's rate, an unseen segment its make's; a regime or powertrain outside the enumerations takes the overall rate.
    """
    out = rows.join(F.broadcast(tables["overall"]))  # one row
    out = out.join(F.broadcast(tables["regime"].select("regime", F.col("rate").alias("_regime"))), "regime", "left")  # the enumerations
    out = out.join(F.broadcast(tables["powertrain"].select("regime", "powertrain", F.col("rate").alias("_power"))), ["regime", "powertrain"], "left")
    out = out.join(tables["make"].select("make", F.col("rate").alias("_make")), "make", "left")
    out = out.join(tables["segment"].select("make", *segment, F.col("rate").alias("_segment")), ["make", *segment], "left")
    regime = F.coalesce("_regime", "overall")
    power = F.coalesce(F.col("_power"), regime)
    made = F.coalesce(F.col("_make"), power)
    return out.select(
        *rows.columns, regime.alias("regime_fail_rate"), power.alias("powertrain_fail_rate"), made.alias("make_fail_rate_smoothed"),
        F.coalesce(F.col("_segment"), made).alias("segment_fail_rate_smoothed"), F.concat_ws("_", "make", segment[0]).alias("make_x_age_band"),
        F.concat_ws("_", F.col("make"), F.coalesce("prev_outcome", F.lit("UNKNOWN"))).alias("make_x_prev_outcome"),
    )


def shrink(rows: DataFrame, key: str, target: str, k: float, least: int = 0) -> DataFrame:
    """key, n, rate: one level shrunk to the overall rate."""
    return Encoder([[key]], [k], least).fit(rows, target)[1]


def out_of_fold(rows: DataFrame, key: str, target: str, k: float, folds: int, fold) -> DataFrame:
    """rows with rate: the key's shrunk rate over the other folds; keys are summed once by fold and once in all."""
    marked = rows.withColumn("fold", fold)
    by_fold = marked.groupBy(key, "fold").agg(F.sum(target).alias("f"), F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(key)
    own = by_fold.select(key, "fold", (F.sum("f").over(total) - F.col("f")).alias("f"), (F.sum("n").over(total) - F.col("n")).alias("n"))
    overall = by_fold.groupBy("fold").agg(F.sum("f").alias("of"), F.sum("n").alias("on"))
    every = Window.partitionBy()
    parents = overall.select("fold", F.try_divide(F.sum("of").over(every) - F.col("of"), F.sum("on").over(every) - F.col("on")).alias("parent"))  # one row a fold
    rates = own.join(F.broadcast(parents), "fold").select(key, "fold", F.try_divide(F.col("f") + k * F.col("parent"), F.col("n") + k).alias("rate"))
    return marked.join(rates, [key, "fold"], "left")


def observed_expected(rows: DataFrame, key: str, cohort: list[str], target: str, prior: float = 10.0) -> DataFrame:
    """key, strictness: observed over expected failures (expected from cohort rates), damped and held within 0.5 and 2."""
    rates = rows.groupBy(*cohort).agg(F.avg(target).alias("expected"))
    joined = rows.join(rates, cohort)
    ratio = (F.sum(target) + prior) / (F.sum("expected") + prior)
    return joined.groupBy(key).agg(F.greatest(F.lit(0.5), F.least(F.lit(2.0), ratio)).alias("strictness"))
