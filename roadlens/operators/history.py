"""Point-in-time features of histories: every test sees the tests before it, or the whole history from its newest test on.

All take rows with a vehicle, a time and a unique id; windows go over one vehicle's tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

VEHICLE, TIME, ID = "vehicle_id", "test_ts", "test_id"


def oldest_first() -> WindowSpec:
    return Window.partitionBy(VEHICLE).orderBy(TIME, ID)


def newest_first() -> WindowSpec:
    return Window.partitionBy(VEHICLE).orderBy(F.desc(TIME), F.desc(ID))


def earlier(count: int | None = None) -> WindowSpec:
    """The tests before this one, all or the last so many."""
    return oldest_first().rowsBetween(Window.unboundedPreceding if count is None else -count, -1)


def latest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(newest_first())).where("_r = 1").drop("_r")


def prior_counts(rows: DataFrame, flag: str) -> DataFrame:
    """n_prior, flagged_prior, prior_rate (null for a first test)."""
    n = F.count(F.lit(1)).over(earlier())
    hits = F.coalesce(F.sum(flag).over(earlier()), F.lit(0))
    return rows.withColumns({"n_prior": n, "flagged_prior": hits, "prior_rate": F.try_divide(hits.cast("double"), n)})


def within_days(flag: Column, days: int) -> Column:
    """Sum of flag over the tests of the last so many days, this one left out."""
    seconds = F.unix_micros(F.col(TIME).cast("timestamp"))
    return F.coalesce(F.sum(flag).over(Window.partitionBy(VEHICLE).orderBy(seconds).rangeBetween(-days * 86_400_000_000, -1)), F.lit(0))


def since_last(flag: str) -> Column:
    """How many tests ago the flag was last set before this test; null if never."""
    place = F.row_number().over(oldest_first())
    return place - F.last(F.when(F.col(flag) == 1, F.col("_place")), ignorenulls=True).over(earlier())


def with_place(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(oldest_first()))


def leading_streaks(rows: DataFrame, flags: list[str]) -> DataFrame:
    """For each vehicle and flag: tests, how many tests ago it was last set (999 if never), the length of the streak that its newest
    tests form, whether it is set in the last one or two tests, whether ever. One window and one aggregation."""
    numbered = rows.withColumn("_r", F.row_number().over(newest_first()))
    aggregates = [F.count(F.lit(1)).alias("tests")]
    for flag in flags:
        on = F.col(flag) == 1
        first_off = F.min(F.when(~on, F.col("_r")))
        aggregates += [
            F.coalesce(F.min(F.when(on, F.col("_r"))) - 1, F.lit(999)).alias(f"since_{flag}"),
            F.coalesce(first_off - 1, F.count(F.lit(1))).alias(f"streak_{flag}"),
            F.max((on & (F.col("_r") <= 1)).cast("int")).alias(f"last1_{flag}"),
            F.max((on & (F.col("_r") <= 2)).cast("int")).alias(f"last2_{flag}"),
            F.max(on.cast("int")).alias(f"ever_{flag}"),
        ]
    return numbered.groupBy(VEHICLE).agg(*aggregates)


def annualised(delta: Column, days: Column) -> Column:
    """Yearly use held within 0 and 50000; null without days."""
    return F.greatest(F.lit(0.0), F.least(F.lit(50_000.0), F.try_divide(delta * 365.0, F.when(days > 0, days))))


def anomaly(delta: Column, days: Column) -> Column:
    """1 if days are not positive, the reading falls by over 1000, jumps by over 100000, or the yearly use is over 40000."""
    yearly = F.try_divide(delta * 365.0, days)
    return F.when((days <= 0) | (delta < -1000) | (delta > 100_000) | (yearly > 40_000), 1).otherwise(0)


def advisory_trend(rows: DataFrame, advisories: str) -> DataFrame:
    """vehicle_id, trend: advisories of the newest test against those of the one before; unknown with fewer than two tests."""
    numbered = rows.withColumn("_r", F.row_number().over(newest_first())).where("_r <= 2")
    at = lambda r: F.max(F.when(F.col("_r") == r, F.col(advisories)))
    two = numbered.groupBy(VEHICLE).agg(F.count(F.lit(1)).alias("_n"), at(1).alias("_now"), at(2).alias("_before"))
    now, before = F.col("_now"), F.col("_before")
    return two.select(
        VEHICLE, F.when(F.col("_n") < 2, "unknown").when(now > before, "increasing").when(now < before, "decreasing").otherwise("stable").alias("trend")
    )


def days_late(as_of: Column, expiry: Column) -> Column:
    """Days since the expiry date, 0 before it and without one."""
    return F.greatest(F.lit(0), F.coalesce(F.datediff(as_of, expiry), F.lit(0)))


def training_days_late(days_since: Column) -> Column:
    """Days since the last test less a year; 730 days stand for no test."""
    return F.coalesce(days_since, F.lit(730)) - 365


def to_miles(reading: Column, unit: Column) -> Column:
    """Kilometres as whole miles (halves to even); other units and none as they are."""
    return F.when(F.lower(unit) == "km", F.bround(reading * 0.621371)).otherwise(reading)


def serving_reading(reading: Column, unit: Column, before: Column, days: Column) -> tuple[Column, Column]:
    """Reading in miles and whether it is implausible: more than 50000 miles a year since the reading before, which then replaces it."""
    now, last = to_miles(reading, unit), to_miles(before, unit)
    yearly = F.try_divide((now - last) * 365.0, F.when((days > 0) & (now > last), days))
    odd = F.coalesce(yearly > 50_000, F.lit(False))
    return F.when(odd, last).otherwise(now), odd.cast("int")
