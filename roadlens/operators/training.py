"""The training table in one call: features of every test from what was known before its day, and rates that the training span alone decides.

Each test gets the summary of its vehicle's earlier tests from running sums, and from it the features of `history_features`; what other vehicles tell
(rates of makers, models, segments, areas, cohort means) is fitted on tests before a cut and applied to all. Training rows take the unified
prior from the other folds of vehicles, later rows from all of the training span, so no row sees its own outcome in it.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import rules as R
from roadlens.functions import text as X
from roadlens.operators.encoders import Encoder, observed_expected, out_of_fold
from roadlens.operators.features import FEATURE_NAMES, running_summary, summary_features
from roadlens.operators.metrics import stored

#: Weights of the levels, folds of vehicles, and tests that an area needs for a rate of its own.
K_MAKE, K_MODEL, K_AGE, K_SEGMENT, K_STATION, FOLDS, LEAST_AREA = 10.0, 20.0, 10.0, 5.0, 10.0, 5, 100
KEYS = ("vehicle_id", "test_id", "test_date", "target")
#: Base features that rates and cohorts are found or compared by, those that they take the place of, and all others.
_LOOKED_AT = (
    "vehicle_id", "target", "make", "model_id", "age_band", "mileage_band", "area", "prev_cycle_outcome_band", "test_mileage", "prev_count_advisory", "mech_decay_index",
)
_REPLACED = (
    "make_fail_rate_smoothed", "model_fail_rate_smoothed", "make_age_fail_rate_eb", "model_age_fail_rate_eb", "eb_unified_prior", "segment_fail_rate_smoothed",
    "station_fail_rate_smoothed", "station_x_prev_outcome_fail_rate", "station_strictness_bias", "local_corrosion_index", "local_corrosion_delta",
    "suspension_risk_profile", "mileage_cohort_ratio", "advisory_cohort_delta", "mech_decay_index_normalized",
)
_CARRIED = tuple(c for c in (*KEYS, *FEATURE_NAMES) if c not in _LOOKED_AT and c not in _REPLACED)


def point_in_time(tests: DataFrame) -> DataFrame:
    """tests with their column `tests`: the vehicle's tests of earlier days (null without any), in an array as long as its history.

    tests: vehicle_id, test_id, test_date, result, odometer, unit, expiry, defects and any other columns. Tests of the same day don't see
    each other.
    """
    one = F.struct("test_date", "result", "odometer", "unit", "expiry", "defects")
    before = Window.partitionBy("vehicle_id").orderBy(F.unix_date("test_date")).rangeBetween(Window.unboundedPreceding, -1)
    return tests.withColumn("tests", F.collect_list(one).over(before)).drop("result", "odometer", "unit", "expiry", "defects")


def base_features(tests: DataFrame, veterans_only: bool = False) -> DataFrame:
    """KEYS, FEATURE_NAMES with neutral rates, and model_id, age_band, mileage_band, area of every test.

    tests as for point_in_time with make, model, postcode, manufacture_date and target. With veterans_only tests without history are left out.
    """
    age = F.when(F.col("manufacture_date").isNotNull(), F.floor(F.datediff("test_date", "manufacture_date") / 365)).otherwise(5).cast("int")
    rows = running_summary(tests)
    if veterans_only:
        rows = rows.where(F.col("_h.n") > 0)
    named = F.when(F.length("model") > 0, F.concat_ws(" ", "make", "model")).otherwise(F.col("make"))
    rows = rows.withColumns({"model_id": named, "age_band": R.serving_age_band(age), "area": F.coalesce(X.postcode_area(F.col("postcode")), F.lit("UNKNOWN"))})
    marks = ("_model_id", "_age_band", "area")
    rows = rows.withColumnsRenamed({"model_id": "_model_id", "age_band": "_age_band"})
    made = summary_features(rows, F.col("test_date"), None, (*KEYS, *marks))
    made = made.withColumnsRenamed({"_model_id": "model_id", "_age_band": "age_band"})
    return made.withColumn("mileage_band", R.below(F.col("test_mileage"), R.MILEAGE_BANDS, "100k+"))


@dataclass
class Fitted:
    """Tables of a training span; every one has a row for each value of its keys."""

    overall: float
    make: DataFrame  # make, rate
    model: DataFrame  # model_id, rate, suspension
    make_age: DataFrame  # make, age_band, rate
    model_age: DataFrame  # model_id, age_band, rate, miles, advised
    segment: DataFrame  # make, age_band, mileage_band, rate
    area: DataFrame  # area, corrosion, station, strictness
    outcome: DataFrame  # area, prev_cycle_outcome_band, rate
    decay: DataFrame  # age_band, usual

    def stored(self) -> Fitted:
        """The same with tables written once: they are joined in two jobs, and Spark sees before a join how small they are."""
        return replace(self, **{f.name: stored(getattr(self, f.name)) for f in fields(self) if f.name != "overall"})


def fit(train: DataFrame) -> Fitted:
    """The tables from base features of the training span."""
    levels = Encoder([["make"], ["make", "model_id"]], [K_MAKE, K_MODEL]).fit(train, "target")
    ages = Encoder([["make", "age_band"], ["make", "age_band", "model_id"]], [K_AGE, K_AGE]).fit(train, "target")
    segments = Encoder([["make"], ["make", "age_band", "mileage_band"]], [K_MAKE, K_SEGMENT]).fit(train, "target")
    stations = Encoder([["area"], ["area", "prev_cycle_outcome_band"]], [K_STATION, K_STATION]).fit(train, "target")
    overall = levels[0].first()["rate"] or 0.0
    suspended = (F.col("prev_adv_suspension") > 0).cast("int")
    share = train.agg(F.coalesce(F.avg(suspended), F.lit(0.0))).first()[0]
    profile = train.groupBy("model_id").agg(((F.sum(suspended) + K_MODEL * share) / (F.count(F.lit(1)) + K_MODEL)).alias("suspension"))
    cohorts = train.groupBy("model_id", "age_band").agg(F.avg("test_mileage").alias("miles"), F.avg("prev_count_advisory").alias("advised"))
    corrosion = train.groupBy("area").agg(F.avg("target").alias("corrosion"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_AREA)
    strict = observed_expected(train, "area", ["make", "age_band"], "target")
    area = stations[1].select("area", F.col("rate").alias("station")).join(strict, "area", "left").join(corrosion.drop("n"), "area", "left")
    by_model = ages[2].groupBy("model_id", "age_band").agg(F.max_by("rate", "n").alias("rate"))  # a model has one maker
    return Fitted(
        overall, levels[1].select("make", "rate"), levels[2].groupBy("model_id").agg(F.max_by("rate", "n").alias("rate")).join(profile, "model_id"),
        ages[1].select("make", "age_band", "rate"), by_model.join(cohorts, ["model_id", "age_band"]), segments[2].select("make", "age_band", "mileage_band", "rate"),
        area, stations[2].select("area", "prev_cycle_outcome_band", "rate"), train.groupBy("age_band").agg(F.avg("mech_decay_index").alias("usual")),
    )


def packed(rows: DataFrame) -> DataFrame:
    """Base features with those that apply does not look at in one struct, _row, which a join copies as a whole and not field by field."""
    return rows.select(*_LOOKED_AT, F.struct(*_CARRIED).alias("_row"))


def apply(rows: DataFrame, fitted: Fitted, unified: Column | None = None) -> DataFrame:
    """Base features with the fitted rates in place of the neutral ones; keys that the span lacks take the level above.

    rows are packed and may have more columns. unified: the unified prior where a row has one of its own, else null.
    """
    joined = rows.join(fitted.make.withColumnRenamed("rate", "_make"), "make", "left")
    joined = joined.join(fitted.model.select("model_id", F.col("rate").alias("_model"), F.col("suspension").alias("_suspension")), "model_id", "left")
    joined = joined.join(fitted.make_age.withColumnRenamed("rate", "_make_age"), ["make", "age_band"], "left")
    by_age = fitted.model_age.select("model_id", "age_band", F.col("rate").alias("_model_age"), F.col("miles").alias("_miles"), F.col("advised").alias("_advised"))
    joined = joined.join(by_age, ["model_id", "age_band"], "left")
    joined = joined.join(fitted.segment.withColumnRenamed("rate", "_segment"), ["make", "age_band", "mileage_band"], "left")
    by_area = fitted.area.select("area", F.col("station").alias("_station"), F.col("strictness").alias("_strict"), F.col("corrosion").alias("_corrosion"))
    joined = joined.join(by_area, "area", "left")
    joined = joined.join(fitted.outcome.withColumnRenamed("rate", "_outcome"), ["area", "prev_cycle_outcome_band"], "left")
    joined = joined.join(fitted.decay.withColumnRenamed("usual", "_usual"), "age_band", "left")
    overall = F.lit(fitted.overall)
    make = F.coalesce("_make", overall)
    make_age = F.coalesce(F.col("_make_age"), make)
    model_age = F.coalesce(F.col("_model_age"), make_age)
    station = F.coalesce("_station", overall)
    corrosion = F.coalesce("_corrosion", overall)
    miles = F.when(F.col("_miles") > 0, F.col("_miles"))
    made = {
        "make_fail_rate_smoothed": make, "model_fail_rate_smoothed": F.coalesce(F.col("_model"), make), "make_age_fail_rate_eb": make_age,
        "model_age_fail_rate_eb": model_age, "eb_unified_prior": F.coalesce(unified, model_age) if unified is not None else model_age,
        "segment_fail_rate_smoothed": F.coalesce(F.col("_segment"), make), "station_fail_rate_smoothed": station,
        "station_x_prev_outcome_fail_rate": F.coalesce(F.col("_outcome"), station), "station_strictness_bias": F.coalesce("_strict", F.lit(1.0)),
        "local_corrosion_index": corrosion, "local_corrosion_delta": corrosion - overall, "suspension_risk_profile": F.coalesce("_suspension", F.lit(0.0)),
        "mileage_cohort_ratio": F.coalesce(F.try_divide(F.col("test_mileage"), miles), F.lit(1.0)),
        "advisory_cohort_delta": F.coalesce(F.col("prev_count_advisory") - F.col("_advised"), F.lit(0.0)),
        "mech_decay_index_normalized": F.coalesce(F.try_divide(F.col("mech_decay_index"), F.when(F.col("_usual") > 0, F.col("_usual"))), F.col("mech_decay_index")),
    }
    held = {c: F.col(f"_row.{c}") for c in _CARRIED}
    return joined.select(*[(made | held).get(c, F.col(c)).alias(c) for c in (*KEYS, *FEATURE_NAMES)])


def training_table(tests: DataFrame, cut: str, veterans_only: bool = False) -> DataFrame:
    """KEYS, `part` (dev before the cut, oot from it on) and the FEATURE_NAMES of every test; rates and cohorts come from dev alone.

    Base features are written once. Dev rows take the unified prior from the other folds of vehicles.
    """
    base = stored(base_features(tests, veterans_only))
    early = F.col("test_date") < F.lit(cut).cast("date")
    train = base.where(early)
    key = packed(train).withColumn("_key", F.concat_ws("|", "model_id", "age_band"))
    folds = out_of_fold(key, "_key", "target", K_AGE, FOLDS, F.pmod(F.xxhash64("vehicle_id"), F.lit(FOLDS)).cast("int"))
    fitted = fit(train).stored()
    dev = apply(folds.withColumnRenamed("rate", "_own"), fitted, F.col("_own")).withColumn("part", F.lit("dev"))
    later = apply(packed(base.where(~early)), fitted).withColumn("part", F.lit("oot"))
    return dev.unionByName(later).select(*KEYS, "part", *FEATURE_NAMES)
