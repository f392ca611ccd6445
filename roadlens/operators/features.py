"""From nested histories to the feature table of the model, in one call.

Every row is one vehicle with an array of its tests, so all history features are array expressions over the row itself: nothing is exploded
or shuffled, and no Python runs on rows. Only the priors of models, makes and cohorts are joined. What the features need of a history is a
summary of fixed size; `running_summary` has it for every test of a table from running sums, where an array for each test would hold the
history over and over.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import rules as R
from roadlens.functions import text as X

from .history import to_miles

#: What `tests` holds, in any order.
TESTS = "array<struct<test_date:date,result:string,odometer:int,unit:string,expiry:date,defects:array<struct<text:string,type:string>>>>"

# The features of the model in its order.
FEATURE_NAMES = [
    "prev_cycle_outcome_band", "gap_band", "make", "advisory_trend",
    "test_mileage", "prev_count_advisory", "days_since_last_test",
    "prior_fail_rate_smoothed", "n_prior_tests", "make_fail_rate_smoothed",
    "segment_fail_rate_smoothed", "model_fail_rate_smoothed", "days_late",
    "prev_adv_brakes", "prev_adv_suspension", "prev_adv_steering", "prev_adv_tyres",
    "mileage_cohort_ratio", "advisory_cohort_delta", "days_since_pass_ratio",
    "station_fail_rate_smoothed", "station_x_prev_outcome_fail_rate",
    "multi_system_advisory_count", "n_prior_fails", "fails_last_365d",
    "fails_last_730d", "fail_rate_trend", "recent_fail_intensity", "mdps_score",
    "front_end_advisory_intensity", "brake_system_stress", "commercial_wear_proxy",
    "usage_band_hybrid", "has_prior_advisory_brakes", "tests_since_last_advisory_brakes",
    "advisory_in_last_1_brakes", "advisory_in_last_2_brakes", "advisory_streak_len_brakes",
    "has_prior_advisory_tyres", "miles_since_last_advisory_tyres",
    "tests_since_last_advisory_tyres", "advisory_in_last_1_tyres",
    "advisory_in_last_2_tyres", "advisory_streak_len_tyres",
    "has_prior_advisory_suspension", "miles_since_last_advisory_suspension",
    "tests_since_last_advisory_suspension", "advisory_in_last_1_suspension",
    "advisory_in_last_2_suspension", "advisory_streak_len_suspension",
    "has_prior_failure_brakes", "has_ever_failed_brakes", "failure_streak_len_brakes",
    "tests_since_last_failure_brakes", "has_prior_failure_tyres", "has_ever_failed_tyres",
    "failure_streak_len_tyres", "tests_since_last_failure_tyres",
    "has_prior_failure_suspension", "has_ever_failed_suspension",
    "failure_streak_len_suspension", "tests_since_last_failure_suspension",
    "station_strictness_bias", "annualized_mileage_v2", "mileage_anomaly_flag",
    "has_prev_mileage", "mileage_plausible_flag", "local_corrosion_index",
    "local_corrosion_delta", "high_risk_model_flag", "suspension_risk_profile",
    "model_age_fail_rate_eb", "make_age_fail_rate_eb",
    "historic_negligence_ratio_smoothed", "negligence_band", "raw_behavioral_count",
    "eb_unified_prior", "mech_decay_brake", "mech_decay_suspension",
    "mech_decay_structure", "mech_decay_steering", "mech_decay_index",
    "mech_decay_index_normalized", "mech_risk_driver", "text_corrosion_index",
    "text_wear_index", "text_leak_index", "text_damage_index",
    "text_corrosion_index_log", "text_wear_index_log", "text_leak_index_log",
    "text_damage_index_log", "has_corrosion_history", "has_wear_history",
    "has_leak_history", "has_damage_history", "mechanism_count", "max_severity_score",
    "severity_escalation_flag", "has_advisory_history", "dominant_mechanism",
    "test_month", "is_winter_test", "day_of_week",
]
NEUTRAL_RATE, NEUTRAL_STATION, NEUTRAL_CORROSION, USUAL_MILES = 0.28, 0.25, 0.5, 10_000.0
_COMPONENTS = ["brakes", "suspension", "steering", "tyres", "structure"]
_MECHANISMS = ["corrosion", "wear", "leak", "damage"]


@dataclass
class Priors:
    """What other vehicles tell: rates by key (column rate), cohort means and lists. A missing table gives the neutral value."""

    model: DataFrame | None = None  # model_id, rate
    make: DataFrame | None = None  # make, rate
    model_age: DataFrame | None = None  # model_id, age_band, rate
    make_age: DataFrame | None = None  # make, age_band, rate
    segment: DataFrame | None = None  # make, age_band, mileage_band, rate
    overall_age_rate: float = NEUTRAL_RATE
    cohort: DataFrame | None = None  # model_id, age_band, mileage, advisories
    overall_mileage: float | None = None
    overall_advisories: float | None = None
    age_decay: dict[int, float] = field(default_factory=dict)
    corrosion: dict[str, float] = field(default_factory=dict)
    high_risk_models: list[str] = field(default_factory=list)


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) if table else F.lit(None).cast("double")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _derived(test: Column) -> Column:
    """A test with the advisories and failures of each component and the mechanisms that its defects name."""

    def defect(d: Column) -> Column:
        text = F.coalesce(F.nullif(d["text"], F.lit("")), d["type"], F.lit(""))
        said = F.lower(F.to_json(d))  # marks may stand in any field of the record
        flags = X.mechanism_flags(text)
        return F.struct(
            said.contains("advisory").alias("adv"), said.contains("fail").alias("fail"), X.defect_component(text).alias("part"), *[
                flags[m].alias(m) for m in _MECHANISMS
            ]
        )

    found = F.transform(F.coalesce(test["defects"], F.array().cast("array<struct<text:string,type:string>>")), defect)
    return F.struct(
        test["test_date"].alias("date"), test["result"].alias("result"), F.coalesce(test["result"] == "FAILED", F.lit(False)).alias("failed"),
        test["odometer"].alias("odometer"),
        test["unit"].alias("unit"), test["expiry"].alias("expiry"), found.alias("defects"),
    )


def _counted(t: Column) -> Column:
    n = lambda keep: F.size(F.filter(t["defects"], keep))
    of = lambda kind, c: lambda d: d[kind] & F.coalesce(d["part"] == c, F.lit(False))
    names = lambda m: lambda d: d["adv"] & d[m]
    advised = [n(of("adv", c)).alias(f"adv_{c}") for c in _COMPONENTS]
    failed = [(t["failed"] & (n(of("fail", c)) > 0)).cast("int").alias(f"fail_{c}") for c in ("brakes", "tyres", "suspension")]
    named = [n(names(m)).alias(m) for m in _MECHANISMS]
    return F.struct(
        *[t[c].alias(c) for c in ("date", "result", "failed", "odometer", "unit", "expiry")], n(lambda d: d["adv"]).alias("adv"), *advised, *failed, *named
    )


def _streaks(name: str, label: str, on: Column, off: Column, n: Column) -> dict[str, Column]:
    """since, streak and whether ever, from the places (newest test 1, null: none) of the newest test that has the flag and of that without it."""
    return {
        "ever": on.isNotNull().cast("int"),
        f"tests_since_last_{label}_{name}": F.coalesce(on - 1, F.lit(999)).cast("int"),
        f"{label}_streak_len_{name}": F.coalesce(off - 1, n).cast("int"),
    }


#: Flags of a counted test whose newest places are kept.
_FLAGS = [f"{kind}_{c}" for kind in ("adv", "fail") for c in ("brakes", "tyres", "suspension")]
_SUMS = ["adv", *[f"adv_{c}" for c in _COMPONENTS], *_MECHANISMS]


def array_summary(tests: Column, day: Column) -> tuple[Column, Column]:
    """The derived tests of an array, newest first, and the summary of a column _t of such tests once counted."""
    numbered = F.transform(F.coalesce(tests, F.array().cast(TESTS)), lambda t, i: F.struct(t["test_date"].alias("d"), (-i).alias("i"), t.alias("t")))
    newest_first = F.transform(F.sort_array(numbered, asc=False), lambda s: _derived(s["t"]))
    t = F.col("_t")
    fails = F.filter(t, lambda x: x["failed"])
    failed = F.transform(t, lambda x: x["failed"].cast("int"))
    within = lambda days: F.size(F.filter(fails, lambda x: F.datediff(day, x["date"]) <= days))
    each = lambda c: F.transform(t, lambda x: x[c])
    flags = lambda c: F.transform(t, lambda x: (x[c] > 0).cast("int"))
    return newest_first, F.struct(
        F.size(t).alias("n"), F.get(t, F.lit(0)).alias("newest"), F.get(t, F.lit(1)).alias("before"), F.size(fails).alias("fails"),
        within(365).alias("fails_365"), within(730).alias("fails_730"),
        F.when(F.size(t) >= 4, _total(F.slice(failed, 1, 2)) - _total(F.slice(failed, 3, 2))).otherwise(0).alias("trend"),
        *[_total(each(c)).alias(f"sum_{c}") for c in _SUMS],
        *[F.nullif(F.array_position(flags(c), v), F.lit(0)).alias(f"{name}_{c}") for c in _FLAGS for name, v in (("on", 1), ("off", 0))],
    )


def running_summary(tests: DataFrame) -> DataFrame:
    """tests with _h: the summary of the vehicle's tests of earlier days; linear in the tests, by running sums over each vehicle.

    tests: vehicle_id, test_id, test_date, result, odometer, unit, expiry, defects and any other columns. Tests of the same day don't see
    each other; of those the one with the smallest test_id counts as the newest. Each test's defects are read once.
    """
    fields = ("test_date", "result", "odometer", "unit", "expiry", "defects")
    others = [c for c in tests.columns if c not in fields[1:]]
    rows = tests.select(*others, _derived(F.struct(*fields)).alias("_d")).withColumn("_c", _counted(F.col("_d"))).drop("_d")
    by_vehicle, day = Window.partitionBy("vehicle_id"), F.unix_date("test_date")
    ordered = by_vehicle.orderBy(day, F.col("test_id").desc())
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    c = lambda name: F.col(f"_c.{name}")
    failed = c("failed").cast("int")
    rows = rows.withColumns({
        "_n": F.row_number().over(ordered), "_before": F.lag("_c", 1).over(ordered), **{f"_f{i}": F.lag(failed, i).over(ordered) for i in (1, 2, 3)},
        "_fails": F.sum(failed).over(running), **{f"_sum_{x}": F.sum(c(x)).over(running) for x in _SUMS},
    })
    last = lambda flag: F.max(F.when(flag, F.col("_n"))).over(running)
    rows = rows.withColumns({f"_{name}_{x}": last((c(x) > 0) == (name == "on")) for x in _FLAGS for name in ("on", "off")})
    state = F.struct(
        F.col("_n").alias("n"), F.col("_c").alias("newest"), F.col("_before").alias("before"), F.col("_fails").cast("int").alias("fails"),
        F.when(F.col("_n") >= 4, failed + F.col("_f1") - F.col("_f2") - F.col("_f3")).otherwise(0).alias("trend"),
        *[F.col(f"_sum_{x}").cast("int").alias(f"sum_{x}") for x in _SUMS],
        *[(F.col("_n") + 1 - F.col(f"_{name}_{x}")).alias(f"{name}_{x}") for x in _FLAGS for name in ("on", "off")],
    )
    until = lambda days: by_vehicle.orderBy(day).rangeBetween(Window.unboundedPreceding, -days)
    old = lambda days: F.coalesce(F.sum(failed).over(until(days + 1)).cast("int"), F.lit(0))
    rows = rows.withColumn("_s", state).select(
        *others, F.max_by("_s", "_n").over(until(1)).alias("_s"), old(365).alias("_old_365"), old(730).alias("_old_730")
    )
    s, none = F.col("_s"), lambda x: F.coalesce(F.col(f"_s.{x}"), F.lit(0)).alias(x)
    return rows.select(*others, F.struct(
        none("n"), s["newest"].alias("newest"), s["before"].alias("before"), none("fails"),
        *[(F.coalesce(s["fails"], F.lit(0)) - F.col(f"_old_{d}")).alias(f"fails_{d}") for d in (365, 730)], none("trend"),
        *[none(f"sum_{x}") for x in _SUMS], *[s[f"{name}_{x}"].alias(f"{name}_{x}") for x in _FLAGS for name in ("on", "off")],
    ).alias("_h"))


def history_features(vehicles: DataFrame, as_of: str | Column, priors: Priors | None = None, keys: tuple[str, ...] = ("registration",)) -> DataFrame:
    """keys and FEATURE_NAMES for every row of vehicles (keys, make, model, postcode, manufacture_date, tests of type TESTS).

    as_of is the date of the prediction, or a column of dates among the keys. Tests may stand in any order, the newest counts as the latest one (of one day the first listed); a
    null or empty array is a vehicle without history. Repeated rows get equal results; other columns are left out.
    """
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    newest_first, summary = array_summary(F.col("tests"), day)
    rows = vehicles.select(*keys, "make", "model", "postcode", "manufacture_date", newest_first.alias("_d"))
    rows = rows.withColumn("_t", F.transform("_d", _counted)).drop("_d").withColumn("_h", summary).drop("_t")
    return summary_features(rows, day, priors, keys)


def summary_features(rows: DataFrame, day: Column, priors: Priors | None, keys: tuple[str, ...]) -> DataFrame:
    """keys and FEATURE_NAMES from the summary _h of each row's history (keys, make, model, postcode, manufacture_date, _h)."""
    p = priors or Priors()
    rows = rows.select(*keys, "make", "model", "postcode", "manufacture_date", "_h")
    h = lambda c: F.col(f"_h.{c}")
    n = h("n")
    at = lambda i, c: h("before" if i else "newest")[c]

    def add(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
        return frame.withColumns(columns)

    # dates, outcomes, counts
    shown = F.coalesce(at(0, "date"), day)
    gap = F.when(n >= 2, F.datediff(at(0, "date"), at(1, "date"))).otherwise(0)
    rows = add(rows, {
        "test_month": F.month(shown).cast("string"), "is_winter_test": F.month(shown).isin(10, 11, 12, 1, 2, 3).cast("int"),
        "day_of_week": F.weekday(shown).cast("string"),
        "prev_cycle_outcome_band": F.when(n == 0, "first_test").when(
            at(0, "result") == "PASSED", "pass"
        ).when(at(0, "result") == "FAILED", "fail").otherwise("unknown"),
        "days_since_last_test": gap, "gap_band": F.when(n >= 2, R.gap_band(gap)).otherwise("first_test"), "n_prior_tests": n,
        "n_prior_fails": h("fails"),
        "fails_last_365d": h("fails_365"), "fails_last_730d": h("fails_730"), "fail_rate_trend": h("trend"),
        "prev_count_advisory": h("sum_adv"),
        "advisory_trend": F.when(n < 2, "unknown").when(
            at(0, "adv") > at(1, "adv"), "increasing"
        ).when(at(0, "adv") < at(1, "adv"), "decreasing").otherwise("stable"),
        "days_late": F.greatest(F.lit(0), F.coalesce(F.datediff(day, at(0, "expiry")), F.lit(0))),
        **{f"_adv_{c}": h(f"sum_adv_{c}") for c in _COMPONENTS}, **{f"text_{m}_index": h(f"sum_{m}") for m in _MECHANISMS},
    })

    # odometer: the newest reading, or the one before it where the yearly use is impossible
    has = at(0, "odometer").isNotNull()
    now, before = to_miles(at(0, "odometer"), at(0, "unit")).cast("double"), to_miles(at(1, "odometer"), at(0, "unit")).cast("double")
    yearly = F.when((gap > 0) & (now > before), (now - before) * 365.0 / gap)
    odd = has & F.coalesce(yearly > 50_000, F.lit(False))
    plain = F.when((gap > 0) & (at(0, "odometer") > at(1, "odometer")), (at(0, "odometer") - at(1, "odometer")) * 365.0 / gap)
    annual = F.when(has & ~odd & plain.isNotNull(), plain)
    rows = add(rows, {
        "test_mileage": F.when(odd, before).when(has, now).otherwise(0.0), "has_prev_mileage": has.cast("int"),
        "mileage_plausible_flag": (has & ~odd).cast("int"), "mileage_anomaly_flag": odd.cast("int"),
        "annualized_mileage_v2": F.coalesce(annual, F.lit(USUAL_MILES)),
        "usage_band_hybrid": F.when(annual.isNull(), "average").otherwise(R.usage_band(annual)),
    })

    # advisories and failures of components, newest test first
    out: dict[str, Column] = {}
    for c in ("brakes", "tyres", "suspension"):
        advised = _streaks(c, "advisory", h(f"on_adv_{c}"), h(f"off_adv_{c}"), n)
        out[f"has_prior_advisory_{c}"] = advised.pop("ever")
        out |= advised
        for k in (1, 2):
            out[f"advisory_in_last_{k}_{c}"] = F.coalesce(h(f"on_adv_{c}") <= k, F.lit(False)).cast("int")
        broken = _streaks(c, "failure", h(f"on_fail_{c}"), h(f"off_fail_{c}"), n)
        out[f"has_prior_failure_{c}"] = out[f"has_ever_failed_{c}"] = broken.pop("ever")
        out |= broken
    for c in ("tyres", "suspension"):
        share = F.least(F.lit(8000.0), F.floor(F.col("test_mileage") / F.greatest(n, F.lit(1))))
        out[f"miles_since_last_advisory_{c}"] = F.when(
            (F.col(f"_adv_{c}") > 0) & (F.col("has_prev_mileage") == 1) & (F.col("test_mileage") > 0), share
        ).otherwise(0.0)
    rows = add(rows, out)

    # texts and decay
    kinds, dominant = R.mechanisms({m: F.col(f"text_{m}_index") for m in _MECHANISMS}, n)
    decay = {c: F.least(0.2 * F.col(f"_adv_{c}"), F.lit(1.0)) for c in _COMPONENTS}
    index, driver = R.decay(
        {label: F.col(f"_adv_{c}") for label, c in (("BRAKE", "brakes"), ("SUSP", "suspension"), ("STEER", "steering"), ("STRUCT", "structure"))}
    )
    age = F.when(F.col("manufacture_date").isNotNull(), F.floor(F.datediff(day, F.col("manufacture_date")) / 365)).otherwise(5).cast("int")
    usual_decay = _lookup(p.age_decay, age)
    rows = add(rows, {
        **{f"text_{m}_index_log": F.log1p(f"text_{m}_index") for m in _MECHANISMS}, **{
            f"has_{m}_history": (F.col(f"text_{m}_index") > 0).cast("int") for m in _MECHANISMS
        },
        "mechanism_count": kinds, "dominant_mechanism": dominant, "has_advisory_history": (F.col("prev_count_advisory") > 0).cast("int"),
        "max_severity_score": F.when(F.col("n_prior_fails") > 0, 2).when(F.col("prev_count_advisory") > 0, 1).otherwise(0),
        "severity_escalation_flag": (F.col("fail_rate_trend") > 0).cast("int"),
        "mech_decay_brake": decay["brakes"], "mech_decay_suspension": decay[
            "suspension"
        ], "mech_decay_structure": decay["structure"], "mech_decay_steering": decay["steering"],
        "mech_decay_index": index, "mech_decay_index_normalized": F.coalesce(F.try_divide(index, F.when(usual_decay > 0, usual_decay)), index),
        "mech_risk_driver": driver,
    })

    # sums of what is there
    per_test = F.log1p(n) / 3.0
    ratio, band = R.negligence(F.col("prev_count_advisory"), n)
    model_id = F.when(F.length("model") > 0, F.concat_ws(" ", "make", "model")).otherwise(F.col("make"))
    index_here = F.coalesce(_lookup(p.corrosion, X.postcode_area(F.col("postcode"))), F.lit(NEUTRAL_CORROSION))
    rows = add(rows, {
        **{f"prev_adv_{c}": F.col(f"_adv_{c}") for c in _COMPONENTS[:4]}, "multi_system_advisory_count": reduce(
            lambda a, b: a + b, [(F.col(f"_adv_{c}") > 0).cast("int") for c in _COMPONENTS]
        ),
        "prior_fail_rate_smoothed": F.coalesce(F.try_divide(F.col("n_prior_fails").cast("double"), n), F.lit(0.0)),
        "recent_fail_intensity": F.col("fails_last_365d"),
        "front_end_advisory_intensity": F.col("_adv_steering") + F.col("_adv_suspension") + F.col("_adv_tyres"),
        "brake_system_stress": F.col("_adv_brakes") + per_test,
        "commercial_wear_proxy": F.log1p(F.col("annualized_mileage_v2") / 10_000) + F.greatest(
            F.lit(0), F.col("days_since_last_test") - 365
        ) / 365.0 + per_test,
        "mdps_score": F.col("days_late") / 365.0, "days_since_pass_ratio": F.col("days_since_last_test") / 365.0,
        "historic_negligence_ratio_smoothed": ratio, "negligence_band": band,
        "raw_behavioral_count": F.col("prev_count_advisory"), "local_corrosion_index": index_here, "local_corrosion_delta": index_here - NEUTRAL_CORROSION,
        "high_risk_model_flag": X.flag_in(F.trim(model_id), p.high_risk_models or [""]), "suspension_risk_profile": F.lit(0.0),
        "station_strictness_bias": F.lit(0.0),
        "station_fail_rate_smoothed": F.lit(NEUTRAL_STATION), "station_x_prev_outcome_fail_rate": F.lit(NEUTRAL_STATION),
        "model_id": model_id, "age_band": R.serving_age_band(age), "mileage_band": R.below(F.col("test_mileage"), R.MILEAGE_BANDS, "100k+"),
    })

    # what other vehicles tell
    def rated(frame: DataFrame, table: DataFrame | None, on: list[str], name: str) -> DataFrame:
        if table is None:
            return frame.withColumn(name, F.lit(None).cast("double"))
        return frame.join(table.select(*on, F.col("rate").alias(name)), on, "left")

    rows = rated(rows, p.model, ["model_id"], "_model")
    rows = rated(rows, p.make, ["make"], "_make")
    rows = rated(rows, p.model_age, ["model_id", "age_band"], "_model_age")
    rows = rated(rows, p.make_age, ["make", "age_band"], "_make_age")
    rows = rated(rows, p.segment, ["make", "age_band", "mileage_band"], "_segment")
    if p.cohort is not None:
        rows = rows.join(
            p.cohort.select("model_id", "age_band", F.col("mileage").alias("_miles"), F.col("advisories").alias("_advised")),
            ["model_id", "age_band"],
            "left",
        )
    else:
        rows = rows.withColumns({"_miles": F.lit(None).cast("double"), "_advised": F.lit(None).cast("double")})
    miles = F.coalesce(F.when(F.col("_miles") > 0, F.col("_miles")), F.lit(p.overall_mileage).cast("double"), F.col("test_mileage"))
    advised = F.coalesce("_advised", F.lit(p.overall_advisories).cast("double"), F.col("prev_count_advisory"))
    known = p.cohort is not None
    by_age = F.coalesce("_model_age", "_make_age", F.lit(p.overall_age_rate))
    rows = add(rows, {
        "model_fail_rate_smoothed": F.coalesce("_model", F.lit(NEUTRAL_RATE)), "make_fail_rate_smoothed": F.coalesce("_make", F.lit(NEUTRAL_RATE)),
        "model_age_fail_rate_eb": by_age,
        "make_age_fail_rate_eb": F.coalesce("_make_age", F.lit(p.overall_age_rate)), "eb_unified_prior": by_age, "segment_fail_rate_smoothed": F.coalesce(
            "_segment", "_make", F.lit(NEUTRAL_RATE)
        ),
        "mileage_cohort_ratio": F.coalesce(F.try_divide(F.col("test_mileage"), F.when(miles > 0, miles)), F.lit(1.0)) if known else F.lit(1.0),
        "advisory_cohort_delta": (F.col("prev_count_advisory") - advised).cast("double") if known else F.lit(0.0),
    })
    return rows.select(*keys, *FEATURE_NAMES)
