"""Windows over histories (WN). Readings of a vehicle are the running sum of its event values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens.functions import rules as R
from roadlens.operators import cube as C
from roadlens.operators import history as H
from roadlens.operators import metrics as M

from .base import BANDED, CUBE, DEFECTS, HISTORY, INSPECTIONS, pick_sql, pick, query
from .relational import RATES, count, rates
from .scalars import COMPONENT_SQL

HI = f"WITH {HISTORY} "
W = "(PARTITION BY vehicle_id ORDER BY test_ts, test_id)"
P = "(PARTITION BY vehicle_id ORDER BY test_ts, test_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
R_DESC = "row_number() OVER (PARTITION BY vehicle_id ORDER BY test_ts DESC, test_id DESC)"
MILES = (
    HI + ", o AS (SELECT *, sum(reading) OVER (PARTITION BY vehicle_id ORDER BY test_ts, test_id ROWS UNBOUNDED PRECEDING) * 40 AS odo FROM history), g "
    f"AS (SELECT *, odo - lag(odo) OVER {W} AS delta, date_diff('day', lag(test_date) OVER {W}, test_date) AS days, lag(odo) OVER {W} AS before FROM "
    "o)"
)


def miles(t):
    """History with odometer, its change, days since the test before and the reading before."""
    rows = t.history().withColumn("odo", F.sum("reading").over(H.oldest_first().rowsBetween(Window.unboundedPreceding, Window.currentRow)) * 40)
    w = H.oldest_first()
    return rows.withColumns(
        {"delta": F.col("odo") - F.lag("odo").over(w), "days": F.datediff("test_date", F.lag("test_date").over(w)), "before": F.lag("odo").over(w)}
    )


@query("wn01_latest", HI + f"SELECT vehicle_id, test_id, outcome FROM (SELECT *, {R_DESC} AS r FROM history) WHERE r = 1")
def _(t):
    return H.latest(t.history()).select("vehicle_id", "test_id", "outcome")


@query("wn02_previous", HI + f"SELECT test_id, lag(test_id) OVER {W} AS prev_id, date_diff('day', lag(test_date) OVER {W}, test_date) AS days FROM history")
def _(t):
    w = H.oldest_first()
    return t.history().select("test_id", F.lag("test_id").over(w).alias("prev_id"), F.datediff("test_date", F.lag("test_date").over(w)).alias("days"))


@query(
    "wn03_previous_outcome",
    HI + f", p AS (SELECT test_id, lag(outcome) OVER {W} AS before, row_number() OVER {W} AS r FROM history) SELECT test_id, CASE WHEN r = 1 THEN "
    "'first_test' WHEN before = 'error' THEN 'fail' WHEN before IN ('view', 'purchase') THEN 'pass' ELSE 'unknown' END AS band FROM p",
)
def _(t):
    w = H.oldest_first()
    before = F.lag("outcome").over(w)
    return t.history().select(
        "test_id",
        F.when(
            F.row_number().over(w) == 1, "first_test"
        ).when(before == "error", "fail").when(before.isin("view", "purchase"), "pass").otherwise("unknown").alias("band"),
    )


@query(
    "wn04_prior_counts",
    HI + f"SELECT test_id, count(*) OVER {P} AS n_prior, coalesce(sum(failed) OVER {P}, 0)::BIGINT AS flagged_prior, round(avg(failed) OVER {P}, 6) AS "
    "prior_rate FROM history",
)
def _(t):
    return H.prior_counts(t.history(), "failed").select("test_id", "n_prior", "flagged_prior", F.round("prior_rate", 6).alias("prior_rate"))


@query(
    "wn05_recent_fails",
    HI + "SELECT test_id, coalesce(sum(failed) OVER (PARTITION BY vehicle_id ORDER BY test_ts RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 1 "
    "MICROSECOND PRECEDING), 0)::BIGINT AS fails_5, coalesce(sum(failed) OVER (PARTITION BY vehicle_id ORDER BY test_ts RANGE BETWEEN INTERVAL "
    "10 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0)::BIGINT AS fails_10 FROM history",
)
def _(t):
    return t.history().select("test_id", H.within_days(F.col("failed"), 5).alias("fails_5"), H.within_days(F.col("failed"), 10).alias("fails_10"))


@query(
    "wn06_fail_trend",
    HI + f", r AS (SELECT vehicle_id, failed, {R_DESC} AS r FROM history) SELECT vehicle_id, CASE WHEN count(*) >= 4 THEN (sum(failed) FILTER (r <= 2) "
    "- sum(failed) FILTER (r IN (3, 4)))::BIGINT ELSE 0 END AS trend FROM r GROUP BY 1",
)
def _(t):
    w = H.oldest_first()
    pair = lambda a, b: F.sum("failed").over(w.rowsBetween(a, b))
    rows = t.history().select(
        "vehicle_id",
        "test_ts",
        "test_id",
        F.when(F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) >= 4, pair(-1, 0) - pair(-3, -2)).otherwise(0).alias("trend"),
    )
    return H.latest(rows).select("vehicle_id", "trend")


@query(
    "wn07_train_trend",
    HI + f", c AS (SELECT test_id, count(*) OVER {P} AS n, coalesce(sum(failed) OVER {P}, 0) AS f, coalesce(sum(failed) OVER (PARTITION BY vehicle_id "
    "ORDER BY test_ts RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS r FROM history) SELECT test_id, "
    "round(greatest(-1, least(1, r - f / greatest(n, 1))), 6) AS trend, round(greatest(0, least(3, r / greatest(f, 0.1))), 6) AS intensity FROM "
    "c",
)
def _(t):
    rows = H.prior_counts(t.history(), "failed").withColumn("r", H.within_days(F.col("failed"), 5))
    hold = lambda c, a, b: F.round(F.greatest(F.lit(a), F.least(F.lit(b), c)), 6)
    return rows.select(
        "test_id",
        hold(F.col("r") - F.col("flagged_prior") / F.greatest("n_prior", F.lit(1)), -1.0, 1.0).alias("trend"),
        hold(F.col("r") / F.greatest(F.col("flagged_prior").cast("double"), F.lit(0.1)), 0.0, 3.0).alias("intensity"),
    )


@query(
    "wn08_advisory_trend",
    HI + f""", r AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY test_ts DESC, test_id DESC) AS r FROM history),
p AS (SELECT vehicle_id, count(*) AS n, sum(advisory) FILTER (r = 1) AS a, sum(advisory) FILTER (r = 2) AS b FROM r WHERE r <= 2 GROUP BY 1)
SELECT vehicle_id, CASE WHEN n < 2 THEN 'unknown' WHEN a > b THEN 'increasing' WHEN a < b THEN 'decreasing' ELSE 'stable' END AS trend FROM p""",
)
def _(t):
    return H.advisory_trend(t.history(), "advisory")


_STREAKS = (
    HI + f", r AS (SELECT *, {R_DESC} AS r FROM history), s AS (SELECT vehicle_id, count(*) AS tests, coalesce(min(r) FILTER (advisory = 1) - 1, 999) AS "
    "since_advisory, coalesce(min(r) FILTER (advisory <> 1) - 1, count(*)) AS streak_advisory, max((advisory = 1 AND r <= 1)::INT) AS "
    "last1_advisory, max((advisory = 1 AND r <= 2)::INT) AS last2_advisory, max(advisory) AS ever_advisory, coalesce(min(r) FILTER (failed = 1) - 1, "
    "999) AS since_failed, coalesce(min(r) FILTER (failed <> 1) - 1, count(*)) AS streak_failed, max((failed = 1 AND r <= 1)::INT) AS last1_failed, "
    "max((failed = 1 AND r <= 2)::INT) AS last2_failed, max(failed) AS ever_failed FROM r GROUP BY 1) "
)


def _part(name: str, columns: list[str]):
    @query(name, _STREAKS + f"SELECT vehicle_id, {', '.join(columns)} FROM s")
    def _(t):
        return H.leading_streaks(t.history(), ["advisory", "failed"]).select("vehicle_id", *columns)


_part("wn09_last_one_two", ["last1_advisory", "last2_advisory", "ever_advisory"])
_part("wn10_tests_since", ["since_advisory", "since_failed"])
_part("wn11_streaks", ["streak_advisory", "streak_failed"])
_part("wn12_prior_or_ever", ["last1_failed", "ever_failed"])


@query("wn13_miles_since_advisory", MILES + f", k AS (SELECT *, sum(failed) OVER (PARTITION BY vehicle_id ORDER BY test_ts, test_id ROWS UNBOUNDED PRECEDING) AS era FROM g) SELECT test_id, round(odo - last_value(CASE WHEN advisory = 1 THEN odo END IGNORE NULLS) OVER (PARTITION BY vehicle_id, era ORDER BY test_ts, test_id ROWS UNBOUNDED PRECEDING), 4) AS since FROM k")
def _(t):
    upto = H.oldest_first().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = miles(t).withColumn("era", F.sum("failed").over(upto))
    era = Window.partitionBy("vehicle_id", "era").orderBy("test_ts", "test_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "test_id", F.round(F.col("odo") - F.last(F.when(F.col("advisory") == 1, F.col("odo")), ignorenulls=True).over(era), 4).alias("since")
    )


@query(
    "wn14_mileage_anomaly",
    MILES + " SELECT test_id, CASE WHEN days <= 0 OR delta < -1000 OR delta > 100000 OR delta * 365.0 / nullif(days, 0) > 40000 THEN 1 ELSE 0 END AS "
    "flag FROM g",
)
def _(t):
    return miles(t).select("test_id", H.anomaly(F.col("delta"), F.col("days")).alias("flag"))


@query(
    "wn15_annualised",
    MILES + " SELECT test_id, round(coalesce(greatest(0.0, least(50000.0, delta * 365.0 / CASE WHEN days > 0 THEN days END)), CASE WHEN reading > 50 "
    "THEN reading * 100 END, 8000.0), 4) AS annual FROM g",
)
def _(t):
    return miles(t).select(
        "test_id",
        F.round(
            F.coalesce(H.annualised(F.col("delta"), F.col("days")), F.when(F.col("reading") > 50, F.col("reading") * 100), F.lit(8000.0)), 4
        ).alias("annual"),
    )


@query(
    "wn16_source_mismatch",
    MILES + ", a AS (SELECT *, greatest(0.0, least(50000.0, delta * 365.0 / CASE WHEN days > 0 THEN days END)) AS annual FROM g) SELECT test_id, CASE "
    "WHEN abs(annual - reading * 200) > 5000 THEN 1 ELSE 0 END AS mismatch, (before IS NOT NULL)::INT AS has_prev, CASE WHEN annual > 0 AND "
    "annual < 50000 THEN 1 ELSE 0 END AS plausible FROM a",
)
def _(t):
    annual = H.annualised(F.col("delta"), F.col("days"))
    rows = miles(t).withColumn("annual", annual)
    return rows.select(
        "test_id",
        F.when(F.abs(F.col("annual") - F.col("reading") * 200) > 5000, 1).otherwise(0).alias("mismatch"),
        F.col("before").isNotNull().cast("int").alias("has_prev"),
        F.when((F.col("annual") > 0) & (F.col("annual") < 50000), 1).otherwise(0).alias("plausible"),
    )


@query(
    "wn17_serving_mileage",
    MILES + """, u AS (SELECT *, test_id % 2 = 0 AS km, round_even(odo, 0) AS o, round_even(before, 0) AS p FROM g),
m AS (SELECT *, CASE WHEN km THEN round_even(o * 0.621371, 0) ELSE o END AS now, CASE WHEN km THEN round_even(p * 0.621371, 0) ELSE p END AS last FROM u),
f AS (SELECT *, coalesce(days > 0 AND now > last AND (now - last) * 365.0 / nullif(days, 0) > 50000, false) AS odd FROM m)
SELECT test_id, CASE WHEN odd THEN last ELSE now END AS miles, CAST(odd AS INT) AS implausible FROM f""",
)
def _(t):
    unit = F.when(F.col("test_id") % 2 == 0, "KM").otherwise("mi")
    reading, odd = H.serving_reading(F.bround("odo"), unit, F.bround("before"), F.col("days"))
    return miles(t).select("test_id", reading.alias("miles"), odd.alias("implausible"))


@query("wn18_display_mileage", MILES + f", f AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY test_ts DESC, test_id DESC) AS r, days > 0 AND (delta < 0 OR delta * 365.0 / nullif(days, 0) > 50000) AS odd FROM g) SELECT vehicle_id, round(CASE WHEN odd THEN before ELSE odo END, 3) AS miles, coalesce(odd, false) AS anomaly FROM f WHERE r = 1")
def _(t):
    odd = F.coalesce((F.col("days") > 0) & ((F.col("delta") < 0) | (F.try_divide(F.col("delta") * 365.0, F.col("days")) > 50000)), F.lit(False))
    rows = miles(t).withColumn("shown", F.struct(F.when(odd, F.col("before")).otherwise(F.col("odo")).alias("miles"), odd.alias("anomaly")))
    return H.latest(rows).select("vehicle_id", F.round("shown.miles", 3).alias("miles"), "shown.anomaly")


@query(
    "wn19_usage_band",
    MILES + ", a AS (SELECT test_id, coalesce(delta * 365.0 / CASE WHEN days > 0 THEN days END, 10000) AS y, days FROM g) SELECT test_id, CASE WHEN "
    "coalesce(days, 0) <= 0 THEN 'average' WHEN y < 5000 THEN 'low' WHEN y < 10000 THEN 'average' WHEN y < 15000 THEN 'high' ELSE 'very_high' "
    "END AS band FROM a",
)
def _(t):
    yearly = F.try_divide(F.col("delta") * 365.0, F.col("days"))
    return miles(t).select("test_id", F.when(F.coalesce("days", F.lit(0)) <= 0, "average").otherwise(R.usage_band(yearly)).alias("band"))


@query(
    "wn20_coverage",
    HI + f", c AS (SELECT test_id, test_date, min(test_date) OVER {P} AS first FROM history) SELECT test_id, date_diff('day', DATE '2024-01-01', "
    "test_date) AS window_days, round(coalesce(date_diff('day', first, test_date), 0) / 365.25, 6) AS years, (first IS NOT NULL)::INT AS "
    "has_prior, (first = DATE '2024-01-01')::INT AS left_truncated FROM c",
)
def _(t):
    first = F.min("test_date").over(H.earlier())
    start = F.lit("2024-01-01").cast("date")
    return t.history().select(
        "test_id",
        F.datediff("test_date", start).alias("window_days"),
        F.round(F.coalesce(F.datediff("test_date", first), F.lit(0)) / 365.25, 6).alias("years"),
        first.isNotNull().cast("int").alias("has_prior"),
        (first == start).cast("int").alias("left_truncated"),
    )


@query("wn21_rank", RATES + "SELECT model_id, row_number() OVER (ORDER BY risk DESC, model_id) AS place FROM rates")
def _(t):
    return rates(t).select("model_id", F.row_number().over(Window.orderBy(F.desc("risk"), "model_id")).alias("place"))  # over models, not rows


@query(
    "wn24_mileage_percentile",
    f"WITH {BANDED} SELECT vehicle_id, round(sum(p), 5) AS percentile FROM (SELECT vehicle_id, percent_rank() OVER (PARTITION BY make, age_band ORDER "
    "BY test_mileage) AS p FROM banded) GROUP BY 1",
)
def _(t):
    ranked = M.percent_ranks(t.banded().select("vehicle_id", "make", "age_band", "test_mileage"), "test_mileage", ["make", "age_band"], "p")
    return ranked.groupBy("vehicle_id").agg(F.round(F.sum("p"), 5).alias("percentile"))


_PRIORS = (
    f"WITH {INSPECTIONS}, m AS (SELECT make, year(test_date) * 12 + month(test_date) AS month, sum(target) AS f, count(*) AS n FROM inspections GROUP BY "
    "ALL), s AS (SELECT make, month, sum(f) OVER (PARTITION BY make ORDER BY month RANGE BETWEEN 36 PRECEDING AND 1 PRECEDING) AS lf, sum(n) OVER "
    "(PARTITION BY make ORDER BY month RANGE BETWEEN 36 PRECEDING AND 1 PRECEDING) AS ln, sum(f) OVER (PARTITION BY make ORDER BY month RANGE BETWEEN 6 "
    "PRECEDING AND 1 PRECEDING) AS sf, sum(n) OVER (PARTITION BY make ORDER BY month RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING) AS sn FROM m), g AS "
    "(SELECT avg(target) AS r FROM inspections), e AS (SELECT make, month, (lf + 20 * r) / (ln + 20) AS long, (sf + 20 * r) / (sn + 20) AS short FROM s, "
    "g WHERE ln IS NOT NULL AND sn IS NOT NULL)"
)


@query(
    "wn25_drift_ratio",
    _PRIORS + " SELECT make, month, round(long, 9) AS long, round(short, 9) AS short, round(greatest(0.5, least(2.0, short / long)), 9) AS drift FROM e",
)
def _(t):
    rows = t.inspections()
    months = rows.groupBy("make", (F.year("test_date") * 12 + F.month("test_date")).alias("month")).agg(F.sum("target").alias("f"), count())
    over = lambda k: Window.partitionBy("make").orderBy("month").rangeBetween(-k, -1)
    overall = rows.agg(F.avg("target").alias("r"))
    eb = lambda k: (F.sum("f").over(over(k)) + 20 * F.col("r")) / (F.sum("n").over(over(k)) + 20)
    # one row
    shrunk = months.join(F.broadcast(overall)).select(
        "make", "month", eb(36).alias("long"), eb(6).alias("short")
    ).where("long is not null and short is not null")
    return shrunk.select(
        "make",
        "month",
        F.round("long", 9).alias("long"),
        F.round("short", 9).alias("short"),
        F.round(F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("short") / F.col("long"))), 9).alias("drift"),
    )


@query(
    "wn26_days_late",
    HI + """, d AS (SELECT test_id, test_date, date_diff('day', lag(test_date) OVER {W}, test_date) AS days, lag(test_date +
CAST(test_id % 5 AS INT)) OVER {W} AS expiry FROM history)
SELECT test_id, CASE WHEN expiry IS NULL THEN 0 ELSE greatest(0, date_diff('day', expiry, test_date)) END AS late,
coalesce(days, 730) - 365 AS train_late FROM d""".replace("{W}", W),
)
def _(t):
    """Every test has an expiry date some days after it, which the next test is held against."""
    expiry = F.lag(F.date_add("test_date", (F.col("test_id") % 5).cast("int"))).over(H.oldest_first())
    days = F.datediff("test_date", F.lag("test_date").over(H.oldest_first()))
    return t.history().select("test_id", H.days_late(F.col("test_date"), expiry).alias("late"), H.training_days_late(days).alias("train_late"))


@query(
    "wn27_severity",
    HI + f", c AS (SELECT test_id, coalesce(sum(failed) OVER {P}, 0) AS f, coalesce(sum(advisory) OVER {P}, 0) AS a, coalesce(sum(failed) OVER "
    "(PARTITION BY vehicle_id ORDER BY test_ts, test_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) - coalesce(sum(failed) OVER (PARTITION BY "
    "vehicle_id ORDER BY test_ts, test_id ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING), 0) AS trend FROM history) SELECT test_id, CASE WHEN f > 0 "
    "THEN 2 WHEN a > 0 THEN 1 ELSE 0 END AS severity, (trend > 0)::INT AS escalation FROM c",
)
def _(t):
    w = H.oldest_first()
    some = lambda c: F.coalesce(F.sum(c).over(H.earlier()), F.lit(0)) > 0
    pair = lambda a, b: F.coalesce(F.sum("failed").over(w.rowsBetween(a, b)), F.lit(0))
    return t.history().select(
        "test_id",
        F.when(some("failed"), 2).when(some("advisory"), 1).otherwise(0).alias("severity"),
        (pair(-2, -1) - pair(-4, -3) > 0).cast("int").alias("escalation"),
    )


@query(
    "wn28_best_worst_band",
    f"WITH {CUBE}, b AS (SELECT model_id, age_band, round(sum(risk * n) / sum(n), 9) AS risk FROM cube GROUP BY ALL) SELECT model_id, arg_max(age_band, "
    "risk) AS worst, arg_min(age_band, risk) AS best FROM b GROUP BY 1",
)
def _(t):
    bands = t.cube().groupBy("model_id", "age_band").agg(C.weighted("risk", digits=9).alias("risk"))
    return bands.groupBy("model_id").agg(F.max_by("age_band", "risk").alias("worst"), F.min_by("age_band", "risk").alias("best"))


_DEFECTS = (
    HI + f", d AS (SELECT vehicle_id, test_id, failed, advisory, {pick_sql(DEFECTS, 'test_id * 3')} AS defect FROM history), c AS (SELECT *, "
    f"{COMPONENT_SQL} AS component FROM d) "
)


def defects(t):
    from roadlens.functions import text as X

    return t.history().select(
        "vehicle_id", "test_id", "test_ts", "failed", "advisory", X.defect_component(pick(DEFECTS, F.col("test_id") * 3)).alias("component")
    )


@query(
    "wn29_advisory_counts",
    _DEFECTS + "SELECT vehicle_id, sum(advisory)::BIGINT AS total, count(*) FILTER (advisory = 1 AND component = 'brakes') AS brakes, count(*) FILTER "
    "(advisory = 1 AND component = 'tyres') AS tyres, count(DISTINCT CASE WHEN advisory = 1 THEN component END) AS systems FROM c GROUP BY "
    "1",
)
def _(t):
    of = lambda c: F.count_if((F.col("advisory") == 1) & (F.col("component") == c))
    return defects(t).groupBy("vehicle_id").agg(
        F.sum("advisory").alias("total"),
        of("brakes").alias("brakes"),
        of("tyres").alias("tyres"),
        F.count_distinct(F.when(F.col("advisory") == 1, F.col("component"))).alias("systems"),
    )


@query(
    "wn30_component_failures",
    _DEFECTS + "SELECT vehicle_id, max((failed = 1 AND component = 'brakes')::INT) AS brakes, max((failed = 1 AND component = 'suspension')::INT) AS "
    "suspension, max((failed = 1 AND component = 'tyres')::INT) AS tyres FROM (SELECT vehicle_id, failed, coalesce(component, '') AS "
    "component FROM c) GROUP BY 1",
)
def _(t):
    ever = lambda c: F.max(((F.col("failed") == 1) & (F.coalesce("component", F.lit("")) == c)).cast("int"))
    return defects(t).groupBy("vehicle_id").agg(*[ever(c).alias(c) for c in ("brakes", "suspension", "tyres")])
