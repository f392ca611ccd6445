"""Aggregations (AG)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens.functions import rules as R
from roadlens.functions import text as X
from roadlens.operators import cube as C
from roadlens.operators import encoders as E
from roadlens.operators import metrics as M
from roadlens.operators import relational as O
from roadlens.operators import sketches as SK

from . import oracle_values as OV
from .base import BANDED, CUBE, HISTORY, INSPECTIONS, VEHICLES, query
from .joins import eb_sql
from .relational import RATES, count, rates
from .scalars import _ARG, BASE_MODEL_CTE, CANONICAL_SQL, PLATT_SQL, POWER_SQL, REGIME_SQL

IN, BA, CU, HI, VE = f"WITH {INSPECTIONS} ", f"WITH {BANDED} ", f"WITH {CUBE} ", f"WITH {HISTORY} ", f"WITH {VEHICLES} "
COMPONENT_SUMS = ", ".join(f"round(sum(risk_{c} * n) / sum(n), 6) AS risk_{c}" for c in R.COMPONENTS)


@query("ag01_base_rate", IN + "SELECT make, sum(target)::BIGINT AS failures, count(*) AS n, round(avg(target), 6) AS rate FROM inspections GROUP BY 1")
def _(t):
    return t.inspections().groupBy("make").agg(F.sum("target").alias("failures"), count(), F.round(F.avg("target"), 6).alias("rate"))


def encoder_query(name: str, levels: list[list[str]], ks: list[float], least: int = 0, overrides: dict[int, float] | None = None):
    """The finest table of a fitted encoder."""
    used = [(overrides or {}).get(i, k) for i, k in enumerate(ks)]
    keys = ", ".join(levels[-1])
    sql = BA + ", " + eb_sql(levels, used, least) + f" SELECT {keys}, n, round(rate, 7) AS rate FROM e{len(levels)}"

    @query(name, sql)
    def _(t):
        fitted = E.Encoder(levels, ks, least, overrides or {}).fit(t.banded(), "target")
        return fitted[-1].withColumn("rate", F.round("rate", 7))


encoder_query("ag02_shrinkage", [["area"]], [20.0], 100)
encoder_query("ag03_make_segment", [["make"], ["make", "age_band", "mileage_band"]], [10.0, 5.0])
encoder_query("ag04_make_model", [["make"], ["make", "model_id"]], [10.0, 20.0], 0, {1: 25.0})
encoder_query("ag06_station_outcome", [["area"], ["area", "prev_outcome"]], [100.0, 50.0])
encoder_query(
    "ag41_unified_prior",
    [["prev_outcome"], ["prev_outcome", "age_band"], ["prev_outcome", "age_band", "make"], ["prev_outcome", "age_band", "make", "model_id"]],
    [50.0, 50.0, 20.0, 10.0],
)

_REGIME_SQL = VE + f""", v AS (SELECT {REGIME_SQL} AS regime, {POWER_SQL} AS powertrain, split_part(model_id, ' ', 1) AS make, (price > 1400)::INT AS target,
CASE WHEN size % 20 < 3 THEN '0-2' WHEN size % 20 < 6 THEN '3-5' WHEN size % 20 < 11 THEN '6-10' WHEN size % 20 < 16 THEN '11-15'
ELSE '15+' END AS age_band, CASE WHEN price < 1300 THEN '0-30k' ELSE '30k-60k' END AS mileage_band FROM vehicles),
g AS (SELECT avg(target) AS rate
FROM v), d AS (SELECT unnest(['Car', 'Motorcycle', 'Commercial']) AS regime), w AS (SELECT unnest(['ICE', 'HEV', 'PHEV', 'BEV']) AS powertrain),
r AS (SELECT regime, (coalesce(sum(target), 0) + 10 * (SELECT rate FROM g)) / (count(target) + 10) AS rate FROM d LEFT JOIN v USING (regime) GROUP BY 1),
p AS (SELECT regime, powertrain, count(target) AS n, (coalesce(sum(target), 0) + 10 * any_value(r.rate)) / (count(target) + 10) AS rate FROM d CROSS
JOIN w JOIN r USING (regime) LEFT JOIN v USING (regime, powertrain) GROUP BY ALL)"""


def _regime_rows(t):
    return t.vehicles().select(
        "vehicle_id", X.regime(F.col("raw_make")).alias("regime"), X.powertrain(F.col("model_id")).alias("powertrain"),
        X.first_word(F.col("model_id")).alias("make"), (F.col("price") > 1400).cast("int").alias("target"), R.age_band(F.col("size") % 20).alias("age_band"),
        F.when(F.col("price") < 1300, "0-30k").otherwise("30k-60k").alias("mileage_band"),
    )


_SEGMENT = ["age_band", "mileage_band"]


def _regimes(rows):
    return E.regime_hierarchy(rows, "target", _SEGMENT, ["Car", "Motorcycle", "Commercial"], ["ICE", "HEV", "PHEV", "BEV"])


@query("ag05_regime_dense", _REGIME_SQL + " SELECT regime, powertrain, n, round(rate, 6) AS rate FROM p")
def _(t):
    return _regimes(_regime_rows(t))["powertrain"].withColumn("rate", F.round("rate", 6))


@query(
    "ag05b_regime_segments",
    _REGIME_SQL + """, k AS (SELECT make, regime, powertrain, (sum(target) + 10 * any_value(p.rate)) / (count(*) + 10) AS rate FROM v
JOIN p USING (regime, powertrain) GROUP BY ALL),
m AS (SELECT make, arg_max(rate, regime || '/' || powertrain) AS rate FROM k GROUP BY 1)
SELECT make, age_band, mileage_band, count(*) AS n, round((sum(target) + 5 * any_value(m.rate)) / (count(*) + 5), 6) AS rate FROM v
JOIN m USING (make) GROUP BY ALL""",
)
def _(t):
    return _regimes(_regime_rows(t))["segment"].withColumn("rate", F.round("rate", 6))


_FITTED = _REGIME_SQL.replace("FROM vehicles),", "FROM vehicles WHERE split_part(model_id, ' ', 1) NOT IN ('SKODA', 'TESLA') AND NOT (split_part(model_id, ' ', 1) = 'FORD' AND size % 20 < 3)),", 1)


@query(
    "ag05c_regime_features",
    _FITTED + f""", k AS (SELECT make, regime, powertrain, (sum(target) + 10 * any_value(p.rate)) / (count(*) + 10) AS rate FROM v JOIN p USING (regime, powertrain) GROUP BY ALL),
m AS (SELECT make, arg_max(rate, regime || '/' || powertrain) AS rate FROM k GROUP BY 1),
s AS (SELECT make, age_band, mileage_band, (sum(target) + 5 * any_value(m.rate)) / (count(*) + 5) AS rate FROM v JOIN m USING (make) GROUP BY ALL),
a AS (SELECT vehicle_id, {REGIME_SQL} AS regime, {POWER_SQL} AS powertrain, split_part(model_id, ' ', 1) AS make,
CASE WHEN size % 20 < 3 THEN '0-2' WHEN size % 20 < 6 THEN '3-5' WHEN size % 20 < 11 THEN '6-10' WHEN size % 20 < 16 THEN '11-15' ELSE '15+' END AS age_band,
CASE WHEN price < 1300 THEN '0-30k' ELSE '30k-60k' END AS mileage_band, CASE WHEN vehicle_id % 3 > 0 THEN 'pass' END AS prev FROM vehicles)
SELECT vehicle_id, round(r.rate, 6) AS regime_fail_rate, round(p.rate, 6) AS powertrain_fail_rate, round(coalesce(m.rate, p.rate), 6) AS make_fail_rate_smoothed,
round(coalesce(s.rate, m.rate, p.rate), 6) AS segment_fail_rate_smoothed, a.make || '_' || a.age_band AS make_x_age_band,
a.make || '_' || coalesce(prev, 'UNKNOWN') AS make_x_prev_outcome FROM a JOIN r USING (regime) JOIN p USING (regime, powertrain)
LEFT JOIN m ON a.make = m.make LEFT JOIN s ON a.make = s.make AND a.age_band = s.age_band AND a.mileage_band = s.mileage_band""",
)
def _(t):
    """Fitted without two makers and one segment of a third, applied to all vehicles."""
    rows = _regime_rows(t)
    tables = _regimes(rows.where("make not in ('SKODA', 'TESLA') and not (make = 'FORD' and age_band = '0-2')"))
    asked = rows.withColumn("prev_outcome", F.when(F.col("vehicle_id") % 3 > 0, "pass"))
    rates = ("regime_fail_rate", "powertrain_fail_rate", "make_fail_rate_smoothed", "segment_fail_rate_smoothed")
    found = E.regime_transform(asked, tables, _SEGMENT)
    return found.select("vehicle_id", *[F.round(c, 6).alias(c) for c in rates], "make_x_age_band", "make_x_prev_outcome")


@query(
    "ag07_strictness",
    BA + ", c AS (SELECT make, age_band, avg(target) AS expected FROM banded GROUP BY ALL) SELECT area, round(greatest(0.5, least(2.0, (sum(target) + "
    "10.0) / (sum(expected) + 10.0))), 6) AS strictness FROM banded JOIN c USING (make, age_band) GROUP BY area",
)
def _(t):
    return E.observed_expected(t.banded(), "area", ["make", "age_band"], "target").withColumn("strictness", F.round("strictness", 6))


@query(
    "ag08_cohort_mean",
    BA + ", c AS (SELECT model_id, age_band, avg(test_mileage) AS m, count(*) AS n FROM banded GROUP BY ALL), o AS (SELECT model_id, "
    "avg(test_mileage) AS m FROM banded GROUP BY 1) SELECT c.model_id, age_band, n, round(CASE WHEN n < 40 THEN o.m ELSE c.m END, 4) AS mean "
    "FROM c JOIN o USING (model_id)",
)
def _(t):
    rows = t.banded()
    cells = rows.groupBy("model_id", "age_band").agg(F.avg("test_mileage").alias("m"), count())
    models = rows.groupBy("model_id").agg(F.avg("test_mileage").alias("om"))
    return cells.join(models, "model_id").select(
        "model_id", "age_band", "n", F.round(F.when(F.col("n") < 40, F.col("om")).otherwise(F.col("m")), 4).alias("mean")
    )


@query(
    "ag09_weighted_rates",
    CU + f"SELECT model_id, age_band, sum(n)::BIGINT AS n, round(sum(risk * n) / sum(n), 6) AS risk, {COMPONENT_SUMS} FROM cube GROUP BY model_id, "
    "age_band",
)
def _(t):
    return C.weighted_rates(t.cube(), ["model_id", "age_band"], R.COMPONENTS)


@query(
    "ag10_keyless_having",
    CU + f"SELECT sum(n)::BIGINT AS n, round(sum(risk * n) / sum(n), 6) AS risk, {COMPONENT_SUMS} FROM cube WHERE starts_with(model_id, 'Brand#12') "
    "HAVING sum(n) >= 100",
)
def _(t):
    return C.weighted_rates(t.cube().where(F.col("model_id").startswith("Brand#12")), [], R.COMPONENTS).where("n >= 100")


def _rank_sql(where: str, worst_first: bool, least: int) -> str:
    order = "risk DESC" if worst_first else "risk"
    return (
        CU + f", r AS (SELECT model_id, sum(n)::BIGINT AS n, round(sum(risk * n) / sum(n), 6) AS risk, {COMPONENT_SUMS} FROM cube {where} GROUP BY 1 "
        f"HAVING sum(n) >= {least}), k AS (SELECT *, row_number() OVER (ORDER BY {order}, model_id) AS rank FROM r) SELECT rank, model_id, n, risk, "
        f"{_ARG} AS worst FROM k WHERE rank <= 10"
    )


@query("ag11_ranking", _rank_sql("", True, 100))
def _(t):
    return C.ranking(C.weighted_rates(t.cube(), ["model_id"], R.COMPONENTS), "model_id", 100, 10, True, R.COMPONENTS)


@query("ag12_band_ranking", _rank_sql("WHERE age_band = '0-2'", False, 20))
def _(t):
    return C.ranking(C.weighted_rates(t.cube().where("age_band = '0-2'"), ["model_id"], R.COMPONENTS), "model_id", 20, 10, False, R.COMPONENTS)


_UNPIVOT = "unnest([" + ", ".join(repr(c) for c in R.COMPONENTS) + "]) AS component, unnest([" + ", ".join(f"risk_{c}" for c in R.COMPONENTS) + "]) AS risk"


@query(
    "ag13_breakdown",
    CU + f", r AS (SELECT age_band, {COMPONENT_SUMS} FROM cube GROUP BY 1 UNION ALL SELECT 'all', {COMPONENT_SUMS} FROM cube) SELECT age_band, "
    f"{_UNPIVOT} FROM r",
)
def _(t):
    per_band = C.weighted_rates(t.cube(), ["age_band"], R.COMPONENTS)
    overall = C.weighted_rates(t.cube(), [], R.COMPONENTS).withColumn("age_band", F.lit("all"))
    return C.breakdown(per_band.unionByName(overall), ["age_band"], R.COMPONENTS)


@query(
    "ag14_component_hub",
    CU + "SELECT model_id, sum(n)::BIGINT AS n, round(sum(risk_brakes * n) / sum(n), 7) AS brakes FROM cube GROUP BY 1 HAVING sum(n) >= 300 ORDER BY "
    "round(sum(risk_brakes * n) / sum(n), 7) DESC, model_id LIMIT 50",
)
def _(t):
    return t.cube().groupBy("model_id").agg(
        F.sum("n").alias("n"), C.weighted("risk_brakes", digits=7).alias("brakes")
    ).where("n >= 300").orderBy(F.desc("brakes"), "model_id").limit(50)


@query(
    "ag15_models_by_maker",
    RATES + ", k AS (SELECT split_part(model_id, ' ', 1) AS make, *, row_number() OVER (PARTITION BY split_part(model_id, ' ', 1) ORDER BY n DESC, "
    "model_id) AS place FROM rates) SELECT * FROM k WHERE place <= 3",
)
def _(t):
    named = rates(t).withColumn("make", X.first_word(F.col("model_id")))
    return named.withColumn("place", F.row_number().over(Window.partitionBy("make").orderBy(F.desc("n"), "model_id"))).where("place <= 3")


@query(
    "ag16_funnel",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS total, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = "
    "'signup') AS signups, count(*) FILTER (event_type = 'purchase' AND value > 50) AS large FROM events GROUP BY 1",
)
def _(t):
    kind = F.col("event_type")
    return t("events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kind == "view").alias("views"),
        F.count_if(kind == "signup").alias("signups"),
        F.count_if((kind == "purchase") & (F.col("value") > 50)).alias("large"),
    )


@query("ag17_distinct_vehicles", "SELECT event_type, count(DISTINCT user_id) AS vehicles FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("vehicles"))


@query(
    "ag17b_sketched_levels",
    " UNION ALL ".join(
        f"SELECT '{name}' AS level, {key} AS key, count(*) AS n, true AS distinct_ok, true AS p50_ok, true AS p95_ok FROM events GROUP BY ALL"
        for name, key in (("all", "'all'"), ("kind", "event_type"), ("day", "CAST(CAST(ts AS DATE) AS VARCHAR)"), ("kind_day", "event_type || '/' || CAST(CAST(ts AS DATE) AS VARCHAR)"))
    ),
)
def _(t):
    """Distinct vehicles and quantiles of four levels, merged from sketches by kind and day that are made in one scan, held against exact ones.

    A distinct count is right within three standard errors, a quantile if the share of rows up to it is within the sketch's bound.
    """
    rows = t("events").select(F.col("event_type").alias("kind"), F.to_date("ts").cast("string").alias("day"), "user_id", "value")
    sketches = M.stored(SK.sketch(rows, ["kind", "day"], "user_id", "value"))
    wanted = {"all": [], "kind": ["kind"], "day": ["day"], "kind_day": ["kind", "day"]}
    found = SK.levels(sketches, wanted, {"p50": 0.5, "p95": 0.95})
    exact = None
    for name, keys in wanted.items():
        key = F.concat_ws("/", *keys) if keys else F.lit("all")
        met = rows.withColumns({"level": F.lit(name), "key": key}).join(F.broadcast(found.where(F.col("level") == name).drop("level", "n")), "key")  # one row a key
        share = lambda q: F.avg((F.col("value") <= F.col(q)).cast("double"))
        below = lambda q: F.avg((F.col("value") < F.col(q)).cast("double"))
        within = lambda q, p: (share(q) >= p - SK.KLL_ERROR) & (below(q) <= p + SK.KLL_ERROR)
        n = F.count_distinct("user_id")
        one = met.groupBy("level", "key").agg(
            count(), (F.abs(F.first("distinct") - n) <= 3 * SK.HLL_ERROR * n).alias("distinct_ok"), within("p50", 0.5).alias("p50_ok"), within("p95", 0.95).alias("p95_ok")
        )
        exact = one if exact is None else exact.unionByName(one)
    return exact


@query(
    "ag18_conversion",
    "SELECT user_id, round(100.0 * count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0), 6) AS pct FROM events "
    "GROUP BY 1",
)
def _(t):
    hits = lambda v: F.count_if(F.col("event_type") == v)
    return t("events").groupBy("user_id").agg(F.round(F.try_divide(100.0 * hits("purchase"), hits("view")), 6).alias("pct"))


@query(
    "ag19_sources",
    "SELECT coalesce(CASE WHEN source <> 'src3' THEN source END, 'direct') AS source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source "
    "LIMIT 10",
)
def _(t):
    source = F.coalesce(F.when(F.col("source") != "src3", F.col("source")), F.lit("direct"))
    return t("documents").groupBy(source.alias("source")).agg(count()).orderBy(F.desc("n"), "source").limit(10)


@query(
    "ag20_month_to_date",
    "SELECT count(*) AS total, count(*) FILTER (ts >= date_trunc('month', TIMESTAMP '2024-01-20')) AS month, count(*) FILTER (ts >= date_trunc('week', "
    "TIMESTAMP '2024-01-20')) AS week FROM events",
)
def _(t):
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return t("events").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ts") >= F.date_trunc("month", now)).alias("month"),
        F.count_if(F.col("ts") >= F.date_trunc("week", now)).alias("week"),
    )


@query(
    "ag21_makers",
    VE + f", m AS (SELECT {CANONICAL_SQL} AS make FROM vehicles) SELECT make, count(*) AS n FROM m WHERE make IS NOT NULL GROUP BY 1 HAVING count(*) >= 10",
)
def _(t):
    return t.vehicles().select(X.canonical_make(F.col("raw_make")).alias("make")).where("make is not null").groupBy("make").agg(count()).where("n >= 10")


@query(
    "ag22_base_models",
    VE + ", " + BASE_MODEL_CTE + """, c AS (SELECT b.make, b.model, v.model_id, count(*) AS n FROM base b JOIN vehicles v USING (vehicle_id)
WHERE model IS NOT NULL GROUP BY ALL),
d AS (SELECT make, model, max(n) AS support, count(*) AS variants FROM c GROUP BY make, model)
SELECT * FROM d WHERE (make = 'FORD' AND model IN ('FIESTA', 'TRANSIT', 'FOCUS')) OR (make = 'BMW' AND model IN ('3 SERIES'))
UNION ALL SELECT make, model, support, variants FROM (SELECT *, row_number() OVER (PARTITION BY make ORDER BY model) AS r FROM d
WHERE make NOT IN ('FORD', 'BMW') AND regexp_full_match(model, '[A-Za-z]{3,}')) WHERE r <= 30""",
)
def _(t):
    make = X.raw_make(F.col("model_id"))
    cells = t.vehicles().select(
        make.alias("make"), X.base_model(F.col("model_id"), make).alias("model"), "model_id"
    ).where("model is not null").groupBy("make", "model", "model_id").agg(count())
    return C.base_model_list(cells, {"FORD": ["FIESTA", "TRANSIT", "FOCUS"], "BMW": ["3 SERIES"]})


_MID = "CASE age_band WHEN '0-2' THEN 1 WHEN '3-5' THEN 4 WHEN '6-10' THEN 8 WHEN '11-15' THEN 13 ELSE 17 END"
_YEARS = (
    CU + f", y AS (SELECT model_id, CAST(greatest(1990, 2024 - max({_MID}) - 5) AS INT) AS first_year, CAST(least(2024, 2024 - min({_MID})) AS INT) AS "
    "last_year FROM cube GROUP BY 1)"
)


def years(t):
    mid = F.create_map(*[F.lit(x) for p in {"0-2": 1, "3-5": 4, "6-10": 8, "11-15": 13}.items() for x in p])
    middle = R.map_or(mid, F.col("age_band"), F.lit(17))
    return t.cube().groupBy("model_id").agg(
        F.greatest(F.lit(1990), 2024 - F.max(middle) - 5).alias("first_year"), F.least(F.lit(2024), 2024 - F.min(middle)).alias("last_year")
    )


@query("ag23_production_years", _YEARS + " SELECT * FROM y")
def _(t):
    return years(t)


@query(
    "ag24_year_check",
    _YEARS + " SELECT p_partkey, CASE WHEN first_year IS NULL THEN 'unknown' WHEN 1990 + p_size < first_year THEN 'too_early' WHEN 1990 + p_size > "
    "last_year THEN 'too_late' ELSE 'valid' END AS verdict FROM part LEFT JOIN y ON model_id = concat(p_brand, ' ', CASE WHEN p_partkey % 9 "
    "= 0 THEN 'X' ELSE p_type END)",
)
def _(t):
    asked = t("part").select(
        "p_partkey",
        (1990 + F.col("p_size")).alias("year"),
        F.concat_ws(" ", "p_brand", F.when(F.col("p_partkey") % 9 == 0, "X").otherwise(F.col("p_type"))).alias("model_id"),
    )
    verdict = F.when(F.col("first_year").isNull(), "unknown").when(
        F.col("year") < F.col("first_year"), "too_early"
    ).when(F.col("year") > F.col("last_year"), "too_late").otherwise("valid")
    return asked.join(years(t), "model_id", "left").select("p_partkey", verdict.alias("verdict"))


@query(
    "ag25_boundaries",
    CU + " UNION ALL ".join(
        f"SELECT '{c}' AS component, count(*) FILTER (round(risk_{c}, 2) <= 0) AS zeros, count(*) FILTER (risk_{c} >= 1) AS ones FROM cube" for c in R.COMPONENTS
    ),
)
def _(t):
    return C.breakdown(t.cube(), ["model_id"], R.COMPONENTS).groupBy("component").agg(
        F.count_if(F.round("risk", 2) <= 0).alias("zeros"), F.count_if(F.col("risk") >= 1).alias("ones")
    )


@query(
    "ag26_sparse_rows",
    CU + f"SELECT count(*) AS sparse, count(*) FILTER ({' + '.join(f'risk_{c}' for c in R.COMPONENTS)} > 0) AS smoothed FROM cube WHERE n < 20 AND "
    "failures = 0",
)
def _(t):
    total = sum((F.col(f"risk_{c}") for c in R.COMPONENTS), F.lit(0.0))
    return t.cube().where("n < 20 and failures = 0").agg(F.count(F.lit(1)).alias("sparse"), F.count_if(total > 0).alias("smoothed"))


_PLACE = "CASE mileage_band WHEN '0-30k' THEN 1 WHEN '30k-60k' THEN 2 WHEN '60k-100k' THEN 3 ELSE 4 END"


def _falls_sql(scope: str, axis: str, order: list[str]) -> str:
    place = "CASE " + axis + " " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(order)) + " END"
    return f"""SELECT scope, '{axis}' AS axis, count(*) FILTER (fall > 0 AND NOT (fall > 2 AND least(n, before_n) >= 100)) AS soft,
count(*) FILTER (fall > 2 AND least(n, before_n) >= 100) AS hard
FROM (SELECT scope, n, lag(n) OVER w AS before_n, 100 * (lag(risk) OVER w - risk) / lag(risk) OVER w AS fall
FROM (SELECT {scope} AS scope, {place} AS place, sum(n) AS n, sum(risk * n) / sum(n) AS risk
FROM cube WHERE {place} IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY scope ORDER BY place)) GROUP BY scope"""


_AGES, _MILES = ["0-2", "3-5", "6-10", "11-15", "15+"], ["0-30k", "30k-60k", "60k-100k", "100k+"]


@query(
    "ag27_monotonicity",
    CU + " UNION ALL ".join(
        _falls_sql(scope, axis, order) for scope in ("model_id", "'all'") for axis, order in (("age_band", _AGES), ("mileage_band", _MILES))
    ),
)
def _(t):
    cube = t.cube()
    parts = [M.falls(cube, axis, order, scope) for scope in ("model_id", None) for axis, order in (("age_band", _AGES), ("mileage_band", _MILES))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_PARTS = ["brakes", "suspension", "tyres", "steering", "visibility", "lamps", "body"]


def _fall_list_sql(scope: str, axis: str, order: list[str], rate: str, name: str) -> str:
    place = f"CASE {axis} " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(order)) + " END"
    return f"""SELECT '{name}' AS component, scope, '{axis}' AS axis, lower_band, higher_band, round(lower_rate, 9) AS lower_rate, round(higher_rate, 9) AS higher_rate,
round(fall, 6) AS fall_pct, fall > 2 AND least(n, before_n) >= 100 AS hard
FROM (SELECT *, 100 * (lower_rate - higher_rate) / nullif(lower_rate, 0) AS fall FROM (SELECT scope, n, higher_band, higher_rate, lag(n) OVER w AS before_n,
lag(higher_band) OVER w AS lower_band, lag(higher_rate) OVER w AS lower_rate FROM (SELECT {scope} AS scope, {axis} AS higher_band, {place} AS place, sum(n) AS n,
sum({rate} * n) / sum(n) AS higher_rate FROM cube WHERE {place} IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY scope ORDER BY place))) WHERE fall > 0"""


@query(
    "ag27b_component_falls",
    CU + " UNION ALL ".join(
        _fall_list_sql(scope, axis, order, rate, name)
        for scope in ("model_id", "'all'") for axis, order in (("age_band", _AGES), ("mileage_band", _MILES))
        for name, rate in [("overall", "risk")] + [(c, f"risk_{c}") for c in _PARTS]
    ),
)
def _(t):
    """Every fall of the overall and of each component's risk, by model and over all, listed with its bands and rates."""
    cube = t.cube().cache()
    rates = {"overall": "risk"} | {c: f"risk_{c}" for c in R.COMPONENTS}
    parts = [M.fall_list(cube, axis, order, rates, scope) for scope in ("model_id", None) for axis, order in (("age_band", _AGES), ("mileage_band", _MILES))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.withColumns({"lower_rate": F.round("lower_rate", 9), "higher_rate": F.round("higher_rate", 9), "fall_pct": F.round("fall_pct", 6)})


@query(
    "ag28_trend_votes",
    CU + """, m AS (SELECT model_id, CASE mileage_band WHEN '0-30k' THEN 15000.0 WHEN '30k-60k' THEN 45000.0 WHEN '60k-100k' THEN 80000.0 WHEN '100k+'
THEN 120000.0 END AS m, risk FROM cube),
c AS (SELECT model_id, corr(m, risk) AS r FROM m WHERE m IS NOT NULL GROUP BY 1 HAVING count(*) > 3)
SELECT CASE WHEN r > 0.1 THEN 'rising' WHEN r < -0.1 THEN 'falling' ELSE 'flat' END AS trend, count(*) AS models FROM c GROUP BY 1""",
)
def _(t):
    return M.trend_votes(t.cube(), "model_id", "mileage_band", {"0-30k": 15000.0, "30k-60k": 45000.0, "60k-100k": 80000.0, "100k+": 120000.0}, "risk")


@query(
    "ag29_golden_diff",
    CU + """, g AS (SELECT count(*) AS n, avg(risk) AS m FROM cube WHERE n >= 3), c AS (SELECT count(*) AS n, avg(risk) AS m FROM cube)
SELECT c.n AS rows_now, g.n AS rows_golden, 13 AS columns_now, 12 AS columns_golden, false AS same_shape, round(c.m, 9) AS mean_now,
round(g.m, 9) AS mean_golden, round(abs(c.m - g.m), 9) AS diff, abs(c.m - g.m) <= 0.01 AS ok FROM c, g""",
)
def _(t):
    cube = t.cube()
    return M.golden_diff(cube, cube.where("n >= 3").drop("failures"), "risk")  # a golden table of fewer rows and columns


@query(
    "ag30_weighted_brier",
    CU + "SELECT round(sum(n * pow(risk - failures / n, 2)) / sum(n), 9) AS weighted, round(avg(pow(risk - failures / n, 2)), 9) AS plain, "
    "round(sum(n * risk - failures) / sum(n), 9) AS bias, CASE WHEN sum(n * pow(risk - failures / n, 2)) / sum(n) < 0.001 THEN 'excellent' WHEN "
    "sum(n * pow(risk - failures / n, 2)) / sum(n) < 0.01 THEN 'good' WHEN sum(n * pow(risk - failures / n, 2)) / sum(n) < 0.05 THEN 'moderate' "
    "ELSE 'poor' END AS grade FROM cube",
)
def _(t):
    square = F.pow(F.col("risk") - F.col("failures") / F.col("n"), 2)
    one = t.cube().agg(
        (F.sum(F.col("n") * square) / F.sum("n")).alias("w"),
        F.round(F.avg(square), 9).alias("plain"),
        F.round(F.sum(F.col("n") * F.col("risk") - F.col("failures")) / F.sum("n"), 9).alias("bias"),
    )
    return one.select(
        F.round("w", 9).alias("weighted"),
        "plain",
        "bias",
        R.below(F.col("w"), [(0.001, "excellent"), (0.01, "good"), (0.05, "moderate")], "poor").alias("grade"),
    )


@query(
    "ag31_schema_check",
    CU + """, w AS (SELECT * REPLACE (CAST(risk_lamps AS VARCHAR) AS risk_lamps, CAST(n AS VARCHAR) AS n) FROM cube), one AS (SELECT * FROM w LIMIT 1),
have AS (SELECT unnest(['model_id', 'age_band', 'mileage_band', 'n', 'risk', 'risk_brakes', 'risk_suspension', 'risk_tyres', 'risk_steering', 'risk_visibility', 'risk_lamps', 'risk_body']) AS name,
unnest([typeof(model_id), typeof(age_band), typeof(mileage_band), typeof(n), typeof(risk), typeof(risk_brakes), typeof(risk_suspension), typeof(risk_tyres), typeof(risk_steering), typeof(risk_visibility), typeof(risk_lamps), typeof(risk_body)]) AS kind
FROM one),
want AS (SELECT unnest(['model_id', 'age_band', 'mileage_band', 'n', 'failures', 'risk_brakes', 'risk_suspension', 'risk_tyres', 'risk_steering', 'risk_visibility', 'risk_lamps', 'risk_body']) AS name)
SELECT name, kind IS NOT NULL AS present, CASE WHEN name NOT IN ('model_id', 'age_band', 'mileage_band') THEN
coalesce(kind <> 'VARCHAR', false) END AS numeric FROM want LEFT JOIN have USING (name)""",
)
def _(t):
    """A wrong table: failures has another name, two numbers are text."""
    wrong = t.cube().withColumnRenamed("failures", "fails").withColumns({"n": F.col("n").cast("string"), "risk_lamps": F.col("risk_lamps").cast("string")})
    return M.schema_check(wrong, ["model_id", "age_band", "mileage_band", "n", "failures"], ["n", "failures"], "risk_")


_SCORED = (
    BA + ", "
    + eb_sql([["model_id"]], [10.0]) + ", s AS (SELECT b.*, round(e1.rate + age_years / 100.0, 3) AS score FROM banded b JOIN e1 USING (model_id))"
)


def scored(t):
    """Scores of all lines. Lines are joined once and stored in four columns; the rates are stored too, so that Spark sees before the join how few they are."""
    rows = M.stored(t.banded().select("make", "model_id", "age_years", "target"))
    rates = M.stored(E.shrink(rows, "model_id", "target", 10.0).select("model_id", "rate"))
    return rows.join(rates, "model_id").withColumn("score", F.round(F.col("rate") + F.col("age_years") / 100.0, 3))


_AUC = (
    "SELECT {k}count(*) AS n, round((sum(CASE WHEN target = 1 THEN r END) - sum(target) * (sum(target) + 1) / 2.0) / nullif(sum(target) * (count(*) - "
    "sum(target)), 0), 6) AS auc FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {p}score) - 1) / 2.0 AS r FROM s WINDOW w AS ({q}ORDER BY "
    "score)) {g}"
)


@query("ag32_auc", _SCORED + " " + _AUC.format(k="", p="", q="", g=""))
def _(t):
    return M.auc(scored(t), "score", "target").withColumn("auc", F.round("auc", 6))


@query(
    "ag33_auc_by_entity",
    _SCORED + " SELECT * FROM (" + _AUC.format(k="make, ", p="make, ", q="PARTITION BY make ", g="GROUP BY make") + ") WHERE n >= 50 AND auc IS NOT NULL",
)
def _(t):
    return M.auc(scored(t), "score", "target", ["make"]).withColumn("auc", F.round("auc", 6)).where("n >= 50 and auc is not null")


@query(
    "ag34_brier_log_loss",
    _SCORED + " SELECT round(avg(pow(score - target, 2)), 9) AS brier, round(avg(-(target * ln(greatest(1e-15, least(1 - 1e-15, score))) + (1 - "
    "target) * ln(1 - greatest(1e-15, least(1 - 1e-15, score))))), 9) AS log_loss FROM s",
)
def _(t):
    return M.brier_and_loss(scored(t), "score", "target")


@query(
    "ag35_top_decile_lift",
    "WITH s AS (SELECT event_id, (event_type = 'error')::INT AS target, round(value, 1) AS score FROM events), r AS (SELECT *, row_number() OVER (ORDER "
    "BY score DESC, event_id) AS r FROM s) SELECT count(*) AS n, round(avg(target) / (SELECT avg(target) FROM s), 6) AS lift FROM r WHERE r <= (SELECT "
    "count(*) FROM s) // 10",
)
def _(t):
    rows = t("events").select("event_id", (F.col("event_type") == "error").cast("int").alias("target"), F.round("value", 1).alias("score"))
    return M.top_share_lift(rows, "score", "target", "event_id")


@query(
    "ag36_risk_categories",
    _SCORED + ", z AS (SELECT target, round((score - 0.3) * 3, 6) AS z FROM s) SELECT CASE WHEN z < 0.10 THEN 'GREEN' WHEN z < 0.40 THEN 'AMBER' ELSE "
    "'RED' END AS category, count(*) AS n, "
    "round(count(*) / (SELECT count(*) FROM z), 6) AS share, round(avg(target) / (SELECT avg(target) FROM z), 6) AS lift FROM z GROUP BY 1",
)
def _(t):
    return M.risk_categories(scored(t).withColumn("z", F.round((F.col("score") - 0.3) * 3, 6)), "z", "target")


@query(
    "ag37_calibration_error",
    _SCORED + ", b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, sum(score) AS p, sum(target) AS y FROM s GROUP BY 1) SELECT "
    "round(sum(abs(p - y)) / sum(n), 9) AS ece, round(sum(p) / sum(y), 9) AS expected_over_observed FROM b",
)
def _(t):
    return M.calibration(scored(t), "score", "target")


@query(
    "ag38_distribution",
    IN + "SELECT prev_outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM inspections), 9) AS share FROM inspections GROUP BY 1",
)
def _(t):
    counts = t.inspections().groupBy("prev_outcome").agg(count())
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))  # over categories


@query(
    "ag39_encoder_summary",
    BA + ", "
    + eb_sql([["make"], ["make", "model_id"]], [10.0, 20.0]) + " SELECT count(*) AS n, round(min(rate), 6) AS least, round(max(rate), 6) AS most, "
    "round(stddev_pop(rate), 6) AS spread FROM e2",
)
def _(t):
    table = E.Encoder([["make"], ["make", "model_id"]], [10.0, 20.0]).fit(t.banded(), "target")[-1]
    return table.agg(
        count(), F.round(F.min("rate"), 6).alias("least"), F.round(F.max("rate"), 6).alias("most"), F.round(F.stddev_pop("rate"), 6).alias("spread")
    )


@query(
    "ag40_out_of_fold",
    BA + ", m AS (SELECT *, vehicle_id % 5 AS fold FROM banded), k AS (SELECT make, fold, sum(target) AS f, count(*) AS n FROM m GROUP BY ALL), a AS "
    "(SELECT make, sum(f) AS f, sum(n) AS n FROM k GROUP BY 1), o AS (SELECT fold, sum(f) AS f, sum(n) AS n FROM k GROUP BY 1), g AS (SELECT "
    "sum(f) AS f, sum(n) AS n FROM k) SELECT k.make, k.fold, k.n, round((a.f - k.f + 10.0 * ((g.f - o.f) / (g.n - o.n))) / (a.n - k.n + 10.0), "
    "7) AS rate FROM k JOIN a USING (make) JOIN o USING (fold) CROSS JOIN g",
)
def _(t):
    rows = E.out_of_fold(t.banded(), "make", "target", 10.0, 5, F.col("vehicle_id") % 5)
    return rows.groupBy("make", "fold").agg(count(), F.round(F.first("rate"), 7).alias("rate"))


@query(
    "ag42_decay_index",
    HI + ", a AS (SELECT vehicle_id, outcome, date_diff('day', test_date, DATE '2024-01-31') // 10 AS age, count(*) AS n FROM history WHERE outcome "
    "IN ('error', 'click', 'view') GROUP BY ALL), w AS (SELECT vehicle_id, outcome, sum(CASE outcome WHEN 'error' THEN 3.0 WHEN 'click' THEN 2.0 "
    "ELSE 1.0 END * (1 + ln(n)) * pow(0.7, age)) AS v FROM a GROUP BY ALL) SELECT vehicle_id, round(max(v) + 0.25 * (sum(v) - max(v)), 6) AS "
    "decay FROM w GROUP BY 1",
)
def _(t):
    age = F.floor(F.datediff(F.lit("2024-01-31").cast("date"), "test_date") / 10)
    groups = t.history().where("outcome in ('error', 'click', 'view')").groupBy("vehicle_id", "outcome", age.alias("age")).agg(count())
    weight = F.when(F.col("outcome") == "error", 3.0).when(F.col("outcome") == "click", 2.0).otherwise(1.0)
    systems = groups.groupBy("vehicle_id", "outcome").agg(F.sum(weight * (1 + F.ln("n")) * F.pow(F.lit(0.7), "age")).alias("v"))
    return systems.groupBy("vehicle_id").agg(F.round(F.max("v") + 0.25 * (F.sum("v") - F.max("v")), 6).alias("decay"))


@query(
    "ag43_latency",
    "WITH s AS (SELECT round(value, 2) AS ms, event_type, ts, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT "
    "count(*) AS n, min(ms) FILTER (i = least(n * 50 // 100, n - 1)) AS p50, min(ms) FILTER (i = least(n * 95 // 100, n - 1)) AS p95, min(ms) FILTER (i "
    "= least(n * 99 // 100, n - 1)) AS p99, min(ms) AS least, max(ms) AS most, round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 6) AS "
    "error_pct, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 6) AS rps FROM s",
)
def _(t):
    rows = t("events").select(F.round("value", 2).alias("ms"), (F.col("event_type") == "error").cast("int").alias("failed"), "ts")
    return M.latency(rows, "ms", "failed", "ts")


@query("ag44_regional_listing", IN + "SELECT split_part(make, '#', 2) AS series, area, round(avg(target), 6) AS rate FROM inspections GROUP BY ALL")
def _(t):
    return t.inspections().groupBy(F.split_part("make", F.lit("#"), F.lit(2)).alias("series"), "area").agg(F.round(F.avg("target"), 6).alias("rate"))


@query(
    "ag45_risk_cube",
    CU + "SELECT model_id, age_band, mileage_band, n, failures::BIGINT AS failures, round(risk, 9) AS risk, "
    + ", "
    .join(f"round(risk_{c}, 9) AS risk_{c}" for c in R.COMPONENTS) + " FROM cube",
)
def _(t):
    return t.cube().withColumns({c: F.round(c, 9) for c in ["risk", *[f"risk_{c}" for c in R.COMPONENTS]]})


@query(
    "ag46_age_normalised",
    HI + ", d AS (SELECT vehicle_id, least(0.02 * sum(advisory), 1.0) AS decay, CASE WHEN count(*) < 62 THEN 'young' WHEN count(*) < 70 THEN 'middle' "
    "ELSE 'old' END AS band FROM history GROUP BY 1), m AS (SELECT band, avg(decay) AS mean FROM d GROUP BY 1) SELECT vehicle_id, band, "
    "round(CASE WHEN mean > 0 THEN decay / mean ELSE decay END, 6) AS normalised FROM d JOIN m USING (band)",
)
def _(t):
    rows = t.history().groupBy("vehicle_id").agg(
        F.least(0.02 * F.sum("advisory"), F.lit(1.0)).alias("decay"), R.below(F.count(F.lit(1)), [(62, "young"), (70, "middle")], "old").alias("band")
    )
    means = rows.groupBy("band").agg(F.avg("decay").alias("mean"))
    return rows.join(means, "band").select(
        "vehicle_id", "band", F.round(F.when(F.col("mean") > 0, F.col("decay") / F.col("mean")).otherwise(F.col("decay")), 6).alias("normalised")
    )


@query(
    "ag47_index_encoding",
    IN + ", m AS (SELECT make, model_id, count(*) AS n FROM inspections GROUP BY ALL) SELECT model_id, dense_rank() OVER (ORDER BY make) - 1 AS "
    "make_index, row_number() OVER (ORDER BY make, model_id) - 1 AS model_index FROM m",
)
def _(t):
    models = t.inspections().groupBy("make", "model_id").agg(count())
    over = lambda *c: Window.orderBy(*c)  # noqa: E731  over models, not rows
    return models.select(
        "model_id", (F.dense_rank().over(over("make")) - 1).alias("make_index"), (F.row_number().over(over("make", "model_id")) - 1).alias("model_index")
    )


@query(
    "ag48_model_detail",
    CU + "SELECT model_id, age_band, sum(n)::BIGINT AS n, round(sum(risk * n) / sum(n), 6) AS risk, age_band = '6-10' AS own_band FROM cube WHERE "
    "starts_with(model_id, 'Brand#21') GROUP BY ALL",
)
def _(t):
    band = R.age_band(F.lit(2024) - F.lit(2016))
    return C.weighted_rates(
        t.cube().where(F.col("model_id").startswith("Brand#21")), ["model_id", "age_band"], []
    ).withColumn("own_band", F.col("age_band") == band)


_COSTS = "CASE component " + " ".join(f"WHEN '{c}' THEN {a} || '-' || {b}" for c, (a, b) in OV.COST_RANGES.items()) + " END"


@query(
    "ag49_model_component",
    CU + f", r AS (SELECT model_id, round(sum(risk * n) / sum(n), 6) AS overall, {COMPONENT_SUMS} FROM cube GROUP BY 1), u AS (SELECT model_id, "
    f"overall, {_UNPIVOT} FROM r) SELECT *, {_COSTS} AS cost FROM u",
)
def _(t):
    costs = t.spark.createDataFrame([(c, f"{a}-{b}") for c, (a, b) in R.COST_RANGES.items()], "component string, cost string")
    rows = C.weighted_rates(t.cube(), ["model_id"], R.COMPONENTS).withColumnRenamed("risk", "overall")
    return C.breakdown(rows, ["model_id", "overall"], R.COMPONENTS).join(costs, "component", "left").select(
        "model_id", "overall", "component", "risk", "cost"
    )


@query("ag50_eligibility", RATES + "SELECT model_id, n, risk, n >= 100 AS valid, n >= 400 AS detailed FROM rates")
def _(t):
    return rates(t).withColumns({"valid": F.col("n") >= 100, "detailed": F.col("n") >= 400})
