"""Filters, projections, sorts and set operations (FLT, PRJ, SRT, SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens.functions import rules as R
from roadlens.functions import text as X
from roadlens.operators import cube as C
from roadlens.operators import relational as O

from .base import BANDED, CUBE, EMAILS, HISTORY, INSPECTIONS, VEHICLES, before, pick, pick_sql, query
from .scalars import AREA_SQL, LINKS_SQL

CU, HI, IN, VE = f"WITH {CUBE} ", f"WITH {HISTORY} ", f"WITH {INSPECTIONS} ", f"WITH {VEHICLES} "


def count():
    return F.count(F.lit(1)).alias("n")


# Filters -----------------------------------------------------------------------------------------------------------------------


@query(
    "flt01_has_history",
    "SELECT o_orderkey FROM orders WHERE NOT (CASE WHEN o_orderpriority = '1-URGENT' THEN 'NO_PRIOR_RECORDED' WHEN o_orderpriority <> '5-LOW' THEN "
    "'SOME' END = 'NO_PRIOR_RECORDED' AND (nullif(o_custkey % 3, 2) IS NULL OR nullif(o_custkey % 3, 2) = 0))",
)
def _(t):
    band = F.when(F.col("o_orderpriority") == "1-URGENT", "NO_PRIOR_RECORDED").when(F.col("o_orderpriority") != "5-LOW", "SOME")
    return t("orders").where(O.three_valued_history(band, F.nullif(F.col("o_custkey") % 3, F.lit(2)))).select("o_orderkey")


@query("flt02_years", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1")
def _(t):
    return t("orders").where(O.in_years("o_orderdate", [1995, 1996])).groupBy(F.year("o_orderdate").alias("year")).agg(count())


@query(
    "flt03_entity_or_variant",
    IN + "SELECT model_id, count(*) AS n FROM inspections WHERE model_id = 'Brand#12' OR starts_with(model_id, 'Brand#12 ') GROUP BY 1",
)
def _(t):
    return t.inspections().where(O.entity_or_variant(F.col("model_id"), "Brand#12")).groupBy("model_id").agg(count())


@query(
    "flt04_alias_expansion",
    VE + """SELECT model_id, count(*) AS n FROM vehicles WHERE model_id IN ('MERCEDES-BENZ SPRINTER-CLASS', 'MERCEDES-BENZ SPRINTER', 'FORD 500', 'AUDI A')
OR starts_with(model_id, 'MERCEDES-BENZ SPRINTER-CLASS ') OR starts_with(model_id, 'MERCEDES-BENZ SPRINTER ') OR starts_with(model_id, 'FORD 500 ') OR starts_with(model_id, 'AUDI A ')
GROUP BY 1""",
)
def _(t):
    asked = [("MERCEDES-BENZ", "SPRINTER-CLASS"), ("FORD", "500"), ("AUDI", "A")]
    aliases = t.spark.createDataFrame([(alias,) for pair in asked for alias in O.class_variants(*pair)], "alias string")
    return O.any_entity_or_variant(t.vehicles(), "model_id", aliases, "alias").groupBy("model_id").agg(count())


@query(
    "flt05_prefix",
    VE + """SELECT vehicle_id, upper(trim(raw_make)) AS make FROM vehicles
WHERE starts_with(upper(trim(raw_make)), 'MERCEDES-BENZ') OR starts_with(upper(trim(raw_make)), 'MERCEDES')
OR starts_with(upper(trim(raw_make)), 'OPEL') OR starts_with(upper(trim(raw_make)), '0PEL')""",
)
def _(t):
    rows = t.vehicles().select("vehicle_id", F.upper(F.trim("raw_make")).alias("make"))
    return O.prefix_match(rows, "make", [p for make in ("Mercedes-Benz", "Opel") for p in X.reverse_aliases(make)])


@query("flt06_support", IN + "SELECT model_id, count(*) AS n, sum(target)::BIGINT AS failures FROM inspections GROUP BY 1 HAVING count(*) >= 400")
def _(t):
    return O.supported(t.inspections(), ["model_id"], 400, F.sum("target").alias("failures"))


@query("flt07_known_band", f"WITH {BANDED} SELECT age_band, count(*) AS n FROM banded WHERE age_band <> 'Unknown' GROUP BY 1")
def _(t):
    return t.banded().where("age_band <> 'Unknown'").groupBy("age_band").agg(count())


@query(
    "flt08_postcode_prefixes",
    VE + f"""SELECT vehicle_id,
coalesce({AREA_SQL} IN ('N', 'M', 'SW'), false) AS by_area, starts_with(postcode, 'N') OR starts_with(postcode, 'M') OR starts_with(postcode, 'SW') AS by_prefix
FROM vehicles WHERE {AREA_SQL} IN ('N', 'M', 'SW') OR starts_with(postcode, 'N') OR starts_with(postcode, 'M') OR starts_with(postcode, 'SW')""",
)
def _(t):
    by_area, by_prefix = (X.in_areas(F.col("postcode"), ["N", "M", "SW"], mode) for mode in (False, True))
    return t.vehicles().where(by_area | by_prefix).select("vehicle_id", by_area.alias("by_area"), by_prefix.alias("by_prefix"))


@query(
    "flt09_due_window",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) + 365 BETWEEN DATE '1997-06-01' + 25 AND DATE '1997-06-01' + "
    "31 AND o_custkey % 5 <> 0",
)
def _(t):
    today = F.lit("1997-06-01").cast("date")
    due = F.date_add(F.to_date("o_orderdate"), 365).between(F.date_add(today, 25), F.date_add(today, 31))
    unsubscribed = F.when(F.col("o_custkey") % 5 == 0, F.lit("1997-01-01"))
    return t("orders").where((F.col("o_orderstatus") == "O") & due & unsubscribed.isNull()).select("o_orderkey")


@query("flt10_paging", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def _(t):
    return O.page(t("events").where("ts >= timestamp'2024-01-10'"), [F.desc("ts"), F.asc("event_id")], 50, 100).select("event_id", "ts")


_LEAD_SQL = f"""leads AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_extendedprice * 30 - 90000 END AS mileage, CASE
WHEN l_linenumber <> 3 THEN 1880 + l_partkey % 160 END AS year,
CASE WHEN l_linenumber <> 4 THEN l_discount * 12 - 0.1 END AS failure_risk, CASE WHEN l_linenumber <> 5 THEN
CAST(l_quantity * 3 - 10 AS INT) END AS reliability_score,
{pick_sql(['asap', 'this_week', 'this_month', 'exploring', 'soon'], 'l_suppkey')} AS urgency, l_returnflag <> 'A' AS consent, {pick_sql(EMAILS, 'l_partkey')} AS email,
{pick_sql([' M1 ', 'N1', ' B ', 'SW1A 1AA'], 'l_suppkey')} AS postcode, {pick_sql(['AB12 CDE', '<b>A1</b>', 'ABCDEFGHI', ' '], 'l_orderkey')} AS registration
FROM lineitem)"""


def _leads(t):
    line = F.col("l_linenumber")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(line != 2, F.col("l_extendedprice") * 30 - 90000).alias("mileage"),
        F.when(line != 3, 1880 + F.col("l_partkey") % 160).alias("year"),
        F.when(line != 4, F.col("l_discount") * 12 - 0.1).alias("failure_risk"), F.when(
            line != 5, (F.col("l_quantity") * 3 - 10).cast("int")
        ).alias("reliability_score"),
        pick(["asap", "this_week", "this_month", "exploring", "soon"], F.col("l_suppkey")).alias("urgency"),
        (F.col("l_returnflag") != "A").alias("consent"), pick(EMAILS, F.col("l_partkey")).alias("email"),
        pick([" M1 ", "N1", " B ", "SW1A 1AA"], F.col("l_suppkey")).alias("postcode"), pick(
            ["AB12 CDE", "<b>A1</b>", "ABCDEFGHI", " "], F.col("l_orderkey")
        ).alias("registration"),
    )


@query(
    "flt11_validation",
    f"""WITH {_LEAD_SQL} SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN mileage < 0 OR mileage > 1000000 THEN 'mileage' END, CASE
WHEN year < 1900 OR year > 2027 THEN 'year' END,
CASE WHEN failure_risk < 0 OR failure_risk > 1 THEN 'failure_risk' END, CASE WHEN reliability_score < 0 OR reliability_score > 100
THEN 'reliability_score' END,
CASE WHEN urgency NOT IN ('asap', 'this_week', 'this_month', 'exploring') THEN 'urgency' END, CASE WHEN NOT consent THEN 'consent' END,
CASE WHEN email NOT IN ('jo@example.com', ' Ann.Lee@Example.co.uk ', 'x+y@mail.org') THEN 'email' END, CASE WHEN postcode <> 'SW1A 1AA' THEN 'postcode' END,
CASE WHEN registration IN ('ABCDEFGHI', ' ') THEN 'registration' END) AS errors FROM leads""",
)
def _(t):
    return O.validate(_leads(t), O.lead_rules(2026)).select("l_orderkey", "l_linenumber", F.array_join("errors", ",").alias("errors"))


@query(
    "flt12_window_cap",
    "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP "
    "'1995-01-01' AND CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)",
)
def _(t):
    rows = t("lineitem").where("l_shipdate >= timestamp'1995-01-01'").join(
        t("orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).where(F.to_date("l_shipdate") < F.to_date("o_orderdate"))
    return rows.agg(count(), F.count_distinct("l_orderkey").alias("orders"))


@query(
    "flt13_plausible_components",
    CU + ", u AS (SELECT model_id, age_band, mileage_band, unnest(["
    + ", "
    .join(repr(c) for c in R.COMPONENTS) + "]) AS component, unnest(["
    + ", "
    .join(f"risk_{c}" for c in R.COMPONENTS) + "]) AS risk FROM cube) SELECT component, count(*) AS n FROM u WHERE risk >= 0.05 GROUP BY 1",
)
def _(t):
    return C.breakdown(t.cube(), ["model_id", "age_band", "mileage_band"], R.COMPONENTS).where("risk >= 0.05").groupBy("component").agg(count())


ASIDES = [
    " My MOT failed?", " the motor runs", " Annual Test due, how likely is that?", " roadworthy, should I worry", " pre-MOT chat", " Will it pass?", " mot due: will my car PASS", "", " Any advice before the mot test", " remote control?",
]
_SAID = f"(text || {pick_sql(ASIDES, 'conv_id * 3 + turn')})"


@query(
    "flt14_relevant_text",
    rf"""SELECT conv_id, turn FROM conversations
WHERE regexp_matches({_SAID}, '\bMOT\b|mot fail|mot pass|mot test|pre-mot|pre mot|mot due|mot expir|mot advisory|mot check|annual test|roadworthy|mot preparation|mot cost', 'i')
AND (contains({_SAID}, '?') OR regexp_matches({_SAID}, 'will (it|my car) (pass|fail)|chances of (passing|failing)|should I (fix|repair|worry|be concerned)|how (likely|probable)|is (this|it) (worth|going to)|any advice.*(mot|test)|first (mot|test)|about to (take|go for|book).*(mot|test)|failed.*(mot|test)|advisory.*(mot|test)|what (are|were) the (common|main|usual).*(fail|problem|issue)|(reliable|reliability).*(mot|test)', 'i'))""",
)
def _(t):
    rows = t("conversations").withColumn("said", F.concat("text", pick(ASIDES, F.col("conv_id") * 3 + F.col("turn"))))
    return rows.where(X.relevant(F.col("said"))).select("conv_id", "turn")


@query(
    "flt15_recency_band",
    "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-15' - INTERVAL 48 HOUR AND TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR AND event_type "
    "<> 'error'",
)
def _(t):
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    return t("events").where(
        F.col("ts").between(now - F.expr("INTERVAL 48 HOURS"), now - F.expr("INTERVAL 1 HOUR")) & (F.col("event_type") != "error")
    ).select("event_id")


@query("flt16_min_support", IN + "SELECT area, count(*) AS n, sum(target)::BIGINT AS failures FROM inspections GROUP BY 1 HAVING count(*) >= 100")
def _(t):
    return O.supported(t.inspections(), ["area"], 100, F.sum("target").alias("failures"))


@query("flt17_active_entities", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0 AND nullif(s_nationkey, 3) IS NOT NULL")
def _(t):
    return t("supplier").where((F.col("s_acctbal") > 0) & F.nullif(F.col("s_nationkey"), F.lit(3)).isNotNull()).select("s_suppkey", "s_nationkey")


# Projections -------------------------------------------------------------------------------------------------------------------


_BANDS = ["low", "medium", "high", "average", "very_high"]
#: Tests and the three tables that join them; each misses some tests and some values.
_WIDE_SQL = f"""tests AS (SELECT l_orderkey * 10 + l_linenumber AS test_id, l_partkey AS vehicle_id, l_shipdate,
CAST(l_shipdate AS DATE) AS test_date, l_returnflag = 'R' AS is_failure,
CASE WHEN l_suppkey % 5 <> 0 THEN 'M' || l_partkey END AS model_id, CASE WHEN l_linenumber % 3 = 0 THEN 'NO_PRIOR_RECORDED' WHEN l_linenumber % 3 = 1
THEN 'PASS' END AS prev_cycle_outcome_band,
CASE WHEN l_linenumber % 2 = 0 THEN 'late' END AS gap_band, CASE WHEN l_suppkey % 7 <> 0 THEN 'FORD' END AS make, CASE WHEN l_linenumber <> 4
THEN '3-5' END AS age_band, nullif(l_quantity, 1.0) AS test_mileage,
CASE WHEN l_returnflag <> 'A' THEN l_tax END AS prior_fail_rate_smoothed, CASE WHEN l_suppkey % 4 <> 0 THEN
CAST(l_suppkey % 4 - 1 AS DOUBLE) END AS n_prior_tests,
CASE WHEN l_linenumber <> 5 THEN l_extendedprice / 4 - 1000 END AS annualized_mileage, CASE WHEN l_linenumber <> 6
THEN 'SW' END AS postcode_area, nullif(l_discount, 0.0) AS mileage_percentile_for_age,
CASE WHEN l_linenumber = 1 THEN 2.0 END AS n_prior_fails, CASE WHEN l_linenumber = 2 THEN 1.0 END AS fails_last_365d, CASE WHEN l_linenumber = 3
THEN 1.0 END AS fails_last_730d,
CASE WHEN l_partkey % 6 < 5 THEN {pick_sql(_BANDS, 'l_partkey % 6')} END AS usage_intensity_band FROM lineitem),
h AS (SELECT test_id, CAST(test_id % 5 AS DOUBLE) AS prev_advisory_total, CASE WHEN test_id % 4 > 0 THEN 'STABLE' END AS advisory_trend, CASE
WHEN test_id % 9 > 0 THEN CAST(test_id % 900 AS DOUBLE) END AS days_since_prev_cycle FROM tests WHERE test_id % 3 > 0),
a AS (SELECT test_id, CAST(test_id % 2 AS DOUBLE) AS prev_adv_brakes, CAST(test_id % 3 AS DOUBLE) AS prev_adv_suspension,
CAST(NULL AS DOUBLE) AS prev_adv_steering, CAST(test_id % 4 AS DOUBLE) AS prev_adv_tyres FROM tests WHERE test_id % 5 > 0),
p AS (SELECT test_id, test_id % 10 / 10.0::DOUBLE AS ponr_risk_score, CAST(test_id % 2 AS INT) AS has_ponr_pattern FROM tests WHERE test_id % 7 > 0)
SELECT test_id, vehicle_id, CAST(test_date AS VARCHAR) AS test_date, CAST(is_failure AS INT) AS target,
coalesce(model_id, 'UNKNOWN UNKNOWN') AS model_id, coalesce(prev_cycle_outcome_band, 'NONE') AS prev_cycle_outcome_band,
coalesce(gap_band, 'NONE') AS gap_band, coalesce(make, 'UNKNOWN') AS make, coalesce(age_band, 'UNKNOWN') AS age_band,
coalesce(test_mileage, 50000.0)::DOUBLE AS test_mileage,
coalesce(prior_fail_rate_smoothed, 0.33)::DOUBLE AS prior_fail_rate_smoothed, coalesce(n_prior_tests, 0.0)::DOUBLE AS n_prior_tests,
coalesce(annualized_mileage, 8000.0)::DOUBLE AS annualized_mileage,
coalesce(postcode_area, 'UNKNOWN') AS postcode_area, coalesce(mileage_percentile_for_age, 0.5)::DOUBLE AS mileage_percentile_for_age,
coalesce(n_prior_fails, 0.0)::DOUBLE AS n_prior_fails,
coalesce(fails_last_365d, 0.0)::DOUBLE AS fails_last_365d, coalesce(fails_last_730d, 0.0)::DOUBLE AS fails_last_730d,
coalesce(prev_advisory_total, 0.0)::DOUBLE AS prev_count_advisory,
coalesce(advisory_trend, 'UNKNOWN') AS advisory_trend, coalesce(days_since_prev_cycle, 730.0)::DOUBLE AS days_since_last_test,
coalesce(days_since_prev_cycle, 730.0)::DOUBLE - 365 AS days_late,
CASE WHEN h.test_id IS NOT NULL THEN 1 ELSE 0 END AS has_cycle_history_link, coalesce(prev_adv_brakes, 0.0)::DOUBLE AS prev_adv_brakes,
coalesce(prev_adv_suspension, 0.0)::DOUBLE AS prev_adv_suspension,
coalesce(prev_adv_steering, 0.0)::DOUBLE AS prev_adv_steering, coalesce(prev_adv_tyres, 0.0)::DOUBLE AS prev_adv_tyres,
CASE WHEN usage_intensity_band IN ('low', 'medium', 'high') THEN usage_intensity_band WHEN annualized_mileage > 0 THEN CASE
WHEN annualized_mileage < 5000 THEN 'low' WHEN annualized_mileage < 12000 THEN 'medium' ELSE 'high' END ELSE 'unknown' END AS usage_band_hybrid,
coalesce(ponr_risk_score, 0.0)::DOUBLE AS ponr_risk_score, coalesce(has_ponr_pattern, 0)::INT AS has_ponr_pattern
FROM tests LEFT JOIN h USING (test_id) LEFT JOIN a USING (test_id) LEFT JOIN p USING (test_id)
WHERE l_shipdate {{0}} TIMESTAMP '1997-01-01' AND NOT (prev_cycle_outcome_band = 'NO_PRIOR_RECORDED' AND (n_prior_tests IS NULL OR n_prior_tests = 0))"""


def _tests(rows):
    line, supp, part = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    return rows.select(
        (F.col("l_orderkey") * 10 + line).alias("test_id"), part.alias("vehicle_id"), F.to_date("l_shipdate").alias("test_date"),
        (F.col("l_returnflag") == "R").alias("is_failure"),
        F.when(supp % 5 != 0, F.concat(F.lit("M"), part)).alias("model_id"),
        F.when(line % 3 == 0, "NO_PRIOR_RECORDED").when(line % 3 == 1, "PASS").alias("prev_cycle_outcome_band"),
        F.when(line % 2 == 0, "late").alias("gap_band"), F.when(supp % 7 != 0, "FORD").alias("make"), F.when(line != 4, "3-5").alias("age_band"), F.nullif(
            "l_quantity", F.lit(1.0)
        ).alias("test_mileage"),
        F.when(F.col("l_returnflag") != "A", F.col("l_tax")).alias("prior_fail_rate_smoothed"),
        F.when(supp % 4 != 0, (supp % 4 - 1).cast("double")).alias("n_prior_tests"),
        F.when(
            line != 5, F.col("l_extendedprice") / 4 - 1000
        ).alias("annualized_mileage"), F.when(line != 6, "SW").alias("postcode_area"), F.nullif("l_discount", F.lit(
            0.0
        )).alias("mileage_percentile_for_age"),
        F.when(line == 1, 2.0).alias("n_prior_fails"), F.when(line == 2, 1.0).alias("fails_last_365d"), F.when(line == 3, 1.0).alias("fails_last_730d"),
        F.when(part % 6 < 5, pick(_BANDS, F.least(part % 6, F.lit(4)))).alias("usage_intensity_band"),
    )


def _wide(t, rows):
    tests, every, i = _tests(rows), _tests(t("lineitem")), F.col("test_id")
    number = lambda m: (i % m).cast("double")
    history = every.where(i % 3 > 0).select(
        "test_id", number(5).alias("prev_advisory_total"), F.when(i % 4 > 0, "STABLE").alias("advisory_trend"), F.when(i % 9 > 0, number(900)).alias(
            "days_since_prev_cycle"
        )
    )
    advisories = every.where(i % 5 > 0).select(
        "test_id", number(2).alias("prev_adv_brakes"), number(3).alias("prev_adv_suspension"), F.lit(None).cast("double").alias("prev_adv_steering"),
        number(4).alias("prev_adv_tyres")
    )
    patterns = every.where(i % 7 > 0).select("test_id", (number(10) / 10).alias("ponr_risk_score"), (i % 2).cast("int").alias("has_ponr_pattern"))
    return O.wide_features(tests, history, advisories, patterns).withColumn("test_date", F.col("test_date").cast("string"))


@query("prj01_wide_dev", "WITH " + _WIDE_SQL.format("<"))
def _(t):
    return _wide(t, t("lineitem").where(before("l_shipdate", 1997)))


@query("prj02_wide_oot", "WITH " + _WIDE_SQL.format(">="))
def _(t):
    return _wide(t, t("lineitem").where(~before("l_shipdate", 1997)))


@query(
    "prj03_hybrid_band",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'trusted' WHEN nullif(l_quantity, 7) IS NULL THEN 'unknown' WHEN "
    "l_extendedprice / 4 < 5000 THEN 'low' WHEN l_extendedprice / 4 < 12000 THEN 'medium' ELSE 'high' END AS band FROM lineitem",
)
def _(t):
    annual = F.when(F.nullif("l_quantity", F.lit(7.0)).isNotNull(), F.col("l_extendedprice") / 4)
    band = F.when(F.col("l_returnflag") == "R", "trusted").when(annual.isNull(), "unknown").otherwise(
        R.below(annual, [(5000, "low"), (12000, "medium")], "high")
    )
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", band.alias("band"))


@query("prj04_link_flag", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1 ELSE 0 END AS linked FROM customer")
def _(t):
    return t("customer").join(
        t("orders").select("o_custkey").distinct(), F.col("c_custkey") == F.col("o_custkey"), "left"
    ).select("c_custkey", F.col("o_custkey").isNotNull().cast("int").alias("linked"))


@query(
    "prj05_interactions",
    IN + "SELECT concat_ws('_', make, area, coalesce(nullif(prev_outcome, 'P'), 'UNKNOWN')) AS key, count(*) AS n FROM inspections GROUP BY 1",
)
def _(t):
    return t.inspections().groupBy(
        F.concat_ws("_", "make", "area", F.coalesce(F.nullif("prev_outcome", F.lit("P")), F.lit("UNKNOWN"))).alias("key")
    ).agg(count())


@query("prj06_contract_select", "SELECT p_size, p_partkey, p_brand FROM part")
def _(t):
    return O.select_contract(t("part").select("p_size", "p_name", "p_partkey", "p_brand"), ["p_size", "p_partkey", "p_brand"], extra=["p_name"])


_PART = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")]


@query("prj07_derive_contract", " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS name, '{d}' AS dtype, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS null_rate, {'NULL' if d == 'string' else f'min({c})::DOUBLE'} AS least, {'NULL' if d == 'string' else f'max({c})::DOUBLE'} AS most FROM part" for i, (c, d) in enumerate(_PART)))
def _(t):
    return O.contract(t("part"))


@query("prj08_rename_drop", "SELECT p_partkey AS id, p_size AS size, p_retailprice AS price, p_name FROM part")
def _(t):
    return O.rename_drop(t("part"), {"p_partkey": "id", "p_size": "size", "p_retailprice": "price"}, ["p_brand", "p_type"])


@query("prj09_missing_to_zero", "SELECT n_nationkey, n_name, 0 AS rate, 0 AS support FROM nation")
def _(t):
    return O.add_missing(t("nation").select("n_nationkey", "n_name"), ["n_name", "rate", "support"])


@query(
    "prj10_categories",
    "SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'UNKNOWN') AS kind, CAST(month(ts) AS VARCHAR) AS month FROM events",
)
def _(t):
    return t("events").select(
        "event_id",
        F.coalesce(F.when(F.col("event_type") != "error", F.col("event_type")).cast("string"), F.lit("UNKNOWN")).alias("kind"),
        F.month("ts").cast("string").alias("month"),
    )


@query("prj11_clean_names", 'SELECT s_suppkey AS "S_Suppkey", s_name AS "S_Name", s_acctbal AS "Acct_Bal_X" FROM supplier')
def _(t):
    return O.clean_names(t("supplier").select("s_suppkey", "s_name", F.col("s_acctbal").alias("acct-bal (x)")))


@query(
    "prj12_campaign_tags",
    "SELECT event_id, event_type || '|exp:' || (user_id % 2) AS tag, CAST(user_id % 2 AS VARCHAR) AS variant, event_type AS campaign FROM events",
)
def _(t):
    tag = F.concat_ws("|", "event_type", F.concat(F.lit("exp:"), F.col("user_id") % 2))
    return t("events").select("event_id", tag.alias("tag")).withColumns(
        {"variant": F.regexp_extract("tag", r"exp:([^|]*)", 1), "campaign": F.split("tag", r"\|")[0]}
    )


OUTCOMES, TRENDS = ["pass", "fail", "first_test", "unknown", "PASS", "other"], ["stable", "increasing", "decreasing", "unknown", "FIRST_WITH_HISTORY"]


@query(
    "prj13_vocabulary",
    f"""WITH e AS (SELECT event_id, {pick_sql(OUTCOMES, 'event_id')} AS o, {pick_sql(TRENDS, 'event_id')} AS d FROM events)
SELECT event_id, CASE o WHEN 'pass' THEN 'PASS' WHEN 'fail' THEN 'FAIL' WHEN 'first_test' THEN 'FIRST_TEST' WHEN 'unknown' THEN 'HISTORY_MISSING_LINK'
ELSE o END AS outcome,
CASE d WHEN 'stable' THEN 'STABLE' WHEN 'increasing' THEN 'WORSENING' WHEN 'decreasing' THEN 'IMPROVING' WHEN 'unknown' THEN 'UNKNOWN'
ELSE d END AS trend FROM e""",
)
def _(t):
    twice = lambda c, name: O.remap(O.remap(c, X.VOCABULARY[name]), X.VOCABULARY[name])
    k = F.col("event_id")
    outcome, trend = twice(pick(OUTCOMES, k), "prev_cycle_outcome_band"), twice(pick(TRENDS, k), "advisory_trend")
    return t("events").select("event_id", outcome.alias("outcome"), trend.alias("trend"))


@query(
    "prj14_coverage",
    "WITH j AS (SELECT c.*, o.o_custkey, CASE WHEN c_acctbal > 0 THEN 1 END AS pos FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o "
    "ON c_custkey = o_custkey) SELECT 'o_custkey' AS feature, round(avg((o_custkey IS NOT NULL)::INT), 9) AS covered FROM j UNION ALL SELECT 'pos', "
    "round(avg((pos IS NOT NULL)::INT), 9) FROM j",
)
def _(t):
    joined = t("customer").join(
        t("orders").select(F.col("o_custkey").cast("double").alias("o_custkey")).distinct(), F.col("c_custkey") == F.col("o_custkey"), "left"
    ).withColumn("pos", F.when(F.col("c_acctbal") > 0, 1.0))
    return O.coverage(joined, ["o_custkey", "pos"]).withColumn("covered", F.round("covered", 9))


@query("prj15_distribution_status", """WITH a AS (SELECT l_orderkey, count(*) AS matches, count(*) FILTER (l_returnflag = 'A') AS sent FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'already_distributed' WHEN coalesce(matches, 0) = 0 THEN 'no_garage_found'
WHEN o_orderstatus = 'P' THEN 'assignment_failed' WHEN sent > 0 THEN 'distributed' ELSE 'email_failed' END AS status FROM orders LEFT
JOIN a ON o_orderkey = l_orderkey""")
def _(t):
    sent = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("l_returnflag") == "A").alias("sent"))
    status = F.when(F.col("o_orderstatus") == "F", "already_distributed").when(
        F.coalesce("matches", F.lit(0)) == 0, "no_garage_found"
    ).when(F.col("o_orderstatus") == "P", "assignment_failed").when(F.col("sent") > 0, "distributed").otherwise("email_failed")
    return t("orders").join(sent, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", status.alias("status"))


@query(
    "prj16_flatten_lead",
    "SELECT o_orderkey, o_custkey AS vehicle_id, o_totalprice AS mileage, CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS consent_at FROM orders",
)
def _(t):
    lead = t("orders").select(
        "o_orderkey",
        F.struct(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("mileage")).alias("vehicle"),
        (F.col("o_orderstatus") == "O").alias("consent"),
        "o_orderdate",
    )
    return lead.select(
        "o_orderkey", F.col("vehicle.id").alias("vehicle_id"), "vehicle.mileage", F.when(F.col("consent"), F.col("o_orderdate")).alias("consent_at")
    )


# Sorts -------------------------------------------------------------------------------------------------------------------------

RATES = CU + ", rates AS (SELECT model_id, sum(n)::BIGINT AS n, round(sum(risk * n) / sum(n), 6) AS risk FROM cube GROUP BY 1) "


def rates(t):
    return t.cube().groupBy("model_id").agg(F.sum("n").alias("n"), C.weighted("risk").alias("risk"))


@query("srt01_order_limit", RATES + "SELECT * FROM rates ORDER BY risk DESC, model_id LIMIT 10")
def _(t):
    return O.page(rates(t), [F.desc("risk"), F.asc("model_id")], 10)


@query(
    "srt02_largest_smallest",
    RATES + "SELECT 'largest' AS side, model_id, risk FROM (SELECT * FROM rates ORDER BY risk DESC, model_id LIMIT 5) UNION ALL SELECT 'smallest', "
    "model_id, risk FROM (SELECT * FROM rates ORDER BY risk, model_id LIMIT 5)",
)
def _(t):
    ends = [O.page(rates(t), [order("risk"), F.asc("model_id")], 5).select(F.lit(side).alias("side"), "model_id", "risk") for side, order in (("largest", F.desc), ("smallest", F.asc))]
    return ends[0].union(ends[1])


BAND_ORDER = ["0-2", "3-5", "6-10", "11-15", "15+", "Unknown"]
_ORDER_SQL = "list_position(['" + "', '".join(BAND_ORDER) + "'], age_band)"


@query("srt03_band_order", CU + f"SELECT age_band, CAST({_ORDER_SQL} AS BIGINT) AS place, sum(n)::BIGINT AS n FROM cube GROUP BY ALL")
def _(t):
    return t.cube().groupBy("age_band").agg(F.sum("n").alias("n")).withColumn("place", C.band_order(F.col("age_band"), BAND_ORDER)).orderBy("place")


@query(
    "srt04_priority_first",
    IN + "SELECT make, count(*) AS n, row_number() OVER (ORDER BY CASE make WHEN 'Brand#33' THEN 1 WHEN 'Brand#11' THEN 2 ELSE 99 END, make) AS place "
    "FROM inspections GROUP BY make",
)
def _(t):
    place = F.array_position(F.array(F.lit("Brand#33"), F.lit("Brand#11")), F.col("make"))
    makes = t.inspections().groupBy("make").agg(count())
    return makes.withColumn("place", F.row_number().over(Window.orderBy(F.when(place > 0, place).otherwise(99), "make")))  # over makes, not rows


@query(
    "srt05_business_priority",
    "SELECT s_suppkey, rank FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 "
    "ELSE 3 END, abs(s_acctbal), s_suppkey) AS rank FROM supplier)",
)
def _(t):
    tier = F.when(F.col("s_suppkey") % 3 == 0, 1).when(F.col("s_suppkey") % 3 == 1, 2).otherwise(3)
    return t("supplier").select(
        "s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(tier, F.abs("s_acctbal"), "s_suppkey")).alias("rank")
    )


@query("srt06_score_then_comments", "SELECT conv_id, turn FROM conversations ORDER BY length(text) DESC, turn, conv_id LIMIT 20")
def _(t):
    return O.page(t("conversations"), [F.desc(F.length("text")), F.asc("turn"), F.asc("conv_id")], 20).select("conv_id", "turn")


@query(
    "srt07_priority_urls",
    "SELECT page_id, row_number() OVER (PARTITION BY split_part(url, '/', 4) ORDER BY regexp_matches(url, '^https://') DESC, page_id) AS place FROM pages",
)
def _(t):
    first = F.col("url").rlike("^https://")
    return t("pages").select(
        "page_id", F.row_number().over(Window.partitionBy(F.split_part("url", F.lit("/"), F.lit(4))).orderBy(first.desc(), "page_id")).alias("place")
    )


@query("srt08_seeded_shuffle")
def _(t):
    return t("supplier").orderBy((F.col("s_suppkey") % 3).desc(), F.xxhash64("s_suppkey", F.lit(42)), "s_suppkey").limit(20)


@query(
    "srt09_largest_row",
    CU + "SELECT model_id, arg_max(age_band || ' ' || mileage_band, n * 1000 - length(age_band || mileage_band)) AS cell, max(n)::BIGINT AS n FROM "
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY n DESC, age_band, mileage_band) AS r FROM cube) WHERE r = 1) "
    "GROUP BY model_id",
)
def _(t):
    order = Window.partitionBy("model_id").orderBy(F.desc("n"), "age_band", "mileage_band")
    return t.cube().withColumn("r", F.row_number().over(order)).where("r = 1").select(
        "model_id", F.concat_ws(" ", "age_band", "mileage_band").alias("cell"), "n"
    )


# Sets --------------------------------------------------------------------------------------------------------------------------


@query("set01_union_ids", "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def _(t):
    return t("orders").select(F.col("o_custkey").alias("id")).union(t("customer").where("c_nationkey < 5").select("c_custkey")).distinct()


@query("set02_distinct", "SELECT DISTINCT l_partkey FROM lineitem")
def _(t):
    return t("lineitem").select("l_partkey").distinct()


@query(
    "set03_difference",
    "SELECT 'minus' AS op, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'both', c_custkey FROM "
    "customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
)
def _(t):
    customers, buyers = t("customer").select(F.col("c_custkey").alias("id")), t("orders").select(F.col("o_custkey").alias("id"))
    return customers.subtract(buyers).select(F.lit("minus").alias("op"), "id").union(customers.intersect(buyers).select(F.lit("both"), "id"))


@query(
    "set04_two_datasets",
    IN + ", r AS (SELECT make, avg(target) AS rate FROM inspections WHERE test_date < DATE '1997-01-01' GROUP BY 1) SELECT CASE WHEN year(test_date) "
    "< 1997 THEN 'dev' ELSE 'oot' END AS dataset, count(*) AS n, round(avg(rate), 6) AS rate FROM inspections LEFT JOIN r USING (make) GROUP BY "
    "1",
)
def _(t):
    rows = t.inspections()
    dev, oot = rows.where(before("shipped", 1997)), rows.where(~before("shipped", 1997))
    fitted = dev.groupBy("make").agg(F.avg("target").alias("rate"))
    both = dev.withColumn("dataset", F.lit("dev")).unionByName(oot.withColumn("dataset", F.lit("oot")))
    return both.join(fitted, "make", "left").groupBy("dataset").agg(count(), F.round(F.avg("rate"), 6).alias("rate"))


@query(
    "set05_keyed_upsert",
    "WITH e AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-10') SELECT user_id, event_type, min(event_id) AS event_id "
    "FROM events a WHERE ts >= TIMESTAMP '2024-01-10' AND NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = a.user_id AND e.event_type = a.event_type) GROUP "
    "BY ALL",
)
def _(t):
    rows = t("events").select("user_id", "event_type", "event_id", "ts")
    old, new = rows.where("ts < timestamp'2024-01-10'"), rows.where("ts >= timestamp'2024-01-10'").drop("ts")
    return O.new_rows(new, old, ["user_id", "event_type"])
