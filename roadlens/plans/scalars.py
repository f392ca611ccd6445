"""Scalar functions over vehicles and inspections (SCL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.functions import rules as R
from roadlens.functions import text as X
from roadlens.operators import metrics as M

from . import oracle_values as OV
from .base import AGE_SQL, BANDED, CUBE, HISTORY, INSPECTIONS, MILEAGE_SQL, VEHICLES, bands_sql, pick, pick_sql, query

V = f"WITH {VEHICLES} "
I = f"WITH {INSPECTIONS} "  # noqa: E741


def any_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def in_sql(text: str, values: list[str]) -> str:
    return f"{text} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


@query("scl_s1_maker", V + "SELECT vehicle_id, split_part(model_id, ' ', 1) AS maker FROM vehicles")
def _(t):
    return t.vehicles().select("vehicle_id", X.first_word(F.col("model_id")).alias("maker"))


# Values in the SQL of this section are typed out, so that an oracle shares nothing with the functions it checks.
_TWO = """CASE WHEN starts_with(upper(model_id), 'LAND ROVER ') THEN substr(model_id, 1, 10)
WHEN starts_with(upper(model_id), 'MERCEDES-BENZ ') THEN substr(model_id, 1, 13)
WHEN starts_with(upper(model_id), 'ALFA ROMEO ') THEN substr(model_id, 1, 10)
WHEN starts_with(upper(model_id), 'ASTON MARTIN ') THEN substr(model_id, 1, 12)
WHEN starts_with(upper(model_id), 'ROLLS ROYCE ') THEN substr(model_id, 1, 11)
WHEN starts_with(upper(model_id), 'DS AUTOMOBILES ') THEN substr(model_id, 1, 14)
ELSE split_part(model_id, ' ', 1) END"""


def title_sql(text: str) -> str:
    """Letter names of up to three as they are, others with a capital at the start of each run of letters."""
    runs = f"[upper(x[1:1]) || lower(x[2:]) FOR x IN regexp_extract_all({text}, '[A-Za-z]+|[^A-Za-z]+')]"
    return f"CASE WHEN regexp_full_match({text}, '[A-Za-z]{{1,3}}') THEN {text} ELSE array_to_string({runs}, '') END"


#: Ids with makers of several words, of one word, and in small letters.
ODD_IDS = ["ROLLS ROYCE GHOST", "DS AUTOMOBILES DS3 CROSSBACK", "rolls-royce phantom", "MG", "Land Rover Range-Rover", "BMW 320D SE", "ASTON MARTIN DB9"]
_ODD_ID = pick_sql(ODD_IDS, "vehicle_id * 5")
_ALL_IDS = f"ids AS (SELECT vehicle_id, model_id FROM vehicles UNION ALL SELECT -vehicle_id, {_ODD_ID} FROM vehicles)"


def _ids(t):
    rows = t.vehicles()
    return rows.select("vehicle_id", "model_id").unionByName(
        rows.select((-F.col("vehicle_id")).alias("vehicle_id"), pick(ODD_IDS, F.col("vehicle_id") * 5).alias("model_id"))
    )


@query(
    "scl_s2_split_make",
    V + f", {_ALL_IDS}, p AS (SELECT vehicle_id, {_TWO} AS m, model_id FROM ids), q AS (SELECT vehicle_id, m, substr(model_id, length(m) + 2) AS r FROM p) "
    f"SELECT vehicle_id, {title_sql('m')} AS make, {title_sql('r')} AS model FROM q",
)
def _(t):
    make, model = X.split_make(F.col("model_id"))
    return _ids(t).select("vehicle_id", make.alias("make"), model.alias("model"))


_FIRST = {}
for _m in OV.MAJOR_MAKES:
    _FIRST.setdefault(_m.split(" ")[0], _m)
CANONICAL_SQL = (
    "CASE WHEN " + in_sql("trim(upper(raw_make))", OV.REJECTED_MAKES) + " THEN NULL " + " ".join(
        f"WHEN trim(upper(raw_make)) = '{a}' THEN '{b}'" for a, b in OV.CANONICAL_MAKES.items()
    )
    + " WHEN " + in_sql("trim(upper(raw_make))", OV.MAJOR_MAKES) + " THEN trim(upper(raw_make)) " + " ".join(
        f"WHEN trim(upper(raw_make)) = '{a}' THEN '{b}'" for a, b in _FIRST.items()
    ) + " END"
)


@query("scl_s3_canonical_make", V + f"SELECT vehicle_id, {CANONICAL_SQL} AS make FROM vehicles")
def _(t):
    return t.vehicles().select("vehicle_id", X.canonical_make(F.col("raw_make")).alias("make"))


_STRIPPED = "m"
for _p in OV.MODEL_STRIPS:
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_p}', '', 'gi')"
BASE_MODEL_CTE = f"""s AS (SELECT vehicle_id, model_id, make, CASE WHEN starts_with(model_id, make) THEN trim(substr(model_id, length(make) + 1))
ELSE model_id END AS m
  FROM (SELECT *, {_TWO} AS make FROM vehicles)),
w AS (SELECT *, split_part(trim(regexp_replace({_STRIPPED}, '\\s+', ' ', 'g')), ' ', 1) AS word FROM s),
base AS (SELECT vehicle_id, make, CASE WHEN m = '' OR substr(m, 1, 1) IN ('.', '/', '-', '(', ')') OR word = '' OR {in_sql("word", OV.TRIM_WORDS)} THEN NULL
  WHEN {in_sql("make", OV.NUMERIC_MODEL_MAKES)} AND regexp_matches(word, '^[A-Z]?[0-9]') THEN CASE WHEN make = 'BMW' AND regexp_matches(word, '^[0-9]')
THEN substr(word, 1, 1) || ' SERIES' ELSE word END
  WHEN regexp_matches(word, '^[0-9]') OR length(word) < 2 OR length(regexp_replace(word, '[^A-Z]', '', 'g')) < length(word) * 0.6 THEN NULL
ELSE word END AS model FROM w)"""


@query("scl_s4_base_model", V + ", " + BASE_MODEL_CTE + " SELECT * FROM base")
def _(t):
    make = X.raw_make(F.col("model_id"))
    return t.vehicles().select("vehicle_id", make.alias("make"), X.base_model(F.col("model_id"), make).alias("model"))


@query(
    "scl_s5_slugify",
    "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(lower(p_name || ' - & ' || p_type || ' '), '&', 'and'), '[^a-z0-9\\s-]', "
    "'', 'g'), "
    "'\\s+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
)
def _(t):
    return t("part").select("p_partkey", X.slugify(F.concat("p_name", F.lit(" - & "), "p_type", F.lit(" "))).alias("slug"))


@query("scl_s6_display_name", V + f", {_ALL_IDS} SELECT vehicle_id, {title_sql('model_id')} AS shown, {title_sql('left(model_id, 3)')} AS short FROM ids")
def _(t):
    return _ids(t).select("vehicle_id", X.display_name(F.col("model_id")).alias("shown"), X.display_name(F.substring("model_id", 1, 3)).alias("short"))


AREA_SQL = "nullif(regexp_extract(replace(upper(trim(postcode)), ' ', ''), '^([A-Z]{1,2})', 1), '')"


@query("scl_s7_postcode_area", V + f"SELECT vehicle_id, {AREA_SQL} AS area FROM vehicles")
def _(t):
    return t.vehicles().select("vehicle_id", X.postcode_area(F.col("postcode")).alias("area"))


ODD_CODES = ["S W1A 1AA", "SW1A  1AA", " n1 9gu ", "EC2V", "E C2V", "M1", "M", "W1A0AX", "B33 8T", "1AB 2CD"]


@query(
    "scl_s8_postcode_valid",
    V + f""", c AS (SELECT vehicle_id, postcode FROM vehicles UNION ALL SELECT -vehicle_id, {pick_sql(ODD_CODES, "vehicle_id")} FROM vehicles)
SELECT vehicle_id, regexp_full_match(upper(trim(postcode)), '[A-Z]{{1,2}}[0-9][A-Z0-9]?\\s*[0-9][A-Z]{{2}}|[A-Z]{{1,2}}[0-9][A-Z0-9]?') AS valid FROM c""",
)
def _(t):
    rows = t.vehicles()
    both = rows.select("vehicle_id", "postcode").unionByName(
        rows.select((-F.col("vehicle_id")).alias("vehicle_id"), pick(ODD_CODES, F.col("vehicle_id")).alias("postcode"))
    )
    return both.select("vehicle_id", X.postcode_valid(F.col("postcode")).alias("valid"))


@query(
    "scl_s9_registration",
    V + """, r AS (SELECT vehicle_id, replace(upper(trim(registration)), ' ', '') AS raw FROM vehicles),
p AS (SELECT vehicle_id, CASE WHEN regexp_full_match(raw, '[A-Z0-9]{2,8}') THEN raw END AS plate FROM r)
SELECT vehicle_id, plate, CASE WHEN regexp_full_match(plate, '[A-Z]{2}[0-9]{2}[A-Z]{3}') THEN 'current'
WHEN regexp_full_match(plate, '[A-Z][0-9]{1,3}[A-Z]{3}') THEN 'prefix'
WHEN regexp_full_match(plate, '[A-Z]{3}[0-9]{1,3}[A-Z]') THEN 'suffix' WHEN regexp_full_match(plate, '[0-9]{1,4}[A-Z]{1,3}') THEN 'dateless_numeric'
WHEN regexp_full_match(plate, '[A-Z]{1,3}[0-9]{1,4}') THEN 'dateless_alpha' END AS kind FROM p""",
)
def _(t):
    plate = X.normal_registration(F.col("registration"))
    return t.vehicles().select("vehicle_id", plate.alias("plate"), X.registration_kind(plate).alias("kind"))


ODD_EMAILS = ["o'neil@x.com", "j@x.org", "a@b@c.de", "@nope.com", "no.dot@host", "UP@X.Y ", "", "x@.y"]


@query(
    "scl_s10_email",
    V + f""", e AS (SELECT vehicle_id, email FROM vehicles UNION ALL SELECT -vehicle_id, {pick_sql(ODD_EMAILS, "vehicle_id")} FROM vehicles),
p AS (SELECT vehicle_id, email, contains(email, '@') AS has, split_part(email, '@', -1) AS domain, left(email, greatest(0, length(email) - length(split_part(email, '@', -1)) - 1)) AS local
FROM e)
SELECT vehicle_id, CASE WHEN has AND local <> '' AND contains(domain, '.') THEN trim(lower(email)) END AS email,
CASE WHEN NOT has THEN '***' WHEN length(local) <= 1 THEN '*@' || domain ELSE left(local, 1) || '***@' || domain END AS masked FROM p""",
)
def _(t):
    rows = t.vehicles()
    both = rows.select("vehicle_id", "email").unionByName(
        rows.select((-F.col("vehicle_id")).alias("vehicle_id"), pick(ODD_EMAILS, F.col("vehicle_id")).alias("email"))
    )
    return both.select("vehicle_id", X.normal_email(F.col("email")).alias("email"), X.mask_email(F.col("email")).alias("masked"))


@query("scl_s11_short_hash", V + "SELECT vehicle_id, substr(sha256(registration), 1, 8) AS hash FROM vehicles")
def _(t):
    return t.vehicles().select("vehicle_id", X.short_hash(F.col("registration")).alias("hash"))


#: Text as it comes in, and what is left of it.
MARKUP = {
    "<b>Ann</b> Lee": "Ann Lee", "  plain  ": "plain", "a < b & c": "a &lt; b &amp; c", "<script>x</script>": "x", "<!-- note -->": None, "R&amp;D": "R&amp;D",
    "1 > 0": "1 &gt; 0", "<a href='/x'>link</a>, please": "link, please", "": None,
}
_CLEAN = f"CASE CAST(vehicle_id % {len(MARKUP)} AS INT) " + " ".join(
    f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(MARKUP.values())
) + " END"


@query(
    "scl_s12_sanitise",
    V + f"SELECT vehicle_id, left({_CLEAN}, 12) AS cleaned, nullif(left(trim(regexp_replace('tel ' || registration || ' (0)  +44-1', '[^0-9\\s+()-]', "
    "'', 'g')), 20), '') AS phone FROM vehicles",
)
def _(t):
    k = F.col("vehicle_id")
    phone = F.concat(F.lit("tel "), "registration", F.lit(" (0)  +44-1"))
    return t.vehicles().select("vehicle_id", X.clean_text(pick(list(MARKUP), k), 12).alias("cleaned"), X.clean_phone(phone).alias("phone"))


REGIME_SQL = (
    f"CASE WHEN {in_sql('trim(upper(raw_make))', OV.MOTORCYCLE_MAKES)} THEN 'Motorcycle' WHEN {in_sql('trim(upper(raw_make))', OV.COMMERCIAL_MAKES)} THEN "
    "'Commercial' ELSE 'Car' END"
)
_M = "trim(upper(model_id))"
POWER_SQL = (
    f"CASE WHEN {any_sql(_M, OV.BEV_WORDS)} THEN 'BEV' WHEN {any_sql(_M, OV.PHEV_WORDS)} THEN 'PHEV' WHEN {any_sql(_M, OV.HEV_WORDS)} THEN 'HEV' ELSE 'ICE' "
    "END"
)


@query("scl_s13_regime", V + f"SELECT vehicle_id, {REGIME_SQL} AS regime FROM vehicles")
def _(t):
    return t.vehicles().select("vehicle_id", X.regime(F.col("raw_make")).alias("regime"))


@query("scl_s14_powertrain", V + f"SELECT vehicle_id, {POWER_SQL} AS powertrain FROM vehicles")
def _(t):
    return t.vehicles().select("vehicle_id", X.powertrain(F.col("model_id")).alias("powertrain"))


@query(
    "scl_s15_body_type", V + f"SELECT vehicle_id, CASE WHEN {any_sql(_M, OV.COMMERCIAL_MODELS)} THEN 'Commercial' ELSE 'Passenger' END AS body FROM vehicles"
)
def _(t):
    return t.vehicles().select("vehicle_id", X.body_type(F.col("model_id")).alias("body"))


_VAN_IDS = ["RENAULT MASTER", "IVECO DAILY", "VOLKSWAGEN CRAFTER", "CITROEN DISPATCH", "MERCEDES-BENZ VITO", "FORD KA+", "VOLVO XC60", "CITROEN C4"]
_COHORT = """CASE
WHEN regexp_matches(upper(model_id), 'TRANSIT|SPRINTER|BOXER|TRAFIC|VIVARO|RELAY|MASTER|CRAFTER|DUCATO|DAILY|DISPATCH|TRANSPORTER|CADDY|BERLINGO|PARTNER|COMBO|PROACE|TALENTO|MOVANO|NV200|NV300|NV400')
THEN 'commercial_van'
WHEN regexp_matches(upper(model_id), 'CORSA|ADAM|VIVA|KA|500|PANDA|AYGO|YARIS|I10|I20|PICANTO|RIO|MICRA|NOTE|SWIFT|IGNIS|TWINGO|ZOE') THEN 'small_hatch'
WHEN split_part(model_id, ' ', 1) IN ('BMW', 'MERCEDES-BENZ', 'MERCEDES', 'AUDI', 'PORSCHE', 'JAGUAR', 'VOLVO', 'LAND ROVER', 'LEXUS') THEN 'euro_premium'
WHEN regexp_matches(upper(model_id), 'CLIO|MEGANE|CAPTUR|SCENIC|KADJAR|207|208|308|2008|3008|C3|C4|DS3|DS4') THEN 'french_compact' ELSE 'standard' END"""


@query(
    "scl_s16_cohort",
    V + f", c AS (SELECT vehicle_id, model_id FROM vehicles UNION ALL SELECT -vehicle_id, {pick_sql(_VAN_IDS, 'vehicle_id')} FROM vehicles) SELECT "
    f"vehicle_id, {_COHORT} AS cohort FROM c",
)
def _(t):
    rows = t.vehicles()
    both = rows.select("vehicle_id", "model_id").unionByName(
        rows.select((-F.col("vehicle_id")).alias("vehicle_id"), pick(_VAN_IDS, F.col("vehicle_id")).alias("model_id"))
    )
    return both.select("vehicle_id", X.vehicle_cohort(F.col("model_id"), X.first_word(F.col("model_id"))).alias("cohort"))


_RISKY = ["PEUGEOT 307", "FORD 500"]


@query("scl_s17_high_risk_flag", V + f"SELECT vehicle_id, CASE WHEN {in_sql('upper(model_id)', _RISKY)} THEN 1 ELSE 0 END AS flag FROM vehicles")
def _(t):
    return t.vehicles().select("vehicle_id", X.flag_in(F.col("model_id"), _RISKY).alias("flag"))


COMPONENT_SQL = "CASE " + " ".join(f"WHEN {any_sql('lower(defect)', w)} THEN '{c}'" for c, w in OV.COMPONENT_WORDS.items()) + " END"


@query("scl_s18_defect_component", V + f"SELECT vehicle_id, {COMPONENT_SQL} AS component FROM vehicles")
def _(t):
    return t.vehicles().select("vehicle_id", X.defect_component(F.col("defect")).alias("component"))


@query(
    "scl_s19_mechanisms",
    V + "SELECT vehicle_id, " + ", ".join(f"{any_sql('lower(defect)', w)} AS {m}" for m, w in OV.MECHANISM_WORDS.items()) + " FROM vehicles",
)
def _(t):
    return t.vehicles().select("vehicle_id", *[c.alias(n) for n, c in X.mechanism_flags(F.col("defect")).items()])


@query(
    "scl_s20_component_key",
    V + "SELECT vehicle_id, replace(CASE WHEN vehicle_id % 2 = 0 THEN defect ELSE 'risk_' || defect END, ' ', '_') AS key FROM vehicles",
)
def _(t):
    prefix = F.when(F.col("vehicle_id") % 2 == 0, "Risk_").otherwise("risk_")  # only the first spelling is a prefix
    return t.vehicles().select("vehicle_id", X.component_key(F.concat(prefix, "defect")).alias("key"))


LINKS_SQL = """links AS (SELECT page_id, regexp_extract(unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)), '^[^?#]*') AS link FROM pages)"""


@query("scl_s21_internal_links", f"WITH {LINKS_SQL} SELECT link, count(*) AS n, count(DISTINCT page_id) AS pages FROM links GROUP BY link")
def _(t):
    links = t("pages").select("page_id", F.explode(X.internal_links(F.col("html"))).alias("link"))
    return links.groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


# Bands -------------------------------------------------------------------------------------------------------------------------


def _banded(name: str, sql: str, fn, source: str = "inspections"):
    """A query that counts rows by band."""
    cte = I if source == "inspections" else f"WITH {HISTORY} "
    query(name, f"{cte}SELECT {sql} AS band, count(*) AS n FROM {source} GROUP BY 1")(
        lambda t: getattr(t, source)().groupBy(fn().alias("band")).agg(F.count(F.lit(1)).alias("n"))
    )


_age = "CASE WHEN line = 7 THEN NULL ELSE age_years - line // 6 END"


def _age_column():
    return F.when(F.col("line") != 7, F.col("age_years") - F.floor(F.col("line") / 6))


_banded("scl_b1_age_band", AGE_SQL.replace("age_years", f"({_age})"), lambda: R.age_band(_age_column()))
_banded("scl_b2_mileage_band", MILEAGE_SQL.replace("test_mileage", "(test_mileage * 6 - 20000)"), lambda: R.mileage_band(F.col("test_mileage") * 6 - 20000))
_banded("scl_b3_serving_age_band", bands_sql("age_years", OV.SERVING_AGE_BANDS, "15+", closed=True), lambda: R.serving_age_band(F.col("age_years")))
_banded(
    "scl_b4_closed_bins",
    "CASE WHEN line * 2 - 2 <= 0 THEN '0-2' WHEN line * 2 - 2 <= 2 THEN '3-5' WHEN line * 2 - 2 <= 5 THEN '6-10' WHEN line * 2 - 2 <= 10 THEN "
    "'11-15' ELSE '15+' END || ' ' || "
    "CASE WHEN test_mileage <= 30000 THEN '0-30k' WHEN test_mileage <= 60000 THEN '30k-60k' WHEN test_mileage <= 100000 THEN '60k-100k' ELSE '100k+' END",
    lambda: F.concat_ws(" ", R.tests_band(F.col("line") * 2 - 2), R.closed_mileage_band(F.col("test_mileage"))),
)
FINE_BANDS = ["1-2", "8-9", "UNKNOWN", "Unknown", "11-15", "4-5", "15+", "0-3", "10-11", "3-5", "5-6"]


@query(
    "scl_b5_age_key",
    f"WITH b AS (SELECT CASE WHEN p_partkey % 13 < 11 THEN {pick_sql(FINE_BANDS, 'p_partkey % 13')} END AS band FROM part) SELECT coalesce(band, "
    "'null') AS band, "
    "CASE WHEN band IS NULL OR band = 'UNKNOWN' THEN 'Unknown' WHEN band IN ('1-2', '0-3') THEN '0-2' WHEN band IN ('4-5', '3-5') THEN '3-5' WHEN band IN ('8-9', '5-6') THEN '6-10' "
    "WHEN band IN ('11-15', '10-11') THEN '11-15' ELSE '15+' END AS key, count(*) AS n FROM b GROUP BY ALL",
)
def _(t):
    band = F.when(F.col("p_partkey") % 13 < 11, pick(FINE_BANDS, F.least(F.col("p_partkey") % 13, F.lit(10))))
    rows = t("part").select(band.alias("band"))
    return rows.groupBy(F.coalesce("band", F.lit("null")).alias("band"), R.age_key(F.col("band")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


_banded("scl_b6_gap_band", bands_sql("age_years * 30", OV.GAP_BANDS, "very_late"), lambda: R.gap_band(F.col("age_years") * 30))
_banded("scl_b7_usage_band", bands_sql("test_mileage / 5", OV.USAGE_BANDS, "very_high"), lambda: R.usage_band(F.col("test_mileage") / 5))


@query(
    "scl_b8_confidence",
    I + "SELECT model_id, count(*) AS n, CASE WHEN count(*) >= 1000 THEN 'High' WHEN count(*) >= 100 THEN 'Medium' WHEN count(*) >= 20 THEN 'Low' "
    "ELSE 'Very Low' END AS confidence FROM inspections GROUP BY model_id",
)
def _(t):
    return t.inspections().groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).withColumn("confidence", R.confidence_class(F.col("n")))


@query("scl_b9_negligence", f"""WITH {HISTORY}, c AS (SELECT vehicle_id, sum(advisory) AS a, count(*) AS n FROM history GROUP BY vehicle_id), r AS (SELECT vehicle_id, least(a::DOUBLE / n, 1.0) AS ratio FROM c)
SELECT vehicle_id, round(ratio, 6) AS ratio, CASE WHEN ratio <= 0 THEN 'clean' WHEN ratio < 0.3 THEN 'low' WHEN ratio < 0.6 THEN 'high'
ELSE 'chronic' END AS band FROM r""")
def _(t):
    ratio, band = R.negligence(F.col("a"), F.col("n"))
    return t.history().groupBy("vehicle_id").agg(F.sum("advisory").alias("a"), F.count(F.lit(1)).alias("n")).select(
        "vehicle_id", F.round(ratio, 6).alias("ratio"), band.alias("band")
    )


@query(
    "scl_b10_risk_levels",
    f"""WITH {CUBE} SELECT model_id, age_band, mileage_band, CASE WHEN risk >= 0.35 THEN 'HIGH' WHEN risk >= 0.2 THEN 'MODERATE' ELSE 'LOW' END AS email,
CASE WHEN risk_brakes >= 0.15 THEN 'High' WHEN risk_brakes >= 0.08 THEN 'Medium' ELSE 'Low' END AS fault, CASE WHEN risk * 100 > 50 THEN 'high'
WHEN risk * 100 > 30 THEN 'medium' ELSE 'low' END AS report FROM cube""",
)
def _(t):
    report = R.below(F.col("risk") * 100, [(30, "low"), (50, "medium")], "high", closed=True)
    email, fault = R.cut_class(F.col("risk"), 0.35, 0.20, ("HIGH", "MODERATE", "LOW")), R.cut_class(
        F.col("risk_brakes"), 0.15, 0.08, ("High", "Medium", "Low")
    )
    return t.cube().select("model_id", "age_band", "mileage_band", email.alias("email"), fault.alias("fault"), report.alias("report"))


@query(
    "scl_b11_verdict",
    f"WITH {CUBE} SELECT CASE WHEN risk < 0.15 THEN 'Good reliability' WHEN risk < 0.3 THEN 'Moderate reliability' WHEN risk < 0.45 THEN 'Below "
    "average reliability' "
    "ELSE 'High risk vehicle' END AS verdict, count(*) AS cells, sum(n)::BIGINT AS n FROM cube GROUP BY 1",
)
def _(t):
    return t.cube().groupBy(R.verdict(F.col("risk")).alias("verdict")).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"))


@query("scl_b12_recommendation", f"""WITH {CUBE}, p AS (SELECT model_id, age_band, mileage_band, risk, CAST(n % 200 AS INT) - 20 AS d FROM cube),
a AS (SELECT *, CASE WHEN risk >= 0.5 THEN 'GET_QUOTES' WHEN risk >= 0.3 THEN 'PRE_MOT_CHECK' WHEN d < 0 OR d <= 30 THEN 'BOOK_MOT'
ELSE 'SET_REMINDER' END AS action FROM p)
SELECT model_id, age_band, mileage_band, action AS "primary", CASE WHEN action IN ('GET_QUOTES', 'PRE_MOT_CHECK') THEN 'SET_REMINDER'
WHEN action = 'BOOK_MOT' THEN 'GET_QUOTES' ELSE 'FIND_GARAGE' END AS secondary,
CASE WHEN risk > 0.33 AND action IN ('GET_QUOTES', 'PRE_MOT_CHECK') THEN 'COST_ESTIMATE' WHEN d < 0 OR d <= 90 THEN 'MOT_COUNTDOWN'
ELSE 'REMINDER_PITCH' END AS card FROM a""")
def _(t):
    days = (F.col("n") % 200).cast("int") - 20
    return t.cube().withColumn("r", R.recommendation(F.col("risk"), days, days < 0, F.col("risk") > 0.33)).select(
        "model_id", "age_band", "mileage_band", "r.primary", "r.secondary", "r.card"
    )


@query(
    "scl_b13_chart_class",
    f"WITH {CUBE} SELECT model_id, round(100 * sum(risk * n) / sum(n), 6) AS pct, CASE WHEN 100 * sum(risk * n) / sum(n) >= 35 THEN 'red' WHEN 100 * "
    "sum(risk * n) / sum(n) >= 20 THEN 'amber' ELSE 'green' END AS colour FROM cube GROUP BY model_id",
)
def _(t):
    rates = t.cube().groupBy("model_id").agg((100 * F.try_divide(F.sum(F.col("risk") * F.col("n")), F.sum("n"))).alias("pct"))
    return rates.select("model_id", F.round("pct", 6).alias("pct"), R.cut_class(F.col("pct"), 35, 20, ("red", "amber", "green")).alias("colour"))


# Math --------------------------------------------------------------------------------------------------------------------------


def wilson_sql(k: str, n: str, z: float) -> tuple[str, str]:
    centre, scale = f"({k}::DOUBLE / {n} + {z * z} / (2 * {n}))", f"(1 + {z * z} / {n})"
    margin = f"({z} * sqrt(({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) + {z * z} / (4 * {n})) / {n}))"
    return f"greatest(0.0, ({centre} - {margin}) / {scale})", f"least(1.0, ({centre} + {margin}) / {scale})"


_LOW, _HIGH = wilson_sql("sum(target)", "count(*)", 1.96)


@query(
    "scl_m1_wilson",
    I + f"SELECT model_id, age_years, count(*) AS n, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM inspections GROUP BY model_id, age_years",
)
def _(t):
    low, high = R.wilson(F.col("k"), F.col("n"))
    grouped = t.inspections().groupBy("model_id", "age_years").agg(F.sum("target").alias("k"), F.count(F.lit(1)).alias("n"))
    return grouped.select("model_id", "age_years", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "scl_m2_clamp",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, round(CASE WHEN l_linenumber = 3 THEN 0.0 ELSE greatest(0.0, least(1.0, l_extendedprice / 50000 - "
    "0.3)) END, 6) AS clamped FROM lineitem",
)
def _(t):
    risk = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 50000 - 0.3)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(R.clamp(risk), 6).alias("clamped"))


@query("scl_m3_haversine", f"""SELECT c_custkey, round({OV.EARTH_MILES} * 2 * atan2(sqrt(a), sqrt(1 - a)), 4) AS miles FROM (SELECT c_custkey, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2) AS a
FROM (SELECT c_custkey, 50 + c_custkey % 89 / 10.0 AS lat1, -5 + c_custkey % 71 / 10.0 AS lon1, 50 + c_custkey % 83 / 10.0 AS lat2, -5 + c_custkey % 67 / 10.0 AS lon2
FROM customer))""")
def _(t):
    at = lambda base, m: base + (F.col("c_custkey") % m) / 10.0
    return t("customer").select("c_custkey", F.round(R.haversine(at(50, 89), at(-5, 71), at(50, 83), at(-5, 67)), 4).alias("miles"))


def tens_sql(v: str) -> str:
    return f"CAST(round_even({v} / 10, 0) * 10 AS BIGINT)"


_PER = " + ".join(f"risk_{c} * {v}" for c, v in OV.TYPICAL_COSTS.items())


@query(
    "scl_m4_expected_cost",
    f"WITH {CUBE}, m AS (SELECT model_id, age_band, mileage_band, ({_PER}) / risk AS mid FROM cube WHERE risk > 0) SELECT model_id, age_band, "
    f"mileage_band, {tens_sql('greatest(0.6 * mid, 150.0)')} AS cost_min, {tens_sql('mid')} AS cost_mid, {tens_sql('1.7 * mid')} AS cost_max FROM m",
)
def _(t):
    cost = R.expected_cost({c: F.col(f"risk_{c}") for c in R.COMPONENTS}, F.col("risk"))
    return t.cube().where("risk > 0").withColumn("cost", cost).select("model_id", "age_band", "mileage_band", "cost.*")


_MIX = " + ".join(f"risk_{c} * {v}" for c, v in OV.MIDPOINT_COSTS.items())


@query(
    "scl_m5_scaled_cost",
    f"WITH {CUBE}, m AS (SELECT model_id, age_band, mileage_band, greatest(({_MIX}) * greatest(0.5, least(3.0, risk / {OV.AVERAGE_FAIL_RATE})), 100.0) AS "
    f"e FROM cube WHERE risk > 0) SELECT model_id, age_band, mileage_band, {tens_sql('e')} AS expected, {tens_sql('greatest(e * 0.5, 50.0)')} AS "
    f"range_low, {tens_sql('e * 2')} AS range_high FROM m",
)
def _(t):
    cost = R.scaled_cost({c: F.col(f"risk_{c}") for c in R.COMPONENTS}, F.col("risk"))
    return t.cube().where("risk > 0").withColumn("cost", cost).select("model_id", "age_band", "mileage_band", "cost.*")


_COSTS = """costs(component, low, high, usual) AS (VALUES ('brakes', 80, 350, 180), ('suspension', 150, 600, 350), ('tyres', 60, 200, 100), ('steering', 100, 500, 250),
('visibility', 20, 150, 60), ('lamps', 30, 200, 80), ('body', 200, 1000, 450))"""
_UP = "CAST(round_even({0} * CASE WHEN age_years >= 10 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END, 0) AS BIGINT)"


@query(
    "scl_m6_component_cost",
    I + f", {_COSTS}, c AS (SELECT age_years, list_extract(['brakes', 'suspension', 'tyres', 'steering', 'visibility', 'lamps', 'engine'], line) AS component, "
    f"count(*) AS n FROM inspections GROUP BY ALL) SELECT age_years, component, n, {_UP.format('low')} AS cost_min, {_UP.format('high')} AS cost_max, "
    f"{_UP.format('usual')} AS typical, CASE WHEN low IS NOT NULL THEN age_years >= 10 END AS age_adjusted FROM c LEFT JOIN costs USING (component)",
)
def _(t):
    name = F.element_at(F.array(*[F.lit(c) for c in ("brakes", "suspension", "tyres", "steering", "visibility", "lamps", "engine")]), F.col("line"))
    grouped = t.inspections().groupBy("age_years", name.alias("component")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("cost", R.component_costs(F.col("component"), F.col("age_years"))).select("age_years", "component", "n", "cost.*")


COUNTS = f"""WITH {HISTORY}, c AS (SELECT vehicle_id, sum(CASE WHEN outcome = 'click' THEN 1 ELSE 0 END)::BIGINT AS brakes, sum(CASE
WHEN outcome = 'view' THEN 1 ELSE 0 END)::BIGINT AS suspension, sum(CASE WHEN outcome = 'signup' THEN 1 ELSE 0 END)::BIGINT AS steering,
sum(CASE WHEN outcome = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS tyres, sum(failed)::BIGINT AS fails, count(*) AS n, sum(reading) * 10 AS annual,
CAST(count(*) * 9 AS BIGINT) AS days FROM history GROUP BY vehicle_id)"""


def counts(t):
    """Per vehicle: how often each component was advised, fails, tests, yearly use and days since the last test."""
    of = lambda v: F.count_if(F.col("outcome") == v)
    return t.history().groupBy("vehicle_id").agg(
        of("click").alias("brakes"), of("view").alias("suspension"), of("signup").alias("steering"), of("purchase").alias("tyres"),
        F.sum("failed").alias("fails"), F.count(F.lit(1)).alias("n"), (F.sum("reading") * 10).alias("annual"), (F.count(F.lit(1)) * 9).alias("days")
    )


@query(
    "scl_m7_wear_proxies",
    COUNTS + " SELECT vehicle_id, steering + suspension + tyres AS front_end, round(brakes + ln(1 + n) / 3.0, 6) AS brake_stress, round(ln(1 + annual "
    "/ 10000) + greatest(0, days - 365) / 365.0 + ln(1 + n) / 3.0, 6) AS wear FROM c",
)
def _(t):
    age = F.log1p("n") / 3.0
    wear = F.log1p(F.col("annual") / 10000) + F.greatest(F.lit(0), F.col("days") - 365) / 365.0 + age
    return counts(t).select(
        "vehicle_id",
        (F.col("steering") + F.col("suspension") + F.col("tyres")).alias("front_end"),
        F.round(F.col("brakes") + age, 6).alias("brake_stress"),
        F.round(wear, 6).alias("wear"),
    )


@query("scl_m8_debt_score", COUNTS + """, d AS (SELECT *, CASE WHEN brakes > tyres THEN 'worsening' WHEN brakes = tyres THEN 'stable' ELSE 'improving' END AS trend FROM c)
SELECT vehicle_id, trend,
round(greatest(1.0, 1 + 0.7 * ln(1 + annual / 5000) + 0.3 * ln(1 + days / 30.0)) * (1.3 * ln(1 + suspension + steering) + 1.2 * ln(1 + brakes) + ln(1 + tyres)) *
CASE trend WHEN 'worsening' THEN 2.5 WHEN 'stable' THEN 1.5 ELSE 1.0 END, 5) AS debt FROM d""")
def _(t):
    trend = F.when(F.col("brakes") > F.col("tyres"), "worsening").when(F.col("brakes") == F.col("tyres"), "stable").otherwise("improving")
    rows = counts(t).withColumn("trend", trend)
    return rows.select(
        "vehicle_id",
        "trend",
        F.round(R.debt_score(*[F.col(c) for c in ("brakes", "suspension", "steering", "tyres", "trend", "days", "annual")]), 5).alias("debt"),
    )


@query("scl_m9_late_debt", COUNTS + " SELECT vehicle_id, round(greatest(0, days - 365) / 365.0, 6) AS debt FROM c")
def _(t):
    return counts(t).select("vehicle_id", F.round(F.greatest(F.lit(0), F.col("days") - 365) / 365.0, 6).alias("debt"))


@query("scl_m10_neglect", COUNTS + " SELECT vehicle_id, " + ", ".join(f"round({c} * {a}::DOUBLE + fails * {f}::DOUBLE + CASE WHEN n = 999 THEN 0 ELSE n END * ({s})::DOUBLE, 6) AS neglect_{c}" for c, (a, f, s) in OV.NEGLECT_WEIGHTS.items()) + " FROM c")
def _(t):
    since = F.when(F.col("n") == 999, 0).otherwise(F.col("n"))
    return counts(t).select(
        "vehicle_id", *[F.round(F.col(c) * a + F.col("fails") * f + since * s, 6).alias(f"neglect_{c}") for c, (a, f, s) in R.NEGLECT_WEIGHTS.items()]
    )


_PAIRS = [("brakes", "tyres"), ("brakes", "steering"), ("suspension", "tyres"), ("steering", "tyres"), ("suspension", "steering"), ("brakes", "suspension")]
_OVER = 13


@query(
    "scl_m11_cooccurrence",
    COUNTS + ", f AS (SELECT vehicle_id, "
    + ", "
    .join(f"(({c} > {_OVER})::INT) AS {c}" for c in ("brakes", "suspension", "steering", "tyres")) + " FROM c) SELECT vehicle_id, "
    + ", "
    .join(f"{a} * {b} AS {a}_{b}" for a, b in _PAIRS) + ", brakes + suspension + steering + tyres AS systems, CASE WHEN brakes + suspension + "
    "steering + tyres >= 2 THEN 1 ELSE 0 END AS multi FROM f",
)
def _(t):
    flags = {c: (F.col(c) > _OVER).cast("int") for c in ("brakes", "suspension", "steering", "tyres")}
    systems = sum(flags.values(), F.lit(0))
    return counts(t).select(
        "vehicle_id", *[(flags[a] * flags[b]).alias(f"{a}_{b}") for a, b in _PAIRS], systems.alias("systems"), (systems >= 2).cast("int").alias("multi")
    )


_SYSTEMS = ("brakes", "suspension", "steering", "tyres")
_FEW = "d AS (SELECT vehicle_id, brakes % 4 AS b, suspension % 4 AS su, steering % 5 AS st, tyres % 7 AS x FROM c)"  # small counts, zeros among them


def _few(t):
    return counts(t).select("vehicle_id", *[(F.col(c) % m).alias(c) for c, m in zip(_SYSTEMS, (4, 4, 5, 7), strict=True)])


@query(
    "scl_m12_decay_index",
    COUNTS + f""", {_FEW} SELECT vehicle_id, round(least(0.2 * greatest(b, su, st, x), 1.0), 6) AS decay,
CASE WHEN greatest(b, su, st, x) = 0 THEN 'CLEAN' WHEN least(b, 5) >= least(greatest(su, st, x), 5) THEN 'BRAKE'
WHEN least(su, 5) >= least(greatest(st, x), 5) THEN 'SUSP'
WHEN least(st, 5) >= least(x, 5) THEN 'STEER' ELSE 'STRUCT' END AS driver FROM d""",
)
def _(t):
    index, driver = R.decay(dict(zip(("BRAKE", "SUSP", "STEER", "STRUCT"), map(F.col, _SYSTEMS), strict=True)))
    return _few(t).select("vehicle_id", F.round(index, 6).alias("decay"), driver.alias("driver"))


@query(
    "scl_m13_text_indices",
    COUNTS + f""", {_FEW}, e AS (SELECT *, vehicle_id % 3 AS tests FROM d) SELECT vehicle_id, round(ln(1 + b), 6) AS corrosion_log,
round(ln(1 + su), 6) AS wear_log,
(b > 0)::INT AS has_corrosion, (b > 0)::INT + (su > 0)::INT + (st > 0)::INT + (x > 0)::INT AS mechanisms, CASE WHEN greatest(b, su, st, x) = 0 THEN
CASE WHEN tests > 0 THEN 'CLEAN' ELSE 'NO_HISTORY' END
WHEN b >= greatest(su, st, x) THEN 'CORROSION' WHEN su >= greatest(st, x) THEN 'WEAR' WHEN st >= x THEN 'LEAK' ELSE 'DAMAGE' END AS dominant FROM e""",
)
def _(t):
    named = dict(zip(("corrosion", "wear", "leak", "damage"), map(F.col, _SYSTEMS), strict=True))
    kinds, dominant = R.mechanisms(named, F.col("vehicle_id") % 3)
    logs = [
        F.round(F.log1p("brakes"), 6).alias("corrosion_log"),
        F.round(F.log1p("suspension"), 6).alias("wear_log"),
        (F.col("brakes") > 0).cast("int").alias("has_corrosion"),
    ]
    return _few(t).select("vehicle_id", *logs, kinds.alias("mechanisms"), dominant.alias("dominant"))


PLATT_SQL = f"1 / (1 + exp(-({OV.PLATT_A} * greatest(1e-8, least(1 - 1e-8, risk)) + ({OV.PLATT_B}))))"


@query("scl_m14_platt", f"WITH {CUBE} SELECT model_id, age_band, mileage_band, round({PLATT_SQL}, 4) AS calibrated FROM cube")
def _(t):
    return t.cube().select("model_id", "age_band", "mileage_band", F.round(R.platt(F.col("risk")), 4).alias("calibrated"))


@query(
    "scl_m15_calibration_check",
    f"""WITH {CUBE}, s AS (SELECT least(9, floor(risk * 10)) AS bucket, risk, {PLATT_SQL} - CASE WHEN n % 3 = 0 THEN 0.05 ELSE 0 END AS cal FROM cube),
o AS (SELECT *, lag(cal) OVER (ORDER BY risk, cal) AS before FROM s)
SELECT CAST(bucket AS INT) AS bucket, count(*) AS n, count(*) FILTER (cal <= 0 OR cal >= 1) AS outside, count(*) FILTER (cal < before) AS falling
FROM o GROUP BY bucket""",
)
def _(t):
    calibrated = R.platt(F.col("risk")) - F.when(F.col("n") % 3 == 0, 0.05).otherwise(0.0)  # not monotone, so that falls are found
    return M.calibration_check(t.cube().select("risk", calibrated.alias("cal")), "risk", "cal")


@query(
    "scl_m16_reliability_score", f"WITH {CUBE} SELECT model_id, age_band, mileage_band, CAST(floor((1 - risk) * 100 + 0.5) AS BIGINT) AS score FROM cube"
)
def _(t):
    return t.cube().select("model_id", "age_band", "mileage_band", F.floor((1 - F.col("risk")) * 100 + 0.5).alias("score"))


@query(
    "scl_m17_cohort_residuals",
    BANDED.join(("WITH ", "")) + ", m AS (SELECT model_id, age_band, avg(test_mileage) AS mean_mileage, avg(target) AS mean_target FROM banded GROUP "
    "BY ALL) SELECT model_id, age_band, round(avg(test_mileage / mean_mileage), 6) AS ratio, round(max(target - "
    "mean_target), 6) AS delta, count(*) AS n FROM banded JOIN m USING (model_id, age_band) GROUP BY ALL",
)
def _(t):
    rows = t.banded()
    means = rows.groupBy("model_id", "age_band").agg(F.avg("test_mileage").alias("mean_mileage"), F.avg("target").alias("mean_target"))
    joined = rows.join(means, ["model_id", "age_band"])
    return joined.groupBy("model_id", "age_band").agg(
        F.round(F.avg(F.try_divide(F.col("test_mileage"), F.col("mean_mileage"))), 6).alias("ratio"),
        F.round(F.max(F.col("target") - F.col("mean_target")), 6).alias("delta"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "scl_m18_corrosion_delta",
    I + ", a AS (SELECT area, avg(target) AS rate FROM inspections GROUP BY area) SELECT area, round(rate - (SELECT avg(target) FROM inspections), 6) "
    "AS train_delta, round(rate - 0.5, 6) AS serve_delta FROM a",
)
def _(t):
    rows = t.inspections()
    rates = rows.groupBy("area").agg(F.avg("target").alias("rate")).join(F.broadcast(rows.agg(F.avg("target").alias("all"))))  # one row
    return rates.select("area", F.round(F.col("rate") - F.col("all"), 6).alias("train_delta"), F.round(F.col("rate") - 0.5, 6).alias("serve_delta"))


# Dates -------------------------------------------------------------------------------------------------------------------------


@query(
    "scl_d1_calendar",
    "SELECT month(ts) AS month, isodow(ts) - 1 AS weekday, CASE WHEN month(ts) IN (10, 11, 12, 1, 2, 3) THEN 1 ELSE 0 END AS winter, count(*) AS n FROM "
    "events GROUP BY ALL",
)
def _(t):
    month = F.month("ts")
    return t("events").groupBy(
        month.alias("month"), F.weekday("ts").alias("weekday"), month.isin(10, 11, 12, 1, 2, 3).cast("int").alias("winter")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scl_d2_day_gap",
    "SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders "
    "ON l_orderkey = o_orderkey",
)
def _(t):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.datediff("l_shipdate", "o_orderdate").alias("days")
    )


@query(
    "scl_d3_month_clip",
    "SELECT CAST(least(CAST(date_trunc('month', o_orderdate) AS DATE), DATE '1997-06-01') AS VARCHAR) AS month, count(*) AS n FROM orders GROUP BY 1",
)
def _(t):
    return t("orders").groupBy(
        F.least(F.trunc("o_orderdate", "MM"), F.lit("1997-06-01").cast("date")).cast("string").alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scl_d4_age_years",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 5 ELSE CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-06-30') / 365) AS "
    "BIGINT) END AS age FROM orders",
)
def _(t):
    born = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return t("orders").select("o_orderkey", F.coalesce(F.floor(F.datediff(F.lit("2024-06-30").cast("date"), born) / 365), F.lit(5)).alias("age"))


@query(
    "scl_d5_tolerant_date",
    "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS parsed FROM orders",
)
def _(t):
    text = F.when(
        F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy.MM.dd HH:mm:ss")
    ).when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("not a date")
    return t("orders").select("o_orderkey", R.tolerant_date(text).cast("string").alias("parsed"))


@query(
    "scl_d6_days_until",
    "SELECT event_id, CAST(ceil((epoch(ts + INTERVAL 20 DAY) - epoch(TIMESTAMP '2024-02-01 12:00:00')) / 86400.0) AS BIGINT) AS days_left, epoch(ts + "
    "INTERVAL 20 DAY) < epoch(TIMESTAMP '2024-02-01 12:00:00') AS expired FROM events",
)
def _(t):
    seconds = F.unix_micros(
        F.col("ts").cast("timestamp") + F.expr("INTERVAL 20 DAYS")
    ) / 1e6 - F.unix_micros(F.lit("2024-02-01 12:00:00").cast("timestamp")) / 1e6
    return t("events").select("event_id", F.ceil(seconds / 86400).alias("days_left"), (seconds < 0).alias("expired"))


@query("scl_d7_month_start", "SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))


# Arrays, maps, JSON ------------------------------------------------------------------------------------------------------------

_ARG = "CASE " + " ".join(f"WHEN risk_{c} >= greatest({', '.join(f'risk_{d}' for d in R.COMPONENTS)}) THEN '{c}'" for c in R.COMPONENTS) + " END"


@query("scl_a1_argmax", f"WITH {CUBE} SELECT model_id, age_band, mileage_band, {_ARG} AS worst FROM cube")
def _(t):
    return t.cube().select("model_id", "age_band", "mileage_band", R.first_argmax({c: F.col(f"risk_{c}") for c in R.COMPONENTS}).alias("worst"))


_STACK = "SELECT model_id, age_band, mileage_band, unnest([" + ", ".join(repr(c) for c in R.COMPONENTS) + "]) AS component, unnest([" + ", ".join(
    f"risk_{c}" for c in R.COMPONENTS
) + "]) AS risk, unnest(range(7)) AS i FROM cube"


@query(
    "scl_a2_top_three",
    f"WITH {CUBE}, u AS ({_STACK}), r AS (SELECT *, row_number() OVER (PARTITION BY model_id, age_band, mileage_band ORDER BY risk DESC, i) AS k FROM u) "
    "SELECT model_id, age_band, mileage_band, string_agg(component, ',' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY ALL",
)
def _(t):
    return t.cube().select(
        "model_id", "age_band", "mileage_band", F.array_join(R.top_components({c: F.col(f"risk_{c}") for c in R.COMPONENTS}, 3), ",").alias("top")
    )


@query("scl_a3_unpivot", f"WITH {CUBE}, u AS ({_STACK}) SELECT model_id, age_band, mileage_band, component, round(risk, 9) AS risk FROM u")
def _(t):
    from roadlens.operators.cube import breakdown

    return breakdown(t.cube(), ["model_id", "age_band", "mileage_band"], R.COMPONENTS).withColumn("risk", F.round("risk", 9))


@query(
    "scl_a4_explode_nested",
    "SELECT o_custkey AS vehicle_id, l_orderkey AS test, l_linenumber AS item, l_quantity AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
)
def _(t):
    # a test's own items
    lines = t("lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("item"), F.col("l_quantity").alias("quantity"))).alias("items")
    )
    tests = t("orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(
        F.collect_list(F.struct(F.col("o_orderkey").alias("test"), "items")).alias("tests")
    )
    flat = tests.select(F.col("o_custkey").alias("vehicle_id"), F.explode_outer("tests").alias("t"))
    return flat.select("vehicle_id", "t.test", F.explode_outer("t.items").alias("i")).select("vehicle_id", "test", "i.item", "i.quantity")


@query(
    "scl_a5_defect_predicates",
    V + """SELECT vehicle_id, contains(lower(defect), 'advisory') AS advisory, contains(lower(defect), 'fail') OR size % 7 = 0 AS failure FROM vehicles""",
)
def _(t):
    defect = F.struct(F.when(F.col("size") % 7 == 0, "FAIL").otherwise("OTHER").alias("type"), F.col("defect").alias("text"))
    text = F.lower(F.to_json(defect))
    return t.vehicles().select("vehicle_id", text.contains("advisory").alias("advisory"), text.contains("fail").alias("failure"))


@query(
    "scl_a6_project_structs",
    "SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey",
)
def _(t):
    items = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    return items.select("l_orderkey", F.array_join(F.transform("items", lambda i: i["l_linenumber"].cast("string")), ",").alias("lines"))


@query(
    "scl_a7_map_default",
    f"SELECT n_nationkey, CASE r_name WHEN 'EUROPE' THEN 3 WHEN 'ASIA' THEN 2 ELSE 1 END AS weight FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def _(t):
    table = F.create_map(F.lit("EUROPE"), F.lit(3), F.lit("ASIA"), F.lit(2))
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", R.map_or(table, F.col("r_name"), F.lit(1)).alias("weight")
    )
