"""Filters, projections, keyed dedupe, contracts and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.functions.text import clean_text, normal_email


def entity_or_variant(column: Column, entity: str) -> Column:
    """Equal to the entity or beginning with it and a space."""
    return (column == entity) | column.startswith(entity + " ")


def class_variants(make: str, model: str) -> list[str]:
    """The ids that a model goes by: its own, and for X-CLASS names the bare letter form too."""
    short = model.replace("-CLASS", "") if model.endswith("-CLASS") else None
    return [f"{make} {m}" for m in (model, short) if m is not None]


def any_entity_or_variant(rows: DataFrame, column: str, entities: DataFrame, entity: str) -> DataFrame:
    """Rows whose column equals one of the entities or begins with one and a space, each row once.

    Each distinct value is expanded into its leading word sequences, which meet the entities in an equi-join; the list may be long.
    """
    words = F.split(column, " ")
    leading = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    heads = rows.select(column).distinct().select(column, F.explode(leading).alias(entity))
    found = heads.join(entities.select(entity).distinct(), entity, "left_semi").select(column).distinct()
    return rows.join(found, column, "left_semi")


def prefix_match(rows: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows that begin with any of the prefixes; the test reaches the scan."""
    return rows.where(reduce(lambda a, b: a | b, [F.col(column).startswith(p) for p in prefixes], F.lit(False)))


def in_years(column: str, years: list[int]) -> Column:
    """Whether a stored time lies in one of the years: half-open ranges, which reach the scan as year(column) does not."""
    start = lambda y: F.lit(f"{y}-01-01").cast("timestamp_ntz")
    return reduce(lambda a, b: a | b, [(F.col(column) >= start(y)) & (F.col(column) < start(y + 1)) for y in years], F.lit(False))


def supported(rows: DataFrame, keys: list[str], least: int, *aggregates: Column) -> DataFrame:
    """Groups of at least so many rows, with n and further aggregates."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggregates).where(F.col("n") >= least)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with errors (names of broken rules, in their order) and valid; a rule that gives null is broken."""
    found = F.filter(
        F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]), lambda e: e.isNotNull()
    )
    return rows.withColumn("errors", found).withColumn("valid", F.size("errors") == 0)


URGENCIES = ["asap", "this_week", "this_month", "exploring"]


def lead_rules(this_year: int) -> dict[str, Column]:
    """What a lead must meet, by name, over columns mileage, year, failure_risk, reliability_score, urgency, consent, email, postcode, registration.

    Missing values of optional fields (the first five) are fine.
    """
    optional = lambda name, ok: F.col(name).isNull() | ok
    plate = F.upper(clean_text(F.col("registration"), 1_000_000))
    return {
        "mileage": optional("mileage", F.col("mileage").between(0, 1_000_000)),
        "year": optional("year", F.col("year").between(1900, this_year + 1)),
        "failure_risk": optional("failure_risk", F.col("failure_risk").between(0.0, 1.0)),
        "reliability_score": optional("reliability_score", F.col("reliability_score").between(0, 100)),
        "urgency": optional("urgency", F.col("urgency").isin(URGENCIES)),
        "consent": F.col("consent"),
        "email": normal_email(F.col("email")).isNotNull(),
        "postcode": F.length(F.regexp_replace("postcode", r"(?U)^\s+|\s+$", "")) >= 3,
        "registration": F.length(plate).between(1, 8),
    }


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that meet all rules, and the others with the names of those they break."""
    checked = validate(rows, rules)
    return checked.where("valid").drop("valid", "errors"), checked.where("not valid").drop("valid")


def with_optional_source(rows: DataFrame, path: str, key: str, defaults: dict[str, object]) -> DataFrame:
    """with_defaults over the Parquet table at path, or over none where there is no such path."""
    spark = rows.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    return with_defaults(rows, spark.read.parquet(path) if exists else None, key, defaults)


#: Defaults of the wide feature table, by the source that a feature comes from. Fixed values.
TEST_DEFAULTS = {
    "model_id": "UNKNOWN UNKNOWN", "prev_cycle_outcome_band": "NONE", "gap_band": "NONE", "make": "UNKNOWN", "age_band": "UNKNOWN", "test_mileage": 50000.0,
    "prior_fail_rate_smoothed": 0.33, "n_prior_tests": 0.0, "annualized_mileage": 8000.0, "postcode_area": "UNKNOWN", "mileage_percentile_for_age": 0.5,
    "n_prior_fails": 0.0, "fails_last_365d": 0.0, "fails_last_730d": 0.0,
}
HISTORY_DEFAULTS = {"prev_advisory_total": 0.0, "advisory_trend": "UNKNOWN", "days_since_prev_cycle": 730.0}
ADVISORY_DEFAULTS = {"prev_adv_brakes": 0.0, "prev_adv_suspension": 0.0, "prev_adv_steering": 0.0, "prev_adv_tyres": 0.0}
PATTERN_DEFAULTS = {"ponr_risk_score": 0.0, "has_ponr_pattern": 0}


def usage_band(recorded: Column, annual: Column) -> Column:
    """The recorded band if it is a known one, else one from the yearly use, else unknown."""
    by_use = F.when(annual < 5000, "low").when(annual < 12000, "medium").otherwise("high")
    return F.when(recorded.isin("low", "medium", "high"), recorded).when(annual > 0, by_use).otherwise("unknown")


def wide_features(tests: DataFrame, history: DataFrame, advisories: DataFrame, patterns: DataFrame, veterans_only: bool = True) -> DataFrame:
    """The feature table of tests: left joins on test_id with a default for every missing value.

    The development table and the out-of-time one differ in the history that is given. veterans_only leaves out tests without any earlier one.
    """
    rows = tests.where(three_valued_history(F.col("prev_cycle_outcome_band"), F.col("n_prior_tests"))) if veterans_only else tests
    linked = history.select("test_id", *HISTORY_DEFAULTS, F.lit(1).alias("has_cycle_history_link"))
    joined = rows.join(linked, "test_id", "left")
    joined = joined.join(
        advisories.select("test_id", *ADVISORY_DEFAULTS), "test_id", "left"
    ).join(patterns.select("test_id", *PATTERN_DEFAULTS), "test_id", "left")
    filled = lambda name, value: F.coalesce(F.col(name), F.lit(value)).cast({str: "string", float: "double", int: "int"}[type(value)])
    days = filled("days_since_prev_cycle", 730.0)
    return joined.select(
        "test_id", "vehicle_id", "test_date", F.col("is_failure").cast("int").alias("target"),
        *[filled(c, v).alias(c) for c, v in TEST_DEFAULTS.items()],
        filled("prev_advisory_total", 0.0).alias("prev_count_advisory"), filled("advisory_trend", "UNKNOWN").alias("advisory_trend"),
        days.alias("days_since_last_test"), (days - 365).alias("days_late"), filled("has_cycle_history_link", 0).alias("has_cycle_history_link"),
        *[filled(c, v).alias(c) for c, v in ADVISORY_DEFAULTS.items()],
        usage_band(F.col("usage_intensity_band"), F.col("annualized_mileage")).alias("usage_band_hybrid"),
        *[filled(c, v).alias(c) for c, v in PATTERN_DEFAULTS.items()],
    )


def with_defaults(rows: DataFrame, features: DataFrame | None, key: str, defaults: dict[str, object]) -> DataFrame:
    """rows with the features' columns, or their defaults where a key or the whole source is missing."""
    if features is None:
        return rows.withColumns({c: F.lit(v) for c, v in defaults.items()})
    return rows.join(features.select(key, *defaults), key, "left").na.fill(defaults)


def add_missing(rows: DataFrame, names: list[str], value: object = 0) -> DataFrame:
    return rows.withColumns({c: F.lit(value) for c in names if c not in rows.columns})


def rename_drop(rows: DataFrame, renames: dict[str, str], drops: list[str]) -> DataFrame:
    return rows.withColumnsRenamed(renames).drop(*drops)


def clean_names(rows: DataFrame) -> DataFrame:
    """Column names with special characters as underscores, trimmed, in Title_Case."""
    import re

    return rows.toDF(*["_".join(p.capitalize() for p in re.sub(r"[^0-9A-Za-z]+", "_", c).strip("_").split("_")) for c in rows.columns])


def remap(column: Column, table: dict[str, str]) -> Column:
    """Values through the table; others pass. Idempotent if targets are no sources."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), column), column)


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, covered: the share of rows that have each column, from one pass."""
    shares = rows.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return shares.unpivot([], columns, "feature", "covered")


def contract(rows: DataFrame) -> DataFrame:
    """name, position, dtype, null_rate, least, most of every column, from one aggregation over all columns."""
    numeric = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)}
    stats = []
    for f in rows.schema.fields:
        value = F.col(f.name)
        bounds = (
            F.min(value).cast("double"), F.max(value).cast("double")
        ) if f.name in numeric else (F.lit(None).cast("double"), F.lit(None).cast("double"))
        stats.append(
            F.struct(
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.avg(value.isNull().cast("double")).alias("null_rate"),
                bounds[0].alias("least"),
                bounds[1].alias("most"),
            ).alias(f"s_{f.name}")
        )
    one = rows.agg(*stats)
    return one.select(F.posexplode(F.array(*[F.col(f"s_{f.name}") for f in rows.schema.fields])).alias("position", "s")).select("position", "s.*")


def contract_problems(rows: DataFrame, names: list[str]) -> list[tuple[str, str]]:
    """(column, problem) of a table held against an ordered list of names: missing, extra or misplaced."""
    have = rows.columns
    common = [c for c in have if c in names]
    wanted = [c for c in names if c in have]
    misplaced = [(c, "misplaced") for c, w in zip(common, wanted, strict=True) if c != w]
    return [(c, "missing") for c in names if c not in have] + [(c, "extra") for c in have if c not in names] + misplaced


def require_contract(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows, if its columns are the names in order; raises on missing, extra and misplaced ones."""
    if problems := contract_problems(rows, names):
        raise ValueError(f"columns differ from the contract: {problems}")
    return rows


def select_contract(rows: DataFrame, names: list[str], extra: list[str] | None = None) -> DataFrame:
    """The names in order from rows that have them in that order, without the columns that `extra` names; any other column raises."""
    return require_contract(rows.drop(*(extra or [])), names)


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is neither in existing nor earlier among themselves (by all columns)."""
    fresh = incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in incoming.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("first"))
    return first.select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest])


def three_valued_history(band: Column, n: Column) -> Column:
    """NOT (band is the no-history mark AND n is null or 0), nulls as SQL has them."""
    return ~((band == "NO_PRIOR_RECORDED") & (n.isNull() | (n == 0)))


def all_true(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))
