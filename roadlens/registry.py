"""Named queries: name -> callable(spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def load() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in ("scalars", "relational", "joins", "aggregates", "windows", "flows"):
        importlib.import_module(f"roadlens.plans.{name}")

    for name, columns in INT_COLUMNS.items():
        if not ORACLE_SQL[name].startswith("SELECT * REPLACE"):
            casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in columns.items())
            ORACLE_SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({ORACLE_SQL[name]})"


#: Oracle columns whose type differs from Spark's for the same function (day differences, date parts, row numbers, decimals).
INT_COLUMNS = {
    "scl_m12_decay_index": {"decay": "DOUBLE"}, "scl_d1_calendar": {
        "month": "INTEGER", "weekday": "INTEGER"
    }, "scl_d2_day_gap": {"days": "INTEGER"}, "flt02_years": {"year": "INTEGER"},
    "srt04_priority_first": {"place": "INTEGER"}, "srt05_business_priority": {"rank": "INTEGER"}, "srt07_priority_urls": {"place": "INTEGER"},
    "jn06_defaults": {
        "absent": "DOUBLE"
    }, "wn23_top_three_garages": {"place": "INTEGER"}, "jn17_nearest_value": {"place": "INTEGER"}, "wn22_one_per_maker": {"place": "INTEGER"}, "ag11_ranking": {"rank": "INTEGER"},
    "ag12_band_ranking": {"rank": "INTEGER"}, "ag15_models_by_maker": {"place": "INTEGER"}, "ag47_index_encoding": {
        "make_index": "INTEGER", "model_index": "INTEGER"
    }, "wn02_previous": {"days": "INTEGER"},
    "wn10_tests_since": {
        "since_advisory": "INTEGER", "since_failed": "INTEGER"
    }, "wn20_coverage": {"window_days": "INTEGER"}, "wn21_rank": {"place": "INTEGER"}, "wn25_drift_ratio": {"month": "INTEGER"},
    "wn26_days_late": {
        "late": "INTEGER", "train_late": "INTEGER"
    }, "ml01_recency_weights": {"year": "INTEGER"}, "snk06_matrix": {"year": "INTEGER", "weight": "DOUBLE"}, "src03_optional_source": {"strictness": "DOUBLE"},
}
