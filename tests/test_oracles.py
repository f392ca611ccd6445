"""Every registered query of the risk library against its DuckDB oracle, and the plans' shape."""

import pytest
from compare import check

from roadlens import registry

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(name, spark, duck, folder):
    check(name, spark, duck, folder, registry.QUERIES, registry.ORACLE_SQL)


@pytest.mark.parametrize("name", ["srt08_seeded_shuffle"])
def test_deterministic(name, spark, folder):
    assert registry.QUERIES[name](spark, folder).collect() == registry.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", ["jn17_nearest_value", "wn22_one_per_maker"])
def test_nearest_values_have_no_nested_loop(name, spark, folder):
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["ag45_risk_cube", "jn16_radius", "wn24_mileage_percentile", "wn05_recent_fails", "scl_s4_base_model", "ag32_auc"])
def test_plan_has_no_python_or_cartesian_product(name, spark, folder):
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = registry.QUERIES["src01_parquet_scan"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


@pytest.mark.parametrize("name", ["flt02_years", "prj01_wide_dev", "jn08_segment_make_global", "jn04_as_of_month", "ml04_batch_scoring"])
def test_date_bounds_reach_the_scan(name, spark, folder):
    """A bound on the stored time of the facts is pushed: it is no function of the column."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [p.split("ReadSchema")[0] for p in plan.split("PushedFilters:")[1:]]
    assert any("Than" in p and ("l_shipdate" in p or "o_orderdate" in p) for p in pushed)
