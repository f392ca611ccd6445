"""Work that must not grow faster than the tables: what is shuffled early, and what several jobs read again."""

from roadlens.operators import encoders as E
from roadlens.operators import metrics as M
from roadlens.operators import refresh as RF
from roadlens.plans.base import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_meet_orders_before_names_are_joined(spark, folder):
    joins = [x for x in plan(Tables(spark, folder).inspections()).splitlines() if "Join" in x]
    assert len(joins) == 4 and "o_orderkey" in joins[2] and "p_partkey" in joins[1]  # innermost but that of supplier and nation: orders


def test_fitted_tables_read_stored_sums(spark, folder):
    rows = Tables(spark, folder).inspections()
    _, fitted = RF.fit_encoder(rows, "target", [["make"], ["make", "model_id"]])
    saved = E.Encoder([["make"], ["make", "model_id"]], [10.0, 20.0]).fit(rows, "target", store=True)
    for table in (*fitted, *saved):
        assert "l_orderkey" not in plan(table)


def test_scores_are_read_from_lines_joined_once(spark, folder):
    from roadlens.plans.aggregates import scored

    assert "l_orderkey" not in plan(scored(Tables(spark, folder)))


def test_both_versions_of_a_refresh_read_one_cube(spark, folder, monkeypatch):
    import __spark_entry__ as entry
    from roadlens.plans import flows as PF

    refreshed = []
    refresh = PF.IO.full_refresh
    monkeypatch.setattr(PF.IO, "full_refresh", lambda df, *rest: refreshed.append(plan(df)) or refresh(df, *rest))
    entry.queries()["snk01_full_refresh"](spark, folder).count()
    assert len(refreshed) == 2 and not any("l_orderkey" in p for p in refreshed)


def test_risk_categories_read_scores_once(spark):
    scored = spark.createDataFrame([(0.05, 0), (0.2, 1), (0.3, 0), (0.9, 1), (0.95, None)], "score double, label int")
    found = M.risk_categories(scored, "score", "label")
    assert plan(found).count("LogicalRDD") + plan(found).count("LocalRelation") == 1
    got = {r.category: (r.n, r.share, r.lift) for r in found.collect()}
    assert got == {"GREEN": (1, 0.2, 0.0), "AMBER": (2, 0.4, 1.0), "RED": (2, 0.4, 2.0)}


def test_buckets_follow_the_number_of_lines(spark, folder, monkeypatch):
    import __spark_entry__ as entry
    from roadlens.plans import joins as PJ

    made = []
    bucketed = PJ.IO.bucketed
    monkeypatch.setattr(PJ.IO, "bucketed", lambda df, keys, n: made.append(n) or bucketed(df, keys, n))
    monkeypatch.setattr(PJ, "BUCKET_LINES", 250, raising=False)
    rows = entry.queries()["jn01b_co_located"](spark, folder)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert made == [lines // 250] * 2 and rows.count() == lines


def test_seen_sets_hold_no_rows_of_a_batch():
    """Rows of a source's batch are let go of as they come; their order and the output stay those of (ts, id)."""
    import random

    from roadlens.streaming.jobs import SeenSet

    class Kept:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    alive, most = [0], [0]

    class Post:
        def __init__(self, id_, at):
            self.id, self.at = id_, at
            alive[0] += 1
            most[0] = max(most[0], alive[0])

        def __del__(self):
            alive[0] -= 1

    posts = [(f"u{random.Random(i).randrange(40)}", random.Random(i + 9999).randrange(500)) for i in range(2000)]
    seen = SeenSet(10, 20 / 3_600_000_000)
    seen.held = Kept()
    got = [(r.id, r.at) for r in seen.handleInputRows(("s",), (Post(*p) for p in posts), None)]
    held, want = {}, []
    for id_, at in sorted(posts, key=lambda p: (p[1], p[0])):
        while held and held[next(iter(held))] < at - 20:
            del held[next(iter(held))]
        if id_ not in held:
            held[id_] = at
            want.append((id_, at))
            if len(held) > 10:
                del held[next(iter(held))]
    assert got == want and most[0] < 10


def test_training_rows_hold_no_histories(spark):
    """Every test's features come from running sums of fixed size, with those of the nested history as the result (days shared, dates unknown)."""
    from pyspark.sql import functions as F

    from roadlens.operators import features as FE
    from roadlens.operators import training as TR

    i = F.col("id")
    defect = F.struct(F.element_at(F.array(*map(F.lit, ("Brake pad worn", "Tyre cut", "Spring rust"))), (i % 3 + 1).cast("int")).alias("text"), F.when(i % 2 == 0, "FAIL").otherwise("ADVISORY").alias("type"))
    tests = spark.range(0, 240, 1, 1).select(
        (i % 4).alias("vehicle_id"), i.alias("test_id"), F.when(i % 23 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (i / 8).cast("int") * 61)).alias("test_date"),
        F.when(i % 5 < 2, "FAILED").otherwise("PASSED").alias("result"), (i * 300).cast("int").alias("odometer"), F.when(i % 7 == 0, "km").otherwise("mi").alias("unit"),
        F.lit("2021-01-01").cast("date").alias("expiry"), F.when(i % 3 > 0, F.array(defect)).alias("defects"), F.lit("FORD").alias("make"), F.lit("KA").alias("model"),
        F.lit("M1 1AE").alias("postcode"), F.lit("2015-01-01").cast("date").alias("manufacture_date"), (i % 2).cast("int").alias("target"),
    )
    made = TR.base_features(tests)
    assert "collect_list" not in plan(made)
    names = ["test_id", *FE.FEATURE_NAMES]
    want = FE.history_features(TR.point_in_time(tests), F.col("test_date"), None, ("test_id", "test_date")).select(names)
    got = sorted(map(tuple, made.select(names).collect()), key=lambda r: r[0])
    assert got == sorted(map(tuple, want.collect()), key=lambda r: r[0]) and len(got) == 240


def test_cohort_means_are_stored_before_lines_meet_them(spark, folder):
    import __spark_entry__ as entry

    lines = plan(entry.queries()["jn13_cohort_ratio"](spark, folder)).splitlines()
    assert sum("Relation" in x and "l_orderkey" in x for x in lines) == 1


def test_rows_are_not_shuffled_by_an_encoders_keys(spark, folder):
    """A coarse level has few keys (three outcomes), so that a task would read half of all rows."""
    import __spark_entry__ as entry

    physical = entry.queries()["jn10_five_levels"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(prev_outcome" not in physical and physical.count("BroadcastHashJoin") >= 4
