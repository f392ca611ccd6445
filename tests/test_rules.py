"""Edge values, golden constants and properties of the column functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadlens.functions import rules as R
from roadlens.functions import text as X
from roadlens.operators import encoders as E
from roadlens.operators import joins as J
from roadlens.operators import metrics as M
from roadlens.operators import relational as O
from roadlens.sources import files as IO


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_age_and_mileage_bands(spark):
    ages = [None, float("nan"), 0.0, 2.9, 3.0, 11.0, 15.9, 16.0, 25.0]
    assert values(spark, [(a,) for a in ages], "v double", R.age_band(F.col("v"))) == [
        "Unknown", "Unknown", "0-2", "0-2", "3-5", "11-15", "11-15", "15+", "15+"
    ]
    miles = [None, float("nan"), -1.0, 0.0, 29999.0, 30000.0, 59999.0, 60000.0, 99999.0, 100000.0, 200000.0, 500001.0]
    assert values(spark, [(m,) for m in miles], "v double", R.mileage_band(F.col("v"))) == [
        "Unknown", "Unknown", "Unknown", "0-30k", "0-30k", "30k-60k", "30k-60k", "60k-100k", "60k-100k", "100k+", "100k+", "Unknown"
    ]
    assert values(spark, [(30000.0,)], "v double", R.closed_mileage_band(F.col("v"))) == ["0-30k"]


@pytest.mark.parametrize("k,n", [(25, 100), (0, 0), (0, 100), (100, 100), (0, 10), (5, 10), (10, 10), (1, 1000), (999, 1000)])
def test_wilson(spark, k, n):
    low, high = R.wilson(F.col("k"), F.col("n"))
    row = spark.createDataFrame([(k, n)], "k long, n long").select(low.alias("l"), high.alias("h")).first()
    if n == 0:
        assert (row.l, row.h) == (0.0, 1.0)
    else:
        z, p = 1.96, k / n
        centre, margin = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)
        assert row.l == pytest.approx(max(0, centre - margin)) and row.h == pytest.approx(min(1, centre + margin))
        assert 0 <= row.l <= p <= row.h + 1e-12 <= 1 + 1e-9


def test_confidence_classes(spark):
    counts = [0, 10, 19, 20, 50, 99, 100, 500, 999, 1000, 5000]
    assert values(spark, [(c,) for c in counts], "v long", R.confidence_class(F.col("v"))) == ["Very Low"] * 3 + ["Low"] * 3 + ["Medium"] * 3 + ["High"] * 2


def test_platt_golden_and_monotone(spark):
    probes = [0.05, 0.25, 0.5, 0.75, 0.95]
    got = values(spark, [(p,) for p in probes], "v double", R.platt(F.col("v")))
    assert got == pytest.approx([1 / (1 + math.exp(-(R.PLATT_A * p + R.PLATT_B))) for p in probes], abs=1e-15)
    assert got == sorted(got) and max(got) - min(got) > 0.5


def test_costs(spark):
    risks = {c: F.lit(0.05) for c in R.COMPONENTS}
    row = spark.range(1).select(
        R.expected_cost(risks, F.lit(0.3)).alias("e"), R.expected_cost(risks, F.lit(0.0)).alias("none"), R.scaled_cost(risks, F.lit(0.28)).alias("s")
    ).first()
    assert row.e.asDict() == {"cost_min": 150, "cost_mid": 240, "cost_max": 420} and row.none is None
    assert row.s.expected == 100 and row.s.range_low == 50


def test_makers_models_and_plates(spark):
    makes = ["0pel", "LAND", " ford ", "THE", "unknown", "ASTON", None, ""]
    assert values(
        spark, [(m,) for m in makes], "v string", X.canonical_make(F.col("v"))
    ) == ["OPEL", "LAND ROVER", "FORD", None, None, "ASTON MARTIN", None, None]
    models = [("BMW 320D SE", "BMW"), ("FORD FIESTA 1.4L", "FORD"), ("FORD ZETEC", "FORD"), ("FORD 500", "FORD"), ("MG 3 STYLE", "MG"), (None, "MG")]
    assert [
        r[0] for r in spark.createDataFrame(models, "m string, k string").select(X.base_model(F.col("m"), F.col("k"))).collect()
    ] == ["3 SERIES", "FIESTA", None, None, "3", None]
    plates = ["AB12CDE", "A123BCD", "ABC123D", "AB1234", "1234AB", "1A", "ABCDEFGH", "1234567"]
    kinds = ["current", "prefix", "suffix", "dateless_alpha", "dateless_numeric", "dateless_numeric", None, None]
    assert values(spark, [(p,) for p in plates], "v string", X.registration_kind(F.col("v"))) == kinds
    asked = ["AB12 CDE", "A1ABC", "1A", "A", "ABCDEFGH", "ABCDEF", "123456", None]
    assert values(spark, [(p,) for p in asked], "v string", X.registration_valid(F.col("v"))) == [True, True, True, False, False, False, False, False]
    raw = ["ab 12 cde", " ab12cde\n", "ZZ-99-ZZZ", "A", "ABCDEFGHI", "", None, "AB1\t2"]
    assert values(spark, [(p,) for p in raw], "v string", X.normal_registration(F.col("v"))) == ["AB12CDE", "AB12CDE", None, None, None, None, None, None]


def test_names_and_slugs(spark):
    def on(column, texts):
        return values(spark, [(t,) for t in texts], "v string", column)

    v = F.col("v")
    assert on(
        X.slugify(v), ["3 SERIES", "LAND ROVER", "Lamps & Electrics", "a - b", " x ", "C-CLASS (W205)", "é"]
    ) == ["3-series", "land-rover", "lamps-and-electrics", "a---b", "x", "c-class-w205", ""]
    assert on(
        X.display_name(v), ["FORD", "BMW", "mg", "LAND ROVER", "BMW 320D SE", "MERCEDES-BENZ", "A3", "C'EED", ""]
    ) == ["Ford", "BMW", "mg", "Land Rover", "Bmw 320D Se", "Mercedes-Benz", "A3", "C'Eed", ""]
    made = spark.createDataFrame([("ROLLS ROYCE GHOST",), ("Ds Automobiles DS 3",), ("MG",), ("ford FOCUS ST",)], "v string")
    make, model = X.split_make(v)
    assert [tuple(r) for r in made.select(make, model).collect()] == [
        ("Rolls Royce", "Ghost"), ("Ds Automobiles", "Ds 3"), ("MG", ""), ("Ford", "Focus St")
    ]
    assert on(X.component_key(v), ["Risk_Brakes", "Lamps Reflectors", "risk_x"]) == ["Brakes", "Lamps_Reflectors", "risk_x"]
    assert on(X.clean_text(v, 20), ["<b>a</b> & b", "<x", "<!-- c -->", None]) == ["a &amp; b", "&lt;x", None, None]


def test_postcodes_and_emails(spark):
    def on(column, texts):
        return values(spark, [(t,) for t in texts], "v string", column)

    v = F.col("v")
    assert on(X.postcode_area(v), ["SW1A 1AA", " n1", "QQ", "SW", "1AB", "", None]) == ["SW", "N", "QQ", "SW", None, None, None]
    assert on(
        X.postcode_valid(v), ["SW1A 1AA", "SW1A1AA", "S W1A 1AA", "EC2V", "M1  1AE", "QQ", "", None]
    ) == [True, True, False, True, True, False, False, False]
    assert on(X.normal_email(v), ["o'neil@X.com ", "a@b@c.de", "@x.com", "a@b", "none", None]) == ["o'neil@x.com", "a@b@c.de", None, None, None, None]
    assert on(
        X.mask_email(v), ["john@example.com", "j@x.org", "@x.org", "none", "", None]
    ) == ["j***@example.com", "*@x.org", "*@x.org", "***", "***", "***"]
    assert on(X.in_areas(v, ["N"]), ["N1 9GU", "NW1", None]) == [True, False, False] and on(
        X.in_areas(v, ["N"], True), ["N1 9GU", "NW1", None]
    ) == [True, True, False]


def test_fixed_bands_and_labels(spark):
    def on(column, rows, kind="double"):
        return values(spark, [(x,) for x in rows], f"v {kind}", column)

    v = F.col("v")
    assert on(R.tests_band(v), [None, 0, 1, 2, 3, 5, 6, 10, 11], "int") == ["0-2", "0-2", "3-5", "3-5", "6-10", "6-10", "11-15", "11-15", "15+"]
    assert on(
        R.age_key(v), ["1-2", "8-9", "UNKNOWN", None, "11-15", "15+", "Unknown"], "string"
    ) == ["0-2", "6-10", "Unknown", "Unknown", "11-15", "15+", "15+"]
    assert on(R.verdict(v), [0.1, 0.15, 0.3, 0.45]) == ["Good reliability", "Moderate reliability", "Below average reliability", "High risk vehicle"]
    assert on(R.negligence(v, F.lit(10))[1], [0, 2, 3, 6, 20], "int") == ["clean", "low", "high", "chronic", "chronic"]
    assert on(R.negligence(v, F.lit(0))[1], [3], "int") == ["clean"]
    vans = [
        ("RENAULT MASTER", "commercial_van"),
        ("IVECO DAILY", "commercial_van"),
        ("MERCEDES-BENZ VITO", "euro_premium"),
        ("FORD KA+", "small_hatch"),
        ("CITROEN C4", "french_compact"),
        ("SKODA X", "standard"),
    ]
    assert on(X.vehicle_cohort(v, X.first_word(v)), [m for m, _ in vans], "string") == [c for _, c in vans]
    counts = spark.createDataFrame([(0, 0, 0, 0), (1, 1, 0, 0), (0, 2, 3, 3), (9, 7, 0, 0), (0, 0, 0, 1)], "a int, b int, c int, d int")
    index, driver = R.decay(dict(zip(("BRAKE", "SUSP", "STEER", "STRUCT"), map(F.col, "abcd"), strict=True)))
    assert [r[0] for r in counts.select(driver).collect()] == ["CLEAN", "BRAKE", "STEER", "BRAKE", "STRUCT"] and [
        r[0] for r in counts.select(F.round(index, 6)).collect()
    ] == [0.0, 0.2, 0.6, 1.0, 0.2]
    kinds, dominant = R.mechanisms(dict(zip(("corrosion", "wear", "leak", "damage"), map(F.col, "abcd"), strict=True)), F.col("b") - 1)
    assert [tuple(r) for r in counts.select(kinds, dominant).collect()] == [
        (0, "NO_HISTORY"), (2, "CORROSION"), (3, "LEAK"), (2, "CORROSION"), (1, "DAMAGE")
    ]
    asks = ["My MOT failed?", "the motor runs", "annual test: should I worry", "mot check", "MOT due, any advice before the test", None]
    assert on(X.relevant(v), asks, "string") == [True, False, True, False, True, False]


def test_remap_is_idempotent_and_passes_others(spark):
    table = {"stable": "STABLE", "increasing": "WORSENING"}
    once = O.remap(F.col("v"), table)
    rows = [("stable",), ("increasing",), ("other",), (None,)]
    assert values(spark, rows, "v string", once) == ["STABLE", "WORSENING", "other", None] == values(spark, rows, "v string", O.remap(once, table))


def test_shrunk_rate_lies_between_raw_and_parent(spark):
    rows = spark.createDataFrame([("a", 1)] * 9 + [("a", 0)] + [("b", 0)] * 30 + [(None, 1)] * 5, "k string, y int")
    overall = rows.agg(F.avg("y")).first()[0]
    for r in E.shrink(rows.na.drop(), "k", "y", 5.0).collect():
        raw = {"a": 0.9, "b": 0.0}[r.k]
        assert min(raw, 9 / 40) <= r.rate <= max(raw, 9 / 40)
    assert overall > 0


def test_out_of_fold_rates_ignore_their_own_fold(spark):
    rows = spark.createDataFrame([("a", f, 1 if f == 0 else 0) for f in range(5) for _ in range(4)], "k string, f int, y int")
    rates = {r.fold: r.rate for r in E.out_of_fold(rows, "k", "y", 1.0, 5, F.col("f")).select("fold", "rate").distinct().collect()}
    assert rates[0] == 0.0 and all(rates[f] > 0 for f in (1, 2, 3, 4))


def test_unseen_keys_fall_back(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("b", "x", 0)], "m string, o string, y int")
    encoder = E.Encoder([["m"], ["m", "o"]], [1.0, 1.0])
    out = encoder.transform(spark.createDataFrame([("a", "z"), ("c", "x"), (None, None)], "m string, o string"), encoder.fit(rows, "y"), "rate")
    assert out.where("rate is null").count() == 0 and out.count() == 3


def test_auc_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([("g", 0.1, 0), ("g", 0.5, 1), ("g", 0.5, 0), ("g", 0.9, 1), ("h", 0.3, 1)], "k string, s double, y int")
    got = {r.k: r.auc for r in M.auc(rows, "s", "y", ["k"]).collect()}
    assert got["g"] == pytest.approx(0.875) and got["h"] is None


def test_latest_before(spark):
    rows = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, at int")
    facts = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (1, 6, "z")], "k int, since int, v string")
    assert {(r.k, r.at): r.v for r in J.latest_before(rows, facts, "k", "at", "since", "v").collect()} == {(1, 5): "y", (1, 1): None, (2, 9): None}


def test_latest_before_with_null_values_and_ties(spark):
    rows = spark.createDataFrame([(1, 9), (1, 4)], "k int, at int")
    facts = spark.createDataFrame([(1, 3, "old", 1), (1, 5, None, 1), (1, 4, "a", 2), (1, 4, "z", 1)], "k int, since int, v string, rank int")
    assert {r.at: r.v for r in J.latest_before(rows, facts, "k", "at", "since", "v").collect()} == {9: None, 4: "z"}
    assert {r.at: r.v for r in J.latest_before(rows, facts, "k", "at", "since", "v", "rank").collect()} == {9: None, 4: "a"}


@pytest.mark.parametrize("where", ["70N", "pole", "equator", "antimeridian"])
def test_radius_join_equals_brute_force_everywhere(spark, where):
    rng = random.Random(where)
    lat, lon = {
        "70N": ((69, 71), (10, 14)), "pole": ((88.5, 90), (-180, 180)), "equator": ((-1, 1), (-1, 1)), "antimeridian": ((59, 61), (178, 182))
    }[where]

    def points(n):
        return [(i, rng.uniform(*lat), (rng.uniform(*lon) + 180) % 360 - 180) for i in range(n)]

    a, b = points(150), points(120)
    found = J.within_radius(spark.createDataFrame(a, "id int, lat double, lon double"), spark.createDataFrame(b, "rid int, rlat double, rlon double"), 25)
    got = [(r.id, r.rid) for r in found.collect()]

    def miles(p, q):
        la, lb = math.radians(p[1]), math.radians(q[1])
        x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 3959.0 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    want = {(p[0], q[0]) for p in a for q in b if miles(p, q) <= 25}
    assert set(got) == want and len(got) == len(set(got)) and len(want) > 20


def test_fan_out_fails_before_the_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (None, "n"), (None, "m")], "k int, r string")
    assert J.guarded_join(left, right, ["k"], 2).count() == 5 and J.guarded_join(left, right, ["k"], 1, "inner").count() == 3
    for factor, how in ((1.5, "left"), (0.9, "inner")):
        with pytest.raises(ValueError, match="fans out"):
            J.guarded_join(left, right, ["k"], factor, how)
    assert J.guarded_join(left.limit(0), right, ["k"]).count() == 0


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(k, v, rng.randint(1, 5)) for k in "ab" for v in rng.sample(range(10_000), 900)]
    got = {(r.k, r.v): r.before_n for r in M.preceding(spark.createDataFrame(rows, "k string, v int, n int"), "v", ["n"], ["k"], slots=16).collect()}
    assert got == {(k, v): sum(n for j, w, n in rows if j == k and w < v) for k, v, _ in rows}
    frame = spark.createDataFrame(
        [(1.0, 0.2), (2.0, 0.3), (3.0, 0.1), (4.0, 0.4), (5.0, 1.0)], "raw double, cal double"
    ).selectExpr("raw / 10 AS raw", "cal")
    assert M.calibration_check(frame, "raw", "cal", 1).first().asDict() == {"bucket": 0, "n": 5, "outside": 1, "falling": 1}


def test_read_table_over_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("id", "id % 7 AS kind").write.format("jdbc").options(url=url, dbtable="t").mode("overwrite").save()
    got = IO.read_table(spark, url, "t", "id", 0, 100, 4, '"kind" = 3')
    assert got.count() == 14 and got.rdd.getNumPartitions() == 4


def test_log_with_backup_and_replay(spark, tmp_path):
    from roadlens.streaming import jobs

    path, backup = f"{tmp_path}/log", f"{tmp_path}/backup"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string")

    def refuse(df, to):
        raise OSError("full")

    assert jobs.append_log(rows.where("id = 1"), 0, path, backup) == f"{path}/batch=0"
    assert jobs.append_log(rows.where("id = 2"), 1, path, backup, refuse) == f"{backup}/batch=1"
    read = lambda: sorted(tuple(r) for r in jobs.replay(spark, path, backup, "id long, kind string").collect())
    assert read() == [(1, "a"), (2, "b")]
    jobs.append_log(rows.where("id = 2"), 1, path, backup)  # the batch runs again, and its store takes it
    assert read() == [(1, "a"), (2, "b")]


def test_leads_are_split_by_validity(spark):
    schema = (
        "mileage long, year int, failure_risk double, reliability_score int, urgency string, consent boolean, email string, postcode string, "
        "registration string"
    )
    good = (None, None, None, None, None, True, "a@b.c", "N1 ", "ab12cde")
    rows = spark.createDataFrame(
        [
            (0, 2027, 1.0, 100, "asap", True, "a@b.c", "N1 1AA", "A1"),
            (1_000_001, 1899, 1.1, 101, "now", False, "a@b", " N ", ""),
            (*good[:7], "N1A", "ab12cde"),
        ],
        schema,
    )
    kept, held = O.quarantine(rows, O.lead_rules(2026))
    assert kept.count() == 2 and held.first().errors == [
        "mileage", "year", "failure_risk", "reliability_score", "urgency", "consent", "email", "postcode", "registration"
    ]


def test_contract_problems(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "a int, c int, b int")
    assert O.contract_problems(frame, ["a", "b", "d"]) == [("d", "missing"), ("c", "extra")]
    assert ("b", "misplaced") in O.contract_problems(frame.select("b", "a"), ["a", "b"])
    with pytest.raises(ValueError):
        O.select_contract(frame, ["a", "d"])


def test_histories_with_bad_json(spark):
    rows = spark.createDataFrame(
        [('{"registration": "A1", "motTests": [{"completedDate": "2024.01.05 10:00", "odometerValue": "x", "defects": []}]}',), ("no",), (None,)],
        "j string",
    )
    got = IO.parse_histories(rows, "j").collect()
    assert len(got) == 1 and str(got[0].test_date) == "2024-01-05" and got[0].odometer is None and got[0].n_defects == 0


def test_validation_reports_every_broken_rule(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (9, "x")], "n int, s string")
    got = O.validate(rows, {"n": F.col("n") < 5, "s": F.col("s").isin("a", "b")}).collect()
    assert [r.errors for r in got] == [[], ["n"], ["n", "s"]] and [r.valid for r in got] == [True, False, False]
