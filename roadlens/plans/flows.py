"""Sources and sinks (SRC, SNK), streams (STR), models (ML) and the encoder API (UDF)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens.functions import rules as R
from roadlens.functions import text as X
from roadlens.operators import contracts as CT
from roadlens.operators import cube as C
from roadlens.operators import encoders as E
from roadlens.operators import features as FE
from roadlens.operators import history as H
from roadlens.operators import metrics as M
from roadlens.operators import relational as O
from roadlens.operators import scorer as SC
from roadlens.operators import scoring as S
from roadlens.operators import training as TR
from roadlens.operators import refresh as RF
from roadlens.sources import files as IO
from roadlens.sources.versions import VersionedTable
from roadlens.streaming import jobs as J

from . import oracle_values as OV
from .base import BANDED, CUBE, DEFECTS, HISTORY, INSPECTIONS, MODELS, POSTCODES, before, pick, query
from .joins import eb_sql
from .relational import RATES, count, rates
from .windows import MILES, P, miles

# Sources -----------------------------------------------------------------------------------------------------------------------


@query("src01_parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(t):
    return IO.read_parquet(t.spark, f"{t.folder}/lineitem.parquet", "l_orderkey long, l_quantity double").where("l_quantity > 45")


@query("src02_glob_scan", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def _(t):
    out = IO.new_folder(t.spark, "sampled")
    t("orders").repartition(4).write.parquet(out)  # several files for one glob
    return IO.read_parquet(t.spark, f"{out}/part-*.parquet").where("o_orderdate >= timestamp'1997-01-01'").groupBy("o_orderstatus").agg(count())


@query(
    "src03_optional_source",
    "SELECT p_partkey, false AS there, 0.5 AS strictness, 'none' AS kind FROM part UNION ALL SELECT p_partkey, true, CASE WHEN p_partkey % 3 > 0 AND "
    "p_size > 9 THEN p_size ELSE 0.5 END, CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE 'none' END FROM part",
)
def _(t):
    parts, defaults = t("part").select("p_partkey"), {"strictness": 0.5, "kind": "none"}
    out = IO.new_folder(t.spark, "features")
    size = F.when(F.col("p_size") > 9, F.col("p_size").cast("double"))
    t("part").where("p_partkey % 3 > 0").select("p_partkey", size.alias("strictness"), F.col("p_brand").alias("kind")).write.parquet(out)
    found = [O.with_optional_source(parts, path, "p_partkey", defaults).select("p_partkey", F.lit(there).alias("there"), *defaults) for there, path in ((False, f"{out}-absent"), (True, out))]
    return found[0].unionByName(found[1])


@query(
    "src04_gzip_csv",
    "SELECT p_brand AS \"Brand_Name\", p_type AS type_x, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size END::BIGINT AS size, p_retailprice AS price "
    "FROM part",
)
def _(t):
    path = IO.new_folder(t.spark, "csv")
    size = F.when(F.col("p_size") % 10 != 0, F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    t("part").select(
        F.col("p_brand").alias(" Brand Name"), F.col("p_type").alias("type-x"), size.alias("size"), F.col("p_retailprice").alias("price ")
    ).write.option("header", True).option("compression", "gzip").csv(path)
    return IO.load_typed_csv(t.spark, path, 2, 1)


@query(
    "src05_csv_rejects",
    "SELECT 'accepted' AS side, o_orderkey, substr(o_orderpriority, 1, 4) AS priority FROM orders WHERE length(o_orderpriority) <= 8 UNION ALL SELECT "
    "'rejected', o_orderkey, o_orderpriority FROM orders WHERE length(o_orderpriority) > 8",
)
def _(t):
    path = IO.new_folder(t.spark, "csv")
    t("orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("key"), F.col("o_orderpriority").alias("priority")
    ).write.option("header", True).csv(path)
    accepted, rejected = IO.load_with_rejects(t.spark, path, "key", 8, 4)
    # the cut touches every string but the key, so ids go through a cast of their own
    full = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("key"))
    ids = lambda side, df: df.select(F.lit(side).alias("side"), "key", "priority").distinct().join(full, "key").select("side", "o_orderkey", "priority")
    return ids("accepted", accepted).union(ids("rejected", rejected))


@query(
    "src06_lookup_pair",
    "SELECT p_partkey AS rfr_id, CASE WHEN n_name = 'CHINA' THEN 'Wheels' ELSE n_name END AS item FROM part JOIN nation ON p_size % 25 = n_nationkey "
    "WHERE p_partkey % 3 = 1 AND n_nationkey % 2 = 1",
)
def _(t):
    paths = [IO.new_folder(t.spark, "lookup") for _ in range(2)]
    k = F.col("p_partkey")
    t("part").select(
        k.alias("rfr_id"), (k % 3).alias("test_class_id"), (F.col("p_size") % 25).alias("test_item_set_section_id")
    ).write.option("header", True).option("sep", "|").csv(paths[0])
    n = F.col("n_nationkey")
    t("nation").select(
        n.alias("test_item_id"),
        (n % 2).alias("test_class_id"),
        F.when(F.col("n_name") == "CHINA", "Road Wheels").otherwise(F.col("n_name")).alias("item_name"),
    ).write.option("header", True).option("sep", "|").csv(paths[1])
    return IO.load_lookup_pair(t.spark, *paths, 1)


@query(
    "src07_nested_history",
    "SELECT CAST(o_custkey AS VARCHAR) AS registration, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS test_date, o_orderstatus AS test_result, CASE WHEN "
    "o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS INT) END AS odometer, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 ELSE 1 END AS n_defects FROM "
    "orders",
)
def _(t):
    comment = F.struct(F.lit("worn").alias("text"), F.lit("ADVISORY").alias("type"))
    status = F.col("o_orderstatus")
    test = F.struct(
        F.date_format("o_orderdate", "yyyy.MM.dd HH:mm:ss").alias("completedDate"), status.alias("testResult"), F.when(
            F.col("o_orderkey") % 5 == 0, "unreadable"
        ).otherwise(F.col("o_orderkey").cast("string")).alias("odometerValue"),
        F.when(status == "F", F.array().cast("array<struct<text:string,type:string>>")).when(status == "O", F.array(comment, comment)).alias("defects"),
        F.array(comment).alias("rfrAndComments"),
    )
    raw = t("orders").groupBy("o_custkey").agg(F.collect_list(test).alias("tests")).select(
        F.to_json(F.struct(F.col("o_custkey").cast("string").alias("registration"), F.col("tests").alias("motTests"))).alias("json")
    )
    return IO.parse_histories(raw, "json").withColumn("test_date", F.col("test_date").cast("string"))


@query(
    "src08_json_columns",
    "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 0 END AS items, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    text = F.when(F.col("user_id") % 3 == 0, '["a", "b"]').when(F.col("user_id") % 3 == 1, "not json")
    return t("events").select("event_id", F.size(IO.json_list(text)).alias("items"), F.from_json("props", "map<string,bigint>")["k"].alias("k"))


# Sinks: written to the shared folder and read back -----------------------------------------------------------------------------

CU = f"WITH {CUBE} "


@query("snk01_full_refresh", CU + "SELECT model_id, age_band, n FROM cube WHERE age_band = '6-10'")
def _(t):
    """Refreshed twice: readers of the second version see it whole, the first one stays for those that have it open."""
    path = IO.new_folder(t.spark, "cube")
    cube = M.stored(t.cube())  # both versions come from one cube
    IO.full_refresh(cube.where("age_band = '0-2'"), path, "age_band", "model_id")
    IO.full_refresh(cube, path, "age_band", "model_id")
    return VersionedTable(t.spark, path).read().where("age_band = '6-10'").select("model_id", "age_band", "n")


@query("snk02_export", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-25'")
def _(t):
    path = IO.new_folder(t.spark, "export")
    IO.export_newest(
        t("events").where("ts >= timestamp'2024-01-25'").select("event_id", "event_type", "ts"), path, "csv", [F.desc("ts"), F.asc("event_id")]
    )
    return t.spark.read.option("header", True).schema("event_id long, event_type string, ts string").csv(path).select("event_id", "event_type")


@query("snk03_jsonl_backup", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, '2024-02-01' AS loaded_at FROM events")
def _(t):
    path = IO.new_folder(t.spark, "backup")
    rows = t("events").select("event_id", F.to_date("ts").cast("string").alias("day"))
    IO.append_jsonl(rows.where("event_id % 2 = 0"), path, "2024-02-01")
    IO.append_jsonl(rows.where("event_id % 2 = 1"), path, "2024-02-01")
    return t.spark.read.schema("event_id long, day string, loaded_at string").json(path)


@query("snk04_result_json", RATES + "SELECT model_id, risk, 'ranking' AS story FROM rates")
def _(t):
    path = IO.new_folder(t.spark, "story")
    IO.write_result(rates(t).select("model_id", "risk"), path, story="ranking", source="cube")
    return t.spark.read.schema("model_id string, risk double, metadata struct<story: string>").json(path).select("model_id", "risk", "metadata.story")


@query(
    "snk05_saved_encoder",
    f"WITH {BANDED}, " + eb_sql([["make"], ["make", "model_id"]], [10.0, 20.0]) + " SELECT model_id, n, round(rate, 7) AS rate FROM e2",
)
def _(t):
    path = IO.new_folder(t.spark, "encoder")
    IO.save_encoder(E.Encoder([["make"], ["make", "model_id"]], [10.0, 20.0]).fit(t.banded(), "target", store=True), path)
    return IO.load_encoder(t.spark, path, 3)[2].select("model_id", "n", F.round("rate", 7).alias("rate"))


@query(
    "snk05b_refreshed_encoder",
    f"WITH {BANDED}, " + eb_sql([["make"], ["make", "model_id"]], [10.0, 20.0]) + " SELECT model_id, n, round(rate, 7) AS rate FROM e2",
)
def _(t):
    """Sums of odd and even vehicles as two batches, the second one sent twice, the first one then merged; the rates are those of one fit."""
    rows = t.banded()
    sums = RF.RunningSums(t.spark, IO.new_folder(t.spark, "sums"), ["make", "model_id"])
    for number, part in ((0, "vehicle_id % 2 = 0"), (1, "vehicle_id % 2 = 1"), (1, "vehicle_id % 2 = 1")):
        sums.upsert(rows.where(part), "target", F.col("test_date"), number)
    sums.merge_before(1)
    tables = sums.fit(E.Encoder([["make"], ["make", "model_id"]], [10.0, 20.0]))
    return tables[2].select("model_id", "n", F.round("rate", 7).alias("rate"))


_PSI = "(ln({x} + 6) - 1 / (2 * ({x} + 6)) - 1 / (12 * ({x} + 6) ^ 2) + 1 / (120 * ({x} + 6) ^ 4) - 1 / (252 * ({x} + 6) ^ 6)" + "".join(
    f" - 1 / ({{x}} + {i})" for i in range(6)
) + ")"
_PSI1 = "(1 / ({x} + 6) + 1 / (2 * ({x} + 6) ^ 2) + 1 / (6 * ({x} + 6) ^ 3) - 1 / (30 * ({x} + 6) ^ 5) + 1 / (42 * ({x} + 6) ^ 7)" + "".join(
    f" + 1 / ({{x}} + {i}) ^ 2" for i in range(6)
) + ")"


def _psi(x, form=_PSI):
    return form.replace("{x}", f"({x})")


_WEIGHT_SQL = f"""WITH {INSPECTIONS}, g AS (SELECT avg(target) AS p FROM inspections),
c AS (SELECT model_id, sum(target)::DOUBLE AS f, count(*)::DOUBLE AS n FROM inspections GROUP BY 1),
d AS (SELECT {_psi('10.0')} - {_psi('n + 10')} + p * ({_psi('f + 10 * p')} - {_psi('10 * p')}) + (1 - p) * ({_psi('n - f + 10 * (1 - p)')} - {_psi('10 * (1 - p)')}) AS a,
  {_psi('10.0', _PSI1)} - {_psi('n + 10', _PSI1)} + p * p * ({_psi('f + 10 * p', _PSI1)} - {_psi('10 * p', _PSI1)})
  + (1 - p) * (1 - p) * ({_psi('n - f + 10 * (1 - p)', _PSI1)} - {_psi('10 * (1 - p)', _PSI1)}) AS b FROM c, g),
s AS (SELECT sum(10 * a) AS slope, sum(10 * a + 100 * b) AS curve FROM d)
SELECT 10.0::DOUBLE AS k, round(slope, 5) AS slope, round(curve, 5) AS curve,
  round(10 * exp(least(2.0, greatest(-2.0, CASE WHEN curve < 0 THEN -slope / curve ELSE sign(slope) END))), 5) AS next_k FROM s"""


@query("ag02k_weight_step", _WEIGHT_SQL)
def _(t):
    """One Newton step from k = 10 towards the weight that the models' counts want around the overall rate."""
    counts = t.inspections().groupBy("model_id").agg(F.sum("target").alias("f"), F.count(F.lit(1)).alias("n"))
    overall = counts.agg((F.sum("f") / F.sum("n")).alias("parent"))
    step = RF.weight_step(counts.join(F.broadcast(overall)), 10.0)  # one row
    return step.select("k", *[F.round(c, 5).alias(c) for c in ("slope", "curve", "next_k")])


@query("ag02l_fitted_weights")
def _(t):
    """Weights of makers and models fitted to their counts, with the rates they give."""
    encoder, tables = RF.fit_encoder(t.inspections(), "target", [["make"], ["make", "model_id"]])
    return tables[2].select("make", "model_id", "n", F.round("rate", 7).alias("rate"), F.lit(encoder.k[0]).alias("k_make"), F.lit(encoder.k[1]).alias("k_model"))


@query(
    "snk06_matrix",
    f"WITH {BANDED} SELECT year(test_date) AS year, count(*) AS n, sum(target)::BIGINT AS failures, round(sum(CASE year(test_date) WHEN 1998 THEN 20.0 "
    "WHEN 1997 THEN 6.0 WHEN 1996 THEN 2.0 ELSE 1.0 END), 6) AS weight FROM banded GROUP BY 1",
)
def _(t):
    """The matrix with its contract beside it, which is checked at writing and at reading."""
    path = IO.new_folder(t.spark, "matrix")
    rows = t.banded().select(F.year("test_date").alias("year"), F.col("target").alias("y"), "age_years", "test_mileage")
    rows = rows.withColumn("weight", S.recency_weight(F.col("year"), 1998))
    carried = ["year", "y", "weight"]
    CT.write_matrix(rows.select("year", "y", "weight", "age_years", "test_mileage"), CT.Contract.of(rows.select("age_years", "test_mileage"), "v1"), carried, path, "year")
    read, _ = CT.read_matrix(t.spark, path, carried)
    return read.groupBy("year").agg(count(), F.sum("y").alias("failures"), F.round(F.sum("weight"), 6).alias("weight"))


@query(
    "snk07_manifest",
    "SELECT 'orders' AS name, count(*) AS n, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) "
    "AS last FROM orders UNION ALL SELECT 'events', count(*), CAST(min(CAST(ts AS DATE)) AS VARCHAR), CAST(max(CAST(ts AS DATE)) AS VARCHAR) FROM events",
)
def _(t):
    return IO.manifest({"orders": (t("orders"), "o_orderdate"), "events": (t("events"), "ts")})


# Streams -----------------------------------------------------------------------------------------------------------------------

@query("str01_daily_funnel", "SELECT strftime(ts, '%Y-%m-%d 00:00:00') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    """Days are written once, when the watermark has passed them, and leave the state."""
    return J.run_to_close(J.read_events(t.spark, t.folder), lambda events: J.windowed_counts(events, "1 day"))[0]


@query("str01b_daily_funnel_batch", "SELECT strftime(ts, '%Y-%m-%d 00:00:00') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return J.windowed_counts(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")


@query(
    "str01c_sliding_week",
    "SELECT strftime(CAST(ts AS DATE) - CAST(k AS INT), '%Y-%m-%d 00:00:00') AS start, event_type, count(*) AS n FROM events, range(7) AS r(k) GROUP "
    "BY ALL",
)
def _(t):
    return J.run_to_close(J.read_events(t.spark, t.folder), lambda events: J.windowed_counts(events, "7 days", "1 day"))[0]


@query("str02_signup_dedupe", "SELECT DISTINCT user_id, event_type FROM events WHERE event_type = 'signup'")
def _(t):
    signups = J.read_events(t.spark, t.folder).where("event_type = 'signup'")
    return J.run_available(J.first_signups(signups, ["user_id", "event_type"], "60 days").select("user_id", "event_type"))


_NOW = "2024-01-15 12:00:00"


@query(
    "str03_seen_ids",
    "SELECT DISTINCT user_id FROM events WHERE event_type <> 'error' AND ts BETWEEN TIMESTAMP '2024-01-13 12:00:00' AND TIMESTAMP '2024-01-15 11:00:00'",
)
def _(t):
    posts = J.age_band(J.read_events(t.spark, t.folder).where("event_type <> 'error'"), _NOW).where("band = 'in_band'")
    return J.run_available(J.first_signups(posts, ["user_id"], "60 days").select("user_id"))


@query(
    "str03b_age_bands",
    "SELECT CASE WHEN ts > TIMESTAMP '2024-01-15 11:00:00' THEN 'too_new' WHEN ts < TIMESTAMP '2024-01-13 12:00:00' THEN 'too_old' ELSE 'in_band' "
    "END AS band, count(*) AS n FROM events GROUP BY 1",
)
def _(t):
    """How many posts are late or too new: a stream of running totals, whose state is one row a band."""
    return J.run_available(J.age_band(J.read_events(t.spark, t.folder), _NOW).groupBy("band").agg(count()), "complete")


@query("str03c_capped_seen")
def _(t):
    """First sights of an id by its source within two days, with at most 1000 ids kept for each source."""
    posts = J.read_events(t.spark, t.folder).select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("id"), "ts")
    return J.run_available(J.unseen(posts))


@query(
    "str04_prediction_log",
    "WITH r AS (SELECT event_type, round(avg(value), 6) AS rate FROM events GROUP BY 1) SELECT event_id, event_type, rate FROM events JOIN r USING "
    "(event_type)",
)
def _(t):
    """Predictions of a stream appended to a log; batches that its store refuses are backed up and replayed."""
    fitted = t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("rate"))
    scored = J.read_events(t.spark, t.folder).join(fitted, "event_type").select("event_id", "event_type", "rate")
    log, backup = IO.new_folder(t.spark, "log"), IO.new_folder(t.spark, "log-backup")
    J.run_stream(scored, lambda batch, number: J.append_log(batch, number, log, backup), "log-state")
    return J.replay(t.spark, log, backup, "event_id long, event_type string, rate double")


_SESSION = """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, count(*) AS n, max((event_type = 'view')::INT) AS viewed, max((event_type = 'purchase')::INT) AS bought, epoch_us(min(ts)) AS start
FROM s GROUP BY user_id, k"""


def _sessions(events):
    steps = {"viewed": F.col("event_type") == "view", "bought": F.col("event_type") == "purchase"}
    found = J.sessions(events, "6 hours", steps)
    return found


@query("str05_session_funnel", _SESSION)
def _(t):
    found, _ = J.run_to_close(J.read_events(t.spark, t.folder), _sessions)
    return found.withColumn("start", F.unix_micros(F.col("start").cast("timestamp")))


@query("str05b_session_funnel_batch", _SESSION)
def _(t):
    found = _sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.withColumn("start", F.unix_micros(F.col("start").cast("timestamp")))


# Encoder API -------------------------------------------------------------------------------------------------------------------

IN = f"WITH {INSPECTIONS} "


@query(
    "udf01_row_rules",
    IN + "SELECT make, prev_outcome, CASE WHEN prev_outcome = 'F' THEN 'a' WHEN make < 'Brand#3' THEN 'b' ELSE 'c' END AS kind, count(*) AS n FROM "
    "inspections GROUP BY ALL",
)
def _(t):
    kind = F.when(F.col("prev_outcome") == "F", "a").when(F.col("make") < "Brand#3", "b").otherwise("c")
    return t.inspections().groupBy("make", "prev_outcome", kind.alias("kind")).agg(count())


@query(
    "udf02_encoder_fit_transform",
    f"WITH {BANDED}, "
    + eb_sql([["area"]], [100.0]) + " SELECT area, count(*) AS n, round(avg(e1.rate), 7) AS rate FROM banded JOIN e1 USING (area) GROUP BY 1",
)
def _(t):
    rows, encoder = t.banded(), E.Encoder([["area"]], [100.0])
    return encoder.transform(rows, encoder.fit(rows, "target", store=True), "rate").groupBy("area").agg(count(), F.round(F.avg("rate"), 7).alias("rate"))


@query("udf03_nested_to_rows", "SELECT o_custkey AS vehicle_id, count(*) AS tests, count(DISTINCT o_orderstatus) AS outcomes FROM orders GROUP BY 1")
def _(t):
    nested = t("orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("tests"))
    flat = nested.select(F.col("o_custkey").alias("vehicle_id"), F.explode_outer("tests").alias("t"))
    return flat.groupBy("vehicle_id").agg(F.count("t.o_orderkey").alias("tests"), F.count_distinct("t.o_orderstatus").alias("outcomes"))


@query(
    "udf04_named_queries",
    CU + """, m AS (SELECT model_id, sum(n) AS n, round(sum(risk * n) / sum(n), 6) AS risk FROM cube GROUP BY 1)
SELECT 'volume' AS story, model_id AS key, n::DOUBLE AS value FROM m WHERE n >= 100
UNION ALL SELECT 'worst', model_id, risk FROM (SELECT * FROM m WHERE n >= 100 ORDER BY risk DESC, model_id LIMIT 10) UNION ALL
SELECT 'best', model_id, risk FROM (SELECT * FROM m WHERE n >= 100 ORDER BY risk, model_id LIMIT 10)
UNION ALL SELECT 'age', age_band, round(sum(risk * n) / sum(n), 6) FROM cube GROUP BY age_band""",
)
def _(t):
    cube = t.cube()
    told = [story(cube).select(F.lit(name).alias("story"), "key", F.col("value").cast("double").alias("value")) for name, story in C.STORIES.items()]
    out = told[0]
    for part in told[1:]:
        out = out.unionByName(part)
    return out


@query("udf05_history_features")
def _(t):
    """The whole feature table of the model from nested histories; tests hold it against plain Python."""
    vehicles, as_of = nested_histories(t), "2024-02-01"
    rates = t.history().groupBy((F.col("vehicle_id") % 7).alias("k")).agg(F.avg("failed").alias("rate"))
    model = rates.select(pick(MODELS, F.col("k")).alias("model_id"), "rate")
    return FE.history_features(vehicles, as_of, FE.Priors(model=model, corrosion={"SW": 0.4, "M": 0.6}, high_risk_models=["PEUGEOT 307"]), ("vehicle_id",))


@query("udf05b_training_table")
def _(t):
    """The training table of all tests, with rates of those before the cut; tests hold it against single histories."""
    return TR.training_table(flat_tests(t), "2024-01-20")


def flat_tests(t):
    """The tests of nested_histories one by one, with what their vehicle has and whether they failed."""
    each = nested_histories(t).withColumn("t", F.explode("tests")).drop("tests").select("*", "t.*").drop("t")
    number = F.row_number().over(Window.partitionBy("vehicle_id").orderBy("test_date", "odometer", "expiry"))
    return each.withColumns({"test_id": number, "target": (F.col("result") == "FAILED").cast("int")})


def nested_histories(t):
    """Vehicles of events: every event is a test, whose kind, value and id give outcome, reading and defects."""
    k, i = F.col("vehicle_id"), F.col("test_id")
    defect = F.struct(pick(DEFECTS, i).alias("text"), F.when(i % 3 == 0, "FAIL").when(i % 3 == 1, "ADVISORY").otherwise("MINOR").alias("type"))
    tests = F.struct(
        "test_date", F.when(F.col("outcome") == "error", "FAILED").when(F.col("outcome") == "view", "ABANDONED").otherwise("PASSED").alias("result"),
        F.when(i % 11 > 0, (F.col("reading") * 700).cast("int")).alias("odometer"), F.when(i % 5 == 0, "km").otherwise("mi").alias("unit"),
        F.when(i % 4 > 0, F.date_add("test_date", 9)).alias("expiry"),
        F.filter(F.array(defect, F.struct(pick(DEFECTS, i * 3).alias("text"), F.lit("ADVISORY").alias("type"))), lambda d: i % 2 == 0).alias("defects"),
    )
    grouped = t.history().groupBy("vehicle_id").agg(F.sort_array(F.collect_list(tests)).alias("tests"))
    tests = F.when(k % 9 > 0, F.col("tests"))  # some without history
    model = F.regexp_replace(pick(MODELS, k), "^[^ ]+ ", "")
    return grouped.select(
        "vehicle_id", F.split(pick(MODELS, k), " ")[0].alias("make"), model.alias("model"), pick(POSTCODES, k).alias("postcode"),
        F.when(k % 4 > 0, F.date_sub(F.lit("2024-01-01").cast("date"), (k * 37 % 7000).cast("int"))).alias("manufacture_date"), tests.alias("tests"),
    )


# Models ------------------------------------------------------------------------------------------------------------------------


@query(
    "ml01_recency_weights",
    IN + "SELECT year(test_date) AS year, CASE year(test_date) WHEN 1998 THEN 20.0 WHEN 1997 THEN 6.0 WHEN 1996 THEN 2.0 ELSE 1.0 END::DOUBLE AS "
    "weight, count(*) AS n FROM inspections GROUP BY ALL",
)
def _(t):
    return t.inspections().groupBy(F.year("test_date").alias("year"), S.recency_weight(F.year("test_date"), 1998).alias("weight")).agg(count())


def _fitted(t, seeds):
    rows = t.banded().select(
        "vehicle_id",
        "test_date",
        "shipped",
        "line",
        "make",
        "area",
        "age_band",
        "mileage_band",
        F.col("age_years").cast("double").alias("age"),
        "test_mileage",
        F.col("target").cast("double").alias("label"),
    )
    rows = rows.withColumns({"weight": S.recency_weight(F.year("test_date"), 1997), "holdout": F.pmod(F.xxhash64("vehicle_id"), F.lit(5)) == 0})
    rows = M.stored(rows)  # every pass of the indexer and of the boosting reads these columns, not the joins
    earlier = before("shipped", 1998)  # reaches the scan
    dev, oot = rows.where(earlier).drop("shipped"), rows.where(~earlier).drop("shipped")
    prepared = S.matrix(["make", "area", "age_band", "mileage_band"], ["age", "test_mileage", "line"]).fit(dev)
    ready = prepared.transform(dev)
    return dev, oot, prepared, S.fit_ensemble(ready, "label", "weight", "holdout", seeds, 4, 32), ready


@query("ml02_ensemble")
def _(t):
    """Out-of-time AUC of one seed and of the mean of ten."""
    _, oot, prepared, models, _ = _fitted(t, list(range(1, 11)))
    later = prepared.transform(oot)
    one = M.auc(S.mean_probability(later, models[:1]), "raw", "label").withColumn("model", F.lit("one"))
    return one.unionByName(M.auc(S.mean_probability(later, models), "raw", "label").withColumn("model", F.lit("mean")))


@query("ml03_platt_fit")
def _(t):
    _, _, _, models, ready = _fitted(t, [1])
    a, b = S.fit_platt(S.mean_probability(ready, models), "raw", "label")
    return t.spark.createDataFrame([(a, b)], "slope double, intercept double")


@query("ml04_batch_scoring")
def _(t):
    """Scored by the scorer as it is loaded from its folder; two areas go under the names that it was trained with."""
    _, oot, prepared, models, _ = _fitted(t, [1])
    carried, names = ["vehicle_id", "test_date"], ["make", "area", "age_band", "mileage_band", "age", "test_mileage", "line"]
    contract = CT.Contract.of(oot.select(*names), "v1")
    vocabulary = {"area": {"GB": "UNITED KINGDOM", "USA": "UNITED STATES"}}
    path = IO.new_folder(t.spark, "scorer")
    SC.build_scorer(contract, carried, vocabulary, prepared, models, R.PLATT_A, R.PLATT_B).write().save(path)
    scored = PipelineModel.load(path).transform(oot.select(*carried, *names))
    return scored.select("vehicle_id", "test_date", "line", F.round("raw", 6).alias("raw"), "calibrated")


@query(
    "ml05_data_confidence",
    MILES + f", c AS (SELECT test_id, (before IS NOT NULL)::INT AS h, count(*) OVER {P} AS n, days * 30 AS days FROM g), p AS (SELECT test_id, 2 * h + "
    "CASE WHEN n > 0 THEN 2 ELSE 0 END + CASE WHEN n >= 3 THEN 1 ELSE 0 END + CASE WHEN coalesce(days, 999) < 400 THEN 1 ELSE 0 END AS points "
    "FROM c) SELECT test_id, CASE WHEN points >= 5 THEN 'High' WHEN points >= 3 THEN 'Medium' ELSE 'Low' END AS confidence FROM p",
)
def _(t):
    rows = H.prior_counts(miles(t), "failed")
    return rows.select("test_id", R.data_confidence(F.col("before").isNotNull().cast("int"), F.col("n_prior"), F.col("days") * 30).alias("confidence"))


_RISK = {c: f"round(least(greatest({b} * (1 + {'0.5 * least(a, 3) + ' if c in ('brakes', 'tyres') else ''}{'2 * least(0.1 * f, 1) + ' if c == 'brakes' else ''}{'CASE WHEN f > 0 THEN 1 ELSE 0 END' if c == 'suspension' else '0'}) * p / {OV.AVERAGE_FAIL_RATE}, 0.01), 0.5), 4) AS {c}" for c, b in OV.BASE_RISKS.items()}


@query(
    "ml06_component_risks",
    f"WITH {HISTORY}, c AS (SELECT vehicle_id, (sum(advisory) % 5)::DOUBLE AS a, (sum(failed) % 4)::DOUBLE AS f, avg(failed) + 0.1037 AS p FROM history "
    f"GROUP BY 1) SELECT vehicle_id, {', '.join(_RISK.values())} FROM c",
)
def _(t):
    rows = t.history().groupBy("vehicle_id").agg(
        (F.sum("advisory") % 5).cast("double").alias("a"), (F.sum("failed") % 4).cast("double").alias("f"), (F.avg("failed") + 0.1037).alias("p")
    )
    found = R.component_risks(
        F.col("p"),
        {"brakes": F.col("a"), "tyres": F.col("a")},
        {"brakes": F.least(0.1 * F.col("f"), F.lit(1.0))},
        {"suspension": (F.col("f") > 0).cast("int")},
    )
    return rows.select("vehicle_id", *[c.alias(n) for n, c in found.items()])


@query("ml07_importances")
def _(t):
    return S.top_importances(_importances(t), 20)


@query("ml07b_group_importances")
def _(t):
    return S.group_importances(_importances(t))


def _importances(t):
    _, _, _, models, _ = _fitted(t, [1])
    names = ["make", "area", "age_band", "mileage_band", "age", "test_mileage", "line"]
    groups = {"make": "vehicle", "area": "place", "age_band": "age", "age": "age", "mileage_band": "use", "test_mileage": "use"}
    return S.importances(models, names, groups, t.spark)


@query(
    "ml08_temporal_split",
    IN + "SELECT CASE WHEN year(test_date) < 1998 THEN 'dev' ELSE 'oot' END AS part, count(*) AS n, CAST(min(test_date) AS VARCHAR) AS first, "
    "CAST(max(test_date) AS VARCHAR) AS last FROM inspections GROUP BY 1",
)
def _(t):
    part = F.when(F.year("test_date") < 1998, "dev").otherwise("oot")
    return t.inspections().groupBy(part.alias("part")).agg(
        count(), F.min("test_date").cast("string").alias("first"), F.max("test_date").cast("string").alias("last")
    )


@query(
    "ml09_category_encoding",
    IN + ", c AS (SELECT make, count(*) AS n FROM inspections GROUP BY 1) SELECT make, n, CAST(row_number() OVER (ORDER BY n DESC, make) - 1 AS "
    "DOUBLE) AS index FROM c",
)
def _(t):
    from pyspark.ml.feature import StringIndexer

    rows = t.inspections().select("make")
    indexed = StringIndexer(inputCol="make", outputCol="index", handleInvalid="keep").fit(rows).transform(rows)
    return indexed.groupBy("make", "index").agg(count())
