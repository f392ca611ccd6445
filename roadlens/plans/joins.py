"""Joins (JN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens.functions import rules as R
from roadlens.functions import text as X
from roadlens.operators import cube as C
from roadlens.operators import joins as J
from roadlens.operators import links as L
from roadlens.operators import relational as O
from roadlens.operators.encoders import Encoder
from roadlens.operators.metrics import stored
from roadlens.sources import files as IO

from . import oracle_values as OV
from .base import BANDED, CUBE, HISTORY, INSPECTIONS, VEHICLES, before, pick, pick_sql, query
from .relational import RATES, count, rates
from .scalars import BASE_MODEL_CTE, LINKS_SQL

IN, BA, CU, HI, VE = f"WITH {INSPECTIONS} ", f"WITH {BANDED} ", f"WITH {CUBE} ", f"WITH {HISTORY} ", f"WITH {VEHICLES} "


@query(
    "jn01_four_way",
    "SELECT l_orderkey, l_linenumber, l_partkey, p_brand, s_name, o_orderstatus FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier "
    "ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey",
)
def _(t):
    line = t("lineitem")
    joined = line.join(t("part"), line.l_partkey == F.col("p_partkey"), "left").join(
        t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left"
    ).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "s_name", "o_orderstatus")


#: Buckets at least, and about as many lines as one of them has: a bucket is sorted and merged by one task, so its size must not grow.
BUCKETS, BUCKET_LINES = 8, 2_000_000


@query(
    "jn01b_co_located",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, o_orderstatus, lines, total FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN "
    "(SELECT l_orderkey AS k, count(*) AS lines, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY 1) ON l_orderkey = k",
)
def _(t):
    """Facts, their orders and their totals by order on one bucketed key: written once, then joined and grouped without a shuffle of the facts."""
    buckets = max(BUCKETS, t("lineitem").count() // BUCKET_LINES)  # counted from the files' footers
    line = IO.bucketed(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), ["l_orderkey"], buckets)
    orders = IO.bucketed(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), ["l_orderkey"], buckets)
    return co_located(line, orders).select("l_orderkey", "l_linenumber", "l_extendedprice", "o_orderstatus", "lines", "total")


def co_located(line, orders):
    sums = line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 6).alias("total"))
    return line.join(orders.hint("merge"), "l_orderkey", "left").join(sums.hint("merge"), "l_orderkey", "left")


@query(
    "jn02_semi",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def _(t):
    wanted = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").join(wanted, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "jn03_chained_lookup",
    HI + ", l AS (SELECT test_id, vehicle_id, lag(test_id) OVER (PARTITION BY vehicle_id ORDER BY test_ts, test_id) AS prev FROM history) SELECT "
    "l.test_id, prev, h.reading AS prev_reading FROM l LEFT JOIN history h ON prev = h.test_id",
)
def _(t):
    rows = t.history()
    linked = rows.select("test_id", F.lag("test_id").over(Window.partitionBy("vehicle_id").orderBy("test_ts", "test_id")).alias("prev"))
    readings = rows.groupBy(F.col("test_id").alias("prev")).agg(F.max("reading").alias("prev_reading"))  # one row a test
    return linked.join(readings, "prev", "left")


@query(
    "jn04_as_of_month",
    IN + ", p AS (SELECT make, date_trunc('month', test_date) AS month, avg(target) AS prior FROM inspections WHERE test_date < DATE '1997-01-01' "
    "GROUP BY ALL) SELECT i.make, count(*) AS n, round(avg(prior), 6) AS prior, count(prior) AS found FROM inspections i LEFT JOIN p ON i.make = "
    "p.make AND least(date_trunc('month', test_date), DATE '1996-12-01') = p.month GROUP BY 1",
)
def _(t):
    rows = t.inspections()
    priors = rows.where(before("shipped", 1997)).groupBy("make", F.trunc("test_date", "MM").alias("month")).agg(F.avg("target").alias("prior"))
    return J.as_of_month(rows, priors, "test_date", "month", ["make"], "1996-12-01").groupBy("make").agg(
        count(), F.round(F.avg("prior"), 6).alias("prior"), F.count("prior").alias("found")
    )


@query(
    "jn04b_latest_before",
    "WITH f AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT * FROM events WHERE event_type = 'view') SELECT r.event_id, f.value AS "
    "last_purchase FROM r ASOF LEFT JOIN f ON r.user_id = f.user_id AND r.ts >= f.ts",
)
def _(t):
    events = t("events")
    rows = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    facts = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("value").alias("last_purchase"))
    return J.latest_before(rows, facts, "user_id", "ts", "bought", "last_purchase").select("event_id", "last_purchase")


@query(
    "jn05_key_coercion",
    "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON CAST(c_custkey AS VARCHAR) = CAST(o_custkey AS VARCHAR) GROUP BY 1",
)
def _(t):
    orders = t("orders").select(F.col("o_custkey").cast("string").alias("key"), "o_orderkey")
    return t("customer").withColumn(
        "key", F.col("c_custkey").cast("string")
    ).join(orders, "key", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query(
    "jn06_defaults",
    "SELECT c_custkey, coalesce(spent, -1.0) AS spent, coalesce(orders, 0) AS orders, 0.25 AS absent FROM customer LEFT JOIN (SELECT o_custkey, "
    "round(sum(o_totalprice), 2) AS spent, count(*) AS orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey",
)
def _(t):
    features = t("orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count(F.lit(1)).alias("orders")
    )
    rows = O.with_defaults(t("customer").select("c_custkey"), features, "c_custkey", {"spent": -1.0, "orders": 0})
    return O.with_defaults(rows, None, "c_custkey", {"absent": 0.25})


@query(
    "jn07_dimension_default",
    "SELECT c_custkey, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name ELSE 'OTHER' END AS region FROM customer JOIN nation ON c_nationkey = "
    "n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def _(t):
    dims = t("nation").join(
        t("region").where("r_name in ('ASIA', 'EUROPE')"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return t("customer").join(dims, "c_nationkey", "left").select("c_custkey", F.coalesce("r_name", F.lit("OTHER")).alias("region"))


def eb_sql(levels: list[list[str]], ks: list[float], least: int = 0, source: str = "banded", target: str = "target") -> str:
    """CTEs e0 (overall) and e1.. of an encoder."""
    out = [f"e0 AS (SELECT count({target}) AS n, sum({target})::DOUBLE / count({target}) AS rate FROM {source})"]
    for i, level in enumerate(levels):
        keys = ", ".join(level)
        shared = [c for c in (levels[i - 1] if i else []) if c in level]
        join = f"LEFT JOIN e{i} p USING ({', '.join(shared)})" if shared else "CROSS JOIN e0 p"
        out.append(
            f"e{i + 1} AS (SELECT {', '.join('g.' + c for c in level)}, g.n, (f + {ks[i]}::DOUBLE * coalesce(p.rate, 0)) / (g.n + {ks[i]}::DOUBLE) AS "
            f"rate FROM (SELECT {keys}, sum({target}) AS f, count(*) AS n FROM {source} WHERE {' AND '.join(c + ' IS NOT NULL' for c in level)} GROUP "
            f"BY {keys} HAVING count(*) >= {least}) g {join})"
        )
    return ", ".join(out)


def lookup_sql(levels: list[list[str]], source: str, group: str) -> str:
    joins = " ".join(f"LEFT JOIN e{i + 1} ON " + " AND ".join(f"s.{c} = e{i + 1}.{c}" for c in level) for i, level in enumerate(levels))
    fine = ", ".join(f"e{i + 1}.rate" for i in reversed(range(len(levels))))
    return f"SELECT s.{group}, count(*) AS n, round(avg(coalesce({fine}, (SELECT rate FROM e0))), 6) AS rate FROM {source} s {joins} GROUP BY 1"


def hierarchy(name: str, levels: list[list[str]], ks: list[float], least: int = 0, group: str = "area"):
    """Fit an encoder on rows before 1996 and look rates of later rows up, with fallbacks for keys it has not seen."""
    held = "make NOT IN ('Brand#11', 'Brand#44') AND NOT (age_band = '11-15' AND make > 'Brand#3')"  # keys that the fit must not see
    fit = (
        f"fitted AS (SELECT * FROM banded WHERE test_date < DATE '1996-01-01' AND {held}), later AS (SELECT * FROM banded WHERE test_date >= DATE "
        "'1996-01-01')"
    )
    sql = BA + ", " + fit + ", " + eb_sql(levels, ks, least, "fitted") + " " + lookup_sql(levels, "later", group)

    @query(name, sql)
    def _(t):
        rows = t.banded()
        encoder = Encoder(levels, ks, least)
        tables = encoder.fit(rows.where(before("shipped", 1996)).where(held), "target", store=True)
        return encoder.transform(rows.where(~before("shipped", 1996)), tables, "rate").groupBy(group).agg(count(), F.round(F.avg("rate"), 6).alias("rate"))


hierarchy("jn08_segment_make_global", [["make"], ["make", "age_band", "mileage_band"]], [10.0, 5.0], 20)
hierarchy("jn09_model_make_global", [["make"], ["make", "model_id"]], [10.0, 20.0], 40)
hierarchy(
    "jn10_five_levels",
    [["prev_outcome"], ["prev_outcome", "area"], ["prev_outcome", "area", "make"], ["prev_outcome", "area", "make", "age_band"]],
    [50.0, 20.0, 10.0, 5.0],
    5,
    "make",
)
hierarchy("jn11_model_age_make_age", [["age_band"], ["make", "age_band"], ["make", "age_band", "model_id"]], [100.0, 20.0, 10.0], 15)
hierarchy("jn12_station_outcome", [["area"], ["area", "prev_outcome"]], [100.0, 50.0], 0, "make")


@query(
    "jn13_cohort_ratio",
    BA + ", c AS (SELECT model_id, age_band, avg(test_mileage) AS mean FROM banded WHERE make <> 'Brand#22' GROUP BY ALL) SELECT vehicle_id, "
    "round(max(test_mileage / CASE WHEN coalesce(mean, 0) = 0 THEN (SELECT avg(test_mileage) FROM banded WHERE make <> 'Brand#22') ELSE mean "
    "END), 6) AS ratio FROM banded LEFT JOIN c USING (model_id, age_band) GROUP BY 1",
)
def _(t):
    rows = t.banded()
    one = rows.where("make <> 'Brand#22'")  # a maker without a cohort of its own
    sums = one.groupBy("model_id", "age_band").agg(F.sum("test_mileage").alias("s"), F.count("test_mileage").alias("c"))
    sums = stored(sums)  # both means come from it, and its size is known before the join
    means = sums.select("model_id", "age_band", F.try_divide("s", "c").alias("mean"))
    overall = sums.agg(F.try_divide(F.sum("s"), F.sum("c")).alias("overall"))
    joined = rows.join(means, ["model_id", "age_band"], "left").join(F.broadcast(overall))  # one row
    mean = F.when(F.coalesce("mean", F.lit(0.0)) == 0, F.col("overall")).otherwise(F.col("mean"))
    return joined.groupBy("vehicle_id").agg(F.round(F.max(F.col("test_mileage") / mean), 6).alias("ratio"))


@query(
    "jn14_fan_out_guard",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL HAVING "
    "count(*) > 1",
)
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber")
    left = t("orders").select(F.col("o_orderkey").alias("l_orderkey")).join(lines, "l_orderkey")
    return J.guard_fan_out(left, lines, ["l_orderkey", "l_linenumber"])


@query(
    "jn15_three_way",
    "SELECT l_orderkey, l_linenumber, l_partkey, s_name, o_totalprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = "
    "o_orderkey WHERE l_returnflag = 'A'",
)
def _(t):
    joined = t("lineitem").where("l_returnflag = 'A'").join(
        t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    ).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "o_totalprice")


# up to 75 degrees, and on both sides of 180
_LEADS = (
    "leads AS (SELECT c_custkey AS id, 50 + c_custkey % 997 / 40.0 AS lat, CASE WHEN c_custkey % 2 = 0 THEN -5 ELSE 177 END + c_custkey % 1009 / 150.0 "
    "AS lon FROM customer), garages AS (SELECT s_suppkey AS rid, 50 + s_suppkey % 97 / 4.0 AS rlat, CASE WHEN s_suppkey % 2 = 0 THEN -5 ELSE -183 END + "
    "s_suppkey % 89 / 14.0 AS rlon FROM supplier)"
)
_NEAR = (
    _LEADS + ", d AS (SELECT *, pow(sin(radians(rlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(rlat)) * pow(sin(radians(rlon - lon) / 2), 2) AS a "
    f"FROM leads, garages), near AS (SELECT id, rid, {OV.EARTH_MILES} * 2 * atan2(sqrt(a), sqrt(1 - a)) AS miles FROM d WHERE {OV.EARTH_MILES} * 2 "
    "* atan2(sqrt(a), sqrt(1 - a)) <= 60)"
)


def places(t):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    east, west = F.when(c % 2 == 0, -5).otherwise(177), F.when(s % 2 == 0, -5).otherwise(-183)
    leads = t("customer").select(c.alias("id"), (50 + (c % 997) / 40.0).alias("lat"), (east + (c % 1009) / 150.0).alias("lon"))
    garages = t("supplier").select(s.alias("rid"), (50 + (s % 97) / 4.0).alias("rlat"), (west + (s % 89) / 14.0).alias("rlon"))
    return leads, garages


@query("jn16_radius", "WITH " + _NEAR + " SELECT id, rid, round(miles, 4) AS miles FROM near")
def _(t):
    return J.within_radius(*places(t), 60).select("id", "rid", F.round("miles", 4).alias("miles"))


@query(
    "wn23_top_three_garages",
    "WITH "
    + _NEAR + ", r AS (SELECT id, rid, row_number() OVER (PARTITION BY id ORDER BY rid % 3, miles, rid) AS place FROM near) SELECT * FROM r WHERE "
    "place <= 3",
)
def _(t):
    leads, garages = places(t)
    return J.nearest_within(leads, garages.withColumn("kind", F.col("rid") % 3), 60, 3, "kind")


_NEAREST = RATES + """, g AS (SELECT model_id, split_part(model_id, ' ', 1) AS make, risk
FROM rates), p AS (SELECT a.model_id, b.make, b.model_id AS similar, round(abs(a.risk - b.risk), 9) AS gap FROM g a JOIN g b ON a.make <> b.make),
b AS (SELECT *, row_number() OVER (PARTITION BY model_id, make ORDER BY gap) AS r FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY model_id
ORDER BY gap, make) AS place FROM b WHERE r = 1) SELECT model_id, place, make, gap FROM k WHERE place <= 5"""


@query("jn17_nearest_value", _NEAREST)
def _(t):
    named = rates(t).withColumn("make", X.first_word(F.col("model_id")))
    return J.nearest_values(named, "model_id", "make", "risk", 5).select("model_id", "place", "make", "gap")


@query("wn22_one_per_maker", _NEAREST.replace("place <= 5", "place <= 1"))
def _(t):
    named = rates(t).withColumn("make", X.first_word(F.col("model_id")))
    return J.nearest_values(named, "model_id", "make", "risk", 1).select("model_id", "place", "make", "gap")


@query(
    "jn18_pair_comparison",
    RATES + ", p AS (SELECT model_id AS a, lead(model_id) OVER (PARTITION BY split_part(model_id, ' ', 1) ORDER BY model_id) AS b FROM rates) SELECT "
    "a, b, x.risk AS risk_a, y.risk AS risk_b, round(x.risk - y.risk, 6) AS diff, CASE WHEN x.risk < y.risk THEN a WHEN y.risk < x.risk THEN "
    "b END AS winner FROM p JOIN rates x ON a = x.model_id JOIN rates y ON b = y.model_id",
)
def _(t):
    known = rates(t)
    following = F.lead("model_id").over(Window.partitionBy(X.first_word(F.col("model_id"))).orderBy("model_id"))
    pairs = known.select(F.col("model_id").alias("a"), following.alias("b")).where("b is not null")
    return J.compare_pairs(pairs, known, "model_id", "risk")


@query(
    "jn19_defect_mapping",
    "SELECT p_partkey AS rfr, replace(n_name, 'CHINA', 'Wheels') AS item FROM part JOIN nation ON p_size % 25 = n_nationkey AND (p_partkey % 5) = "
    "n_regionkey",
)
def _(t):
    detail = t("part").select(F.col("p_partkey").alias("rfr"), (F.col("p_size") % 25).alias("section"), (F.col("p_partkey") % 5).cast("int").alias("class"))
    group = t("nation").select(
        F.col("n_nationkey").alias("section"),
        F.col("n_regionkey").alias("class"),
        F.when(F.col("n_name") == "CHINA", "Wheels").otherwise(F.col("n_name")).alias("item"),
    )
    return detail.join(group, ["section", "class"]).select("rfr", "item")


@query(
    "jn20_denoised_target",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'R' THEN 0 WHEN p_size > 25 THEN CASE WHEN p_brand < 'Brand#3' OR p_type LIKE "
    "'P%' THEN 1 ELSE 0 END ELSE 1 END AS target FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
)
def _(t):
    categories = t("part").where("p_size > 25").select(
        F.col("p_partkey").alias("l_partkey"), ((F.col("p_brand") < "Brand#3") | F.col("p_type").startswith("P")).alias("mechanical")
    )
    target = F.when(F.col("l_returnflag") != "R", 0).when(F.col("mechanical").isNotNull(), F.col("mechanical").cast("int")).otherwise(1)
    return t("lineitem").join(categories, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", target.alias("target"))


@query(
    "jn21_key_overlap",
    "SELECT count(*) AS rows, count(*) FILTER (CAST(k AS VARCHAR) IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)) AS matched FROM (SELECT c_custkey "
    "AS k FROM customer)",
)
def _(t):
    normal = F.split(F.col("key"), "[.]")[0]
    left = t("customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("key"))
    return J.key_overlap(left, t("orders").select(F.col("o_custkey").cast("string").alias("key")), normal)


#: Fixed pairs and pages of the route inventory and of the link tables.
STATIC_ROUTES = ["/", "/mot-check/", "/privacy", "/terms", "/guides/mot-checklist"]
AGE_SLUGS = ["0-3-years", "3-5-years", "6-10-years", "11-15-years", "15-plus-years"]
PAIRS = [("FORD", "FIESTA"), ("VAUXHALL", "CORSA-E")], [("FORD", "FIESTA"), ("TOYOTA", "YARIS")], [("AUDI", "A3"), ("BMW", "3 SERIES")]
RIVALS = {
    ("FORD", "FIESTA"): [("TOYOTA", "YARIS"), ("PEUGEOT", "208"), ("SEAT", "IBIZA")],
    ("AUDI", "A3"): [("BMW", "3 SERIES")],
    ("PEUGEOT", "208"): [("FORD", "FIESTA")],
}

_SLUG = "regexp_replace(regexp_replace(replace(lower({0}), '&', 'and'), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g')"
_MODELS_SQL = (
    "m AS (SELECT DISTINCT split_part(model_id, ' ', 1) AS make, trim(substr(model_id, length(split_part(model_id, ' ', 1)) + 2)) AS model FROM "
    "vehicles)"
)
_ROUTES_SQL = (
    f"s AS (SELECT DISTINCT trim({_SLUG.format('make')}, '-') AS a, trim({_SLUG.format('model')}, '-') AS b FROM m), routes AS (SELECT unnest(["
    + ", "
    .join(f"'{r}'" for r in STATIC_ROUTES) + "]) AS route UNION SELECT '/mot-check/' || a || '/' FROM s UNION SELECT '/mot-check/' || a || '/' || b "
    "|| '/' FROM s "
    "UNION SELECT '/mot-check/' || a || '/' || b || '/' || unnest(["
    + ", ".join(f"'{x}'" for x in AGE_SLUGS) + "]) || '/' FROM s UNION SELECT unnest(['/mot-check/compare/ford-fiesta-vs-vauxhall-corsa-e/', "
    "'/mot-check/compare/ford-fiesta-vs-toyota-yaris/', '/mot-check/compare/audi-a3-vs-bmw-3-series/']))"
)
#: Links of the fixture pages, a few to models among them.
_PAGE_LINKS = (
    "pl AS (SELECT page_id, link FROM links UNION ALL SELECT page_id, '/mot-check/' || "
    f"{pick_sql(['ford', 'bmw', 'nobody', 'audi/a3-20-tdi-dsg', 'ford/500/6-10-years'], 'page_id')} || '/' FROM pages)"
)


def _models(t):
    """make, model of each vehicle id: the first word and what follows it."""
    make = X.first_word(F.col("model_id"))
    return t.vehicles().select(make.alias("make"), F.trim(F.substring("model_id", F.length(make) + 2, F.length("model_id"))).alias("model")).distinct()


@query(
    "jn22_broken_links",
    VE + f", {LINKS_SQL}, {_MODELS_SQL}, {_ROUTES_SQL}, {_PAGE_LINKS} SELECT page_id, link FROM pl WHERE link NOT IN (SELECT route FROM routes)",
)
def _(t):
    pages = t("pages")
    links = pages.select("page_id", F.explode(X.internal_links(F.col("html"))).alias("link"))
    more = F.concat(F.lit("/mot-check/"), pick(["ford", "bmw", "nobody", "audi/a3-20-tdi-dsg", "ford/500/6-10-years"], F.col("page_id")), F.lit("/"))
    routes = L.route_inventory(_models(t), STATIC_ROUTES, AGE_SLUGS, PAIRS)
    return links.unionByName(pages.select("page_id", more.alias("link"))).join(
        routes.withColumnRenamed("route", "link"), "link", "left_anti"
    ).select("page_id", "link")


@query(
    "jn23_leakage",
    IN + ", f AS (SELECT DISTINCT model_id FROM inspections WHERE test_date < DATE '1996-01-01' AND area <> 'FRANCE' AND make <> 'Brand#22'), v AS "
    "(SELECT DISTINCT model_id FROM inspections WHERE test_date >= DATE '1997-01-01') SELECT (SELECT count(*) FROM f) AS fitted, (SELECT "
    "count(*) FROM v) AS validation, (SELECT count(*) FROM v WHERE model_id IN (SELECT model_id FROM f)) AS shared, (SELECT count(*) FROM v "
    "WHERE model_id NOT IN (SELECT model_id FROM f)) AS unknown",
)
def _(t):
    rows = t.inspections()
    fitted = rows.where(before("shipped", 1996)).where("area <> 'FRANCE' and make <> 'Brand#22'").select("model_id", F.lit(1).alias("f")).distinct()
    validation = rows.where(~before("shipped", 1997)).select("model_id", F.lit(1).alias("v")).distinct()
    both = fitted.join(validation, "model_id", "full")
    return both.agg(
        F.count("f").alias("fitted"),
        F.count("v").alias("validation"),
        F.count_if(F.col("f").isNotNull() & F.col("v").isNotNull()).alias("shared"),
        F.count_if(F.col("f").isNull()).alias("unknown"),
    )


@query(
    "jn24_not_seen",
    "SELECT event_id FROM events a WHERE ts >= TIMESTAMP '2024-01-04' AND NOT EXISTS "
    "(SELECT 1 FROM events b WHERE b.ts < TIMESTAMP '2024-01-04' AND b.user_id = a.user_id AND b.event_type = a.event_type)",
)
def _(t):
    events = t("events")
    seen = events.where("ts < timestamp'2024-01-04'").select("user_id", "event_type").distinct()
    return events.where("ts >= timestamp'2024-01-04'").join(seen, ["user_id", "event_type"], "left_anti").select("event_id")


_LOOK = CU + """, q AS (SELECT p_partkey AS id, concat(p_brand, ' ', CASE WHEN p_partkey % 4 = 0 THEN 'NONE' ELSE p_type END) AS model_id,
CASE p_partkey % 3 WHEN 0 THEN '0-2' WHEN 1 THEN '6-10' ELSE '99' END AS age_band, '30k-60k' AS mileage_band FROM part),
c3 AS (SELECT model_id, age_band, mileage_band, sum(n) AS n, sum(risk * n) / sum(n) AS risk FROM cube GROUP BY ALL), c2 AS (SELECT model_id, age_band,
sum(n) AS n, sum(risk * n) / sum(n) AS risk FROM cube GROUP BY ALL),
c1 AS (SELECT model_id, sum(n) AS n, sum(risk * n) / sum(n) AS risk FROM cube GROUP BY ALL), c0 AS (SELECT sum(n) AS n, sum(risk * n) / sum(n) AS risk
FROM cube) """


def requests(t):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "NONE").otherwise(F.col("p_type"))
    return t("part").select(
        k.alias("id"),
        F.concat_ws(" ", "p_brand", kind).alias("model_id"),
        F.when(k % 3 == 0, "0-2").when(k % 3 == 1, "6-10").otherwise("99").alias("age_band"),
        F.lit("30k-60k").alias("mileage_band"),
    )


@query(
    "jn25_cascading_lookup",
    _LOOK + "SELECT id, q.model_id, q.age_band, q.mileage_band, CASE WHEN c3.n IS NOT NULL THEN 0 WHEN c2.n IS NOT NULL THEN 1 WHEN c1.n IS NOT NULL "
    "THEN 2 ELSE 3 END AS level, coalesce(c3.n, c2.n, c1.n, c0.n)::BIGINT AS n, round(coalesce(c3.risk, c2.risk, c1.risk, c0.risk), 6) AS "
    "risk FROM q LEFT JOIN c3 USING (model_id, age_band, mileage_band) LEFT JOIN c2 USING (model_id, age_band) LEFT JOIN c1 USING (model_id) "
    "CROSS JOIN c0",
)
def _(t):
    return C.lookup_cascade(requests(t), t.cube(), ["model_id", "age_band", "mileage_band"])


@query(
    "jn26_band_or_overall",
    _LOOK + "SELECT id, round(coalesce(c2.risk, c1.risk), 6) AS risk, CASE WHEN c2.n IS NOT NULL THEN 'exact' WHEN c1.n IS NOT NULL THEN 'average' "
    "ELSE 'not_found' END AS note FROM q LEFT JOIN c2 USING (model_id, age_band) LEFT JOIN c1 USING (model_id)",
)
def _(t):
    cube = t.cube()
    level = lambda keys, s: cube.groupBy(*keys).agg(F.try_divide(F.sum(F.col("risk") * F.col("n")), F.sum("n")).alias(f"r{s}"))
    joined = requests(t).join(level(["model_id", "age_band"], 2), ["model_id", "age_band"], "left").join(level(["model_id"], 1), "model_id", "left")
    return joined.select(
        "id",
        F.round(F.coalesce("r2", "r1"), 6).alias("risk"),
        F.when(F.col("r2").isNotNull(), "exact").when(F.col("r1").isNotNull(), "average").otherwise("not_found").alias("note"),
    )


_SHOWN = "SELECT DISTINCT make, model FROM base WHERE model IS NOT NULL"


@query(
    "jn27_link_tables",
    VE + f", {BASE_MODEL_CTE}, e AS ({_SHOWN}), " + """r AS (SELECT unnest([{'a': 'FORD', 'b': 'FIESTA', 'c': 'TOYOTA', 'd': 'YARIS', 'p': 1}, {'a': 'FORD', 'b': 'FIESTA', 'c': 'PEUGEOT', 'd': '208', 'p': 2},
{'a': 'FORD', 'b': 'FIESTA', 'c': 'SEAT', 'd': 'IBIZA', 'p': 3}, {'a': 'AUDI', 'b': 'A3', 'c': 'BMW', 'd': '3 SERIES', 'p': 1}, {'a': 'PEUGEOT', 'b': '208', 'c': 'FORD', 'd': 'FIESTA', 'p': 1}]) AS x),
p AS (SELECT unnest([{'a': 'FORD', 'b': 'FIESTA', 'c': 'VAUXHALL', 'd': 'CORSA-E'}, {'a': 'FORD', 'b': 'FIESTA', 'c': 'TOYOTA', 'd': 'YARIS'}, {'a': 'AUDI', 'b': 'A3', 'c': 'BMW', 'd': '3 SERIES'}]) AS x)
SELECT 'sibling' AS kind, a.make, a.model, b.make AS to_make, b.model AS to_model FROM e a JOIN e b ON a.make = b.make AND a.model <> b.model
UNION ALL SELECT 'competitor', e.make, e.model, x.c, x.d FROM e JOIN r ON e.make = x.a AND e.model = x.b WHERE EXISTS (SELECT 1 FROM e f
WHERE f.make = x.c AND f.model = x.d)
UNION ALL SELECT 'comparison', e.make, e.model, CASE WHEN e.make = x.a AND e.model = x.b THEN x.c ELSE x.a END, CASE WHEN e.make = x.a
AND e.model = x.b THEN x.d ELSE x.b END
FROM e JOIN p ON (e.make = x.a AND e.model = x.b) OR (e.make = x.c AND e.model = x.d)""",
)
def _(t):
    make = X.raw_make(F.col("model_id"))
    eligible = t.vehicles().select(make.alias("make"), X.base_model(F.col("model_id"), make).alias("model")).where("model is not null").distinct()
    return L.link_tables(eligible, RIVALS, PAIRS)


@query(
    "jn28_counters",
    "SELECT s_suppkey, coalesce(won, 0) AS won, coalesce(received, 0) AS received FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS received, "
    "count(*) FILTER (l_returnflag = 'A') AS won FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey",
)
def _(t):
    counters = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("l_returnflag") == "A").alias("won")
    )
    return t("supplier").select("s_suppkey").join(counters, "s_suppkey", "left").na.fill(0).select("s_suppkey", "won", "received")
