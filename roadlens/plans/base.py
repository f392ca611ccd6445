"""Fixture views: the driver's tables in the roles of inspections, histories, vehicles and the risk cube.

Each view exists as a DataFrame and as the SQL of a common table expression for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens import registry
from roadlens.functions import rules as R
from roadlens.operators import cube as C
from roadlens.plans import oracle_values as OV

MODELS = [
    "FORD FIESTA ZETEC 1.4L 3 DOOR MANUAL", "BMW 320D SE", "VAUXHALL CORSA-E ELITE", "TOYOTA YARIS HEV CVT", "TESLA MODEL 3 LONG RANGE", "FORD TRANSIT CUSTOM 300", "MERCEDES-BENZ SPRINTER 315",
    "PEUGEOT 208 ACTIVE", "MG 3 STYLE", "RENAULT KADJAR TCE", "MITSUBISHI OUTLANDER PHEV", "HYUNDAI IONIQ 5", "FORD 500", "LAND ROVER DISCOVERY SPORT AUTO", "CITROEN C3 HATCHBACK", "HONDA CB 125CC", "AUDI A3 2.0 TDI DSG",
    "NISSAN LEAF EV ", "ALFA ROMEO GIULIETTA 1.6 COUPE", "FORD -X1", "SKODA X1234", "PEUGEOT 307",
]
RAW_MAKES = [
    "ford", " BMW ", "LAND", "0PEL", "VOLKSWAGON", "MERCEDES", "THE", "HONDA", "Iveco", "TESLA", "zzz", "alfa", "ASTON", "LDV", "Harley-Davidson", "."
]
REGISTRATIONS = ["AB12 CDE", "a123bcd", "ABC123D", "AB1234", "12 AB", "ABCDEFGH", "1234567", "x1 yza", "ab12cd", "ZZ-99-ZZZ"]
POSTCODES = ["SW1A 1AA", "m1 1ae", "N1", "NW10 4UX", "bt9", "12345", "EC2V", "B33 8TH", "", "QQ"]
EMAILS = ["jo@example.com", " Ann.Lee@Example.co.uk ", "bad@", "none", "x+y@mail.org", "@nope.com"]
DEFECTS = [
    "Front brake pads worn", "Coil spring fractured", "Nearside tyre perished", "Steering rack leaking oil", "Corroded sill and floor", "Headlamp aim too high", "Brake pipe rust, bearing noisy", "Wheel rim bent", "Exhaust broken", "ABS lamp advisory",
]


def pick_sql(values: list[str], key: str) -> str:
    """DuckDB: one of the values by key."""
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{listed}], CAST(({key}) % {len(values)} AS INT) + 1)"


def pick(values: list[str], key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def inspections(self) -> DataFrame:
        """One row for each lineitem in the role of an inspection.

        The join with orders, whose size is that of the lines, comes first, while rows are numbers and flags; names and models come with the
        smaller tables, so that no shuffle carries them for all lines unless a later one needs them.
        """
        line, part, orders, supplier, nation = map(self, ("lineitem", "part", "orders", "supplier", "nation"))
        failed = (F.col("l_returnflag") == "R").cast("int")
        line = line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate", failed.alias("target"))
        joined = line.join(orders, line.l_orderkey == orders.o_orderkey)
        joined = joined.join(part, joined.l_partkey == part.p_partkey)
        joined = joined.join(supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey), joined.l_suppkey == supplier.s_suppkey)  # 25 nations
        return joined.select(
            F.col("o_custkey").alias("vehicle_id"), F.to_date("l_shipdate").alias("test_date"), F.col("l_shipdate").alias("shipped"), "target", F.col("p_brand").alias("make"), F.concat_ws(
                " ", "p_brand", "p_type"
            ).alias("model_id"),
            (F.col("p_size") % 20).alias("age_years"), F.col("l_extendedprice").alias("test_mileage"), F.col("n_name").alias("area"),
            F.col("o_orderstatus").alias("prev_outcome"), F.col("l_linenumber").alias("line"),
        )

    def banded(self) -> DataFrame:
        """Inspections with age and mileage bands and one failure flag for each component."""
        rows = self.inspections().withColumn("age_band", R.age_band(F.col("age_years"))).withColumn("mileage_band", R.mileage_band(F.col("test_mileage")))
        return rows.withColumns({f"fail_{c}": F.when(F.col("line") % 7 == i, F.col("target")).otherwise(0) for i, c in enumerate(R.COMPONENTS)})

    def cube(self) -> DataFrame:
        """The risk cube over the banded inspections."""
        return C.risk_cube(self.banded(), ["model_id", "age_band", "mileage_band"], "target", {c: f"fail_{c}" for c in R.COMPONENTS}, k=10.0)

    def history(self) -> DataFrame:
        """One row for each event in the role of an inspection of its user's vehicle."""
        kind = F.col("event_type")
        return self("events").select(
            F.col("event_id").alias("test_id"), F.col("user_id").alias("vehicle_id"), F.col("ts").alias("test_ts"), F.to_date("ts").alias("test_date"),
            kind.alias("outcome"),
            (kind == "error").cast("int").alias("failed"), (kind == "click").cast("int").alias("advisory"), F.col("value").alias("reading"),
        )

    def vehicles(self) -> DataFrame:
        """One row for each part with names, registrations and texts that depend on its key."""
        k = F.col("p_partkey")
        return self("part").select(
            k.alias("vehicle_id"), pick(MODELS, k * 7).alias("model_id"), pick(RAW_MAKES, k).alias("raw_make"),
            pick(REGISTRATIONS, k).alias("registration"), pick(POSTCODES, k * 3).alias("postcode"), pick(EMAILS, k).alias("email"),
            pick(DEFECTS, k * 3).alias("defect"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"),
        )


INSPECTIONS = """inspections AS (
SELECT o_custkey AS vehicle_id, CAST(l_shipdate AS DATE) AS test_date, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target, p_brand AS make,
       concat(p_brand, ' ', p_type) AS model_id, p_size % 20 AS age_years, l_extendedprice AS test_mileage, n_name AS area, o_orderstatus AS prev_outcome, l_linenumber AS line
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey)"""


def bands_sql(value: str, edges, last: str, unknown: str | None = None, closed: bool = False) -> str:
    sign = "<=" if closed else "<"
    return "CASE " + (f"WHEN {unknown} THEN 'Unknown' " if unknown else "") + " ".join(
        f"WHEN {value} {sign} {e} THEN '{n}'" for e, n in edges
    ) + f" ELSE '{last}' END"


AGE_SQL = bands_sql("age_years", OV.AGE_BANDS, "15+", "age_years IS NULL OR age_years < 0")
MILEAGE_SQL = bands_sql("test_mileage", OV.MILEAGE_BANDS, "100k+", "test_mileage IS NULL OR test_mileage < 0 OR test_mileage > 500000")
BANDED = INSPECTIONS + f""", banded AS (
SELECT *, {AGE_SQL} AS age_band, {MILEAGE_SQL} AS mileage_band, {", ".join(f"CASE WHEN line % 7 = {i} THEN target ELSE 0 END AS fail_{c}" for i, c in enumerate(R.COMPONENTS))}
FROM inspections)"""
CUBE = BANDED + f""", cube AS (
SELECT model_id, age_band, mileage_band, count(*) AS n, sum(target) AS failures, (sum(target) + 10.0 * (SELECT avg(target)
FROM banded)) / (count(*) + 10.0) AS risk,
       {", ".join(f"(sum(fail_{c}) + 10.0 * (SELECT avg(fail_{c}) FROM banded)) / (count(*) + 10.0) AS risk_{c}" for c in R.COMPONENTS)}
FROM banded GROUP BY ALL)"""
HISTORY = """history AS (
SELECT event_id AS test_id, user_id AS vehicle_id, ts AS test_ts, CAST(ts AS DATE) AS test_date, event_type AS outcome, CASE WHEN event_type = 'error'
THEN 1 ELSE 0 END AS failed,
       CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS advisory, value AS reading FROM events)"""
VEHICLES = f"""vehicles AS (
SELECT p_partkey AS vehicle_id, {pick_sql(MODELS, "p_partkey * 7")} AS model_id, {pick_sql(RAW_MAKES, "p_partkey")} AS raw_make, {pick_sql(REGISTRATIONS, "p_partkey")} AS registration,
       {pick_sql(POSTCODES, "p_partkey * 3")} AS postcode, {pick_sql(EMAILS, "p_partkey")} AS email, {pick_sql(DEFECTS, "p_partkey * 3")} AS defect, p_size AS size, p_retailprice AS price, p_name AS name
FROM part)"""


def before(column: str, year: int):
    """Whether a stored time lies before a year: a bound that reaches the Parquet scan, unlike year(column)."""
    return F.col(column) < F.lit(f"{year}-01-01").cast("timestamp_ntz")


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with its oracle."""

    def add(fn):
        registry.QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            registry.ORACLE_SQL[name] = sql
        return fn

    return add
