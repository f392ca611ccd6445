"""Readers and writers: typed CSV loads with rejects, lookup pairs, nested JSON histories, exports, manifests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.sources.versions import VersionedTable

HISTORY_SCHEMA = (
    "registration string, make string, motTests array<struct<completedDate string, testResult string, odometerValue string, odometerUnit string, defects "
    "array<struct<text string, type string>>, rfrAndComments array<struct<text string, type string>>>>"
)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir; where that is not set, in a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet scan of a path or glob; filters and columns reach the files."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def clean_header(names: list[str]) -> list[str]:
    return [re.sub(r"[^0-9A-Za-z]+", "_", n.strip()).strip("_") for n in names]


def load_typed_csv(spark: SparkSession, path: str, strings: int, integers: int) -> DataFrame:
    """A CSV (plain or gzip) whose first columns are strings, the next integers and all others doubles; blank or bad numbers are 0."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*clean_header(raw.columns))
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    kinds = [F.col(c) if i < strings else F.bround(number(c)).cast("long").alias(c) if i < strings + integers else number(c).alias(c) for i, c in enumerate(raw.columns)]
    return raw.select(*kinds)


def load_with_rejects(spark: SparkSession, path: str, key: str, longest: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows whose key is too long are rejected, other strings are cut to `keep` characters."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*clean_header(raw.columns))
    too_long = F.coalesce(F.length(key) > longest, F.lit(False))
    return raw.where(~too_long).withColumns({c: F.substring(c, 1, keep) for c in raw.columns if c != key}), raw.where(too_long)


def load_lookup_pair(spark: SparkSession, detail: str, group: str, vehicle_class: int) -> DataFrame:
    """rfr_id and item of two pipe-separated files joined on section and class."""
    read = lambda p: spark.read.option("header", True).option("sep", "|").csv(p)
    details = read(detail).where(F.col("test_class_id").try_cast("int") == vehicle_class).select(
        "rfr_id", F.col("test_item_set_section_id").alias("section")
    )
    groups = read(group).where(F.col("test_class_id").try_cast("int") == vehicle_class).select(
        F.col("test_item_id").alias("section"), F.when(F.col("item_name") == "Road Wheels", "Wheels").otherwise(F.col("item_name")).alias("item")
    )
    return details.join(groups, "section").select(F.col("rfr_id").cast("long").alias("rfr_id"), "item")


def parse_histories(rows: DataFrame, column: str) -> DataFrame:
    """registration, test_date, test_result, odometer, n_defects of each test in a JSON history.

    Readings that are no numbers are null, dates may have dots or hyphens, an absent defects list falls back to rfrAndComments, an
    empty one doesn't. Bad JSON gives no rows.
    """
    parsed = rows.select(F.from_json(column, HISTORY_SCHEMA).alias("h")).select("h.registration", F.explode("h.motTests").alias("t"))
    date = F.try_to_timestamp(F.replace(F.substring("t.completedDate", 1, 10), F.lit("."), F.lit("-")), F.lit("yyyy-MM-dd")).cast("date")
    return parsed.select(
        "registration",
        date.alias("test_date"),
        F.col("t.testResult").alias("test_result"),
        F.col("t.odometerValue").try_cast("int").alias("odometer"),
        F.size(F.coalesce("t.defects", "t.rfrAndComments", F.array())).alias("n_defects"),
    )


def json_list(column):
    """A JSON array of strings as an array, anything else as an empty one."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def read_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, predicate: str = "true") -> DataFrame:
    """A partitioned read over JDBC with the predicate pushed into the query (needs a driver on the class path)."""
    query = f"(SELECT * FROM {table} WHERE {predicate}) AS t"
    return spark.read.format("jdbc").options(url=url, dbtable=query, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def full_refresh(df: DataFrame, path: str, partition: str, sort: str) -> int:
    """A new version of a table, partitioned by one column and sorted by another inside files, so that readers skip row groups.

    Readers see the old version until the new one is whole; read it with VersionedTable(spark, path).read(). Returns the version.
    """
    parts = df.repartition(partition, F.pmod(F.xxhash64(sort), F.lit(4))).sortWithinPartitions(sort)
    return VersionedTable(df.sparkSession, path).write(parts, lambda w: w.partitionBy(partition))


def export_newest(df: DataFrame, path: str, fmt: str, order: list) -> None:
    """Newest first as CSV (with header) or JSON."""
    writer = df.orderBy(*order).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def append_jsonl(df: DataFrame, path: str, loaded_at: str) -> None:
    df.withColumn("loaded_at", F.lit(loaded_at)).write.mode("append").json(path)


def write_result(df: DataFrame, path: str, **metadata: str) -> None:
    """Rows as JSON, each with a struct of metadata."""
    df.withColumn("metadata", F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()])).write.mode("overwrite").json(path)


def save_encoder(tables: list[DataFrame], folder: str) -> None:
    """One Parquet table for each level of a fitted encoder."""
    for i, table in enumerate(tables):
        table.write.mode("overwrite").parquet(f"{folder}/level={i}")


def load_encoder(spark: SparkSession, folder: str, levels: int) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/level={i}") for i in range(levels)]


def manifest(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """name, n, first, last of each input and its date column."""
    rows = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.min(F.to_date(date)).cast("string").alias("first"), F.max(F.to_date(date)).cast("string").alias("last")) for name, (df, date) in tables.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def bucketed(df: DataFrame, keys: list[str], buckets: int, label: str = "bucketed") -> DataFrame:
    """df written once as a table of the session's catalog, bucketed and sorted by keys; read back, it joins and groups by them without a shuffle.

    Tables that are joined on the same keys need the same number of buckets: about the largest table's size over 200 MB.
    """
    path = new_folder(df.sparkSession, label)
    name = f"bucketed_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys)  # one file a bucket
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
