"""Structured Streaming jobs. Each reads what is there, keeps its state in a checkpoint in the shared folder and can be restarted."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from roadlens.sources.files import new_folder

# State processors travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: State on executors' disks with changelogs in the checkpoint: it may outgrow their memory, and a commit writes what changed.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Event time of the row that closes all windows of a finite stream.
CLOSING = "2200-01-01 00:00:00"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """The session's state store setting for the streams that start inside."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, label: str = "stream") -> DataFrame:
    """Process all that is available into a Parquet table and return it. Complete results replace the table, others append."""
    spark = stream.sparkSession
    out = new_folder(spark, label)
    run_stream(stream, each or into(out, mode), f"{label}-state", mode)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def into(out: str, mode: str = "append") -> Callable[[DataFrame, int], None]:
    """A writer of batches; one that is run again after a failure replaces its own folder."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")


def run_stream(stream: DataFrame, each: Callable[[DataFrame, int], object], label: str, mode: str = "append", state: str | None = None) -> list[dict]:
    """Hand all that is available to `each` (batch, number) and return the progress of the batches.

    The state is in a new checkpoint of the shared folder, or in `state`, from which an earlier run is then continued.
    """
    state = state or new_folder(stream.sparkSession, label)
    with rocks_state(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(
            lambda b, n: each(b, n) and None
        ).start()
        query.awaitTermination()
    return list(query.recentProgress)


def run_to_close(events: DataFrame, build: Callable[[DataFrame], DataFrame], label: str = "closed") -> tuple[DataFrame, list[list[dict]]]:
    """Windows of a finite stream in append mode: each is written once, when the watermark passes it, and leaves the state.

    build makes the aggregation from events. A first run writes what the events close; a second one continues from its checkpoint with one
    more event at CLOSING (all other columns null), which closes the rest and is in no result itself. Returns the table and both runs' progress.
    """
    spark = events.sparkSession
    out, ticks, state = new_folder(spark, label), new_folder(spark, f"{label}-ticks"), new_folder(spark, f"{label}-state")
    spark.createDataFrame([], events.schema).write.parquet(ticks)
    closed = build(events.unionByName(spark.readStream.schema(events.schema).parquet(ticks)))
    runs = [run_stream(closed, into(out), label, state=state)]
    tick = [F.lit(CLOSING if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*tick).write.mode("append").parquet(ticks)
    runs.append(run_stream(closed, into(out), label, state=state))
    return spark.read.schema(closed.schema).parquet(out).select(*closed.columns), runs


def state_rows(progress: list[dict]) -> list[int]:
    """Rows of state after each batch."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]


def late_rows(progress: list[dict]) -> int:
    """Rows that came after the watermark had passed them and were left out."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    watermarked = events.withWatermark("ts", "2 days") if events.isStreaming else events
    counted = watermarked.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast("string").alias("start"), "event_type", "n")


def first_signups(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Each key once within the watermark; state for older keys is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def age_band(posts: DataFrame, now: str, least_hours: int = 1, most_hours: int = 48) -> DataFrame:
    """posts with their age against `now`: too_new, in_band or too_old."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("ts")) / 3.6e9
    return posts.withColumn("band", F.when(age < least_hours, "too_new").when(age > most_hours, "too_old").otherwise("in_band"))


def append_log(rows: DataFrame, number: int, path: str, backup: str, write: Callable[[DataFrame, str], None] | None = None) -> str:
    """Write a batch to its own folder of the log; if that fails, its rows go to the backup as JSON. Returns where they went.

    A batch that runs again replaces its own folder, so the log holds each batch once.
    """
    target = f"{path}/batch={number}"
    try:
        (write or (lambda df, to: df.write.mode("overwrite").parquet(to)))(rows, target)
        return target
    except Exception:  # whatever the log's store raises; the rows must not be lost
        rows.write.mode("overwrite").json(f"{backup}/batch={number}")
        return f"{backup}/batch={number}"


def replay(spark: SparkSession, path: str, backup: str, schema: str) -> DataFrame:
    """The log and, after it, what the backup holds for batches that the log lacks."""
    there = spark._jvm.org.apache.hadoop.fs.Path(backup)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(f"{schema}, batch int").parquet(path).drop("batch")
    held = spark.read.schema(f"{schema}, batch int").json(backup)
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not base.getFileSystem(spark._jsc.hadoopConfiguration()).exists(base):
        return held.drop("batch")
    logged = spark.read.schema(f"{schema}, batch int").parquet(path)
    return logged.unionByName(held.join(logged.select("batch").distinct(), "batch", "left_anti")).drop("batch")


def sessions(events: DataFrame, gap: str, steps: dict[str, Column]) -> DataFrame:
    """user_id, start, n and step flags of each session."""
    watermarked = events.withWatermark("ts", "2 days") if events.isStreaming else events
    counted = watermarked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(c.cast("int")).alias(name) for name, c in steps.items()]
    )
    return counted.select("user_id", F.col("w.start").cast("string").alias("start"), "n", *steps)


class SeenSet(StatefulProcessor):
    """Rows (source, id, ts) whose id its source has not seen among its last `cap` ids of the last `hours` hours of event time.

    Each source keeps its ids by arrival; the oldest leave when they are older than `hours` before the newest row, or when there are more
    than `cap`. Rows of one batch are taken by (ts, id). Output: the new rows, and how many ids the source has lost to the cap so far.
    """

    def __init__(self, cap: int, hours: float) -> None:
        self.cap, self.micros = cap, int(hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ids array<string>, times array<long>, evicted long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ids, times, evicted = self.held.get() if self.held.exists() else ([], [], 0)
        held = dict(zip(ids, times, strict=True))
        numbers: dict = {}  # of the batch's ids; its rows are kept as two numbers each
        at_all, codes = array("q"), array("q")
        for row in rows:
            at_all.append(row.at)
            codes.append(numbers.setdefault(row.id, len(numbers)))
        names = list(numbers)
        places = np.empty(len(names), np.int64)
        places[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        for i in np.lexsort((places[np.frombuffer(codes, np.int64)], np.frombuffer(at_all, np.int64))):
            at, id_ = at_all[i], names[codes[i]]
            while held and (oldest := next(iter(held))) and held[oldest] < at - self.micros:
                del held[oldest]
            if id_ in held:
                continue
            held[id_] = at
            if len(held) > self.cap:
                del held[next(iter(held))]
                evicted += 1
            yield Row(source=key[0], id=id_, at=at, evicted=evicted)
        self.held.update((list(held), list(held.values()), evicted))

    def close(self) -> None:
        pass


def unseen(posts: DataFrame, delay: str = "48 hours", cap: int = 1000, hours: float = 48) -> DataFrame:
    """source, id, ts, evicted of the posts (source string, id string, ts) that are new to their source's SeenSet; later than `delay` is too late."""
    at = posts.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    found = at.groupBy("source").transformWithState(SeenSet(cap, hours), "source string, id string, at long, evicted long", "Append", "EventTime")
    return found.select("source", "id", F.timestamp_micros("at").alias("ts"), "evicted")
