"""Streams that end: windows are written once and leave the state, late rows are counted, capped seen sets survive restarts."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from roadlens.sources.files import new_folder
from roadlens.streaming import jobs as J

SCHEMA = "source string, id string, ts timestamp"
START = datetime(2024, 1, 1)


def stream_of(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def add(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_windows_leave_the_state_and_are_written_once(spark, folder):
    batch = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    steps = {"viewed": F.col("event_type") == "view"}
    for build in (lambda e: J.windowed_counts(e, "1 day"), lambda e: J.sessions(e, "6 hours", steps)):
        table, runs = J.run_to_close(J.read_events(spark, folder), build)
        held = J.state_rows([p for run in runs for p in run])
        assert max(held) > 100 and held[-1] == 1  # the closing event alone is left
        assert J.late_rows(runs[0]) == J.late_rows(runs[1]) == 0
        got, want = (sorted(map(tuple, df.collect())) for df in (table, build(batch)))
        assert got == want and len(set(got)) == len(got)


def test_a_closed_stream_writes_most_windows_in_its_first_run(spark, folder):
    closed = J.windowed_counts(J.read_events(spark, folder), "1 day")
    out = new_folder(spark, "first-run")
    progress = J.run_stream(closed, J.into(out), "first-run-state")
    held = J.state_rows(progress)
    assert held[-1] < 0.2 * max(held) and spark.read.parquet(out).count() == max(held) - held[-1]


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    path, state, out = f"{tmp_path}/posts", f"file://{tmp_path}/state", f"{tmp_path}/out"
    hour = lambda h: START + timedelta(hours=h)
    add(spark, path, [("a", "1", hour(0)), ("a", "2", hour(100))])
    found = J.unseen(stream_of(spark, path), "48 hours", 10, 48)
    J.run_stream(found, J.into(out), "", state=state)
    add(spark, path, [("a", "3", hour(10)), ("a", "4", hour(60))])  # 90 hours late, and 40
    progress = J.run_stream(found, J.into(out), "", state=state)
    assert J.late_rows(progress) == 1
    assert {r.id for r in spark.read.parquet(out).collect()} == {"1", "2", "4"}


def plain_unseen(batches, cap, hours):
    held, lost, out = {}, {}, []
    for rows in batches:
        for source, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
            own = held.setdefault(source, [])
            while own and own[0][1] < ts - timedelta(hours=hours):
                own.pop(0)
            if i in [x for x, _ in own]:
                continue
            own.append((i, ts))
            if len(own) > cap:
                own.pop(0)
                lost[source] = lost.get(source, 0) + 1
            out.append((source, i, ts, lost.get(source, 0)))
    return sorted(out)


def test_seen_sets_are_capped_and_continue_after_a_restart(spark, tmp_path):
    """Three runs from one checkpoint: ids leave by age and by the cap, and what an earlier run saw is not new to a later one."""
    path, state, out = f"{tmp_path}/posts", f"file://{tmp_path}/state", f"{tmp_path}/out"
    rng = np.random.default_rng(4)
    batches = []
    for k in range(3):
        batches.append([
            ("hot" if rng.random() < 0.7 else f"s{rng.integers(4)}", str(rng.integers(40)), START + timedelta(minutes=int(k * 1500 + rng.integers(1500))))
            for _ in range(200)
        ])
        add(spark, path, batches[-1])
        J.run_stream(J.unseen(stream_of(spark, path), "90 hours", 12, 20), J.into(out), "", state=state)
    got = sorted((r.source, r.id, r.ts, r.evicted) for r in spark.read.parquet(out).collect())
    assert got == plain_unseen(batches, 12, 20) and max(r[3] for r in got) > 20


def test_the_state_store_setting_is_given_back(spark):
    key = next(iter(J.ROCKS))
    before = spark.conf.get(key, None)
    with J.rocks_state(spark):
        assert spark.conf.get(key) == J.ROCKS[key]
    assert spark.conf.get(key, None) == before
