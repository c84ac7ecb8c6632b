"""Streams replayed from files: closed figures equal batch, late rows, restart."""

from __future__ import annotations

from datetime import date

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_gaps import busy_rows
from worktempo.operators.scan import with_slots
from worktempo.operators.stats import activity
from worktempo.sources import schemas
from worktempo.sources.tables import empty_partition, write_heartbeats
from worktempo.streaming import live, replay, rollup


@pytest.fixture(autouse=True)
def state_store(spark):
    live.configure(spark)


def source(spark, path):
    return spark.readStream.schema(schemas.HEARTBEATS).option("maxFilesPerTrigger", 1).parquet(path)


def add(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def work_off(stream, tmp_path, name="out"):
    live.to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()


def test_sessions_equal_gap_sums(spark, hb, tmp_path):
    """Closed by a heartbeat far in the future, all sessions are out; their spans add up to the batch figure."""
    made = sorted(busy_rows(11), key=lambda r: r["time"])
    src = str(tmp_path / "in")
    for part in (made[:500], made[500:1100], made[1100:]):
        add(hb(*part), src)
    add(hb({"id": 10**6, "at": "31 00:00:00", "user_id": "closer"}), src)
    work_off(live.sessions(source(spark, src)), tmp_path)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {r["user_id"]: r["us"] for r in rows(out.groupBy("user_id").agg(F.sum("active_us").alias("us")))}
    want = {r["user_id"]: r["coding_us"] for r in rows(activity(with_slots(hb(*made)), ["user_id"]))}
    assert got == want and "closer" not in got


def test_late_rows_are_dropped_by_the_stream_and_kept_by_the_rebuild(spark, hb, tmp_path):
    src = str(tmp_path / "in")
    add(hb({"id": 1, "at": "05 06:00:00"}, {"id": 2, "at": "05 06:05:00"}), src)
    work_off(live.minute_counts(source(spark, src)), tmp_path, "rate")
    live.ingest(source(spark, src), str(tmp_path / "hb"), str(tmp_path / "hb-checkpoint")).awaitTermination()
    add(hb({"id": 3, "at": "05 09:00:00"}), src)
    for _ in range(2):  # two restarts from the checkpoint: the watermark moves, nothing is read twice
        work_off(live.minute_counts(source(spark, src)), tmp_path, "rate")
    add(hb({"id": 4, "at": "05 06:02:00", "category": "ai coding"}), src)
    work_off(live.minute_counts(source(spark, src)), tmp_path, "rate")
    live.ingest(source(spark, src), str(tmp_path / "hb"), str(tmp_path / "hb-checkpoint")).awaitTermination()

    windows = live.rate_windows(spark.read.parquet(str(tmp_path / "rate")))
    rate = {str(r["window_end"])[11:16]: r["heartbeats"] for r in rows(windows)}
    assert rate["06:03"] == 1 and rate["06:05"] == 1 and rate["06:06"] == 1

    day = date(2024, 1, 5)
    rollup.refresh(spark, str(tmp_path / "hb"), str(tmp_path / "slots"), day, day)
    (got,) = rows(rollup.active_from(spark, str(tmp_path / "slots"), day, day))
    assert (got["heartbeats"], got["coding_seconds"], got["ai_coding_seconds"]) == (4, 300, 120)


def test_rollup_refresh_replaces_only_its_days(spark, hb, tmp_path):
    src, slots = str(tmp_path / "hb"), str(tmp_path / "slots")
    data = hb(*busy_rows(12))
    live_days = [r["d"] for r in rows(with_slots(data).selectExpr("date_from_unix_date(local_day) d").distinct().orderBy("d"))]
    write_heartbeats(data, src)
    first, last = live_days[0], live_days[-1]
    rollup.refresh(spark, src, slots, first, last)
    rollup.refresh(spark, src, slots, live_days[1], live_days[2])
    flags = rollup.FLAGS
    columns = ["user_id", "coding_seconds", "ide_coding_seconds", "browsing_seconds", "ai_coding_seconds"]
    want = rows(activity(with_slots(data), ["user_id"], flags).select(*columns).orderBy("user_id"))
    got = rows(rollup.active_from(spark, slots, first, last).select(*columns).orderBy("user_id"))
    assert got == want and len(live_days) > 3


def test_active_now_windows(spark, hb, tmp_path):
    src = str(tmp_path / "in")
    add(hb({"at": "05 06:00:30", "editor": "Cursor"}, {"at": "05 06:04:30"}), src)
    add(hb({"id": 9, "at": "05 08:00:00", "user_id": "v"}), src)
    work_off(live.minute_activity(source(spark, src)), tmp_path)
    windows = rows(live.active_windows(spark.read.parquet(str(tmp_path / "out"))))
    out = {str(r["window_end"])[11:16]: r for r in windows if r["user_id"] == "u"}
    assert out["06:05"]["last_type"] == "file" and out["06:05"]["last_entity"] == "/f"
    assert len(out) == 14
    assert out["06:01"]["recent_hb"] == 1 and out["06:10"]["recent_hb"] == 2 and out["06:14"]["recent_hb"] == 1
    assert out["06:05"]["is_ai"] and not out["06:14"]["is_ai"] and str(out["06:10"]["last_ts"])[11:19] == "06:04:30"


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert live.shared_folder(spark).startswith(f"{named.rstrip('/')}/worktempo-")
    assert live.shared_folder(spark, "hdfs://a/b/").startswith("hdfs://a/b/worktempo-")
    assert live.shared_folder(spark) != live.shared_folder(spark)


@pytest.mark.parametrize("figure, end, still_open", [
    (live.minute_activity, replay.MINUTE_END, replay.last_minute), (live.minute_counts, replay.MINUTE_END, replay.last_minute),
    (live.sessions, "last_ts + INTERVAL '10' MINUTE", replay.after_sessions),
])
def test_closed_and_open_rows_add_up(spark, hb, tmp_path, figure, end, still_open):
    """The same rows with one trigger and with four, and the same as the batch figure."""
    made = sorted(busy_rows(13), key=lambda r: r["time"])
    src = str(tmp_path / "in")
    for k in range(4):
        add(hb(*made[k * len(made) // 4:(k + 1) * len(made) // 4]), src)
    table = spark.read.schema(schemas.HEARTBEATS).parquet(src)
    want = sorted(map(str, rows(figure(table))))
    for name, files in (("one", 10), ("four", 1)):
        stream = spark.readStream.schema(schemas.HEARTBEATS).option("maxFilesPerTrigger", files).parquet(src)
        out = replay.replayed(spark, stream, table, figure, end, str(tmp_path / name), still_open)
        assert sorted(map(str, rows(out.drop("closed")))) == want
        assert {r["closed"] for r in rows(out)} == {True, False}


def test_a_day_without_rows_loses_its_slots(spark, hb, tmp_path):
    src, slots = str(tmp_path / "hb"), str(tmp_path / "slots")
    write_heartbeats(hb({"id": 1, "at": "05 06:00:00"}, {"id": 2, "at": "06 06:00:00"}), src)
    first, last = date(2024, 1, 5), date(2024, 1, 6)
    rollup.refresh(spark, src, slots, first, last)
    empty_partition(spark.read.schema(schemas.HEARTBEATS).parquet(src).withColumn("local_day", F.lit("")), src, "local_day", "2024-01-05")
    rollup.refresh(spark, src, slots, first, first)
    (got,) = rows(rollup.active_from(spark, slots, first, last))
    assert got["heartbeats"] == 1
    assert rollup.ingested_days(spark, src) == (last, last)


def test_the_whole_replay_is_attributed(spark):
    """No day is cut: the sum over users is the table's number of heartbeats."""
    path = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{path}/events.parquet").count()
    assert sum(r["heartbeats"] for r in rows(replay.stream_attributed(spark, path))) == events
