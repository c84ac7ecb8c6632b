"""Live figures over a heartbeat stream, all with built-in operators.

Rows later than the watermark are dropped by a streaming aggregate, while a batch re-run always counts them. So
the stream also keeps the heartbeats as a table by local day (``ingest``), from which ``rollup.refresh`` rebuilds
the last days; the rebuilt days replace what the stream said.
"""

from __future__ import annotations

from pathlib import PurePosixPath
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from worktempo.functions.columns import is_ai

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, base: str | None = None) -> str:
    """A new folder below ``base``, else below the folder of ``spark.checkpoint.dir``, else below the warehouse: each is
    one that driver and executors share."""
    base = base or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    scheme, found, path = base.partition("://")
    joined = PurePosixPath(path if found else base) / f"worktempo-{uuid4().hex}"
    return f"{scheme}://{joined}" if found else str(joined)


def configure(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB rather than in executor memory, and merge sessions before the shuffle so
    that a busy user's heartbeats arrive as few rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def event_time(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Add ``ts``, the heartbeat time as a zoned timestamp (a watermark needs one), with a watermark."""
    return stream.withColumn("ts", F.col("time").cast("timestamp")).withWatermark("ts", delay)


def _minute_figures() -> list[Column]:
    return [
        F.count("*").alias("recent_hb"),
        F.max("ts").alias("last_ts"),
        F.bool_or(is_ai()).alias("is_ai"),
        F.max(F.when(F.col("type") == "file", F.col("project"))).alias("project"),
        F.max("language").alias("language"),
        F.max("editor").alias("editor"),
        F.max("type").alias("last_type"),
        F.max("entity").alias("last_entity"),
    ]


def minute_activity(stream: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """Per minute and user: heartbeats, last one and the largest attributes. A heartbeat is in one minute only, so the
    state holds one row per user and open minute; the sliding windows are made from the minutes (``active_windows``)."""
    return (
        event_time(stream, delay).groupBy(F.window("ts", "1 minute"), "user_id").agg(*_minute_figures())
        .select(F.col("window.start").alias("minute"), "user_id", "recent_hb", "last_ts", "is_ai", "project", "language",
                "editor", "last_type", "last_entity")
    )


def _spread(counts: DataFrame, minutes: int) -> DataFrame:
    """Each row of a minute once for every window of ``minutes`` minutes that holds it."""
    ends = F.transform(F.sequence(F.lit(1), F.lit(minutes)), lambda n: F.timestamp_micros(F.unix_micros("minute") + n * 60_000_000))
    return counts.withColumn("window_end", F.explode(ends))


def active_windows(counts: DataFrame, *, minutes: int = 10) -> DataFrame:
    """Sliding windows (a step a minute) over ``minute_activity``: per window and user the figures of
    ``realtime_active``."""
    return _spread(counts, minutes).groupBy("window_end", "user_id").agg(
        F.sum("recent_hb").alias("recent_hb"),
        F.max("last_ts").alias("last_ts"),
        F.bool_or("is_ai").alias("is_ai"),
        *[F.max(c).alias(c) for c in ("project", "language", "editor", "last_type", "last_entity")],
    )


def sessions(stream: DataFrame, *, idle: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Closed sessions per user: heartbeats no further apart than the idle limit. The gaps of a session telescope,
    so its active time is last minus first."""
    return (
        event_time(stream, delay)
        .groupBy(F.session_window("ts", idle), "user_id")
        .agg(F.count("*").alias("heartbeats"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select(
            "user_id", "first_ts", "last_ts", "heartbeats",
            (F.unix_micros("last_ts") - F.unix_micros("first_ts")).alias("active_us"),
        )
    )


def minute_counts(stream: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """Heartbeats per minute."""
    return (
        event_time(stream, delay).groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("heartbeats"))
        .select(F.col("window.start").alias("minute"), "heartbeats")
    )


def rate_windows(counts: DataFrame, *, minutes: int = 5) -> DataFrame:
    """Heartbeats per minute over the trailing minutes, per sliding window, from ``minute_counts``."""
    return _spread(counts, minutes).groupBy("window_end").agg(F.sum("heartbeats").alias("heartbeats")).withColumn(
        "per_minute", F.col("heartbeats") / F.lit(float(minutes))
    )


def to_table(stream: DataFrame, path: str, checkpoint: str, *partition_by: str, **trigger) -> StreamingQuery:
    """Append the stream to a Parquet table; by default work off what is there and stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def ingest(
    stream: DataFrame, path: str, checkpoint: str, *, tz_hours: int = 3, files_per_day: int = 8, **trigger
) -> StreamingQuery:
    """Keep the heartbeats of a stream as a table by local day, each row once. Rows are dealt out by day and user minute
    before they are written, so a batch adds at most ``files_per_day`` files to a day, however many tasks read it."""
    day = F.to_date(F.col("time") + F.expr(f"INTERVAL '{tz_hours}' HOUR"))
    spread = F.pmod(F.xxhash64("user_id", F.date_trunc("minute", F.col("time"))), F.lit(files_per_day))
    dealt = stream.withColumn("local_day", day).withColumn("_file", spread).repartition("local_day", "_file").drop("_file")
    return to_table(dealt, path, checkpoint, "local_day", **trigger)
