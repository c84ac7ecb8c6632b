"""Who is active now, from a stream.

The streaming state is one row per user and minute (update mode): a heartbeat changes one row, each trigger emits the rows
that changed, and the watermark drops minutes that are over, so a user who went idle has no state left. ``keep`` carries the
changes into a stored table of the last minutes: changed rows replace theirs, minutes out of reach go. The table holds at most
one row per active user and minute, whatever the history. ``active_now`` reads it and gives the rows of
``plans.realtime.realtime_active``.

A repeated batch replaces the rows by themselves, so nothing is counted twice.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from worktempo.functions.clock import Clock
from worktempo.plans.realtime import shown, window_figures
from worktempo.sources import stored
from worktempo.streaming import live

_LATEST = T.StructType([T.StructField(c, T.StringType()) for c in ("project", "language", "editor", "type", "entity")])
_TEXTS = ("editor", "project", "language", "last_type", "last_entity")
MINUTES = T.StructType(
    [T.StructField("minute", T.LongType()), T.StructField("user_id", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in _TEXTS]
    + [T.StructField("recent_hb", T.LongType()), T.StructField("max_t", T.LongType()), T.StructField("max_id", T.LongType()),
       T.StructField("is_ai", T.BooleanType()), T.StructField("latest", _LATEST)]
)
MINUTE_US = 60_000_000


def minutes(stream: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """Per minute and user the mergeable figures of ``realtime_active``; for update mode."""
    rows = live.event_time(stream, delay).withColumn("t", F.unix_micros("ts"))
    found = rows.groupBy(F.window("ts", "1 minute"), "user_id").agg(
        *window_figures(), F.max(F.struct("t", "id")).alias("last"))
    return found.select((F.unix_micros("window.start")).alias("minute"), "user_id", *_TEXTS, "recent_hb", "max_t",
                        F.col("last.id").alias("max_id"), "is_ai", "latest")


def create(spark: SparkSession, name: str) -> None:
    """The empty table of the last minutes."""
    stored.create(spark.createDataFrame([], MINUTES), name)


def keep(name: str, *, active_minutes: int = 10):
    """The function for ``foreachBatch``: rows of ``minutes`` that changed into the table."""

    def run(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        old = stored.current(spark, name)
        # The batch is read and aggregated in its state once, however often its rows are used here.
        fresh = changed.select(*MINUTES.fieldNames()).persist()
        try:
            # The instant of the table is the end of its last minute; nothing out of its reach is joined or sorted.
            last = old.select("minute").unionByName(fresh.select("minute")).agg(F.max("minute")).first()[0]
            near = F.col("minute") >= F.lit(last).cast("bigint") + (1 - active_minutes) * MINUTE_US
            fresh_near = fresh.where(near)
            same = F.col("minute").eqNullSafe(F.col("_minute")) & F.col("user_id").eqNullSafe(F.col("_user"))
            keys = fresh_near.select(F.col("minute").alias("_minute"), F.col("user_id").alias("_user"))
            stored.replace(old.where(near).join(keys, same, "left_anti").unionByName(fresh_near), name)
        finally:
            fresh.unpersist()

    return run


def run(stream: DataFrame, name: str, checkpoint: str, *, trigger: dict | None = None, active_minutes: int = 10,
        delay: str = "10 minutes") -> StreamingQuery:
    """Keep the table from a stream of heartbeats; by default work off what is there and stop."""
    writer = minutes(stream, delay=delay).writeStream.outputMode("update").foreachBatch(keep(name, active_minutes=active_minutes))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def instant(table: DataFrame) -> datetime | None:
    """The end of the last minute that has heartbeats."""
    last = table.agg(F.max("minute")).first()[0]
    return None if last is None else datetime(1970, 1, 1) + timedelta(microseconds=last + MINUTE_US)


def active_now(
    table: DataFrame, today: DataFrame, *, as_of: datetime, active_minutes: int = 10, tz_hours: int = 3
) -> DataFrame:
    """The rows of ``realtime_active`` at ``as_of``, a full minute not before the table's instant. ``today``: user_id and
    coding_seconds of the local day, e.g. from ``slots.attributed``."""
    clock = Clock.at(as_of, tz_hours)
    start = F.unix_micros(F.lit(clock.as_of.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")) - active_minutes * MINUTE_US
    recent = table.where(F.col("minute") >= start)
    users = recent.groupBy("user_id").agg(
        *[F.max(c).alias(c) for c in _TEXTS], F.sum("recent_hb").alias("recent_hb"), F.max("max_t").alias("max_t"),
        F.bool_or("is_ai").alias("is_ai"), F.max_by("latest", F.struct("max_t", "max_id")).alias("latest"))
    return shown(users, today, clock)
