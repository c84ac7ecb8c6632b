"""Replay of the derived heartbeats as a stream, worked off and stopped.

Input is read in the order of its files, some at a time (``maxBytesPerTrigger``), so a table whose files are in time order
is replayed in bounded batches. What the watermark has closed comes from the stream; what is still open when the
input ends is taken from the table itself and delivered beside it, so the two add up to the batch figure.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from worktempo.functions.clock import Clock
from worktempo.sources import schemas, stored
from worktempo.sources.derived import AS_OF, heartbeats, heartbeats_from, table as derived_table
from worktempo.streaming import active, live, rollup, slots

#: Of each trigger, so that a batch and its state fit executors of some GB.
BATCH = {"maxBytesPerTrigger": str(4 << 30)}
Figure = Callable[[DataFrame], DataFrame]


def heartbeat_stream(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, since the file stream source takes a single file for a directory.
    events = spark.readStream.schema(schema).options(**{**BATCH, **options}).parquet(f"{sf_dir}/events*.parquet")
    return heartbeats_from(events)


def watermark(query: StreamingQuery) -> datetime:
    """The watermark after the last batch of a finished query; the epoch if it had no rows."""
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]]
    return datetime.fromisoformat(max(marks, default="1970-01-01T00:00:00+00:00").replace("Z", "+00:00"))


def last_minute(table: DataFrame, mark: datetime, closed: DataFrame) -> DataFrame:
    """Heartbeats of the minutes that the watermark has not closed, and a few before."""
    return table.where(F.col("time") > F.lit(mark.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz") - F.expr("INTERVAL '1' MINUTE"))


def after_sessions(table: DataFrame, mark: datetime, closed: DataFrame) -> DataFrame:
    """Heartbeats behind their user's last closed session."""
    ends = closed.groupBy(F.col("user_id").alias("_user")).agg(F.max("last_ts").alias("_end"))
    rows = table.join(ends, F.col("user_id").eqNullSafe(F.col("_user")), "left")
    return rows.where(F.col("_end").isNull() | (F.col("time").cast("timestamp") > F.col("_end"))).drop("_user", "_end")


def replayed(
    spark: SparkSession, stream: DataFrame, table: DataFrame, figure: Figure, end: str, folder: str,
    still_open: Callable[[DataFrame, datetime, DataFrame], DataFrame] = last_minute,
) -> DataFrame:
    """A live figure over the whole stream: rows that the watermark closed (``closed``) and the open rest of the table.

    ``end`` is the SQL text of the instant at which a row closes; ``still_open`` picks the table's heartbeats that rows still
    open can hold, so the history is not aggregated again.
    """
    query = live.to_table(figure(stream), f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    mark = watermark(query)
    closed = spark.read.schema(figure(table).schema).parquet(f"{folder}/out")
    rest = figure(still_open(table, mark, closed)).where(F.expr(end) > F.lit(mark).cast("timestamp"))
    return closed.withColumn("closed", F.lit(True)).unionByName(rest.withColumn("closed", F.lit(False)))


def _replay(spark: SparkSession, sf_dir: str, figure: Figure, end: str, *still_open) -> DataFrame:
    table = heartbeats_from(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return replayed(spark, heartbeat_stream(spark, sf_dir), table, figure, end, live.shared_folder(spark), *still_open)


def _text(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


MINUTE_END = "minute + INTERVAL '1' MINUTE"


def stream_active_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = _replay(spark, sf_dir, live.minute_activity, MINUTE_END)
    return live.active_windows(minutes).select(
        _text("window_end"), "user_id", "recent_hb", _text("last_ts"), "is_ai", "project", "language", "editor", "last_type",
        "last_entity",
    )


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _replay(spark, sf_dir, live.sessions, "last_ts + INTERVAL '10' MINUTE", after_sessions)
    return out.select("user_id", _text("first_ts"), _text("last_ts"), "heartbeats", "active_us", "closed")


def stream_heartbeat_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = _replay(spark, sf_dir, live.minute_counts, MINUTE_END)
    return live.rate_windows(minutes).select(_text("window_end"), "heartbeats", "per_minute")


def stream_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest the stream as a table, roll it up by day, and read the attributed seconds per user."""
    folder = live.shared_folder(spark)
    live.ingest(heartbeat_stream(spark, sf_dir), f"{folder}/heartbeats", f"{folder}/checkpoint").awaitTermination()
    days = rollup.ingested_days(spark, f"{folder}/heartbeats")
    if days is None:
        return rollup.active_from(spark, f"{folder}/rollup", *rollup.NO_DAYS)
    rollup.refresh(spark, f"{folder}/heartbeats", f"{folder}/rollup", *days)
    return rollup.active_from(spark, f"{folder}/rollup", *days)


PARTS = 4


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The heartbeats up to the reference instant in the order they are to arrive: by time, but one in fifty comes with the
    last part, however old it is."""
    hb = heartbeats(spark, sf_dir, end=AS_OF).where(F.col("time") <= F.lit(str(AS_OF)).cast("timestamp_ntz"))
    t = F.unix_micros(F.col("time").cast("timestamp"))
    span = hb.agg(F.coalesce(F.min(t), F.lit(0)).alias("a"), F.coalesce(F.max(t), F.lit(0)).alias("b")).first()
    place = F.floor((t - F.lit(span.a)) * PARTS / F.lit(span.b - span.a + 1)).cast("int")
    part = F.when(F.pmod(F.xxhash64("id"), F.lit(50)) == 0, F.lit(PARTS - 1)).otherwise(place)
    return [hb.where(part == k) for k in range(PARTS)]


class Replay:
    """A stream of parts and what is kept of it, in a folder and a database of its own."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, live.shared_folder(spark)
        self.database = stored.new_database(spark, f"{self.folder}/db")
        self.parts = _parts(spark, sf_dir)
        slots.create(spark, self.database)

    def arrive(self, *numbers: int) -> None:
        """Part after part is written and worked off, a trigger each."""
        for k in numbers:
            self.parts[k].write.mode("append").parquet(f"{self.folder}/in/part{k}")
            slots.run(self.stream(), self.database, f"{self.folder}/slots-checkpoint").awaitTermination()

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(schemas.HEARTBEATS).parquet(f"{self.folder}/in/*")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")


def live_ai_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI time of the last days from the slots that batches added up."""
    replay = Replay(spark, sf_dir)
    replay.arrive(*range(PARTS))
    return slots.ai_totals(replay.table("slots"), derived_table(spark, sf_dir, "users"), as_of=AS_OF)


def live_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributed seconds of all days from the slots that batches added up."""
    replay = Replay(spark, sf_dir)
    replay.arrive(*range(PARTS))
    days = stored.stored_days(spark, f"{replay.database}.slots")
    return slots.attributed(replay.table("slots"), *((days[0], days[-1]) if days else rollup.NO_DAYS))


def live_active_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of who is active, kept by a stream in update mode, beside today's seconds from the live slots."""
    replay = Replay(spark, sf_dir)
    name = f"{replay.database}.minutes"
    active.create(spark, name)
    for k in range(PARTS):
        replay.arrive(k)
        active.run(replay.stream(), name, f"{replay.folder}/minutes-checkpoint").awaitTermination()
    day = Clock.at(AS_OF).local_date
    today = slots.attributed(replay.table("slots"), day, day)
    return active.active_now(stored.current(spark, name), today, as_of=AS_OF)


def live_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats per user and local day, made again after each refresh for the days that have changed, no others."""
    replay = Replay(spark, sf_dir)
    counts = f"{replay.database}.counts"
    stored.create_by_day(spark, counts, T._parse_datatype_string("user_id string, heartbeats bigint"))

    def figure(hb: DataFrame) -> DataFrame:
        return hb.groupBy("user_id", "local_day").agg(F.count("*").alias("heartbeats"))

    replay.arrive(*range(PARTS - 1))
    slots.refresh_stale(spark, replay.database, counts, figure)
    replay.arrive(PARTS - 1)
    slots.refresh_stale(spark, replay.database, counts, figure)
    return spark.table(counts).select("user_id", F.date_format("local_day", "yyyy-MM-dd").alias("day"), "heartbeats")
