"""Attributed active time of a stream, kept as a table of slots by local day.

A session window cannot say whose the gaps are (AI, IDE, browsing), so attributed time comes from the ingested
heartbeats: ``refresh`` rebuilds the slot rows of some days, ``active_from`` links slots and sums. Late heartbeats
count as soon as their day is refreshed again.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock
from worktempo.functions.columns import seconds
from worktempo.operators.gaps import active_us, flagged_slot_rows, linked
from worktempo.operators.scan import with_slots
from worktempo.operators.stats import ATTRIBUTED, gap_flags
from worktempo.sources.tables import read_heartbeats, replace_partitions

FLAGS = ["ide", "browsing", "ai"]
SLOTS = (
    "user_id string, day_number int, slot bigint, first_t bigint, last_t bigint, "
    + ", ".join(f"inner_{f}_us bigint, first_{f} boolean" for f in FLAGS)
    + ", heartbeats bigint, inner_us bigint, local_day date"
)
NO_DAYS = (date(1970, 1, 2), date(1970, 1, 1))


def ingested_days(spark: SparkSession, heartbeats_path: str) -> tuple[date, date] | None:
    """First and last local day of an ingested table, from its partitions; None if it has none."""
    days = spark.read.schema("id bigint, local_day date").parquet(heartbeats_path).agg(F.min("local_day"), F.max("local_day")).first()
    return None if days[0] is None else (days[0], days[1])


def slot_table(
    hb: DataFrame, *, idle_minutes: int = 10, tz_hours: int = 3, slot_seconds: int | None = None
) -> DataFrame:
    rows = with_slots(hb, tz_hours=tz_hours, idle_minutes=idle_minutes, slot_seconds=slot_seconds)
    return flagged_slot_rows(rows, ["user_id"], gap_flags(FLAGS), F.count("*").alias("heartbeats"))


def refresh(
    spark: SparkSession, heartbeats_path: str, rollup_path: str, first: date, last: date, *,
    idle_minutes: int = 10, tz_hours: int = 3, slot_seconds: int | None = None,
) -> None:
    """Rebuild the slot rows of the local days [first, last] and replace those days only, also days without rows."""
    clock = Clock(datetime.combine(last, datetime.min.time()), tz_hours)
    start, end = clock.day_start(first), clock.day_start(last + timedelta(days=1)) - timedelta(microseconds=1)
    hb = read_heartbeats(spark, heartbeats_path, start=start, end=end, tz_hours=tz_hours)
    slots = (
        slot_table(hb, idle_minutes=idle_minutes, tz_hours=tz_hours, slot_seconds=slot_seconds)
        .withColumnRenamed("local_day", "day_number")
        .withColumn("local_day", F.date_from_unix_date("day_number"))
    )
    days = [str(first + timedelta(days=n)) for n in range((last - first).days + 1)]
    found = spark.read.schema("id bigint, local_day date").parquet(heartbeats_path)
    found = found.where(F.col("local_day").between(F.lit(first), F.lit(last))).select("local_day").distinct().collect()
    # A day of slots goes to several files by user and time, so a busy day is no single task.
    dealt = slots.repartition("local_day", F.pmod(F.xxhash64("user_id", "slot"), F.lit(8)))
    replace_partitions(dealt, rollup_path, "local_day", days, [str(r.local_day) for r in found])


def active_from(
    spark: SparkSession, rollup_path: str, first: date, last: date, *, idle_minutes: int = 10, tz_hours: int = 3
) -> DataFrame:
    """Seconds per user over the local days [first, last], from the slot table."""
    slots = spark.read.schema(SLOTS).parquet(rollup_path).where(F.col("local_day").between(F.lit(first), F.lit(last)))
    slots = slots.withColumn("local_day", F.col("day_number"))
    opts = {"idle_minutes": idle_minutes, "tz_hours": tz_hours}
    return linked(slots, ["user_id"]).groupBy("user_id").agg(
        F.sum("heartbeats").alias("heartbeats"),
        seconds(F.sum(active_us(**opts))).alias("coding_seconds"),
        *[seconds(F.sum(active_us(f, **opts))).alias(ATTRIBUTED[f]) for f in FLAGS],
    )
