"""Heartbeats stored for the user window: partitioned by local day, bucketed by (user, slot).

Level one of active time groups by (user, slot); where the rows already lie in buckets of just that, Spark sorts inside the
buckets and exchanges nothing. A slot is at most ten minutes of a user, so a user of a third of the rows is spread over all
buckets like everyone. The time columns are stored, so no report computes them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktempo.functions.columns import is_ai, is_browsing, seconds
from worktempo.operators.gaps import active_us, flagged_slots
from worktempo.operators.scan import with_slots
from worktempo.operators.stats import ATTRIBUTED

FLAGS = ("ide", "browsing", "ai")


def store(hb: DataFrame, name: str, *, buckets: int = 64, idle_minutes: int = 10, tz_hours: int = 3) -> None:
    """A new table of the heartbeats with ``t``, ``day_number``, ``slot`` and the flags of attribution.

    Dealt out by bucket before the write, so a task writes one file per day and bucket it holds."""
    flags = {"f_ide": ~is_browsing(), "f_browsing": is_browsing(), "f_ai": is_ai()}
    rows = with_slots(hb, tz_hours=tz_hours, idle_minutes=idle_minutes).withColumns(flags)
    rows = rows.withColumnRenamed("local_day", "day_number").withColumn("local_day", F.date_from_unix_date("day_number"))
    (
        rows.repartition(buckets, "user_id", "slot").write.format("parquet").partitionBy("local_day")
        .bucketBy(buckets, "user_id", "slot").sortBy("user_id", "slot", "t", "id").saveAsTable(name)
    )


def attributed(slotted: DataFrame, *, idle_minutes: int = 10, tz_hours: int = 3) -> DataFrame:
    """Heartbeats and IDE, browsing, AI and all seconds per user. Only the slot rows are exchanged."""
    rows = slotted.drop("local_day").withColumnRenamed("day_number", "local_day")
    slots = flagged_slots(rows, ["user_id"], {f: F.col(f"f_{f}") for f in FLAGS}, F.count("*").alias("heartbeats"))
    opts = {"idle_minutes": idle_minutes, "tz_hours": tz_hours}
    return slots.groupBy("user_id").agg(
        F.sum("heartbeats").alias("heartbeats"), seconds(F.sum(active_us(**opts))).alias("coding_seconds"),
        *[seconds(F.sum(active_us(f, **opts))).alias(ATTRIBUTED[f]) for f in FLAGS],
    )
