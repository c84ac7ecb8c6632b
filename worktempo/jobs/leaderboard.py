"""Public leaderboard of the last seven days."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock
from worktempo.operators.gaps import active_us, span_slots
from worktempo.operators.scan import instant
from worktempo.plans.base import IDLE, TZ, window_rows

INTERVAL = "7_days"


def leaderboard_7d(
    hb: DataFrame, users: DataFrame, *, as_of: datetime, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Leaderboard rows in nanoseconds for users who opted in. Time is summed per user before the join."""
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.as_of - timedelta(days=7), idle_minutes=idle_minutes)
    totals = span_slots(rows, ["user_id"]).groupBy("user_id").agg(
        (F.sum(active_us(idle_minutes=idle_minutes)) * 1000).alias("total")
    )
    public = users.where(F.col("public_leaderboard")).select(F.col("id").alias("user_id"))
    return totals.join(public, "user_id").select(
        "user_id", F.lit(INTERVAL).alias("interval"), F.lit(None).cast("string").alias("by"), "total",
        F.lit(None).cast("string").alias("key"), instant(as_of).alias("created_at"),
    )


def refresh_leaderboard(items: DataFrame, path: str) -> None:
    """Replace the rows of the intervals in ``items``, of the seven days if it has none; other intervals stay."""
    for interval in [r[0] for r in items.select("interval").distinct().collect()] or [INTERVAL]:
        rows = items.where(F.col("interval") == interval).drop("interval")
        rows.write.mode("overwrite").parquet(f"{path}/interval={interval}")
