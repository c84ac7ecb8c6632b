"""Productivity score."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock
from worktempo.functions.columns import round_even, seconds
from worktempo.operators.gaps import active_days, active_us, flagged_slots
from worktempo.operators.stats import gap_flags
from worktempo.plans.base import IDLE, TZ, productivity_pct, window_rows


def productivity(
    hb: DataFrame, *, as_of: datetime, days: int = 7, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Score 0.6 productivity + 0.4 consistency, without adjustments.

    The window holds days + 1 calendar days while consistency divides by ``days``, so it can exceed 100.
    """
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes)
    slots = flagged_slots(rows, ["user_id"], gap_flags(["ide", "browsing", "ai"]), F.count("*").alias("n"))
    users = slots.groupBy("user_id").agg(
        F.sum("n").alias("heartbeats"),
        active_days(tz_hours).alias("active_days"),
        *[seconds(F.sum(active_us(f, idle_minutes=idle_minutes))).alias(f"{f}_seconds") for f in ("ide", "browsing", "ai")],
    )
    scored = users.withColumn("productivity", productivity_pct(F.col("ide_seconds"), F.col("browsing_seconds")))
    scored = scored.withColumn("consistency", round_even(F.col("active_days") / F.lit(max(days, 1)) * 100))
    score = round_even(F.col("productivity") * F.lit(0.6) + F.col("consistency") * F.lit(0.4))
    return scored.withColumn("score", score).orderBy(F.desc("score"), "user_id").select(
        "user_id", "ide_seconds", "browsing_seconds", "ai_seconds", "productivity", "consistency", "score",
        "active_days", "heartbeats",
    )
