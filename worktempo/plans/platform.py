"""Platform-wide figures for monitoring."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import MINUTE_US, Clock, micros
from worktempo.functions.columns import floor_div, or_zero, seconds
from worktempo.operators.gaps import active_us, span_slots
from worktempo.plans.base import IDLE, TZ, window_rows


def platform_totals(
    hb: DataFrame, users: DataFrame, *, as_of: datetime, active_days: int = 7, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Users, users with a heartbeat in the last days times 24 hours, all-time active seconds, heartbeats."""
    clock = Clock.at(as_of, tz_hours)
    since = F.lit(micros(clock.as_of - timedelta(days=active_days)))
    slots = span_slots(window_rows(hb, clock, None, idle_minutes=idle_minutes), ["user_id"], F.count("*").alias("n"))
    per_user = slots.groupBy("user_id").agg(
        F.sum("n").alias("n"), F.sum(active_us(idle_minutes=idle_minutes)).alias("us"), F.max("last_t").alias("last_t")
    )
    return per_user.agg(
        F.count_if((F.col("last_t") >= since) & F.col("user_id").isNotNull()).alias("users_active_total"),
        seconds(F.sum("us")).alias("seconds_total"),
        or_zero(F.sum("n")).alias("heartbeats_total"),
    ).withColumn("users_total", users.agg(F.count_distinct("id")).scalar())


def heartbeat_rate(
    hb: DataFrame, *, as_of: datetime, start: datetime | None = None, minutes: int = 5, tz_hours: int = TZ
) -> DataFrame:
    """Heartbeats per minute over the trailing minutes, for each full minute that saw any.

    Minutes are counted first; each count is then handed to the ``minutes`` minutes it takes part in. That is one
    small shuffle and no window over all minutes.
    """
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, start)
    counts = rows.groupBy(F.expr(floor_div("t", MINUTE_US)).alias("minute")).agg(F.count("*").alias("n"))
    ends = F.sequence(F.col("minute") + 1, F.col("minute") + minutes)
    spread = counts.select(F.explode(ends).alias("minute"), "n")
    sums = spread.groupBy("minute").agg(F.sum("n").alias("heartbeats"))
    full = sums.where(F.col("minute") <= F.lit(micros(clock.as_of) // MINUTE_US))
    return full.orderBy("minute").select(
        F.date_format(F.timestamp_micros(F.col("minute") * MINUTE_US), "yyyy-MM-dd HH:mm").alias("minute"),
        "heartbeats",
        (F.col("heartbeats") / F.lit(float(minutes))).alias("per_minute"),
    )
