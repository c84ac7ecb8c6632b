"""Shared pieces of the plans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock, day_number
from worktempo.functions.columns import dashed, floored, local_text, or_zero, ratio_pct, zero
from worktempo.operators.scan import between, with_slots

IDLE = 10
TZ = 3


def window_rows(
    hb: DataFrame, clock: Clock, start: datetime | None, end: datetime | None = None, idle_minutes: int = IDLE,
    slot_seconds: int | None = None,
) -> DataFrame:
    """Heartbeats of a UTC range up to as_of, with the integer time columns. Narrower slots than the idle limit give the
    same figures and smaller sorts for users with very dense heartbeats."""
    rows = between(hb, start, end, clock.as_of)
    return with_slots(rows, tz_hours=clock.tz_hours, idle_minutes=idle_minutes, slot_seconds=slot_seconds)


def clock_text(name: str, clock: Clock, pattern: str = "HH:mm") -> Column:
    return local_text(name, pattern, clock.tz_hours)


def since_day(moment: datetime, clock: Clock) -> Column:
    """Cells or slots on or after the local day of a UTC instant."""
    return F.col("local_day") >= F.lit(day_number((moment + clock.offset).date()))


def before_day(moment: datetime, clock: Clock) -> Column:
    return F.col("local_day") < F.lit(day_number((moment + clock.offset).date()))


def with_adjustments(stats: DataFrame, adj: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with summed adjustments; adds ``present`` (has heartbeats) and adj (0 if none)."""
    out = stats.withColumn("_hit", F.lit(True)).join(adj, keys, "full")
    return out.withColumn("present", F.col("_hit").isNotNull()).drop("_hit").withColumn("adj", or_zero("adj"))


def adjusted(name: str) -> Column:
    """Seconds plus adjustment, not below zero."""
    return floored(or_zero(name) + F.col("adj"))


def text_or_dash(name: str) -> Column:
    return dashed(name, F.col("present")).alias(name)


def productivity_pct(ide: Column, browsing: Column) -> Column:
    total = ide + browsing
    return F.when(total > 0, ratio_pct(ide, total)).otherwise(zero())
