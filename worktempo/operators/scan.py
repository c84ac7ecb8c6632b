"""Range scans over heartbeats."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import HOUR_US, MINUTE_US
from worktempo.functions.columns import floor_div, local_day_of


def instant(value: datetime):
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def between(hb: DataFrame, start: datetime | None, end: datetime | None, as_of: datetime) -> DataFrame:
    """Heartbeats in [start, end), none after ``as_of``.

    The predicate is on the stored column so that it reaches the Parquet reader. Where the table is laid
    out by ``local_day``, add the partition predicate with ``sources.tables.read_heartbeats``.
    """
    cond = F.col("time") <= instant(as_of)
    if start is not None:
        cond = cond & (F.col("time") >= instant(start))
    if end is not None:
        cond = cond & (F.col("time") < instant(end))
    return hb.where(cond)


def require_utc(hb: DataFrame) -> None:
    zone = hb.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}: heartbeat times are UTC without zone")


def with_slots(
    hb: DataFrame, *, tz_hours: int = 3, idle_minutes: int = 10, slot_seconds: int | None = None
) -> DataFrame:
    """Add integer time columns: ``t`` (UTC microseconds), ``local_day`` and ``slot``.

    A slot is a stretch of local time no wider than the idle limit and never across local midnight. Slot
    numbers grow with time, so all heartbeats of one slot lie together in any time order, and every gap
    inside a slot is below the idle limit. Any width up to the limit gives the same results; a narrower one than
    the limit itself suits feeds so dense that ten minutes of one key are too much for a task.
    """
    require_utc(hb)
    width = idle_minutes * MINUTE_US
    if slot_seconds is not None:
        width = min(width, slot_seconds * 1_000_000)
    local = f"t + {tz_hours * HOUR_US}L"
    return (
        hb.withColumn("t", F.expr("unix_micros(CAST(time AS TIMESTAMP))"))
        .withColumn("local_day", F.expr(local_day_of("t", tz_hours)))
        .withColumn("slot", F.expr(f"{floor_div(local, width)} + local_day"))
    )
