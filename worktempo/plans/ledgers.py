"""Ledger listings."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock, as_date
from worktempo.functions.columns import day_text, ntz_text
from worktempo.operators import ledger
from worktempo.operators.scan import with_slots
from worktempo.operators.stats import activity
from worktempo.plans.base import IDLE, TZ


def adjustments_list(adjustments: DataFrame, *, tz_hours: int = TZ) -> DataFrame:
    rows = adjustments.orderBy("user_id", F.desc("adjustment_date"), F.desc("created_at"), F.desc("id"))
    return rows.select(
        "id", "user_id", "seconds", "reason",
        F.date_format("adjustment_date", "yyyy-MM-dd").alias("adjustment_date"),
        ntz_text(F.col("created_at"), "dd/MM/yyyy HH:mm", tz_hours).alias("created_at"),
    )


def adjustment_totals(adjustments: DataFrame) -> DataFrame:
    return ledger.adjusted_by(adjustments, "user_id").withColumnRenamed("adj", "total_seconds")


def leaves_list(leaves: DataFrame, *, tz_hours: int = TZ) -> DataFrame:
    rows = leaves.orderBy(F.desc("start_date"), "id")
    return rows.select(
        "id", "user_id", "leave_type", "reason",
        F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
        F.date_format("end_date", "yyyy-MM-dd").alias("end_date"),
        (F.date_diff("end_date", "start_date") + 1).cast("bigint").alias("days"),
        ntz_text(F.col("created_at"), "dd/MM/yyyy HH:mm", tz_hours).alias("created_at"),
    )


def leave_totals(leaves: DataFrame) -> DataFrame:
    """Days per user; overlapping leaves add up."""
    days = (F.date_diff("end_date", "start_date") + 1).cast("bigint")
    return leaves.groupBy("user_id").agg(F.sum(days).alias("total_days"))


def leave_days(leaves: DataFrame, *, start: date | str, end: date | str) -> DataFrame:
    days = ledger.leave_days(leaves, as_date(start), as_date(end))
    return days.select("user_id", F.date_format("leave_date", "yyyy-MM-dd").alias("day"))


def on_leave(leaves: DataFrame, *, as_of: datetime, tz_hours: int = TZ) -> DataFrame:
    return ledger.users_on_leave(leaves, Clock.at(as_of, tz_hours).local_date)


def leave_activity(
    hb_by_day: DataFrame, leaves: DataFrame, *, start: date | str, end: date | str, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Heartbeats and active time of users on their days of leave, from heartbeats with a partition ``local_day``. The join on
    that column lets Spark read only the days that someone was on leave."""
    first, last = as_date(start), as_date(end)
    days = ledger.leave_days(leaves, first, last).withColumnsRenamed({"user_id": "_user", "leave_date": "_day"})
    rows = hb_by_day.where(F.col("local_day").between(F.lit(first), F.lit(last)))
    rows = rows.join(days, (F.col("local_day") == F.col("_day")) & (F.col("user_id") == F.col("_user"))).drop("_user", "_day")
    slots = with_slots(rows.drop("local_day"), tz_hours=tz_hours, idle_minutes=idle_minutes)
    stats = activity(slots, ["user_id"], by_day=True, idle_minutes=idle_minutes, tz_hours=tz_hours)
    return stats.select("user_id", day_text("local_day").alias("day"), "heartbeats", "coding_seconds")
