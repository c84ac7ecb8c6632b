"""Who is active now."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock, micros
from worktempo.functions.columns import is_ai, or_zero, round_even, seconds
from worktempo.operators.stats import activity
from worktempo.plans.base import IDLE, TZ, clock_text, window_rows

WORKDAY_SECONDS = 8 * 3600


def window_figures() -> list[Column]:
    """What is shown of a user's heartbeats in a window; all but ``latest`` can be made from those of its parts as they are,
    ``latest`` by the part with the largest (t, id)."""
    latest = F.max_by(F.struct("project", "language", "editor", "type", "entity"), F.struct("t", "id"))
    return [
        F.max("editor").alias("editor"),
        F.max(F.when(F.col("type") == "file", F.col("project"))).alias("project"),
        F.max("language").alias("language"),
        F.max("type").alias("last_type"),
        F.max("entity").alias("last_entity"),
        F.count("*").alias("recent_hb"),
        F.max("t").alias("max_t"),
        F.bool_or(is_ai()).alias("is_ai"),
        latest.alias("latest"),
    ]


def shown(users: DataFrame, today: DataFrame, clock: Clock) -> DataFrame:
    """The view: figures per active user beside the day's seconds, most recent first."""
    ago = seconds(F.lit(micros(clock.as_of)) - F.col("max_t"))
    done = or_zero("coding_seconds")
    return (
        users.join(today.select("user_id", "coding_seconds"), "user_id", "left")
        .orderBy(F.desc("max_t"), "user_id")
        .select(
            "user_id", "editor", "project", "language", "last_type", "last_entity", "recent_hb",
            clock_text("max_t", clock, "HH:mm:ss").alias("last_seen"),
            "is_ai",
            ago.alias("seconds_ago"),
            done.alias("today_coding_seconds"),
            F.when(ago < 120, "green").when(ago < 300, "yellow").otherwise("orange").alias("status"),
            F.least(round_even(done / F.lit(WORKDAY_SECONDS) * 100), F.lit(100)).alias("progress_pct"),
            *[F.col(f"latest.{c}").alias(f"latest_{c}") for c in ("project", "language", "editor", "type", "entity")],
        )
    )


def realtime_active(
    hb: DataFrame, *, as_of: datetime, active_minutes: int = 10, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Users with a heartbeat in the last minutes, most recent first.

    editor, language, last_type and last_entity are the largest values of the window, project the largest of its
    file rows; the ``latest_*`` columns are those of the last heartbeat.
    """
    clock = Clock.at(as_of, tz_hours)
    recent = window_rows(hb, clock, clock.as_of - timedelta(minutes=active_minutes))
    today = activity(
        window_rows(hb, clock, clock.today, idle_minutes=idle_minutes), ["user_id"],
        idle_minutes=idle_minutes, tz_hours=tz_hours,
    )
    return shown(recent.groupBy("user_id").agg(*window_figures()), today, clock)
