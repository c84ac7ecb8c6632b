"""Per-user breakdowns. Each plan gives all users at once; filter on user_id for one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock
from worktempo.functions.columns import day_text, file_rows, is_ai, joined, or_zero, seconds, site_rows
from worktempo.operators.gaps import active_us, flagged_slots, grouped_slots, span_slots
from worktempo.operators.ledger import adjusted_by_user_day
from worktempo.operators.stats import activity, key_stats, top_per_key
from worktempo.plans.base import IDLE, TZ, adjusted, clock_text, text_or_dash, window_rows, with_adjustments


def user_daily(
    hb: DataFrame, adjustments: DataFrame, *, as_of: datetime, days: int = 14, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """User and local day; adjustments of any date appear, also outside the window."""
    clock = Clock.at(as_of, tz_hours)
    stats = key_stats(
        window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes), ["user_id"],
        lists=["project", "language", "editor"], flags=["ai"], by_day=True, idle_minutes=idle_minutes, tz_hours=tz_hours,
    )
    rows = with_adjustments(stats, adjusted_by_user_day(adjustments), ["user_id", "local_day"])
    rows = rows.select(
        "*",
        joined("project_values").alias("projects"),
        joined("language_values").alias("languages"),
        joined("editor_values").alias("editors"),
        clock_text("first_t", clock).alias("first_active"),
        clock_text("last_t", clock).alias("last_active"),
    )
    return rows.select(
        "user_id",
        day_text("local_day").alias("day"),
        or_zero("heartbeats").alias("heartbeats"),
        *[text_or_dash(c) for c in ("projects", "languages", "editors", "first_active", "last_active")],
        adjusted("coding_seconds").alias("coding_seconds"),
        F.col("adj").alias("adjustment_seconds"),
        or_zero("ai_heartbeats").alias("ai_heartbeats"),
        or_zero("ai_coding_seconds").alias("ai_coding_seconds"),
    )


def _top_keyed(
    hb: DataFrame, key: str, clock: Clock, days: int, top_n: int, idle_minutes: int, *aggs: Column
) -> DataFrame:
    """Top values of one column per user, gaps taken among the heartbeats with that value."""
    rows = window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes).where(F.col(key) != "")
    slots = span_slots(rows, ["user_id", key], F.count("*").alias("heartbeats"), *aggs)
    sums = slots.groupBy("user_id", key).agg(
        F.sum("heartbeats").alias("heartbeats"),
        seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("coding_seconds"),
        *([F.max("os").alias("os")] if aggs else []),
    )
    return top_per_key(sums, ["user_id"], top_n, F.desc("coding_seconds"), F.asc(key))


def user_projects(
    hb: DataFrame, *, as_of: datetime, days: int = 30, top_n: int = 10, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    top = _top_keyed(hb, "project", Clock.at(as_of, tz_hours), days, top_n, idle_minutes)
    return top.select("user_id", "rank", F.col("project").alias("name"), "heartbeats", "coding_seconds")


def user_languages(
    hb: DataFrame, *, as_of: datetime, days: int = 30, top_n: int = 10, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    top = _top_keyed(hb, "language", Clock.at(as_of, tz_hours), days, top_n, idle_minutes)
    return top.select("user_id", "rank", F.col("language").alias("name"), "heartbeats", "coding_seconds")


def user_editors(
    hb: DataFrame, *, as_of: datetime, days: int = 30, top_n: int = 10, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes).where(F.col("editor") != "")
    slots = flagged_slots(
        rows, ["user_id", "editor"], {"ai": is_ai()},
        F.count("*").alias("heartbeats"), F.count_if("f_ai").alias("ai_heartbeats"),
    )
    sums = slots.groupBy("user_id", "editor").agg(
        F.sum("heartbeats").alias("heartbeats"),
        seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("coding_seconds"),
        F.sum("ai_heartbeats").alias("ai_heartbeats"),
        seconds(F.sum(active_us("ai", idle_minutes=idle_minutes))).alias("ai_coding_seconds"),
    )
    top = top_per_key(sums, ["user_id"], top_n, F.desc("coding_seconds"), F.asc("editor"))
    return top.select(
        "user_id", "rank", F.col("editor").alias("name"), "heartbeats", "coding_seconds", "ai_heartbeats",
        "ai_coding_seconds",
    )


def user_weekly_trend(
    hb: DataFrame, adjustments: DataFrame, *, as_of: datetime, days: int = 7, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """User and local day; days with only an adjustment are left out."""
    clock = Clock.at(as_of, tz_hours)
    stats = activity(
        window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes), ["user_id"],
        by_day=True, idle_minutes=idle_minutes, tz_hours=tz_hours,
    )
    rows = stats.join(adjusted_by_user_day(adjustments), ["user_id", "local_day"], "left")
    rows = rows.withColumn("adj", or_zero("adj"))
    return rows.select(
        "user_id",
        day_text("local_day").alias("day"),
        "heartbeats",
        adjusted("coding_seconds").alias("coding_seconds"),
        F.col("adj").alias("adjustment_seconds"),
        "ai_heartbeats",
    )


def user_files(
    hb: DataFrame, *, as_of: datetime, days: int = 7, top_n: int = 30, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Top (file, project, language) per user. Gaps run along the file; each belongs to the project and language
    of its later heartbeat."""
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes).where(file_rows())
    group = ["entity", "project", "language"]
    slots = grouped_slots(rows, ["user_id", "entity"], ["project", "language"], F.count("*").alias("heartbeats"))
    sums = slots.groupBy("user_id", *group).agg(
        F.sum("heartbeats").alias("heartbeats"),
        seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("coding_seconds"),
    )
    order = [F.desc("coding_seconds"), *[F.asc_nulls_first(c) for c in group]]
    top = top_per_key(sums, ["user_id"], top_n, *order)
    return top.select("user_id", "rank", *group, "heartbeats", "coding_seconds")


def user_domains(
    hb: DataFrame, *, as_of: datetime, days: int = 7, top_n: int = 30, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    top = _top_keyed(hb.where(site_rows()), "entity", Clock.at(as_of, tz_hours), days, top_n, idle_minutes)
    return top.select("user_id", "rank", "entity", "heartbeats", "coding_seconds")


def user_machines(
    hb: DataFrame, *, as_of: datetime, days: int = 30, top_n: int = 10, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    top = _top_keyed(
        hb, "machine", Clock.at(as_of, tz_hours), days, top_n, idle_minutes, F.max("operating_system").alias("os")
    )
    return top.select("user_id", "rank", F.col("machine").alias("name"), "os", "heartbeats", "coding_seconds")


def user_hourly(hb: DataFrame, users: DataFrame, *, as_of: datetime, tz_hours: int = TZ) -> DataFrame:
    """24 rows per user: heartbeats of each local hour today."""
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.today)
    hour = clock_text("t", clock, "H").cast("int")
    slots = rows.groupBy("user_id", hour.alias("hour")).agg(F.count("*").alias("n"))
    per_user = slots.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("counts"))
    everyone = users.select(F.col("id").alias("user_id")).join(per_user, "user_id", "left")
    dense = everyone.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return dense.select("user_id", "hour", or_zero(F.try_element_at("counts", F.col("hour"))).alias("heartbeats"))


def user_totals(hb: DataFrame, *, as_of: datetime, tz_hours: int = TZ) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    stats = key_stats(window_rows(hb, clock, None), ["user_id"], distinct=["project", "language"], tz_hours=tz_hours)
    return stats.select(
        "user_id",
        F.col("heartbeats").alias("total_heartbeats"),
        F.col("project_count").alias("total_projects"),
        F.col("language_count").alias("total_languages"),
        F.col("active_days").alias("total_active_days"),
        clock_text("first_t", clock, "dd/MM/yyyy").alias("first_seen"),
        clock_text("last_t", clock, "dd/MM/yyyy HH:mm").alias("last_seen"),
    )


def user_heatmap(hb: DataFrame, *, as_of: datetime, days: int = 90, tz_hours: int = TZ) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.days_back(days))
    counts = rows.groupBy("user_id", "local_day").agg(F.count("*").alias("heartbeats"))
    return counts.select("user_id", day_text("local_day").alias("day"), F.col("heartbeats").alias("count"))


def user_ai_totals(
    hb: DataFrame, users: DataFrame, *, as_of: datetime, days: int = 30, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Gaps between AI heartbeats only: not the AI share of the user's time."""
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes).where(is_ai())
    sums = span_slots(rows, ["user_id"], F.count("*").alias("n")).groupBy("user_id").agg(
        F.sum("n").alias("n"), seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("s")
    )
    return users.select(F.col("id").alias("user_id")).join(sums, "user_id", "left").select(
        "user_id", or_zero("n").alias("ai_heartbeats"), or_zero("s").alias("ai_coding_seconds")
    )
