"""Projects, languages, users and tags as lists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock
from worktempo.functions.columns import is_ai, joined, or_zero, seconds
from worktempo.operators.gaps import active_days, active_us, span_slots
from worktempo.operators.nested import nested
from worktempo.operators.stats import distinct_values, key_stats
from worktempo.plans.base import IDLE, TZ, clock_text, since_day, window_rows


def _size(name: str):
    return F.size(f"{name}_values").cast("bigint")


def projects(
    hb: DataFrame, *, as_of: datetime, days: int = 30, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Team time per project: concurrent work of several users counts once."""
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes).where(F.col("project") != "")
    stats = key_stats(
        rows, ["project"], lists=["user_id", "language"],
        idle_minutes=idle_minutes, tz_hours=tz_hours,
    )
    return stats.orderBy(F.desc("coding_seconds"), "project").select(
        F.col("project").alias("name"),
        "heartbeats",
        _size("user_id").alias("user_count"),
        joined("user_id_values").alias("users"),
        joined("language_values").alias("languages"),
        clock_text("first_t", clock, "dd/MM/yyyy").alias("first_activity"),
        clock_text("last_t", clock, "dd/MM/yyyy HH:mm").alias("last_activity"),
        "active_days",
        "ai_heartbeats",
        "coding_seconds",
    )


def languages(
    hb: DataFrame, *, as_of: datetime, days: int = 30, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Team time per language."""
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes).where(F.col("language") != "")
    stats = key_stats(
        rows, ["language"], lists=["user_id", "project"],
        idle_minutes=idle_minutes, tz_hours=tz_hours,
    )
    return stats.orderBy(F.desc("coding_seconds"), "language").select(
        F.col("language").alias("name"),
        "heartbeats",
        _size("user_id").alias("user_count"),
        joined("user_id_values").alias("users"),
        joined("project_values").alias("projects"),
        "active_days",
        "coding_seconds",
    )


def _named(hb: DataFrame, key: str, as_of: datetime, days: int, idle_minutes: int, tz_hours: int) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    return window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes).where(F.col(key) != "")


def team_figures(
    hb: DataFrame, key: str, *, as_of: datetime, days: int = 30, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Flat form of ``projects`` and ``languages``: figures per key with the number of users, no lists in cells."""
    clock = Clock.at(as_of, tz_hours)
    stats = key_stats(
        _named(hb, key, as_of, days, idle_minutes, tz_hours), [key], distinct=["user_id"],
        idle_minutes=idle_minutes, tz_hours=tz_hours,
    )
    return stats.select(
        F.col(key).alias("name"), "heartbeats", F.col("user_id_count").alias("user_count"),
        clock_text("first_t", clock, "dd/MM/yyyy").alias("first_activity"),
        clock_text("last_t", clock, "dd/MM/yyyy HH:mm").alias("last_activity"),
        "active_days", "ai_heartbeats", "coding_seconds",
    )


def team_members(
    hb: DataFrame, key: str, other: str, *, as_of: datetime, days: int = 30, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Flat form of a list cell: one row per key and non-empty value of another column, with its heartbeats."""
    rows = _named(hb, key, as_of, days, idle_minutes, tz_hours).where(F.col(other) != "")
    return rows.groupBy(F.col(key).alias("name"), F.col(other)).agg(F.count("*").alias("heartbeats"))


def _languages_by_user(hb: DataFrame, as_of: datetime, days: int, idle_minutes: int, tz_hours: int) -> DataFrame:
    rows = _named(hb, "language", as_of, days, idle_minutes, tz_hours)
    slots = span_slots(rows, ["user_id", "language"], F.count("*").alias("heartbeats"))
    return slots.groupBy("user_id", "language").agg(
        F.sum("heartbeats").alias("heartbeats"),
        seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("coding_seconds"),
    )


def languages_by_user(
    hb: DataFrame, *, as_of: datetime, days: int = 30, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Each user's languages, unlike ``languages`` with gaps inside the user."""
    sums = _languages_by_user(hb, as_of, days, idle_minutes, tz_hours)
    return sums.orderBy("user_id", F.desc("coding_seconds"), "language").select(
        "user_id", "language", "heartbeats", "coding_seconds"
    )


def languages_by_user_nested(
    hb: DataFrame, *, as_of: datetime, days: int = 30, most: int = 20, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """One row per user with an array of the languages with most time, and how many more there are."""
    flat = _languages_by_user(hb, as_of, days, idle_minutes, tz_hours).withColumnRenamed("language", "name")
    return nested(flat, ["user_id"], ["name", "heartbeats", "coding_seconds"], most, "languages", F.desc("coding_seconds"), F.col("name"))


def users_overview(
    hb: DataFrame, users: DataFrame, *, as_of: datetime, ai_days: int = 30, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Every user with all-time totals and today, week and AI counts out of one aggregation.

    active_days counts UTC dates here, unlike all other plans.
    """
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, None, idle_minutes=idle_minutes)
    counts = [F.count("*").alias("n"), F.count_if(is_ai()).alias("n_ai")]

    def since(column: str, moment: datetime):
        return or_zero(F.sum(F.when(since_day(moment, clock), F.col(column))))

    times = span_slots(rows, ["user_id"], *counts).groupBy("user_id").agg(
        F.sum("n").alias("total_heartbeats"),
        active_days(0).alias("active_days"),
        F.min("first_t").alias("first_t"),
        F.max("last_t").alias("last_t"),
        since("n", clock.today).alias("today_heartbeats"),
        since("n", clock.week).alias("week_heartbeats"),
        since("n_ai", clock.days_back(ai_days)).alias("ai_heartbeats_30d"),
        seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("total_coding_seconds"),
    )
    values = distinct_values(rows, ["user_id"], distinct=["project", "language"])
    values = values.withColumnsRenamed({"project_count": "total_projects", "language_count": "total_languages"})
    everyone = users.select(F.col("id").alias("user_id"), "email", "created_at")
    out = everyone.join(times.join(values, "user_id"), "user_id", "left").withColumn(
        "total_coding_seconds", or_zero("total_coding_seconds")
    )
    return out.orderBy(F.desc("total_coding_seconds"), "user_id").select(
        "user_id", "email",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        *[or_zero(c).alias(c) for c in ("total_heartbeats", "total_projects", "total_languages", "active_days")],
        "total_coding_seconds",
        clock_text("first_t", clock, "dd/MM/yyyy").alias("first_seen"),
        clock_text("last_t", clock, "dd/MM/yyyy HH:mm").alias("last_seen"),
        *[or_zero(c).alias(c) for c in ("today_heartbeats", "week_heartbeats", "ai_heartbeats_30d")],
    )


def tags_grouped(tags: DataFrame) -> DataFrame:
    """Tags with their patterns as 'id:pattern' text, in pattern order; colour and icon of the first pattern."""
    place = F.struct("domain_pattern", "id")
    item = F.struct("domain_pattern", F.col("id").alias("id"))
    grouped = tags.groupBy("tag_name").agg(
        F.min_by("tag_color", place).alias("tag_color"),
        F.min_by("tag_icon", place).alias("tag_icon"),
        F.count("*").alias("pattern_count"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )
    text = F.transform("items", lambda i: F.concat_ws(":", i["id"].cast("string"), i["domain_pattern"]))
    return grouped.orderBy("tag_name").select(
        "tag_name", "tag_color", "tag_icon", "pattern_count", F.array_join(text, " ").alias("patterns")
    )


def tag_patterns(tags: DataFrame) -> DataFrame:
    """Flat form of ``tags_grouped``: one row per pattern."""
    return tags.select("tag_name", "id", "domain_pattern", "tag_color", "tag_icon")


def tags_nested(tags: DataFrame, *, most: int = 100) -> DataFrame:
    """One row per tag with an array of its first patterns, and how many more there are."""
    flat = tags.select("tag_name", "id", F.col("domain_pattern").alias("pattern"), F.col("tag_color").alias("color"))
    return nested(flat, ["tag_name"], ["id", "pattern", "color"], most, "patterns", F.col("pattern"), F.col("id"))
