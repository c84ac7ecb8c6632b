"""Daily, custom-range and weekly reports."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock, as_date, monday
from worktempo.functions.columns import day_text, floored, joined, or_zero, ratio_pct, round_even, seconds, site_rows, zero
from worktempo.operators.gaps import active_us, span_slots
from worktempo.operators.ledger import adjusted_by, adjustments_between
from worktempo.operators.stats import activity, key_stats
from worktempo.operators.tags import rules_by_id, tag_labels, with_tag
from worktempo.plans.base import (
    IDLE, TZ, adjusted, clock_text, productivity_pct, text_or_dash, window_rows, with_adjustments,
)


def _user_totals(
    hb: DataFrame, adjustments: DataFrame, clock: Clock, start: date, end: date, idle_minutes: int
) -> DataFrame:
    """The figures of ``_user_report`` that a team's sums need: one scan, no lists."""
    rows = window_rows(hb, clock, clock.day_start(start), clock.day_start(end + timedelta(days=1)), idle_minutes)
    stats = activity(rows, ["user_id"], ["ide", "browsing", "ai"], idle_minutes=idle_minutes, tz_hours=clock.tz_hours)
    merged = with_adjustments(stats, adjusted_by(adjustments_between(adjustments, start, end), "user_id"), ["user_id"])
    return merged.select(
        adjusted("ide_coding_seconds").alias("ide_coding_seconds"),
        or_zero("browsing_seconds").alias("browsing_seconds"),
        or_zero("ai_coding_seconds").alias("ai_coding_seconds"),
    ).withColumn("productivity", productivity_pct(F.col("ide_coding_seconds"), F.col("browsing_seconds")))


def _user_report(
    hb: DataFrame, adjustments: DataFrame, clock: Clock, start: date, end: date, idle_minutes: int,
    slot_seconds: int | None = None,
) -> DataFrame:
    """Per user of the local days [start, end]: raw figures merged with the adjustments of those days."""
    rows = window_rows(
        hb, clock, clock.day_start(start), clock.day_start(end + timedelta(days=1)), idle_minutes, slot_seconds
    )
    stats = key_stats(
        rows, ["user_id"], lists=["project", "language", "editor"],
        flags=["ide", "browsing", "ai"], idle_minutes=idle_minutes, tz_hours=clock.tz_hours,
    )
    stats = stats.select(
        "*",
        joined("project_values").alias("projects"),
        joined("language_values").alias("languages"),
        joined("editor_values").alias("editors"),
        F.size(F.filter("project_values", lambda v: v != "")).cast("bigint").alias("project_count"),
        clock_text("first_t", clock).alias("first_active"),
        clock_text("last_t", clock).alias("last_active"),
    )
    adj = adjusted_by(adjustments_between(adjustments, start, end), "user_id")
    merged = with_adjustments(stats, adj, ["user_id"])
    return merged.select(
        "user_id",
        or_zero("heartbeats").alias("heartbeats"),
        *[text_or_dash(c) for c in ("projects", "languages", "editors", "first_active", "last_active")],
        or_zero("active_days").alias("active_days"),
        adjusted("coding_seconds").alias("coding_seconds"),
        adjusted("ide_coding_seconds").alias("ide_coding_seconds"),
        or_zero("browsing_seconds").alias("browsing_seconds"),
        F.col("adj").alias("adjustment_seconds"),
        or_zero("ai_coding_seconds").alias("ai_coding_seconds"),
        or_zero("file_heartbeats").alias("file_heartbeats"),
        or_zero("domain_heartbeats").alias("domain_heartbeats"),
        or_zero("project_count").alias("project_count"),
    ).withColumn("productivity", productivity_pct(F.col("ide_coding_seconds"), F.col("browsing_seconds")))


def _by_ide(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("ide_coding_seconds"), "user_id")


def daily_report_users(
    hb: DataFrame, adjustments: DataFrame, *, as_of: datetime, day: date | str | None = None,
    idle_minutes: int = IDLE, tz_hours: int = TZ,
) -> DataFrame:
    """One local day per user, also users with only an adjustment."""
    clock = Clock.at(as_of, tz_hours)
    which = clock.local_date if day is None else as_date(day)
    users = _user_report(hb, adjustments, clock, which, which, idle_minutes)
    ide, ai = F.col("ide_coding_seconds"), F.col("ai_coding_seconds")
    ai_pct = F.when(ide > 0, ratio_pct(ai, ide)).otherwise(zero())
    return _by_ide(users).select(
        "user_id", "heartbeats", "projects", "languages", "editors", "first_active", "last_active", "coding_seconds",
        "ide_coding_seconds", "browsing_seconds", "adjustment_seconds", "ai_coding_seconds", ai_pct.alias("ai_pct"),
        "productivity", "file_heartbeats", "domain_heartbeats",
    )


def _day_sites(hb: DataFrame, tags: DataFrame, as_of, day, idle_minutes: int, tz_hours: int) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    start = clock.local_date if day is None else as_date(day)
    rows = window_rows(hb, clock, clock.day_start(start), clock.day_start(start + timedelta(days=1)), idle_minutes)
    rows = rows.where(site_rows())
    slots = span_slots(rows, ["user_id", "entity"], F.count("*").alias("n"))
    sums = slots.groupBy("user_id", "entity").agg(
        F.sum("n").alias("heartbeats"), seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("seconds")
    )
    tagged = with_tag(sums, rows, rules_by_id(tags), ["user_id"])
    return tagged.select("user_id", tag_labels()[0], "entity", "heartbeats", "seconds")


def daily_report_site_tags(
    hb: DataFrame, tags: DataFrame, *, as_of: datetime, day: date | str | None = None,
    idle_minutes: int = IDLE, tz_hours: int = TZ,
) -> DataFrame:
    """User, tag and site of one local day; the tag is the first match in insertion order."""
    return _day_sites(hb, tags, as_of, day, idle_minutes, tz_hours)


def daily_report_tag_totals(
    hb: DataFrame, tags: DataFrame, *, as_of: datetime, day: date | str | None = None,
    idle_minutes: int = IDLE, tz_hours: int = TZ,
) -> DataFrame:
    """The same rolled up to user and tag."""
    sites = _day_sites(hb, tags, as_of, day, idle_minutes, tz_hours)
    return sites.groupBy("user_id", "tag_name").agg(
        F.sum("seconds").alias("seconds"), F.sum("heartbeats").alias("heartbeats"), F.count("*").alias("sites")
    )


def _team(users: DataFrame) -> DataFrame:
    sums = users.agg(
        F.count("*").alias("total_users"),
        or_zero(F.sum("ide_coding_seconds")).alias("total_coding_seconds"),
        or_zero(F.sum("browsing_seconds")).alias("total_browsing_seconds"),
        or_zero(F.sum("ai_coding_seconds")).alias("total_ai_seconds"),
        or_zero(F.sum("productivity")).alias("productivity_sum"),
    )
    coding, browsing = F.col("total_coding_seconds"), F.col("total_browsing_seconds")
    return sums.withColumn("team_productivity", ratio_pct(coding, coding + browsing))


def daily_report_team(
    hb: DataFrame, adjustments: DataFrame, *, as_of: datetime, day: date | str | None = None,
    idle_minutes: int = IDLE, tz_hours: int = TZ,
) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    which = clock.local_date if day is None else as_date(day)
    team = _team(_user_totals(hb, adjustments, clock, which, which, idle_minutes))
    average = F.col("productivity_sum") / F.greatest("total_users", F.lit(1))
    return team.select(
        "total_users", "total_coding_seconds", "total_browsing_seconds", "total_ai_seconds",
        round_even(average).alias("avg_productivity"), "team_productivity",
    )


def range_report_users(
    hb: DataFrame, adjustments: DataFrame, *, as_of: datetime, start: date | str, end: date | str,
    idle_minutes: int = IDLE, tz_hours: int = TZ, slot_seconds: int | None = None,
) -> DataFrame:
    """Users of the local days [start, end]. first_active is the clock time of the earliest instant."""
    clock = Clock.at(as_of, tz_hours)
    lo, hi = _span(start, end)
    users = _user_report(hb, adjustments, clock, lo, hi, idle_minutes, slot_seconds)
    return _by_ide(users).select(
        "user_id", "heartbeats", "projects", "languages", "editors", "active_days", "first_active", "last_active",
        "coding_seconds", "ide_coding_seconds", "browsing_seconds", "adjustment_seconds", "ai_coding_seconds",
        "productivity", "project_count",
    )


def _span(start: date | str, end: date | str) -> tuple[date, date]:
    lo, hi = as_date(start), as_date(end)
    if hi < lo:
        raise ValueError("end lies before start")
    return lo, hi


def range_report_days(
    hb: DataFrame, adjustments: DataFrame, *, as_of: datetime, start: date | str, end: date | str,
    idle_minutes: int = IDLE, tz_hours: int = TZ,
) -> DataFrame:
    """Team time per local day (concurrent work counts once) plus the day's adjustments."""
    clock = Clock.at(as_of, tz_hours)
    lo, hi = _span(start, end)
    rows = window_rows(hb, clock, clock.day_start(lo), clock.day_start(hi + timedelta(days=1)), idle_minutes)
    times = span_slots(rows, [], by_day=True).groupBy("local_day").agg(
        seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("coding_seconds")
    )
    counts = rows.groupBy("local_day").agg(
        F.count("*").alias("heartbeats"), F.count_distinct("user_id").alias("active_users")
    )
    adj = adjustments_between(adjustments, lo, hi).withColumn("local_day", F.unix_date("adjustment_date"))
    days = counts.join(times, "local_day").join(adjusted_by(adj, "local_day"), "local_day", "full")
    return days.orderBy("local_day").select(
        day_text("local_day").alias("day"),
        or_zero("heartbeats").alias("heartbeats"),
        or_zero("active_users").alias("active_users"),
        floored(or_zero("coding_seconds") + or_zero("adj")).alias("coding_seconds"),
    )


def range_report_team(
    hb: DataFrame, adjustments: DataFrame, *, as_of: datetime, start: date | str, end: date | str,
    idle_minutes: int = IDLE, tz_hours: int = TZ,
) -> DataFrame:
    lo, hi = _span(start, end)
    team = _team(_user_totals(hb, adjustments, Clock.at(as_of, tz_hours), lo, hi, idle_minutes))
    return team.select(
        "total_users", "total_coding_seconds", "total_browsing_seconds", "total_ai_seconds", "team_productivity",
        F.lit((hi - lo).days + 1).alias("days"),
    )


def week_of(as_of: datetime, week_start: date | str | None = None, tz_hours: int = TZ) -> dict[str, date]:
    """start and end of the week (Monday to Sunday) that holds a date, today's by default."""
    day = Clock.at(as_of, tz_hours).local_date if week_start is None else as_date(week_start)
    first = monday(day)
    return {"start": first, "end": first + timedelta(days=6)}


def weekly_report_users(hb, adjustments, *, as_of, week_start=None, tz_hours: int = TZ, **options) -> DataFrame:
    return range_report_users(
        hb, adjustments, as_of=as_of, tz_hours=tz_hours, **week_of(as_of, week_start, tz_hours), **options
    )


def weekly_report_days(hb, adjustments, *, as_of, week_start=None, tz_hours: int = TZ, **options) -> DataFrame:
    return range_report_days(
        hb, adjustments, as_of=as_of, tz_hours=tz_hours, **week_of(as_of, week_start, tz_hours), **options
    )


def weekly_report_team(hb, adjustments, *, as_of, week_start=None, tz_hours: int = TZ, **options) -> DataFrame:
    return range_report_team(
        hb, adjustments, as_of=as_of, tz_hours=tz_hours, **week_of(as_of, week_start, tz_hours), **options
    )


def report_dates(hb: DataFrame, *, as_of: datetime, days: int = 90, tz_hours: int = TZ) -> DataFrame:
    """Local days with heartbeats in the last ``days`` times 24 hours."""
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.as_of - timedelta(days=days))
    counts = rows.groupBy("local_day").agg(F.count("*").alias("heartbeats"), F.count_distinct("user_id").alias("users"))
    return counts.orderBy(F.desc("local_day")).select(day_text("local_day").alias("day"), "heartbeats", "users")
