"""Dashboard summary: per-user and team figures for today, this week and the weeks before."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock, day_number
from worktempo.functions.columns import (
    dashed, day_text, floored, joined, or_zero, ratio_pct, round_even, seconds, zero,
)
from worktempo.operators.gaps import active_days, active_us, flagged_slots, span_slots
from worktempo.operators.ledger import adjusted_by, adjusted_by_user_day, adjustments_between
from worktempo.operators.nested import nested
from worktempo.operators.stats import activity, distinct_list, gap_flags, key_stats
from worktempo.plans.base import (
    IDLE, TZ, adjusted, clock_text, since_day, text_or_dash, window_rows, with_adjustments,
)


def _lists(*names: str) -> list[Column]:
    return [joined(f"{n}_values").alias(f"{n}s") for n in names]


def today_by_user(
    hb: DataFrame, *, as_of: datetime, idle_minutes: int = IDLE, tz_hours: int = TZ, slot_seconds: int | None = None
) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    stats = key_stats(
        window_rows(hb, clock, clock.today, idle_minutes=idle_minutes, slot_seconds=slot_seconds), ["user_id"],
        lists=["project", "language", "editor"], flags=["ide", "ai"], idle_minutes=idle_minutes, tz_hours=tz_hours,
    )
    return stats.orderBy(F.desc("coding_seconds"), "user_id").select(
        "user_id", "heartbeats",
        F.size("project_values").cast("bigint").alias("project_count"),
        *_lists("project", "language", "editor"),
        clock_text("first_t", clock).alias("first_active"),
        clock_text("last_t", clock).alias("last_active"),
        "coding_seconds", "ide_coding_seconds", "ai_heartbeats", "ai_coding_seconds",
    )


def week_by_user(
    hb: DataFrame, *, as_of: datetime, idle_minutes: int = IDLE, tz_hours: int = TZ, slot_seconds: int | None = None
) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    stats = key_stats(
        window_rows(hb, clock, clock.week, idle_minutes=idle_minutes, slot_seconds=slot_seconds), ["user_id"],
        lists=["project", "language"], flags=["ide", "ai"],
        idle_minutes=idle_minutes, tz_hours=tz_hours,
    )
    return stats.orderBy(F.desc("coding_seconds"), "user_id").select(
        "user_id", "heartbeats",
        F.size("project_values").cast("bigint").alias("project_count"),
        *_lists("project", "language"),
        "active_days", "coding_seconds", "ide_coding_seconds", "ai_heartbeats", "ai_coding_seconds",
    )


def _team_slots(hb: DataFrame, clock: Clock, start, end, idle_minutes: int) -> DataFrame:
    rows = window_rows(hb, clock, start, end, idle_minutes)
    slots = span_slots(rows, ["user_id"], F.count("*").alias("heartbeats"))
    return slots.groupBy("user_id").agg(
        F.sum("heartbeats").alias("heartbeats"), F.sum(active_us(idle_minutes=idle_minutes)).alias("us")
    )


def prev_week_totals(hb: DataFrame, *, as_of: datetime, idle_minutes: int = IDLE, tz_hours: int = TZ) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    users = _team_slots(hb, clock, clock.prev_week, clock.week, idle_minutes)
    return users.agg(
        F.count("user_id").alias("active_users"),
        or_zero(F.sum("heartbeats")).alias("heartbeats"),
        seconds(F.sum("us")).alias("coding_seconds"),
    )


def today_totals(hb: DataFrame, *, as_of: datetime, tz_hours: int = TZ) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    users = window_rows(hb, clock, clock.today).groupBy("user_id").agg(F.count("*").alias("n"))
    return users.agg(F.count("user_id").alias("active_users"), or_zero(F.sum("n")).alias("heartbeats"))


def daily_breakdown(
    hb: DataFrame, adjustments: DataFrame, *, as_of: datetime, days: int = 7, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """User and local day, also days with nothing but an adjustment."""
    clock = Clock.at(as_of, tz_hours)
    stats = key_stats(
        window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes), ["user_id"],
        lists=["project", "language"], flags=["ai"], by_day=True, idle_minutes=idle_minutes, tz_hours=tz_hours,
    )
    adj = adjusted_by_user_day(
        adjustments_between(adjustments, clock.local_date - timedelta(days=days), clock.local_date)
    )
    rows = with_adjustments(stats, adj, ["user_id", "local_day"])
    return _daily_rows(rows, clock, ["project", "language"]).orderBy(
        F.desc("day"), F.desc("coding_seconds"), "user_id"
    )


def daily_breakdown_nested(
    hb: DataFrame, adjustments: DataFrame, *, as_of: datetime, days: int = 7, most: int = 50, idle_minutes: int = IDLE,
    tz_hours: int = TZ,
) -> DataFrame:
    """One row per local day with an array of its rows of ``daily_breakdown``, most time first, and how many more there are."""
    flat = daily_breakdown(hb, adjustments, as_of=as_of, days=days, idle_minutes=idle_minutes, tz_hours=tz_hours)
    items = ["user_id", "coding_seconds", "heartbeats", "adjustment_seconds"]
    return nested(flat, ["day"], items, most, "users", F.desc("coding_seconds"), F.col("user_id"))


def _daily_rows(rows: DataFrame, clock: Clock, lists: list[str]) -> DataFrame:
    rows = rows.select(
        "*",
        *_lists(*lists),
        clock_text("first_t", clock).alias("first_active"),
        clock_text("last_t", clock).alias("last_active"),
    )
    return rows.select(
        day_text("local_day").alias("day"),
        "user_id",
        or_zero("heartbeats").alias("heartbeats"),
        *[text_or_dash(f"{n}s") for n in lists],
        text_or_dash("first_active"),
        text_or_dash("last_active"),
        adjusted("coding_seconds").alias("coding_seconds"),
        F.col("adj").alias("adjustment_seconds"),
        or_zero("ai_heartbeats").alias("ai_heartbeats"),
        or_zero("ai_coding_seconds").alias("ai_coding_seconds"),
    )


def history_baseline(
    hb: DataFrame, *, as_of: datetime, weeks: int = 4, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Each user's averages over the weeks before this one."""
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.week - timedelta(days=7 * weeks), clock.week, idle_minutes)
    users = activity(rows, ["user_id"], idle_minutes=idle_minutes, tz_hours=tz_hours)
    return users.select(
        "user_id",
        F.col("coding_seconds").alias("total_seconds"),
        "active_days",
        (F.col("coding_seconds") / F.greatest("active_days", F.lit(1))).alias("avg_daily"),
        (F.col("coding_seconds") / F.lit(float(weeks))).alias("avg_weekly"),
    )


def _when_today(column: str, clock: Clock) -> str:
    return f"CASE WHEN local_day >= {day_number(clock.local_date)} THEN {column} END"


def _this_week(hb: DataFrame, clock: Clock, idle_minutes: int) -> DataFrame:
    """Per user: today and this week out of one scan per branch. Today's figures are conditional sums that leave
    out the gap into today."""
    rows = window_rows(hb, clock, clock.week, idle_minutes=idle_minutes)
    values = rows.groupBy("user_id").agg(
        *[distinct_list(_when_today(c, clock)).alias(f"{c}_today") for c in ("project", "language", "editor")],
        *[distinct_list(c).alias(f"{c}_week") for c in ("project", "language")],
    )
    counts = [F.count("*").alias("heartbeats"), F.count_if("f_ai").alias("ai_heartbeats")]
    slots = flagged_slots(rows, ["user_id"], gap_flags(["ide", "ai"]), *counts)

    def today(column: str) -> Column:
        return F.expr(_when_today(column, clock))

    times = slots.groupBy("user_id").agg(
        F.sum("heartbeats").alias("hb_week"),
        F.sum("ai_heartbeats").alias("ai_hb_week"),
        or_zero(F.sum(today("heartbeats"))).alias("hb_today"),
        or_zero(F.sum(today("ai_heartbeats"))).alias("ai_hb_today"),
        F.min(today("first_t")).alias("first_t"),
        F.max(today("last_t")).alias("last_t"),
        *_week_times(clock, idle_minutes),
        active_days(clock.tz_hours).alias("active_days_week"),
    )
    return times.join(values, "user_id")


def _week_times(clock: Clock, idle_minutes: int) -> list[Column]:
    """Seconds of today and this week from the week's flagged slots."""
    opts = {"idle_minutes": idle_minutes, "tz_hours": clock.tz_hours}
    today = since_day(clock.today, clock)
    return [
        column
        for name, flag in (("coding", None), ("ide", "ide"), ("ai", "ai"))
        for column in (
            seconds(F.sum(F.when(today, active_us(flag, since=clock.today, **opts)))).alias(f"{name}_today"),
            seconds(F.sum(active_us(flag, **opts))).alias(f"{name}_week"),
        )
    ]


def _adj_sum(adjustments: DataFrame, start: date, end: date) -> DataFrame:
    return adjusted_by(adjustments_between(adjustments, start, end), "user_id")


def user_scorecard(
    hb: DataFrame, users: DataFrame, adjustments: DataFrame, *, as_of: datetime, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Every user with today's and this week's figures, against the user's own four-week history."""
    clock = Clock.at(as_of, tz_hours)
    adj_today = _adj_sum(adjustments, clock.local_date, clock.local_date)
    adj_week = _adj_sum(adjustments, clock.week_date, clock.local_date)
    rows = (
        users.select(F.col("id").alias("user_id"), "email")
        .join(_this_week(hb, clock, idle_minutes), "user_id", "left")
        .join(history_baseline(hb, as_of=clock.as_of, idle_minutes=idle_minutes, tz_hours=tz_hours), "user_id", "left")
        .join(adj_today.withColumnRenamed("adj", "adj_today"), "user_id", "left")
        .join(adj_week.withColumnRenamed("adj", "adj_week"), "user_id", "left")
    )
    had_today, had_week = or_zero("hb_today") > 0, or_zero("hb_week") > 0
    rows = rows.select(
        "*",
        floored(or_zero("coding_today") + or_zero("adj_today")).alias("today_coding_seconds"),
        floored(or_zero("coding_week") + or_zero("adj_week")).alias("week_coding_seconds"),
        F.coalesce("avg_daily", F.lit(0.0)).alias("usual_daily"),
        F.coalesce("avg_weekly", F.lit(0.0)).alias("usual_weekly"),
    )

    def trend(now: str, usual: str, least: int) -> Column:
        change = (F.col(now) - F.col(usual)) / F.greatest(F.col(usual), F.lit(1.0)) * 100
        return F.when(F.col(usual) >= least, round_even(change))

    def size(name: str) -> Column:
        return F.coalesce(F.size(name).cast("bigint"), zero())

    return rows.orderBy(F.desc("today_coding_seconds"), "user_id").select(
        "user_id", "email",
        or_zero("hb_today").alias("today_heartbeats"),
        dashed(joined("project_today"), had_today).alias("today_projects"),
        dashed(joined("language_today"), had_today).alias("today_languages"),
        dashed(joined("editor_today"), had_today).alias("today_editors"),
        dashed(clock_text("first_t", clock), had_today).alias("today_first_active"),
        dashed(clock_text("last_t", clock), had_today).alias("today_last_active"),
        size("project_today").alias("today_project_count"),
        "today_coding_seconds",
        or_zero("adj_today").alias("today_adjustment_seconds"),
        or_zero("ai_hb_today").alias("today_ai_heartbeats"),
        or_zero("ai_today").alias("today_ai_coding_seconds"),
        ratio_pct(or_zero("ai_today"), or_zero("ide_today")).alias("today_ai_pct"),
        trend("today_coding_seconds", "usual_daily", 600).alias("today_trend_pct"),
        round_even(F.col("usual_daily")).alias("avg_daily_4w"),
        or_zero("hb_week").alias("week_heartbeats"),
        dashed(joined("project_week"), had_week).alias("week_projects"),
        dashed(joined("language_week"), had_week).alias("week_languages"),
        or_zero("active_days_week").alias("week_active_days"),
        size("project_week").alias("week_project_count"),
        "week_coding_seconds",
        or_zero("adj_week").alias("week_adjustment_seconds"),
        or_zero("ai_hb_week").alias("week_ai_heartbeats"),
        or_zero("ai_week").alias("week_ai_coding_seconds"),
        ratio_pct(or_zero("ai_week"), or_zero("ide_week")).alias("week_ai_pct"),
        trend("week_coding_seconds", "usual_weekly", 3600).alias("week_trend_pct"),
        round_even(F.col("usual_weekly")).alias("avg_weekly_4w"),
    )


def team_kpis(
    hb: DataFrame, users: DataFrame, adjustments: DataFrame, *, as_of: datetime, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """One row of team totals. The adjustment is added to the sum and floored once; the previous week is taken
    without adjustments."""
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.week, idle_minutes=idle_minutes)
    slots = flagged_slots(rows, ["user_id"], gap_flags(["ide", "ai"]), F.count("*").alias("heartbeats"))
    today = since_day(clock.today, clock)
    per_user = slots.groupBy("user_id").agg(
        or_zero(F.sum(F.when(today, F.col("heartbeats")))).alias("hb_today"), *_week_times(clock, idle_minutes)
    )
    prev_week = prev_week_totals(hb, as_of=clock.as_of, idle_minutes=idle_minutes, tz_hours=tz_hours)

    def adj_total(first: date, last: date) -> Column:
        found = adjustments_between(adjustments, first, last)
        return found.agg(or_zero(F.sum(F.col("seconds").cast("bigint")))).scalar()

    team = per_user.agg(
        F.count_if(F.col("hb_today") > 0).alias("active_today"),
        *[or_zero(F.sum(c)).alias(c) for c in ("hb_today", "coding_today", "coding_week", "ide_today", "ai_today", "ai_week")],
    ).select(
        "*",
        prev_week.select("coding_seconds").scalar().alias("prev_week_coding"),
        users.agg(F.count("*")).scalar().alias("total_users"),
        floored(F.col("coding_today") + adj_total(clock.local_date, clock.local_date)).alias("total_coding_today"),
        floored(F.col("coding_week") + adj_total(clock.week_date, clock.local_date)).alias("total_coding_week"),
    )
    prev = F.col("prev_week_coding")
    delta = (F.col("total_coding_week") - prev) / F.greatest(prev, F.lit(1)) * 100
    return team.select(
        "total_users", "active_today",
        (F.col("total_users") - F.col("active_today")).alias("inactive_today"),
        F.col("hb_today").alias("heartbeats_today"),
        "total_coding_today", "total_coding_week",
        F.col("ai_today").alias("total_ai_today"),
        F.col("ai_week").alias("total_ai_week"),
        ratio_pct(F.col("ai_today"), F.col("ide_today")).alias("ai_pct_today"),
        "prev_week_coding",
        F.when(prev > 0, round_even(delta)).otherwise(zero()).alias("week_delta_pct"),
    )
