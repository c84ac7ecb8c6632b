"""The named queries over the derived tables.

Heartbeat queries read only the days their range needs: the range reaches the Parquet reader as a predicate on
``events.ts``. Alert thresholds are lowered to the density of the test tables; the defaults are the real ones.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock
from worktempo.functions.columns import site_rows
from worktempo.jobs import leaderboard, site_tags, tables, upkeep
from worktempo.operators import ledger, sketches
from worktempo.operators.stats import null_safe_join
from worktempo.operators.tags import rules_by_name
from worktempo.plans import (
    alerts, catalog, export, ledgers, period, platform, productivity, realtime, sites, summary, user_detail,
)
from worktempo.sources.derived import AS_OF, heartbeats, table
from worktempo.sources import bucketed, stored
from worktempo.streaming import live, replay

Query = Callable[[SparkSession, str], DataFrame]

CLOCK = Clock.at(AS_OF)
REPORT_DAY = "2024-01-25"
RANGE = {"start": "2024-01-10", "end": "2024-01-24"}
LEAVE_RANGE = {"start": "2024-01-20", "end": "2024-01-27"}
LEISURE_SECONDS = 300
MIN_PREV = 10
BURNOUT_SECONDS = 1800
WEEKEND_SECONDS = 900
RETENTION_DAYS_AS_OF = datetime(2025, 1, 20, 12)
INACTIVE_AS_OF = datetime(2024, 7, 20, 12)


def _hb(start: datetime | None = None, end: datetime | None = AS_OF):
    return lambda spark, d: heartbeats(spark, d, start=start, end=end)


def _back(days: int):
    return _hb(CLOCK.days_back(days))


def configure(spark: SparkSession) -> None:
    """Session settings that the registered queries need, set here only: heartbeat times are UTC, and streams keep their
    state in RocksDB (``live.configure``)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    live.configure(spark)


def _of(plan, *tables, **options) -> Query:
    """A query that loads the tables (names or loaders) and calls the plan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        loaded = [t(spark, sf_dir) if callable(t) else table(spark, sf_dir, t) for t in tables]
        return plan(*loaded, **options)

    return run


def _at(plan, *tables, **options) -> Query:
    return _of(plan, *tables, as_of=AS_OF, **options)


_DAY = _hb(CLOCK.day_start(datetime(2024, 1, 25)), CLOCK.day_start(datetime(2024, 1, 26)))
_RANGE = _hb(CLOCK.day_start(datetime(2024, 1, 10)), CLOCK.day_start(datetime(2024, 1, 25)))
_WEEK = _hb(CLOCK.week)
_HISTORY = _hb(CLOCK.week - timedelta(days=28))


def _outcome(check, requests: str, ledger_name: str, columns: list[str]) -> Query:
    """Accepted rows and rejected requests of a ledger ingest in one table, with status and error; one pass."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checked = check(
            table(spark, sf_dir, requests), table(spark, sf_dir, "users"), table(spark, sf_dir, ledger_name), as_of=AS_OF
        )
        good = F.col("error").isNull()
        return checked.select(
            F.when(good, "accepted").otherwise("rejected").alias("status"),
            F.when(good, F.col("row.id")).otherwise(F.col("request_id")).cast("bigint").alias("ref"),
            F.when(good, F.col("row.user_id")).otherwise(F.col("user_id")).alias("user_id"),
            *[F.col(f"row.{c}").cast("string").alias(c) for c in columns], "error",
        )

    return run


def _delete(ledger_name: str) -> Query:
    """The ledger without the rows that approved requests name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left = ledger.delete_approved(table(spark, sf_dir, ledger_name), table(spark, sf_dir, "delete_requests"))
        return left.select(*DELETE_COLUMNS[ledger_name])

    return run


DELETE_COLUMNS = {
    "adjustments": ["id", "user_id", "seconds"],
    "leaves": ["id", "user_id", "leave_type"],
    "tags": ["id", "tag_name", "domain_pattern"],
}


def _tags_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, rejected = ledger.apply_tag_requests(
        table(spark, sf_dir, "tag_requests"), table(spark, sf_dir, "tags"), as_of=AS_OF
    )
    kept = new.select(
        F.lit("kept").alias("status"), F.col("id").alias("ref"), "tag_name", "tag_color", "tag_icon", "domain_pattern"
    )
    gone = rejected.select(
        F.lit("rejected").alias("status"), F.col("request_id").alias("ref"),
        *[F.lit(None).cast("string").alias(c) for c in ("tag_name", "tag_color", "tag_icon", "domain_pattern")],
    )
    return kept.unionByName(gone)


def _report_rows(report, layout: str, hb, days: int = 7, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        users = report(hb(spark, sf_dir), table(spark, sf_dir, "adjustments"), as_of=AS_OF, **options)
        return export.report_rows(users, layout, days)

    return run


def _report_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    team = period.range_report_team(_RANGE(spark, sf_dir), table(spark, sf_dir, "adjustments"), as_of=AS_OF, **RANGE)
    return export.report_boxes(team)


def _leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leaderboard.leaderboard_7d(
        _hb(AS_OF - timedelta(days=7))(spark, sf_dir), table(spark, sf_dir, "users"), as_of=AS_OF
    )
    return rows.select("user_id", "interval", "total")


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = upkeep.retention_kept(_hb(end=None)(spark, sf_dir), as_of=RETENTION_DAYS_AS_OF)
    return kept.select("id", "user_id", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"))


def _stored(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A derived table stored in a database of its own."""
    full = f"{stored.new_database(spark, live.shared_folder(spark))}.{name}"
    stored.create(table(spark, sf_dir, name), full)
    return full


def _stored_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after the job has appended the accepted requests and the approved deletions are done."""
    name = _stored(spark, sf_dir, "adjustments")
    tables.append_adjustments(
        spark, name, table(spark, sf_dir, "adjustment_requests"), table(spark, sf_dir, "users"), as_of=AS_OF)
    doomed = table(spark, sf_dir, "delete_requests").where(F.col("decision") == "approved")
    tables.delete_rows(spark, name, doomed)
    return stored.current(spark, name).select(
        "id", "user_id", F.col("seconds").cast("bigint").alias("seconds"),
        F.date_format("adjustment_date", "yyyy-MM-dd").alias("adjustment_date"), "reason",
    )


def _stored_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _stored(spark, sf_dir, "leaves")
    tables.append_leaves(spark, name, table(spark, sf_dir, "leave_requests"), table(spark, sf_dir, "users"), as_of=AS_OF)
    return stored.current(spark, name).select(
        "id", "user_id", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
        F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "leave_type", "reason",
    )


def _stored_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _stored(spark, sf_dir, "tags")
    tables.change_tags(spark, name, table(spark, sf_dir, "tag_requests"), as_of=AS_OF)
    return stored.current(spark, name).select("id", "tag_name", "tag_color", "tag_icon", "domain_pattern")


def _stored_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _stored(spark, sf_dir, "users")
    tables.open_sharing(spark, name)
    return stored.current(spark, name).drop("created_at")


def _by_day(spark: SparkSession, sf_dir: str) -> str:
    """All heartbeats stored by local day."""
    name = f"{stored.new_database(spark, live.shared_folder(spark))}.heartbeats"
    stored.store_heartbeats(_hb(end=None)(spark, sf_dir), name)
    return name


def _stored_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats stored by local day and purged by the retention job."""
    name = _by_day(spark, sf_dir)
    tables.purge_heartbeats(spark, name, as_of=RETENTION_DAYS_AS_OF)
    return spark.table(name).select("id", "user_id", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"))


def _from_days(plan, first: str, last: str, *more: str, **options) -> Query:
    """A report over the stored heartbeats: only the days of its range are listed and read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hb = stored.heartbeats_by_day(spark, _by_day(spark, sf_dir), date.fromisoformat(first), date.fromisoformat(last))
        return plan(hb.drop("local_day"), *[table(spark, sf_dir, t) for t in more], as_of=AS_OF, **options)

    return run


def _stored_leave_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity on days of leave, over the stored heartbeats; the leaves tell which days are read."""
    return ledgers.leave_activity(spark.table(_by_day(spark, sf_dir)), table(spark, sf_dir, "leaves"), **LEAVE_RANGE)


def _bucketed_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributed time per user over heartbeats stored in buckets of (user, slot)."""
    name = f"{stored.new_database(spark, live.shared_folder(spark))}.slotted"
    bucketed.store(_hb(end=None)(spark, sf_dir), name)
    return bucketed.attributed(spark.table(name))


def _as_json(plan: Query, name: str) -> Query:
    """A nested result with its array as JSON text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(spark, sf_dir).withColumn(name, F.to_json(name, {"ignoreNullFields": "false"}))

    return run


def _entity_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct entities per user, and whether the estimate from stored daily sketches is within four standard errors."""
    hb = _hb(end=None)(spark, sf_dir)
    name = f"{stored.new_database(spark, live.shared_folder(spark))}.sketches"
    daily = sketches.daily_sketches(hb, ["entity"])
    daily.write.format("parquet").partitionBy("local_day").saveAsTable(name)
    estimated = sketches.estimates(spark.table(name), ["entity"])
    exact = hb.groupBy("user_id").agg(F.count_distinct("entity").alias("entities"))
    off = F.abs(F.col("entity_estimate") - F.col("entities"))
    both = null_safe_join(exact, estimated, ["user_id"])
    return both.select("user_id", "entities", (off <= 4 * sketches.standard_error() * F.col("entities")).alias("close"))


def _kept_user_tag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag times from a dictionary that was made from other sites and patterns and then brought up to date."""
    hb, tags = _back(7)(spark, sf_dir), table(spark, sf_dir, "tags")
    database = stored.new_database(spark, live.shared_folder(spark))
    site_tags.create(spark, database)
    visited = hb.where(site_rows())
    before = tags.withColumn("domain_pattern", F.when(F.col("id") % 7 == 0, F.concat("domain_pattern", F.lit("/old")))
                             .otherwise(F.col("domain_pattern")))
    site_tags.update(spark, database, visited.where(F.pmod(F.xxhash64("entity"), F.lit(3)) > 0), before)
    site_tags.update(spark, database, visited, tags)
    return sites.kept_user_tag_stats(hb, site_tags.first_tags(spark, database, rules_by_name(tags)), as_of=AS_OF)


def _stored_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{live.shared_folder(spark)}/leaderboard"
    rows = leaderboard.leaderboard_7d(
        _hb(AS_OF - timedelta(days=7))(spark, sf_dir), table(spark, sf_dir, "users"), as_of=AS_OF
    )
    leaderboard.refresh_leaderboard(rows, path)
    return spark.read.schema("user_id string, total bigint, interval string").parquet(path).select("user_id", "interval", "total")


def _share_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.share_flags_update(table(spark, sf_dir, "users")).drop("created_at")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "realtime_active": _at(realtime.realtime_active, _back(0)),
        "today_by_user": _at(summary.today_by_user, _back(0)),
        "week_by_user": _at(summary.week_by_user, _WEEK),
        "week_by_user_dense": _at(summary.week_by_user, _WEEK, slot_seconds=60),
        "range_report_users_dense": _at(period.range_report_users, _RANGE, "adjustments", slot_seconds=60, **RANGE),
        "prev_week_totals": _at(summary.prev_week_totals, _hb(CLOCK.prev_week, CLOCK.week)),
        "daily_breakdown": _at(summary.daily_breakdown, _back(7), "adjustments"),
        "today_totals": _at(summary.today_totals, _back(0)),
        "history_baseline": _at(summary.history_baseline, _HISTORY),
        "user_scorecard": _at(summary.user_scorecard, _HISTORY, "users", "adjustments"),
        "team_kpis": _at(summary.team_kpis, _hb(CLOCK.prev_week), "users", "adjustments"),
        "user_daily": _at(user_detail.user_daily, _back(14), "adjustments"),
        "user_projects": _at(user_detail.user_projects, _back(30)),
        "user_languages": _at(user_detail.user_languages, _back(30)),
        "user_editors": _at(user_detail.user_editors, _back(30)),
        "user_weekly_trend": _at(user_detail.user_weekly_trend, _back(7), "adjustments"),
        "user_files": _at(user_detail.user_files, _back(7)),
        "user_domains": _at(user_detail.user_domains, _back(7)),
        "user_hourly": _at(user_detail.user_hourly, _back(0), "users"),
        "user_totals": _at(user_detail.user_totals, _hb()),
        "user_machines": _at(user_detail.user_machines, _back(30)),
        "user_heatmap": _at(user_detail.user_heatmap, _back(90)),
        "user_ai_totals": _at(user_detail.user_ai_totals, _back(30), "users"),
        "adjustments_list": _of(ledgers.adjustments_list, "adjustments"),
        "adjustment_totals": _of(ledgers.adjustment_totals, "adjustments"),
        "adjustments_ingest": _outcome(
            ledger.check_adjustments, "adjustment_requests", "adjustments", ["seconds", "adjustment_date", "reason"]
        ),
        "ledger_delete": _delete("adjustments"),
        "leave_delete": _delete("leaves"),
        "tag_delete": _delete("tags"),
        "leaves_list": _of(ledgers.leaves_list, "leaves"),
        "leave_totals": _of(ledgers.leave_totals, "leaves"),
        "leaves_ingest": _outcome(
            ledger.check_leaves, "leave_requests", "leaves", ["start_date", "end_date", "leave_type", "reason"]
        ),
        "leave_days": _of(ledgers.leave_days, "leaves", **LEAVE_RANGE),
        "on_leave": _at(ledgers.on_leave, "leaves"),
        "projects": _at(catalog.projects, _back(30)),
        "languages": _at(catalog.languages, _back(30)),
        "project_figures": _at(catalog.team_figures, _back(30), key="project"),
        "project_users": _at(catalog.team_members, _back(30), key="project", other="user_id"),
        "project_languages": _at(catalog.team_members, _back(30), key="project", other="language"),
        "language_figures": _at(catalog.team_figures, _back(30), key="language"),
        "language_users": _at(catalog.team_members, _back(30), key="language", other="user_id"),
        "language_projects": _at(catalog.team_members, _back(30), key="language", other="project"),
        "tag_patterns": _of(catalog.tag_patterns, "tags"),
        "languages_by_user": _at(catalog.languages_by_user, _back(30)),
        "users_overview": _at(catalog.users_overview, _hb(), "users"),
        "tags_grouped": _of(catalog.tags_grouped, "tags"),
        "tags_upsert": _tags_upsert,
        "untagged_domains": _at(sites.untagged_domains, _back(30), "tags"),
        "user_sites": _at(sites.user_sites, _back(7), "tags"),
        "user_tag_stats": _at(sites.user_tag_stats, _back(7), "tags"),
        "user_sites_daily": _at(sites.user_sites_daily, _back(7), "tags"),
        "daily_report_users": _at(period.daily_report_users, _DAY, "adjustments", day=REPORT_DAY),
        "daily_report_site_tags": _at(period.daily_report_site_tags, _DAY, "tags", day=REPORT_DAY),
        "daily_report_tag_totals": _at(period.daily_report_tag_totals, _DAY, "tags", day=REPORT_DAY),
        "daily_report_team": _at(period.daily_report_team, _DAY, "adjustments", day=REPORT_DAY),
        "range_report_users": _at(period.range_report_users, _RANGE, "adjustments", **RANGE),
        "range_report_days": _at(period.range_report_days, _RANGE, "adjustments", **RANGE),
        "range_report_team": _at(period.range_report_team, _RANGE, "adjustments", **RANGE),
        "weekly_report_users": _at(period.weekly_report_users, _WEEK, "adjustments"),
        "weekly_report_days": _at(period.weekly_report_days, _WEEK, "adjustments"),
        "weekly_report_team": _at(period.weekly_report_team, _WEEK, "adjustments"),
        "report_rows_daily": _report_rows(period.daily_report_users, "daily", _DAY, day=REPORT_DAY),
        "report_rows_range": _report_rows(period.range_report_users, "range", _RANGE, days=15, **RANGE),
        "report_rows_weekly": _report_rows(period.weekly_report_users, "weekly", _WEEK),
        "report_boxes": _report_boxes,
        "report_dates": _at(period.report_dates, _hb(AS_OF - timedelta(days=90))),
        "productivity": _at(productivity.productivity, _back(7)),
        "alert_inactive": _at(alerts.alert_inactive, _back(0), "users", "leaves"),
        "alert_on_leave": _at(alerts.alert_on_leave, "leaves"),
        "alert_entertainment": _at(alerts.alert_entertainment, _back(0), "tags", threshold=LEISURE_SECONDS),
        "alert_activity_drop": _at(alerts.alert_activity_drop, _hb(CLOCK.prev_week), "leaves", min_prev=MIN_PREV),
        "alert_burnout": _at(alerts.alert_burnout, _back(10), threshold=BURNOUT_SECONDS),
        "alert_weekend": _at(alerts.alert_weekend, _back(14), threshold=WEEKEND_SECONDS),
        "alerts": _at(
            alerts.alerts, _hb(CLOCK.days_back(14)), "users", "leaves", "tags", leisure_threshold=LEISURE_SECONDS,
            min_prev=MIN_PREV, burnout_threshold=BURNOUT_SECONDS, weekend_threshold=WEEKEND_SECONDS,
        ),
        "leaderboard_7d": _leaderboard,
        "daily_activity_text": _at(upkeep.daily_activity, _back(0)),
        "inactive_today": _at(upkeep.inactive_today, _back(0), "users"),
        "share_flags_update": _share_flags,
        "platform_totals": _at(platform.platform_totals, _hb(), "users"),
        "heartbeat_rate": _at(platform.heartbeat_rate, _hb()),
        "retention_kept": _retention,
        "inactive_accounts": _of(upkeep.inactive_accounts, _hb(end=None), "users", as_of=INACTIVE_AS_OF),
        "stored_adjustments": _stored_adjustments,
        "stored_leaves": _stored_leaves,
        "stored_tags": _stored_tags,
        "stored_users": _stored_users,
        "stored_heartbeats": _stored_heartbeats,
        "stored_leaderboard": _stored_leaderboard,
        "stored_week_by_user": _from_days(summary.week_by_user, "2024-01-22", "2024-01-26"),
        "stored_range_report_users": _from_days(
            period.range_report_users, RANGE["start"], RANGE["end"], "adjustments", **RANGE),
        "stored_leave_activity": _stored_leave_activity,
        "bucketed_attribution": _bucketed_attribution,
        "languages_by_user_nested": _as_json(_at(catalog.languages_by_user_nested, _back(30), most=2), "languages"),
        "tags_nested": _as_json(_of(catalog.tags_nested, "tags", most=5), "patterns"),
        "daily_breakdown_nested": _as_json(_at(summary.daily_breakdown_nested, _back(7), "adjustments", most=10), "users"),
        "entity_estimates": _entity_estimates,
        "kept_user_tag_stats": _kept_user_tag_stats,
        "stream_active_now": replay.stream_active_now,
        "stream_sessions": replay.stream_sessions,
        "stream_heartbeat_rate": replay.stream_heartbeat_rate,
        "stream_attributed": replay.stream_attributed,
        "live_active_now": replay.live_active_now,
        "live_ai_totals": replay.live_ai_totals,
        "live_attributed": replay.live_attributed,
        "live_daily_counts": replay.live_daily_counts,
    }
    return {name: _configured(query) for name, query in found.items()}


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return query(spark, sf_dir)

    return run
