"""Retention, inactive accounts, sharing flags and the daily text report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock
from worktempo.functions.columns import joined_all
from worktempo.operators.scan import between
from worktempo.operators.stats import key_stats
from worktempo.plans.base import TZ, clock_text, window_rows

# Sharing columns opened by ``share_flags_update``; -1 days means no limit.
SHARE_FLAGS = ["share_projects", "share_languages", "share_editors", "share_oss", "share_machines", "share_labels",
               "public_leaderboard"]


def months_before(as_of: datetime, months: int):
    return F.expr(f"TIMESTAMP_NTZ '{as_of.isoformat(sep=' ')}' - INTERVAL '{months}' MONTH")


def retention_kept(hb: DataFrame, *, as_of: datetime, months: int = 12) -> DataFrame:
    """Heartbeats young enough to keep."""
    return hb.where(F.col("time") >= months_before(as_of, months))


def inactive_accounts(hb: DataFrame, users: DataFrame, *, as_of: datetime, months: int = 6) -> DataFrame:
    """Users without a heartbeat in the last months."""
    recent = between(hb, None, None, as_of).where(F.col("time") >= months_before(as_of, months))
    return users.join(recent.select(F.col("user_id").alias("id")).distinct(), "id", "left_anti").select("id", "email")


def share_flags_update(users: DataFrame) -> DataFrame:
    """Open all sharing of users with no shared days or without public leaderboard; others stay as they are."""
    closed = F.coalesce((F.col("share_data_max_days") == 0) | ~F.col("public_leaderboard"), F.lit(False))
    new = {"share_data_max_days": F.when(closed, F.lit(-1)).otherwise(F.col("share_data_max_days"))}
    new |= {c: F.when(closed, F.lit(True)).otherwise(F.col(c)) for c in SHARE_FLAGS}
    return users.withColumns(new)


def daily_activity(hb: DataFrame, *, as_of: datetime, tz_hours: int = TZ) -> DataFrame:
    """Today's figures per user and the printed block. Empty project names stay in the lists here."""
    clock = Clock.at(as_of, tz_hours)
    stats = key_stats(window_rows(hb, clock, clock.today), ["user_id"], lists=["project", "language"])
    rows = stats.select(
        "user_id", "heartbeats",
        joined_all("project_values").alias("projects"),
        joined_all("language_values").alias("languages"),
        clock_text("first_t", clock).alias("first_active"),
        clock_text("last_t", clock).alias("last_active"),
    )
    # Fixed value: layout of a printed block.
    block = F.format_string(
        "👤 %s\n   Heartbeats: %d\n   Aktif: %s - %s\n   Projeler: %s\n   Diller: %s",
        "user_id", "heartbeats", "first_active", "last_active",
        F.coalesce("projects", F.lit("")), F.coalesce("languages", F.lit("")),
    )
    return rows.orderBy(F.desc("heartbeats"), "user_id").withColumn("block", block)


def inactive_today(hb: DataFrame, users: DataFrame, *, as_of: datetime, tz_hours: int = TZ) -> DataFrame:
    """Users NOT IN today's active users, NULL-aware: one active row without user empties the result.

    Written as an anti join and a scalar check, since Spark runs a NULL-aware anti join only by broadcasting the
    whole active side.
    """
    clock = Clock.at(as_of, tz_hours)
    active = window_rows(hb, clock, clock.today).select("user_id").distinct()
    # One check of the same table that the join reads, so that Spark reads the heartbeats once; the join compares
    # NULL-safely for the same reason (else it would filter its side and make it another table).
    found = active.agg(F.struct(
        F.coalesce(F.bool_or(F.col("user_id").isNull()), F.lit(False)).alias("unknown"), (F.count("*") > 0).alias("someone")
    )).scalar()
    rest = users.select("id").join(active, F.col("id").eqNullSafe(F.col("user_id")), "left_anti").withColumn("_found", found)
    kept = rest.where(~F.col("_found.unknown") & (F.col("id").isNotNull() | ~F.col("_found.someone")))
    return kept.select("id", F.concat(F.lit("⚠️  "), F.col("id"), F.lit(" - bugün aktivite yok")).alias("line"))


def write_text(lines: DataFrame, column: str, path: str) -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
