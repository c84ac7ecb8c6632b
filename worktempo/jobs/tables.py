"""Jobs that change the ledgers, the tags, the users and the heartbeats where they are stored: tables of the catalog
(``sources.stored``), named ``database.table``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock
from worktempo.jobs.upkeep import months_before, retention_kept, share_flags_update
from worktempo.operators import ledger
from worktempo.sources import stored


def _ingest(checked: DataFrame, name: str) -> DataFrame:
    """Append what passed. The outcome is computed once and kept as a table beside the ledger; the rejected requests are
    read from it."""
    outcome = stored.stage(checked, f"{name}_requests")
    kept = checked.sparkSession.table(outcome)
    stored.append(ledger.accepted(kept), name)
    return ledger.rejected(kept)


def append_adjustments(
    spark: SparkSession, name: str, requests: DataFrame, users: DataFrame, *, as_of: datetime, tz_hours: int = 3
) -> DataFrame:
    """Append the accepted requests to the ledger; returns the rejected ones."""
    return _ingest(
        ledger.check_adjustments(requests, users, stored.current(spark, name), as_of=as_of, tz_hours=tz_hours), name)


def append_leaves(spark: SparkSession, name: str, requests: DataFrame, users: DataFrame, *, as_of: datetime) -> DataFrame:
    """Append the accepted requests to the leaves; returns the rejected ones."""
    return _ingest(ledger.check_leaves(requests, users, stored.current(spark, name), as_of=as_of), name)


def change_tags(spark: SparkSession, name: str, requests: DataFrame, *, as_of: datetime) -> DataFrame:
    """Create and update tags; returns the rejected requests."""
    new, rejected = ledger.apply_tag_requests(requests, stored.current(spark, name), as_of=as_of)
    stored.replace(new, name)
    return rejected


def delete_rows(spark: SparkSession, name: str, ids: DataFrame) -> None:
    """Remove the rows with the given ids."""
    stored.replace(ledger.delete_ids(stored.current(spark, name), ids), name)


def open_sharing(spark: SparkSession, name: str) -> None:
    """Set the sharing flags of the users table."""
    stored.replace(share_flags_update(stored.current(spark, name)), name)


def purge_heartbeats(spark: SparkSession, name: str, *, as_of: datetime, months: int = 12, tz_hours: int = 3) -> None:
    """Remove heartbeats older than some months from a table by local day.

    Days before the boundary are dropped from the catalog without being read; the day that holds it is written anew and
    swapped in whole; younger days are not touched. A job that stops at any step loses no row that is to be kept, and the
    next one does the rest.
    """
    limit = spark.range(1).select(months_before(as_of, months)).first()[0]
    edge = Clock(limit, tz_hours).local_date
    days = stored.stored_days(spark, name)
    stored.drop_days(spark, name, [d for d in days if d < edge])
    if edge in days:
        day = stored.heartbeats_by_day(spark, name, edge, edge)
        stored.swap_days(spark, name, retention_kept(day, as_of=as_of, months=months), [edge])
