"""Sites visited, with tags."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock
from worktempo.functions.columns import day_text, seconds, site_rows
from worktempo.operators.gaps import active_days, active_us, span_slots
from worktempo.operators.joins import salted_lookup
from worktempo.operators.tags import rules_by_name, tag_labels, untagged, with_tag
from worktempo.plans.base import IDLE, TZ, clock_text, window_rows


def untagged_domains(hb: DataFrame, tags: DataFrame, *, as_of: datetime, days: int = 30, tz_hours: int = TZ) -> DataFrame:
    """Distinct sites of the last days that no pattern matches."""
    clock = Clock.at(as_of, tz_hours)
    rows = window_rows(hb, clock, clock.days_back(days)).where(site_rows())
    return untagged(rows, tags).orderBy("entity")


def _site_rows(hb: DataFrame, clock: Clock, days: int, idle_minutes: int) -> DataFrame:
    return window_rows(hb, clock, clock.days_back(days), idle_minutes=idle_minutes).where(site_rows())


def _user_site_sums(rows: DataFrame, clock: Clock, idle_minutes: int) -> DataFrame:
    slots = span_slots(rows, ["user_id", "entity"], F.count("*").alias("n"))
    return slots.groupBy("user_id", "entity").agg(
        F.sum("n").alias("heartbeats"),
        seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("seconds"),
        F.min("first_t").alias("first_t"),
        F.max("last_t").alias("last_t"),
        active_days(clock.tz_hours).alias("visit_days"),
    )


def _tagged_user_sites(hb: DataFrame, tags: DataFrame, clock: Clock, days: int, idle_minutes: int) -> DataFrame:
    rows = _site_rows(hb, clock, days, idle_minutes)
    return with_tag(_user_site_sums(rows, clock, idle_minutes), rows, rules_by_name(tags), ["user_id"])


def user_sites(
    hb: DataFrame, tags: DataFrame, *, as_of: datetime, days: int = 7, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """User and site with visit figures and the first matching tag (NULL if none)."""
    clock = Clock.at(as_of, tz_hours)
    sites = _tagged_user_sites(hb, tags, clock, days, idle_minutes)
    return sites.select(
        "user_id", "entity", "heartbeats", "seconds",
        clock_text("first_t", clock, "dd/MM HH:mm").alias("first_visit"),
        clock_text("last_t", clock, "dd/MM HH:mm").alias("last_visit"),
        "visit_days", "tag_name", "tag_color", "tag_icon",
    )


def user_tag_stats(
    hb: DataFrame, tags: DataFrame, *, as_of: datetime, days: int = 7, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Time per user and tag: the sum of the sites' whole seconds. Colour and icon are those of the user's
    longest-visited site of the tag."""
    clock = Clock.at(as_of, tz_hours)
    return _tag_sums(_tagged_user_sites(hb, tags, clock, days, idle_minutes))


def kept_user_tag_stats(
    hb: DataFrame, first_tags: DataFrame, *, as_of: datetime, days: int = 7, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """``user_tag_stats`` with the tags of ``jobs.site_tags.first_tags``: nothing is matched, the tags are looked up."""
    clock = Clock.at(as_of, tz_hours)
    sums = _user_site_sums(_site_rows(hb, clock, days, idle_minutes), clock, idle_minutes)
    return _tag_sums(salted_lookup(sums, first_tags, ["entity"], ["user_id"]))


def _tag_sums(sites: DataFrame) -> DataFrame:
    place = F.struct(-F.col("seconds"), -F.col("heartbeats"), F.col("entity"))
    labelled = sites.select("user_id", *tag_labels(), "seconds", "heartbeats", place.alias("place"))
    return labelled.groupBy("user_id", "tag_name").agg(
        F.min_by("tag_color", "place").alias("tag_color"),
        F.min_by("tag_icon", "place").alias("tag_icon"),
        F.sum("seconds").alias("seconds"),
        F.sum("heartbeats").alias("heartbeats"),
    )


def user_sites_daily(
    hb: DataFrame, tags: DataFrame, *, as_of: datetime, days: int = 7, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    rows = _site_rows(hb, clock, days, idle_minutes)
    slots = span_slots(rows, ["user_id", "entity"], F.count("*").alias("n"), by_day=True)
    sums = slots.groupBy("user_id", "entity", "local_day").agg(
        F.sum("n").alias("heartbeats"), seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("seconds")
    )
    tagged = with_tag(sums, rows, rules_by_name(tags), ["user_id", "local_day"])
    return tagged.select(
        "user_id", day_text("local_day").alias("day"), "entity", "heartbeats", "seconds", "tag_name", "tag_color", "tag_icon"
    )
