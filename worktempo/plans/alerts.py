"""Alerts: inactivity, leave, leisure sites, falling activity, overwork, weekend work."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock
from worktempo.functions.columns import is_site, or_zero, round_even, seconds
from worktempo.operators.gaps import active_us, span_slots
from worktempo.operators.ledger import leave_days, users_on_leave
from worktempo.operators.runs import longest_run
from worktempo.operators.tags import tagged_with
from worktempo.plans.base import IDLE, TZ, since_day, window_rows
from worktempo.sources.schemas import LEISURE_TAGS

ALERT_HOUR = 11
NAMES_SHOWN = 5

# Alert kinds in output order, with type, icon, title and message texts. {user}, {n}, {names}, ...
# stand for columns.
TEXTS = {
    "inactive": ("warning", "⚠️", "Bugün İnaktif Kullanıcılar", "{n} kullanıcı bugün hiç aktif olmadı: {names}"),
    "on_leave": ("info", "🏝️", "Bugün İzinli Kullanıcılar", "{n} kişi izinli: {names}"),
    "entertainment": ("danger", "🎮", "{user} — Yüksek Eğlence Kullanımı",
                      "Bugün {minutes} dakika eğlence/sosyal medya sitelerinde"),
    "activity_drop": ("info", "📉", "{user} — Aktivite Düşüşü",
                      "Bu hafta %{drop} daha az aktif (geçen hafta: {prev} HB, bu hafta: {this} HB)"),
    "burnout": ("danger", "🔥", "{user} — Burnout Riski",
                "Üst üste {streak} gün {hours} saatin üzerinde kod yazmış. Mola önerisi yerinde olabilir."),
    "weekend": ("warning", "🏖️", "{user} — Hafta Sonu Çalışması",
                "Son {days} günün hafta sonlarında toplam {hours} saat ({weekend_days} gün). "
                "İş-yaşam dengesi kontrol edilebilir."),
}
KINDS = list(TEXTS)


def _fill(text: str, values: dict[str, Column | str]) -> Column:
    """Concatenate a text whose {name} parts are replaced by columns or literal text."""
    parts: list[Column] = []
    for piece in text.split("{"):
        name, closed, rest = piece.partition("}")
        if not closed:
            parts.append(F.lit(piece))
            continue
        value = values[name]
        parts += [value.cast("string") if isinstance(value, Column) else F.lit(value), F.lit(rest)]
    return F.concat(*parts)


def _alert(
    kind: str, values: dict[str, Column | str], user: Column, count: Column, figure: Column | None = None
) -> list[Column]:
    """``sort_key`` orders the alerts of a kind: those with a figure by it, largest first, then all by user."""
    level, icon, title, message = TEXTS[kind]
    return [
        F.lit(KINDS.index(kind) + 1).alias("alert_order"),
        F.lit(level).alias("type"),
        F.lit(icon).alias("icon"),
        _fill(title, values).alias("title"),
        _fill(message, values).alias("message"),
        user.cast("string").alias("user_id"),
        count.cast("bigint").alias("alert_count"),
        (F.lit(0) if figure is None else -figure).cast("bigint").alias("sort_key"),
    ]


def _group_alert(kind: str, users: DataFrame, clock: Clock) -> DataFrame:
    """One row with the number of users and the first few names; none before the alert hour or without users."""
    if clock.local_now.hour < ALERT_HOUR:
        users = users.where(F.lit(False))
    users = users.select("user_id").distinct()  # one shuffled table for the names and the number
    first = users.orderBy("user_id").limit(NAMES_SHOWN)
    names = first.agg(F.array_join(F.array_sort(F.collect_list("user_id")), ", ")).scalar()
    total = users.agg(F.count("*").alias("n")).where(F.col("n") > 0).withColumn("first_names", names)
    more = F.when(F.col("n") > NAMES_SHOWN, F.lit("...")).otherwise(F.lit(""))
    values = {"n": F.col("n"), "names": F.concat("first_names", more)}
    return total.select(*_alert(kind, values, F.lit(None), F.col("n")))


def inactive_users(active: DataFrame, users: DataFrame, leaves: DataFrame, clock: Clock) -> DataFrame:
    everyone = users.select(F.col("id").alias("user_id"))
    return everyone.join(active, "user_id", "left_anti").join(
        users_on_leave(leaves, clock.local_date), "user_id", "left_anti"
    )


def alert_inactive(hb: DataFrame, users: DataFrame, leaves: DataFrame, *, as_of: datetime, tz_hours: int = TZ) -> DataFrame:
    """Users without heartbeats today who are not on leave."""
    clock = Clock.at(as_of, tz_hours)
    active = window_rows(hb, clock, clock.today).select("user_id").distinct()
    return _in_order(_group_alert("inactive", inactive_users(active, users, leaves, clock), clock))


def alert_on_leave(leaves: DataFrame, *, as_of: datetime, tz_hours: int = TZ) -> DataFrame:
    clock = Clock.at(as_of, tz_hours)
    return _in_order(_group_alert("on_leave", users_on_leave(leaves, clock.local_date), clock))


def alert_entertainment(
    hb: DataFrame, tags: DataFrame, *, as_of: datetime, threshold: int = 3600, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Users with more than ``threshold`` seconds today on sites of the leisure tags, most time first."""
    return _in_order(_leisure_alerts(hb, tags, Clock.at(as_of, tz_hours), threshold, idle_minutes))


def _leisure_alerts(hb: DataFrame, tags: DataFrame, clock: Clock, threshold: int, idle_minutes: int) -> DataFrame:
    """Gaps run along all leisure sites of a user. Sites are reduced to (user, site, slot) before the tags are looked
    up; slots of several sites then merge by minimum and maximum.
    """
    rows = window_rows(hb, clock, clock.today, idle_minutes=idle_minutes).where(is_site())
    parts = rows.groupBy("user_id", "entity", "local_day", "slot").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi")
    )
    leisure = tagged_with(parts, rows, tags, LEISURE_TAGS, ["user_id", "slot"])
    instants = leisure.select("user_id", "local_day", "slot", F.explode(F.array("lo", "hi")).alias("t"))
    total = F.sum(active_us(idle_minutes=idle_minutes))
    users = span_slots(instants.where(F.col("user_id").isNotNull()), ["user_id"]).groupBy("user_id").agg(total.alias("us"))
    users = users.where(F.col("us") > F.lit(threshold * 1_000_000)).withColumn("seconds", seconds("us"))
    values = {"user": F.col("user_id"), "minutes": round_even(F.col("seconds") / F.lit(60))}
    return users.select(*_alert("entertainment", values, F.col("user_id"), F.lit(None), F.col("seconds")))


def _in_order(found: DataFrame) -> DataFrame:
    return found.orderBy("alert_order", "sort_key", "user_id").drop("sort_key")


def user_days(hb: DataFrame, clock: Clock, start: datetime, idle_minutes: int) -> DataFrame:
    """Per named user and local day from ``start``: heartbeats and seconds, days counted alone."""
    rows = window_rows(hb, clock, start, idle_minutes=idle_minutes).where(F.col("user_id").isNotNull())
    return span_slots(rows, ["user_id"], F.count("*").alias("n"), by_day=True).groupBy("user_id", "local_day").agg(
        F.sum("n").alias("n"), seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("seconds")
    )


def by_user(days: DataFrame, clock: Clock, *, burnout_days: int, burnout: int, weekend_days: int, weekend: int) -> DataFrame:
    """One row per user for all alerts that look at a user's days, from one table of days."""
    week, prev = since_day(clock.week, clock), since_day(clock.prev_week, clock)
    is_weekend = F.dayofweek(F.date_from_unix_date("local_day")).isin(1, 7)
    free = is_weekend & (F.col("seconds") > weekend) & since_day(clock.days_back(weekend_days), clock)
    long = (F.col("seconds") >= burnout) & since_day(clock.days_back(burnout_days), clock)
    return days.groupBy("user_id").agg(
        or_zero(F.sum(F.when(since_day(clock.today, clock), F.col("n")))).alias("today_hb"),
        or_zero(F.sum(F.when(week, F.col("n")))).alias("this_hb"),
        or_zero(F.sum(F.when(prev & ~week, F.col("n")))).alias("prev_hb"),
        or_zero(F.sum(F.when(free, F.col("seconds")))).alias("total"),
        F.count_if(free).alias("weekend_n"),
        F.array_sort(F.collect_list(F.when(long, F.col("local_day")))).alias("long_days"),  # a date each, of some days
    )


def _drop_alerts(people: DataFrame, leaves: DataFrame, clock: Clock, min_prev: int, ratio: str, excused_days: int) -> DataFrame:
    limit = F.col("prev_hb") * F.expr(f"CAST('{ratio}' AS DECIMAL(9, 6))")
    dropped = people.where((F.col("prev_hb") > 0) & (F.col("prev_hb") > min_prev) & (F.col("this_hb") < limit))
    today = clock.local_date
    excused = leave_days(leaves, today - timedelta(days=7), today).groupBy("user_id").agg(
        F.count("*").alias("days")
    ).where(F.col("days") >= excused_days)
    left = dropped.join(excused, "user_id", "left_anti")
    share = F.col("this_hb") / F.greatest("prev_hb", F.lit(1))
    values = {
        "user": F.col("user_id"), "drop": round_even((F.lit(1) - share) * 100),
        "prev": F.col("prev_hb"), "this": F.col("this_hb"),
    }
    return left.select(*_alert("activity_drop", values, F.col("user_id"), F.lit(None)))


def _streak() -> Column:
    """Longest run of consecutive days in the sorted array ``long_days``."""
    step = ("aggregate(long_days, named_struct('best', 0L, 'run', 0L, 'last', CAST(NULL AS INT)), (a, d) -> named_struct("
            "'best', greatest(a.best, if(d = a.last + 1, a.run + 1, 1L)), 'run', if(d = a.last + 1, a.run + 1, 1L), 'last', d), "
            "a -> a.best)")
    return F.expr(step)


def _burnout_alerts(people: DataFrame, threshold: int, min_streak: int) -> DataFrame:
    users = people.where(F.col("streak") >= min_streak)
    values = {"user": F.col("user_id"), "streak": F.col("streak"), "hours": f"{threshold / 3600:g}"}
    return users.select(*_alert("burnout", values, F.col("user_id"), F.lit(None)))


def _weekend_alerts(people: DataFrame, days: int) -> DataFrame:
    values = {
        "user": F.col("user_id"), "days": str(days), "weekend_days": F.col("weekend_n"),
        "hours": round_even(F.col("total") / F.lit(3600)),
    }
    return people.where(F.col("weekend_n") > 0).select(
        *_alert("weekend", values, F.col("user_id"), F.lit(None), F.col("total")))


def alert_activity_drop(
    hb: DataFrame, leaves: DataFrame, *, as_of: datetime, min_prev: int = 100, ratio: str = "0.3",
    excused_days: int = 3, tz_hours: int = TZ,
) -> DataFrame:
    """Users with less than ``ratio`` of last week's heartbeats, unless excused by leave in the last eight days."""
    clock = Clock.at(as_of, tz_hours)
    week = since_day(clock.week, clock)
    rows = window_rows(hb, clock, clock.prev_week).where(F.col("user_id").isNotNull())
    counts = rows.groupBy("user_id").agg(F.count_if(week).alias("this_hb"), F.count_if(~week).alias("prev_hb"))
    return _in_order(_drop_alerts(counts, leaves, clock, min_prev, ratio, excused_days))


def alert_burnout(
    hb: DataFrame, *, as_of: datetime, days: int = 10, threshold: int = 36000, min_streak: int = 3,
    idle_minutes: int = IDLE, tz_hours: int = TZ,
) -> DataFrame:
    """Users with ``min_streak`` or more consecutive days of at least ``threshold`` seconds."""
    clock = Clock.at(as_of, tz_hours)
    long_days = user_days(hb, clock, clock.days_back(days), idle_minutes).where(F.col("seconds") >= threshold)
    return _in_order(_burnout_alerts(longest_run(long_days), threshold, min_streak))


def alert_weekend(
    hb: DataFrame, *, as_of: datetime, days: int = 14, threshold: int = 7200, idle_minutes: int = IDLE, tz_hours: int = TZ
) -> DataFrame:
    """Users with Saturdays or Sundays above ``threshold`` seconds; sum and number of such days. Most time first."""
    clock = Clock.at(as_of, tz_hours)
    people = by_user(user_days(hb, clock, clock.days_back(days), idle_minutes), clock, burnout_days=0, burnout=0,
                     weekend_days=days, weekend=threshold)
    return _in_order(_weekend_alerts(people, days))


def alerts(
    hb: DataFrame, users: DataFrame, leaves: DataFrame, tags: DataFrame, *, as_of: datetime,
    leisure_threshold: int = 3600, min_prev: int = 100, burnout_threshold: int = 36000, weekend_threshold: int = 7200,
    tz_hours: int = TZ,
) -> DataFrame:
    """All alerts, in the order of the kinds. Falling activity, overwork and weekend work come from one table of days."""
    clock = Clock.at(as_of, tz_hours)
    days = user_days(hb, clock, min(clock.prev_week, clock.days_back(14)), IDLE)
    people = by_user(days, clock, burnout_days=10, burnout=burnout_threshold, weekend_days=14, weekend=weekend_threshold)
    # All columns of the table stay with every branch, so that Spark finds it to be one and computes it once.
    people = people.where(F.coalesce(F.col("today_hb") + F.col("this_hb") + F.col("prev_hb") + F.col("total") + F.col("weekend_n")
                                     + F.size("long_days"), F.lit(0)) >= 0)
    parts = [
        _group_alert("inactive", inactive_users(people.where(F.col("today_hb") > 0).select("user_id"), users, leaves, clock), clock),
        _group_alert("on_leave", users_on_leave(leaves, clock.local_date), clock),
        _leisure_alerts(hb, tags, clock, leisure_threshold, IDLE),
        _drop_alerts(people, leaves, clock, min_prev, "0.3", 3),
        _burnout_alerts(people.withColumn("streak", _streak()), burnout_threshold, 3),
        _weekend_alerts(people, 14),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _in_order(out)
