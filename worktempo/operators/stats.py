"""Aggregates over heartbeats: counts, value lists and active seconds per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktempo.functions.columns import is_ai, is_browsing, is_file, is_site, seconds
from worktempo.operators.gaps import active_days, active_us, flagged_slots, span_slots


# Counts per slot, by name.
COUNTS = {
    "heartbeats": "count(*)",
    "ai_heartbeats": "count_if(f_ai)",
    "file_heartbeats": "count_if(f_file)",
    "domain_heartbeats": "count_if(f_site)",
}


def distinct_list(column: str) -> Column:
    """Distinct values of a column or SQL expression, NULLs dropped."""
    return F.expr(f"collect_list(DISTINCT {column})")


def distinct_values(
    hb: DataFrame, keys: Sequence[str], lists: Sequence[str] = (), distinct: Sequence[str] = ()
) -> DataFrame:
    """Per key, ``<c>_values`` (array of distinct values) per list column and ``<c>_count`` per distinct column.

    Spark takes out duplicates of each column by itself, before and in a shuffle on (key, value). What is shuffled
    is the number of values of each column added up, not their combinations, and a hot key is spread over its
    values.
    """
    aggs = [distinct_list(c).alias(f"{c}_values") for c in lists]
    aggs += [F.count_distinct(c).alias(f"{c}_count") for c in distinct]
    return hb.groupBy(*keys).agg(*aggs)


ATTRIBUTED: Mapping[str, str] = {
    "ide": "ide_coding_seconds",
    "browsing": "browsing_seconds",
    "ai": "ai_coding_seconds",
}


def gap_flags(names: Sequence[str]) -> dict[str, Column]:
    known = {"ide": ~is_browsing(), "browsing": is_browsing(), "ai": is_ai()}
    return {n: known[n] for n in names}


def activity(
    hb: DataFrame,
    keys: Sequence[str],
    flags: Sequence[str] = (),
    *,
    by_day: bool = False,
    idle_minutes: int = 10,
    tz_hours: int = 3,
) -> DataFrame:
    """Per key (and local day): counts of heartbeats, first_t, last_t, active_days, coding_seconds, coding_us and one
    column per attributed flag. Counts are taken per slot on the way; unused ones are pruned.

    Where gaps are attributed raw rows are shuffled, so the text columns are reduced to flags before that.
    """
    group = [*keys, "local_day"] if by_day else list(keys)
    opts = {"idle_minutes": idle_minutes, "tz_hours": tz_hours}
    rows = hb.withColumns({"f_ai": is_ai(), "f_file": is_file(), "f_site": is_site()})
    counts = [F.expr(f"{agg} AS {name}") for name, agg in COUNTS.items()]
    if flags:
        slots = flagged_slots(rows, keys, gap_flags(flags), *counts, by_day=by_day)
    else:
        slots = span_slots(rows, keys, *counts, by_day=by_day)
    total = F.sum(active_us(**opts))
    aggs = [F.sum(c).alias(c) for c in COUNTS]
    aggs += [F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t")]
    aggs += [seconds(total).alias("coding_seconds"), total.alias("coding_us"), active_days(tz_hours).alias("active_days")]
    aggs += [seconds(F.sum(active_us(f, **opts))).alias(ATTRIBUTED[f]) for f in flags]
    return slots.groupBy(*group).agg(*aggs)


def key_stats(
    hb: DataFrame,
    keys: Sequence[str],
    *,
    lists: Sequence[str] = (),
    distinct: Sequence[str] = (),
    flags: Sequence[str] = (),
    by_day: bool = False,
    idle_minutes: int = 10,
    tz_hours: int = 3,
) -> DataFrame:
    """``activity`` with ``distinct_values`` beside it: two branches over the same scan, so that the text columns of
    the lists never travel with the raw rows."""
    group = [*keys, "local_day"] if by_day else list(keys)
    times = activity(hb, keys, flags, by_day=by_day, idle_minutes=idle_minutes, tz_hours=tz_hours)
    return null_safe_join(times, distinct_values(hb, group, lists, distinct), group)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be NULL: a group of rows without a user is a group."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, same).drop(*[f"_{k}" for k in keys])


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """First n rows of each key, with their rank. Spark prunes to n rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
