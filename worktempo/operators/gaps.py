"""Idle-capped active time.

The rule: order the heartbeats of a key by (time, id); the gap to the previous one counts iff it is at most
the idle limit (inclusive); it belongs to the later heartbeat.

A ``lag`` over the bare key would send all rows of a key through one task, and a busy bot, project or team can
own a third of a table. So every form here works in two levels. Level one groups by (key, slot), where a slot is
at most as wide as the idle limit (see ``with_slots``): all gaps inside it count. Level two runs ``lag`` over the
slot rows of a key, at most 144 a day however many heartbeats there are, and adds the gap between slots.

Three forms, by what the gap is attributed to:

* ``span_slots``: nothing. The gaps of a slot telescope to max(time) - min(time), so level one is a plain
  aggregate that Spark combines before the shuffle; no sort of raw rows at all.
* ``flagged_slots``: boolean flags of the later heartbeat (AI, IDE, browsing). Level one needs a ``lag`` inside
  (key, slot).
* ``grouped_slots``: columns of the later heartbeat, e.g. (project, language) of a file's rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktempo.functions.clock import MINUTE_US, micros
from worktempo.functions.columns import local_day_of, zero


def linked(slots: DataFrame, keys: Sequence[str], by_day: bool = False) -> DataFrame:
    """Level two: add prev_last, the last instant of the key's previous slot."""
    part = [*keys, "local_day"] if by_day else list(keys)
    return slots.withColumn("prev_last", F.lag("last_t").over(Window.partitionBy(*part).orderBy("slot")))


def span_slots(hb: DataFrame, keys: Sequence[str], *aggs: Column, by_day: bool = False) -> DataFrame:
    """One row per (key, slot): first_t, last_t, inner_us, prev_last and the given aggregates.

    With ``by_day`` the gap across local midnight is lost, as if each day were computed alone.
    """
    slots = hb.groupBy(*keys, "local_day", "slot").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), *aggs
    )
    return linked(slots.withColumn("inner_us", F.col("last_t") - F.col("first_t")), keys, by_day)


def flagged_slot_rows(hb: DataFrame, keys: Sequence[str], flags: Mapping[str, Column], *aggs: Column) -> DataFrame:
    """Level one of ``flagged_slots``. It needs nothing outside a local day, so it can be kept as a table by day."""
    rows = hb.withColumns({f"f_{name}": cond for name, cond in flags.items()})
    inside = Window.partitionBy(*keys, "local_day", "slot").orderBy("t", "id")
    rows = rows.withColumn("gap", F.col("t") - F.lag("t").over(inside))
    per_flag: list[Column] = []
    for name in flags:
        per_flag.append(F.expr(f"sum(CASE WHEN f_{name} THEN gap END) AS inner_{name}_us"))
        per_flag.append(F.expr(f"bool_or(CASE WHEN gap IS NULL THEN f_{name} END) AS first_{name}"))
    slots = rows.groupBy(*keys, "local_day", "slot").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), *per_flag, *aggs
    )
    return slots.withColumn("inner_us", F.col("last_t") - F.col("first_t"))


def flagged_slots(
    hb: DataFrame, keys: Sequence[str], flags: Mapping[str, Column], *aggs: Column, by_day: bool = False
) -> DataFrame:
    """As ``span_slots`` plus, per flag f, inner_f_us (gaps inside the slot whose later row has f) and first_f
    (f of the slot's first row, which owns the gap from the previous slot)."""
    return linked(flagged_slot_rows(hb, keys, flags, *aggs), keys, by_day)


def grouped_slots(hb: DataFrame, keys: Sequence[str], attrs: Sequence[str], *aggs: Column) -> DataFrame:
    """One row per (key, slot, attrs); the previous slot is that of the key, whatever its attrs."""
    inside = Window.partitionBy(*keys, "local_day", "slot").orderBy("t", "id")
    rows = hb.withColumn("gap", F.col("t") - F.lag("t").over(inside))
    groups = rows.groupBy(*keys, "local_day", "slot", *attrs).agg(
        F.min(F.when(F.col("gap").isNull(), F.col("t"))).alias("first_t"),
        F.max("t").alias("last_t"),
        F.coalesce(F.sum("gap"), zero()).alias("inner_us"),
        *aggs,
    )
    before = Window.partitionBy(*keys).orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("prev_last", F.max("last_t").over(before))


def active_us(
    flag: str | None = None,
    *,
    since: datetime | None = None,
    same_day: bool = False,
    idle_minutes: int = 10,
    tz_hours: int = 3,
) -> Column:
    """Counted microseconds of one slot row: the inside plus the gap from the previous slot.

    ``since`` drops a gap that starts before a range (the first heartbeat of a range has no predecessor), so one
    slot table serves several ranges; the range must start at a local midnight. ``same_day`` does the same for
    local days.
    """
    gap = "first_t - prev_last"
    counts = f"{gap} <= {idle_minutes * MINUTE_US}"
    if since is not None:
        counts += f" AND prev_last >= {micros(since)}"
    if same_day:
        counts += f" AND {local_day_of('prev_last', tz_hours)} = local_day"
    inner = "inner_us"
    if flag is not None:
        counts += f" AND first_{flag}"
        inner = f"coalesce(inner_{flag}_us, 0L)"
    return F.expr(f"{inner} + CASE WHEN {counts} THEN {gap} ELSE 0L END")


def active_days(tz_hours: int = 3) -> Column:
    """Number of days with heartbeats among a key's linked slots, with days at another offset than the slots' too.
    An aggregate."""
    first, last, before = (local_day_of(t, tz_hours) for t in ("first_t", "last_t", "prev_last"))
    return F.expr(f"count_if(prev_last IS NULL OR {before} <> {first}) + count_if({first} <> {last})")
