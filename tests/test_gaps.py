"""Idle-capped time: hand-computed cases, and the two-level forms against one lag over the whole key."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from helpers import one, rows, when
from pyspark.sql import Window
from pyspark.sql import functions as F
from worktempo.functions.clock import Clock
from worktempo.functions.columns import is_ai, is_browsing
from worktempo.operators.gaps import active_us, flagged_slots, grouped_slots, span_slots
from worktempo.operators.scan import between, with_slots
from worktempo.operators.stats import activity, key_stats

IDLE_US = 600_000_000


def seconds_of(hb, keys=("user_id",), flags=(), **options):
    return activity(with_slots(hb), list(keys), flags, **options)


def test_gap_of_exactly_ten_minutes_counts(hb):
    data = hb({"at": "05 00:00:00"}, {"at": "05 00:10:00"}, {"at": "05 00:20:00.000001"})
    assert one(seconds_of(data))["coding_us"] == IDLE_US
    assert one(seconds_of(data, flags=["ide"]))["coding_seconds"] == 600


def test_gap_across_range_start_is_lost(hb):
    data = hb({"at": "05 20:58:00"}, {"at": "05 21:02:00"})
    ranged = between(data, when("05 21:00:00"), None, when("09 00:00:00"))
    assert one(seconds_of(ranged))["coding_seconds"] == 0
    slots = span_slots(with_slots(data), ["user_id"])
    late = slots.where(F.col("first_t") >= F.lit(1_704_488_400_000_000))  # 21:00 UTC
    assert one(late.select(active_us(since=when("05 21:00:00")).alias("us")))["us"] == 0
    assert one(late.select(active_us().alias("us")))["us"] == 240_000_000


def test_gap_across_local_midnight_counts_for_the_user_but_not_for_days(hb):
    data = hb({"at": "05 20:58:00"}, {"at": "05 21:02:00"})
    assert one(seconds_of(data))["coding_seconds"] == 240
    for flags in ((), ("ide",)):
        days = rows(seconds_of(data, flags=flags, by_day=True))
        assert [d["coding_seconds"] for d in days] == [0, 0]
    same = span_slots(with_slots(data), ["user_id"]).agg(F.sum(active_us(same_day=True)).alias("us"))
    assert one(same)["us"] == 0


def test_half_seconds_round_up(hb):
    data = hb({"at": "05 00:00:00"}, {"at": "05 00:00:00.25"}, {"at": "05 00:00:00.5"})
    assert one(seconds_of(data))["coding_seconds"] == 1


def test_gap_belongs_to_the_later_row(hb):
    data = hb({"at": "05 00:00:00"}, {"at": "05 00:05:00", "category": "Browsing"}, {"at": "05 00:08:00"})
    got = one(seconds_of(data, flags=["ide", "browsing"]))
    assert (got["ide_coding_seconds"], got["browsing_seconds"], got["coding_seconds"]) == (180, 300, 480)


@pytest.mark.parametrize("first_is_ai", [True, False])
def test_of_tied_rows_the_lower_id_owns_the_gap(hb, first_is_ai):
    ai, plain = {"category": "AI Coding"}, {}
    pair = [ai, plain] if first_is_ai else [plain, ai]
    data = hb({"at": "05 00:00:00"}, *[{"at": "05 00:01:00", **p} for p in pair])
    assert one(seconds_of(data, flags=["ai"]))["ai_coding_seconds"] == (60 if first_is_ai else 0)


def test_null_category_and_editor(hb):
    data = hb({"at": "05 00:00:00"}, {"at": "05 00:01:00", "category": None, "editor": None, "user_agent": None})
    got = one(seconds_of(data, flags=["ide", "browsing", "ai"]))
    assert (got["ide_coding_seconds"], got["browsing_seconds"], got["ai_coding_seconds"]) == (60, 0, 0)


def test_team_union_counts_concurrent_work_once(hb):
    data = hb(
        {"at": "05 00:00:00", "user_id": "a"}, {"at": "05 00:08:00", "user_id": "a"},
        {"at": "05 00:04:00", "user_id": "b"}, {"at": "05 00:12:00", "user_id": "b"},
    )
    assert one(seconds_of(data, ["project"]))["coding_seconds"] == 720
    assert sorted(r["coding_seconds"] for r in rows(seconds_of(data))) == [480, 480]


def test_before_the_epoch(spark, hb):
    old = datetime(1969, 12, 31, 23, 55)
    data = hb({"time": old}, {"time": old + timedelta(minutes=9)})
    assert one(seconds_of(data))["coding_seconds"] == 540


def test_session_zone_is_checked(spark, hb):
    data = hb({"at": "05 00:00:00"})
    spark.conf.set("spark.sql.session.timeZone", "Europe/Istanbul")
    try:
        with pytest.raises(ValueError):
            with_slots(data)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def busy_rows(seed: int, n: int = 1500):
    """One user holds most rows, instants collide, gaps straddle the idle limit."""
    rng = random.Random(seed)
    out, at = [], datetime(2024, 1, 4, 18)
    for n in range(n):
        at += timedelta(microseconds=rng.choice([0, 0, 1, 999_999, 30_000_000, 599_999_999, IDLE_US, IDLE_US + 1]))
        out.append({
            "id": n, "time": at, "user_id": rng.choice(["hot"] * 5 + ["b", "c"]), "project": rng.choice(["p", "q"]),
            "language": rng.choice(["Go", "SQL", None]), "category": rng.choice(["coding", "browsing", "ai coding", None]),
            "entity": rng.choice(["/x", "/y"]),
        })
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("keys", [["user_id"], ["project"], ["user_id", "local_day"]])
def test_two_levels_equal_one_lag(hb, seed, keys):
    data = with_slots(hb(*busy_rows(seed)))
    over = Window.partitionBy(*keys).orderBy("t", "id")
    gap = F.col("t") - F.lag("t").over(over)
    plain = data.withColumn("gap", gap).withColumn("gap", F.when(F.col("gap") <= IDLE_US, F.col("gap")))
    want = plain.groupBy(*keys).agg(
        F.coalesce(F.sum("gap"), F.lit(0)).alias("all"),
        F.coalesce(F.sum(F.when(is_ai(), F.col("gap"))), F.lit(0)).alias("ai"),
        F.coalesce(F.sum(F.when(is_browsing(), F.col("gap"))), F.lit(0)).alias("br"),
    )
    names = [k for k in keys if k != "local_day"]
    by_day = "local_day" in keys
    flagged = flagged_slots(data, names, {"ai": is_ai(), "br": is_browsing()}, by_day=by_day)
    got = flagged.groupBy(*keys).agg(
        F.sum(active_us()).alias("all"), F.sum(active_us("ai")).alias("ai"), F.sum(active_us("br")).alias("br")
    )
    span = span_slots(data, names, by_day=by_day).groupBy(*keys).agg(F.sum(active_us()).alias("all"))
    order = [*keys]
    assert rows(got.orderBy(*order)) == rows(want.orderBy(*order))
    assert rows(span.orderBy(*order)) == rows(want.orderBy(*order).select(*keys, "all"))


@pytest.mark.parametrize("idle, slot_seconds", [(1, None), (7, None), (10, 1), (10, 86400)])
def test_other_idle_limits_and_slot_widths(hb, idle, slot_seconds):
    """Slots never cross local midnight, also where the limit does not divide a day."""
    data = with_slots(hb(*busy_rows(3)), idle_minutes=idle, slot_seconds=slot_seconds)
    over = Window.partitionBy("user_id").orderBy("t", "id")
    gap = F.col("t") - F.lag("t").over(over)
    want = data.withColumn("gap", gap).where(F.col("gap") <= idle * 60_000_000).groupBy("user_id").agg(F.sum("gap").alias("us"))
    got = span_slots(data, ["user_id"]).groupBy("user_id").agg(F.sum(active_us(idle_minutes=idle)).alias("us"))
    assert rows(got.orderBy("user_id")) == rows(want.orderBy("user_id"))
    assert data.groupBy("slot").agg(F.count_distinct("local_day").alias("n")).where("n > 1").isEmpty()


def test_grouped_slots_attribute_by_columns(hb):
    data = with_slots(hb(*busy_rows(4)))
    over = Window.partitionBy("user_id", "entity").orderBy("t", "id")
    gap = F.col("t") - F.lag("t").over(over)
    keys = ["user_id", "entity", "project", "language"]
    want = data.withColumn("gap", gap).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("gap") <= IDLE_US, F.col("gap"))), F.lit(0)).alias("us"), F.count("*").alias("n")
    )
    slots = grouped_slots(data, ["user_id", "entity"], ["project", "language"], F.count("*").alias("n"))
    got = slots.groupBy(*keys).agg(F.sum(active_us()).alias("us"), F.sum("n").alias("n"))
    assert rows(got.orderBy(*keys)) == rows(want.orderBy(*keys))


def test_one_slot_table_serves_several_ranges(hb):
    clock = Clock.at(when("12 12:00:00"))
    data = hb(*busy_rows(5))
    slots = span_slots(with_slots(data), ["user_id"])
    for day in (5, 6, 8):
        start = clock.day_start(datetime(2024, 1, day))
        alone = seconds_of(between(data, start, None, clock.as_of)).select("user_id", "coding_us")
        shared = slots.where(F.col("local_day") >= (datetime(2024, 1, day) - datetime(1970, 1, 1)).days)
        shared = shared.groupBy("user_id").agg(F.sum(active_us(since=start)).alias("coding_us"))
        assert rows(shared.orderBy("user_id")) == rows(alone.orderBy("user_id"))


def test_ide_and_browsing_add_up(hb):
    data = with_slots(hb(*busy_rows(6)))
    sums = flagged_slots(data, ["user_id"], {"ide": ~is_browsing(), "browsing": is_browsing()}).agg(
        F.sum(active_us()).alias("all"), F.sum(active_us("ide")).alias("ide"), F.sum(active_us("browsing")).alias("br")
    )
    got = one(sums)
    assert got["ide"] + got["br"] == got["all"] > 0


def test_empty_input(hb):
    empty = hb({"at": "05 00:00:00"}).where("false")
    assert rows(seconds_of(empty, flags=["ai"])) == []
    assert rows(key_stats(with_slots(empty), ["user_id"], lists=["project"], flags=["ide"])) == []
