"""Ledgers and the jobs that write tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from helpers import one, rows, when
from pyspark.sql import functions as F
from worktempo.jobs import leaderboard, upkeep
from worktempo.operators import ledger
from worktempo.plans import ledgers
from worktempo.sources import schemas, tables

AS_OF = when("26 12:00:00")


def requests(spark, schema, *dicts):
    return spark.createDataFrame(
        [tuple({"request_id": n, "user_id": "u", **d}.get(c) for c in schema.fieldNames()) for n, d in enumerate(dicts, 1)], schema
    )


def test_adjustment_requests(spark, users, adjustments):
    asked = requests(
        spark, schemas.ADJUSTMENT_REQUESTS,
        {"hours": "1", "minutes": "30", "op": "add", "reason": " late ", "adjustment_date": "2024-01-05"},
        {"hours": " 0.5 ", "op": "SUB", "adjustment_date": "2024-1-5"},
        {"minutes": "0.125"},
        {"hours": "x"}, {"hours": "NaN"}, {"minutes": "0"}, {"hours": "1", "op": "mul"},
        {"hours": "1", "adjustment_date": "05/01/2024"}, {"hours": "1", "adjustment_date": "2024-02-30"},
        {"hours": "1", "user_id": "ghost"}, {"hours": "x", "op": "mul"},
    )
    good, bad = ledger.ingest_adjustments(asked, users("u"), adjustments(("u", 1, "2024-01-01"), ("u", 1, "2024-01-02")), as_of=AS_OF)
    accepted = rows(good.orderBy("id"))
    assert [(r["id"], r["seconds"], r["adjustment_date"], r["reason"]) for r in accepted] == [
        (2, 5400, date(2024, 1, 5), "late"), (3, -1800, date(2024, 1, 5), None), (4, 8, date(2024, 1, 26), None),
    ]
    assert [r["error"] for r in rows(bad.orderBy("request_id"))] == [
        "invalid number", "invalid number", "not above zero", "invalid op", "invalid date", "invalid date", "unknown user",
        "invalid number",
    ]


def test_leave_requests(spark, users, leaves):
    asked = requests(
        spark, schemas.LEAVE_REQUESTS,
        {"start_date": "2024-01-05", "end_date": "2024-01-07", "leave_type": " sick "},
        {"start_date": " 2024-01-05 "},
        {"start_date": "2024-01-05", "end_date": "2024-01-04"}, {"start_date": "2024-01-05", "leave_type": "party"},
        {"start_date": "soon"}, {}, {"start_date": "2024-01-05", "user_id": "ghost"},
    )
    good, bad = ledger.ingest_leaves(asked, users("u"), leaves(("u", "2024-01-01", "2024-01-01")).where("false"), as_of=AS_OF)
    assert [(r["id"], str(r["start_date"]), str(r["end_date"]), r["leave_type"]) for r in rows(good.orderBy("id"))] == [
        (1, "2024-01-05", "2024-01-07", "sick"), (2, "2024-01-05", "2024-01-05", "annual"),
    ]
    assert [r["error"] for r in rows(bad.orderBy("request_id"))] == [
        "end before start", "invalid leave type", "invalid date", "start_date missing", "unknown user",
    ]


def test_tag_requests(spark, tags):
    asked = requests(
        spark, schemas.TAG_REQUESTS,
        {"tag_name": " new ", "domain_pattern": " a.com "},
        {"id": 7, "tag_name": "first", "domain_pattern": "b.com", "tag_color": "#2"},
        {"id": 7, "tag_name": "second", "domain_pattern": "c.com"},
        {"tag_name": "no pattern"}, {"id": 99, "tag_name": "nobody", "domain_pattern": "d.com"},
    )
    new, bad = ledger.apply_tag_requests(asked, tags((7, "old", "old.com"), (8, "kept", "kept.com")), as_of=AS_OF)
    got = {r["id"]: (r["tag_name"], r["tag_color"], r["tag_icon"], r["domain_pattern"]) for r in rows(new)}
    assert got == {
        7: ("second", "", "", "c.com"), 8: ("kept", "#1", "i", "kept.com"), 9: ("new", "#94a3b8", "🏷️", "a.com"),
    }
    assert one(bad)["tag_name"] == "no pattern"


def test_delete_and_backfill(spark, adjustments):
    table = adjustments(("u", 1, "2024-01-01"), ("u", 2, "2024-01-02"))
    assert one(ledger.delete_ids(table, spark.createDataFrame([(0,), (0,), (9,)], "id long")))["seconds"] == 2
    late = table.limit(1).withColumns({
        "adjustment_date": F.lit(None).cast("date"), "created_at": F.lit("2024-01-05 21:00:00").cast("timestamp_ntz"),
    })
    assert one(ledger.backfill_dates(late))["adjustment_date"] == date(2024, 1, 6)


def test_leave_days_clip_and_count_once(leaves):
    table = leaves(("a", "2024-01-01", "2024-01-31"), ("b", "2024-01-10", "2024-01-11"), ("b", "2024-01-11", "2024-01-12"),
                   ("c", "2024-01-20", "2024-01-21"), ("d", "2024-01-12", "2024-01-10"))
    got = rows(ledgers.leave_days(table, start="2024-01-10", end="2024-01-13"))
    assert sorted((r["user_id"], r["day"][-2:]) for r in got) == [
        ("a", "10"), ("a", "11"), ("a", "12"), ("a", "13"), ("b", "10"), ("b", "11"), ("b", "12"),
    ]
    totals = {r["user_id"]: r["total_days"] for r in rows(ledgers.leave_totals(table))}
    assert totals["b"] == 4 and totals["a"] == 31


def test_default_tags(spark, tags):
    empty = tags((1, "a", "b")).where("false")
    seeded = schemas.ensure_tags(empty)
    assert seeded.count() == 31 and seeded.where("id = 18").first()["domain_pattern"] == "x.com"
    assert schemas.ensure_tags(tags((1, "a", "b"))).count() == 1


def test_heartbeat_table_is_pruned_and_replaced_by_day(spark, hb, tmp_path):
    path = str(tmp_path / "hb")
    tables.write_heartbeats(hb({"at": "05 20:59:00"}, {"at": "05 21:01:00"}, {"at": "09 00:00:00"}), path, files_per_day=3)
    ranged = tables.read_heartbeats(spark, path, start=when("05 21:00:00"), end=when("05 23:00:00"))
    plan = ranged._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(local_day" in plan
    assert ranged.count() == 1
    tables.write_heartbeats(hb({"at": "09 00:00:00", "user_id": "x"}, {"at": "09 01:00:00", "user_id": "x"}), path)
    assert [r["user_id"] for r in rows(tables.read_heartbeats(spark, path).orderBy("time"))] == ["u", "u", "x", "x"]


def test_leaderboard_replaces_its_interval_only(spark, hb, users, tmp_path):
    path = str(tmp_path / "board")
    other = spark.createDataFrame([("o", "30_days", None, 5, None, AS_OF)], schemas.LEADERBOARD)
    leaderboard.refresh_leaderboard(other, path)
    data = hb({"at": "19 11:59:00"}, {"at": "19 12:01:00"}, {"at": "19 12:03:00.5"}, {"at": "19 12:02:00", "user_id": "hidden"})
    for _ in range(2):
        public = users("u").unionByName(users("hidden", public_leaderboard=False))
        leaderboard.refresh_leaderboard(leaderboard.leaderboard_7d(data, public, as_of=AS_OF), path)
    got = {r["user_id"]: (str(r["interval"]), r["total"]) for r in rows(spark.read.parquet(path))}
    assert got == {"o": ("30_days", 5), "u": ("7_days", 120_500_000_000)}


def test_share_flags(users):
    table = users("closed", share_data_max_days=0).unionByName(users("private", public_leaderboard=False)).unionByName(
        users("open", share_projects=False)
    )
    got = {r["id"]: (r["share_data_max_days"], r["public_leaderboard"], r["share_projects"]) for r in rows(upkeep.share_flags_update(table))}
    assert got == {"closed": (-1, True, True), "private": (-1, True, True), "open": (30, True, False)}


def test_retention_and_inactive_accounts(hb, users):
    old = datetime(2023, 1, 26, 12)
    data = hb({"time": old}, {"time": old - timedelta(microseconds=1)}, {"at": "26 00:00:00", "user_id": "b"})
    assert upkeep.retention_kept(data, as_of=AS_OF).count() == 2
    assert [r["id"] for r in rows(upkeep.inactive_accounts(data, users("u", "b"), as_of=AS_OF))] == ["u"]


def test_not_in_is_null_aware(hb, users):
    table = users("u", "v", None)
    assert [r["id"] for r in rows(upkeep.inactive_today(hb({"at": "26 00:00:00"}), table, as_of=AS_OF))] == ["v"]
    unknown = hb({"at": "26 00:00:00", "user_id": None})
    assert rows(upkeep.inactive_today(unknown, table, as_of=AS_OF)) == []
    assert len(rows(upkeep.inactive_today(unknown.where("false"), table, as_of=AS_OF))) == 3


def test_daily_text(spark, hb, tmp_path):
    text = upkeep.daily_activity(hb({"at": "26 00:00:00", "project": ""}, {"at": "26 01:00:00", "language": None}), as_of=AS_OF)
    got = one(text)
    assert got["projects"] == ", p" and "Aktif: 03:00 - 04:00" in got["block"]
    upkeep.write_text(text, "block", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 5


def test_report_files(spark, tmp_path):
    from worktempo.plans.export import write_report

    data = spark.createDataFrame([("u", "1sa 0dk")], "user_id string, ide_time string")
    for fmt in ("csv", "json", "parquet"):
        write_report(data, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first()["ide_time"] == "1sa 0dk"


@pytest.mark.parametrize("schema", [schemas.ADJUSTMENT_REQUESTS])
def test_ingest_into_an_empty_ledger(spark, users, adjustments, schema):
    good, _ = ledger.ingest_adjustments(
        requests(spark, schema, {"hours": "1"}), users("u"), adjustments(("u", 1, "2024-01-01")).where("false"), as_of=AS_OF
    )
    assert one(good)["id"] == 1
