"""Tables that jobs change, site tags by anchors, and how often a plan reads the heartbeats."""

from __future__ import annotations

from datetime import date, datetime
from pathlib import Path

import pytest
from helpers import rows
from pyspark.sql import functions as F
from worktempo import registry
from worktempo.jobs import leaderboard, tables
from worktempo.operators.tags import anchored, entity_pieces, matches, rules_by_id
from worktempo.plans import alerts, summary
from worktempo.sources import schemas, stored

DATA = Path("/root/testdata/sf0.01")
AS_OF = datetime(2024, 1, 26, 12)


@pytest.fixture
def database(spark, tmp_path):
    name = stored.new_database(spark, str(tmp_path / "db"))
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def ids(df):
    return {r["id"] for r in rows(df)}


def test_a_table_is_replaced_by_a_plan_that_reads_it(spark, database):
    name = f"{database}.t"
    stored.create(spark.createDataFrame([(1,), (2,)], "id bigint"), name)
    stored.append(spark.createDataFrame([(3,)], "id int"), name)
    stored.replace(stored.current(spark, name).where("id <> 2"), name)
    assert ids(stored.current(spark, name)) == {1, 3}
    stored.replace(stored.current(spark, name).where("false"), name)
    assert stored.current(spark, name).count() == 0
    assert [t.name for t in spark.catalog.listTables(database)] == ["t"]


def test_a_job_that_died_after_staging_is_finished_by_the_next(spark, database):
    name = f"{database}.t"
    stored.create(spark.createDataFrame([(1,), (2,)], "id bigint"), name)
    stored.stage(spark.table(name).where("id = 2"), name)
    assert ids(spark.table(name)) == {1, 2}
    assert ids(stored.current(spark, name)) == {2}


def test_sharing_and_deletion_jobs(spark, users, adjustments, database):
    people, ledger = f"{database}.users", f"{database}.adj"
    stored.create(users("a", "b", share_data_max_days=0), people)
    tables.open_sharing(spark, people)
    assert {r["share_data_max_days"] for r in rows(stored.current(spark, people))} == {-1}
    stored.create(adjustments(("a", 5, "2024-01-02"), ("b", 6, "2024-01-02")), ledger)
    tables.delete_rows(spark, ledger, spark.createDataFrame([(0,), (0,), (7,)], "id bigint"))
    assert [r["user_id"] for r in rows(stored.current(spark, ledger))] == ["b"]


def test_requests_are_checked_once(spark, users, adjustments, database):
    ledger = f"{database}.adj"
    stored.create(adjustments(("a", 5, "2024-01-02")), ledger)
    requests = spark.createDataFrame(
        [(1, "a", "1", None, None, "x", None), (2, "ghost", "1", None, None, "y", None), (3, "a", "no", None, None, "z", None)],
        "request_id bigint, user_id string, hours string, minutes string, op string, reason string, adjustment_date string")
    bad = tables.append_adjustments(spark, ledger, requests, users("a"), as_of=AS_OF)
    assert {(r["request_id"], r["error"]) for r in rows(bad)} == {(2, "unknown user"), (3, "invalid number")}
    assert {(r["id"], r["seconds"]) for r in rows(stored.current(spark, ledger))} == {(0, 5), (1, 3600)}


@pytest.fixture
def old_heartbeats(hb, database):
    name = f"{database}.hb"
    stored.store_heartbeats(hb(*[{"id": n, "at": at} for n, at in enumerate(
        ("05 06:00:00", "10 06:00:00", "10 14:00:00", "11 06:00:00"))]), name)
    return name


PURGE = {"as_of": datetime(2024, 2, 10, 12), "months": 1}


def test_purge_drops_old_days_and_swaps_the_boundary(spark, old_heartbeats):
    tables.purge_heartbeats(spark, old_heartbeats, **PURGE)
    assert ids(spark.table(old_heartbeats)) == {2, 3}
    assert stored.stored_days(spark, old_heartbeats) == [date(2024, 1, 10), date(2024, 1, 11)]
    tables.purge_heartbeats(spark, old_heartbeats, **PURGE)
    assert ids(spark.table(old_heartbeats)) == {2, 3}


@pytest.mark.parametrize("step", ["drop_days", "swap_days", "point_day", "remove_folder"])
@pytest.mark.parametrize("before", [True, False])
def test_a_purge_stopped_at_any_step_loses_nothing(spark, old_heartbeats, monkeypatch, step, before):
    real = getattr(stored, step)

    def stopped(*args, **options):
        if not before:
            real(*args, **options)
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(stored, step, stopped)
        with pytest.raises(RuntimeError, match="stopped"):
            tables.purge_heartbeats(spark, old_heartbeats, **PURGE)
    spark.catalog.refreshTable(old_heartbeats)
    assert {2, 3} <= ids(spark.table(old_heartbeats)) <= {0, 1, 2, 3}
    tables.purge_heartbeats(spark, old_heartbeats, **PURGE)
    assert ids(spark.table(old_heartbeats)) == {2, 3}


def test_a_boundary_day_without_young_rows_goes(spark, hb, database):
    name = f"{database}.hb"
    stored.store_heartbeats(hb({"id": 1, "at": "10 06:00:00"}, {"id": 2, "at": "12 06:00:00"}), name)
    tables.purge_heartbeats(spark, name, **PURGE)
    assert ids(spark.table(name)) == {2} and stored.stored_days(spark, name) == [date(2024, 1, 12)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["stored_week_by_user", "stored_range_report_users"])
def test_reports_list_only_the_days_of_their_range(spark, name):
    scans = [s for s in plan_of(registry.queries()[name](spark, str(DATA))).split("FileScan")[1:] if "worktempo_" in s]
    assert scans and all("PartitionFilters: [isnotnull(local_day" in s for s in scans)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_a_join_tells_which_days_are_read(spark):
    assert "dynamicpruning" in plan_of(registry.queries()["stored_leave_activity"](spark, str(DATA)))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_buckets_need_no_exchange_of_raw_rows(spark):
    df = registry.queries()["bucketed_attribution"](spark, str(DATA))
    plan = plan_of(df)
    assert "Bucketed: true" in plan
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("slot" in line for line in exchanges)
    per_bucket = spark.table(next(w for w in plan.replace("[", " ").split() if w.endswith(".slotted"))[len("spark_catalog."):])
    shares = [r["count"] for r in rows(per_bucket.where("user_id = 'user0'").groupBy(F.input_file_name()).count())]
    assert len(shares) > 500 and max(shares) < sum(shares) / 50


def test_an_opted_out_user_leaves_the_leaderboard(spark, hb, users, tmp_path):
    path = str(tmp_path / "board")
    data = hb({"at": "25 10:00:00"}, {"at": "25 10:05:00"})
    leaderboard.refresh_leaderboard(leaderboard.leaderboard_7d(data, users("u"), as_of=AS_OF), path)
    read = lambda: spark.read.schema("user_id string, total bigint, interval string").parquet(path)
    assert [r["total"] for r in rows(read())] == [300 * 10**9]
    gone = users("u", public_leaderboard=False)
    leaderboard.refresh_leaderboard(leaderboard.leaderboard_7d(data, gone, as_of=AS_OF), path)
    assert read().count() == 0


def test_rows_without_a_user_stay_a_group(hb):
    data = hb({"at": "26 10:00:00", "user_id": None}, {"at": "26 10:05:00", "user_id": None}, {"at": "26 10:00:00"})
    got = {r["user_id"]: r["coding_seconds"] for r in rows(summary.today_by_user(data, as_of=AS_OF))}
    assert got == {None: 300, "u": 0}


def test_alert_order(hb):
    """Weekend alerts: most time first, not by name."""
    def day(user, minutes):
        return [{"at": f"20 10:{m:02d}:00", "user_id": user} for m in range(0, minutes + 1, 5)]

    found = rows(alerts.alert_weekend(hb(*day("a", 10), *day("b", 50), *day("c", 30)), as_of=AS_OF, threshold=60))
    assert [r["user_id"] for r in found] == ["b", "c", "a"] and "sort_key" not in found[0]


def sites(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity string")


def test_anchors_tell_patterns_apart(spark, tags):
    names = [f"https://site{n}.example" for n in range(200)] + ["https://rare.example", "https://x.com"]
    rules = rules_by_id(tags((1, "A", "https://rare"), (2, "B", "X.com"), (3, "C", "//s"), *[
        (10 + n, "D", f"app{n}.example") for n in range(10, 60)]))
    picked = {r["pattern"]: r["piece"] for r in rows(anchored(rules))}
    assert picked["https://rare"] in ("rar", "are", "/ra", "//r") and picked["//s"] == "//s" and picked["x.com"] in ("x.c", "com")
    assert all(any(c.isdigit() for c in picked[f"app{n}.example"]) for n in range(10, 60))
    got = {(r["entity"], r["info"]["tag_name"]) for r in rows(matches(sites(spark, *names), rules))}
    assert got == {(n, "C") for n in names[:200]} | {("https://rare.example", "A"), ("https://x.com", "B")}


def test_pieces_are_bounded_by_the_length(spark, tags):
    long = "https://example.org/" + "abcdefghij" * 20
    rules = rules_by_id(tags(*[(n, "T", long[n:n + 4 + n]) for n in range(1, 30)]))
    assert entity_pieces(sites(spark, long), rules).count() <= len(long)


@pytest.mark.parametrize("patterns", [["a"], ["ab", "abc"], ["a", "abcd", "É"], ["%", "_b"], ["", "zz"]])
def test_matches_equal_contains(spark, tags, patterns):
    names = ["a", "AB", "xabcdx", "é%", "_b", "zz", "abc", "xabx", "z"]
    rules = rules_by_id(tags(*[(n, "T", p) for n, p in enumerate(patterns)]))
    got = sorted((r["entity"], r["place"]["id"]) for r in rows(matches(sites(spark, *names), rules)))
    assert got == sorted((e, n) for e in names for n, p in enumerate(patterns) if p.lower() in e.lower())


def executed_scans(df, column: str) -> int:
    """File scans of a column that ran. Adaptive plans change after planning, so what follows "Initial Plan" is left out; a
    reused exchange has no scan of its own."""
    df.collect()
    found, skip = 0, None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        place = len(line) - len(line.lstrip(" :+-*|"))
        if skip is not None and place >= skip:
            continue
        skip = line.index("==") if "== Initial Plan ==" in line else None
        found += "FileScan" in line and f"[{column}#" in line
    return found


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name, most", [
    ("inactive_today", 1), ("daily_report_team", 1), ("range_report_team", 1), ("weekly_report_team", 1), ("report_boxes", 1),
    ("alerts", 5), ("user_scorecard", 3),
])
def test_heartbeats_are_read_so_often_at_most(spark, name, most):
    assert 1 <= executed_scans(registry.queries()[name](spark, str(DATA)), "event_id") <= most
