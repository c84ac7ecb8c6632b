"""Report plans on hand-made tables."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from helpers import one, rows, when
from worktempo.functions.clock import Clock
from worktempo.plans import alerts, catalog, export, period, platform, productivity, realtime, sites, summary, user_detail

AS_OF = when("26 12:00:00")  # Friday, 15:00 local


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows(df)}


def steady(user, start, minutes, step=5, **columns):
    """Heartbeats every ``step`` minutes."""
    at = when(start)
    return [{"user_id": user, "time": at + timedelta(minutes=m), **columns} for m in range(0, minutes + 1, step)]


def test_clock_bounds():
    clock = Clock.at("2024-01-26 12:00:00")
    assert clock.today == when("25 21:00:00")
    assert clock.week == when("21 21:00:00") and clock.week_date == date(2024, 1, 22)
    assert clock.prev_week == when("14 21:00:00")
    assert clock.days_back(7) == when("18 21:00:00")
    assert Clock.at(when("25 21:30:00")).local_date == date(2024, 1, 26)


def test_realtime(hb):
    data = hb(
        {"at": "26 11:49:59", "user_id": "old"},
        {"at": "26 11:50:00", "user_id": "a", "editor": "Zed", "project": "z", "type": "domain"},
        {"at": "26 11:58:30.5", "user_id": "a", "editor": "Cursor", "project": "b"},
        {"at": "26 11:55:30", "user_id": "b", "editor": None, "category": None, "user_agent": None},
        {"at": "26 12:00:01", "user_id": "future"},
    )
    got = rows(realtime.realtime_active(data, as_of=AS_OF))
    assert [r["user_id"] for r in got] == ["a", "b"]
    a, b = got
    assert (a["editor"], a["latest_editor"], a["project"], a["recent_hb"]) == ("Zed", "Cursor", "b", 2)
    assert (a["seconds_ago"], a["status"], a["is_ai"], a["last_seen"]) == (90, "green", True, "14:58:30")
    assert a["today_coding_seconds"] == 511 and a["progress_pct"] == 2
    assert (b["status"], b["is_ai"]) == ("yellow", False)


def test_today_lists_and_counts(hb):
    data = hb(
        {"at": "25 21:00:00", "project": "", "language": ""}, {"at": "25 21:05:00", "project": None, "language": None},
        {"at": "25 21:09:00", "project": "b", "language": ""}, {"at": "25 20:59:00", "project": "yesterday"},
        {"at": "25 22:00:00", "project": "a", "language": ""},
    )
    got = one(summary.today_by_user(data, as_of=AS_OF))
    assert got["project_count"] == 3  # the empty name counts, NULL does not
    assert got["projects"] == "a, b" and got["languages"] is None
    assert (got["first_active"], got["last_active"], got["coding_seconds"]) == ("00:00", "01:00", 540)
    week = one(summary.week_by_user(data, as_of=AS_OF))
    assert (week["heartbeats"], week["active_days"], week["coding_seconds"]) == (5, 2, 600)


def test_scorecard_floors_dashes_and_trends(hb, users, adjustments):
    data = hb(
        *steady("a", "26 06:00:00", 60), *steady("b", "26 06:00:00", 10), *steady("a", "18 06:00:00", 300),
        *steady("c", "22 06:00:00", 10, project="", language=None),
    )
    adj = adjustments(("a", 600, "2024-01-26"), ("b", -100000, "2024-01-26"), ("d", 120, "2024-01-26"), ("d", 60, "2024-01-22"))
    got = by(summary.user_scorecard(data, users("a", "b", "c", "d"), adj, as_of=AS_OF), "user_id")
    assert got["a"]["today_coding_seconds"] == 4200 and got["a"]["avg_daily_4w"] == 18000
    assert got["a"]["today_trend_pct"] == -77 and got["a"]["week_trend_pct"] == -7
    assert got["b"]["today_coding_seconds"] == 0 and got["b"]["today_adjustment_seconds"] == -100000
    assert got["b"]["today_trend_pct"] is None
    assert got["c"]["today_projects"] == "-" and got["c"]["week_projects"] is None and got["c"]["week_project_count"] == 1
    assert got["d"]["today_coding_seconds"] == 120 and got["d"]["week_coding_seconds"] == 180
    assert got["d"]["week_projects"] == "-" and got["d"]["week_heartbeats"] == 0
    team = one(summary.team_kpis(data, users("a", "b", "c", "d"), adj, as_of=AS_OF))
    assert team["total_coding_today"] == 0  # floored once, on the sum
    assert (team["active_today"], team["inactive_today"], team["prev_week_coding"]) == (2, 2, 18000)
    assert team["week_delta_pct"] == -100


def test_daily_breakdown_keeps_adjustment_only_days(hb, adjustments):
    data = hb(*steady("a", "25 06:00:00", 10))
    adj = adjustments(("a", 60, "2024-01-25"), ("a", 30, "2024-01-25"), ("z", -5, "2024-01-20"), ("z", 9, "2023-01-01"))
    got = by(summary.daily_breakdown(data, adj, as_of=AS_OF), "user_id", "day")
    assert set(got) == {("a", "2024-01-25"), ("z", "2024-01-20")}
    assert got["a", "2024-01-25"]["coding_seconds"] == 690
    assert got["z", "2024-01-20"] | {} == {
        "day": "2024-01-20", "user_id": "z", "heartbeats": 0, "projects": "-", "languages": "-", "first_active": "-",
        "last_active": "-", "coding_seconds": 0, "adjustment_seconds": -5, "ai_heartbeats": 0, "ai_coding_seconds": 0,
    }
    every = by(user_detail.user_daily(data, adj, as_of=AS_OF), "user_id", "day")
    assert ("z", "2023-01-01") in every
    trend = by(user_detail.user_weekly_trend(data, adj, as_of=AS_OF), "user_id", "day")
    assert set(trend) == {("a", "2024-01-25")}


def test_projects_drop_empty_names_and_top_is_cut(hb):
    data = hb(*[{"at": f"26 0{n % 10}:00:00", "project": f"p{n:02}"} for n in range(12)],
              {"at": "26 01:00:00", "project": ""}, {"at": "26 01:00:00", "project": None})
    top = rows(user_detail.user_projects(data, as_of=AS_OF))
    assert [r["name"] for r in sorted(top, key=lambda r: r["rank"])] == [f"p{n:02}" for n in range(10)]
    assert len(rows(catalog.projects(data, as_of=AS_OF))) == 12


def test_ai_totals_take_gaps_between_ai_rows_only(hb, users):
    ai = {"category": "ai coding"}
    data = hb({"at": "26 00:00:00", **ai}, {"at": "26 00:08:00"}, {"at": "26 00:16:00", **ai})
    got = by(user_detail.user_ai_totals(data, users("u", "v"), as_of=AS_OF), "user_id")
    assert (got["u"]["ai_heartbeats"], got["u"]["ai_coding_seconds"], got["v"]["ai_heartbeats"]) == (2, 0, 0)
    assert one(summary.today_by_user(data, as_of=AS_OF))["ai_coding_seconds"] == 480


def test_hours_are_dense(hb, users):
    got = rows(user_detail.user_hourly(hb({"at": "25 21:30:00"}, {"at": "26 11:00:00"}), users("u", "v"), as_of=AS_OF))
    assert len(got) == 48
    assert {r["hour"]: r["heartbeats"] for r in got if r["user_id"] == "u" and r["heartbeats"]} == {0: 1, 14: 1}


def test_active_days_of_the_overview_are_utc(hb, users):
    data = hb({"at": "25 20:00:00"}, {"at": "25 22:00:00"})
    assert by(catalog.users_overview(data, users("u"), as_of=AS_OF), "user_id")["u"]["active_days"] == 1
    assert one(user_detail.user_totals(data, as_of=AS_OF))["total_active_days"] == 2


@pytest.fixture
def seed(tags):
    return tags((1, "İş", "github.com"), (11, "Eğlence", "netflix.com"), (18, "Sosyal Medya", "x.com"), (22, "AI", "claude.ai"),
                (40, "Team", "GitHub.com"))


def site(at, entity, **columns):
    return {"at": at, "type": "domain", "entity": entity, "category": "browsing", **columns}


def test_first_matching_tag_wins(hb, seed):
    data = hb(site("26 06:00:00", "https://www.netflix.com"), site("26 06:01:00", "https://Claude.ai"),
              site("26 06:02:00", "https://github.com"), site("26 06:03:00", "http://plain"), site("26 06:04:00", ""))
    got = by(sites.user_sites(data, seed, as_of=AS_OF), "entity")
    assert got["https://www.netflix.com"]["tag_name"] == "Eğlence"
    assert got["https://Claude.ai"]["tag_name"] == "AI"
    # Listed by tag name the pattern stands where 'Team' puts it, and the last tag of the pattern is 'İş'.
    assert got["https://github.com"]["tag_name"] == "İş"
    assert got["http://plain"]["tag_name"] is None and "" not in got
    daily = by(period.daily_report_site_tags(data, seed, as_of=AS_OF), "entity")
    assert daily["https://github.com"]["tag_name"] == "İş" and daily["http://plain"]["tag_name"] == "Etiketlenmemiş"
    assert [r["entity"] for r in rows(sites.untagged_domains(data, seed, as_of=AS_OF))] == ["http://plain"]
    stats = by(sites.user_tag_stats(data, seed, as_of=AS_OF), "tag_name")
    assert stats["Etiketlenmemiş"]["heartbeats"] == 1


def test_no_tags_at_all(hb, tags):
    data = hb(site("26 06:00:00", "https://x.com"))
    none = tags((1, "a", "b")).where("false")
    assert one(sites.user_sites(data, none, as_of=AS_OF))["tag_name"] is None
    assert len(rows(sites.untagged_domains(data, none, as_of=AS_OF))) == 1


def test_tag_matching_equals_brute_force(spark, hb, tags):
    import random
    from worktempo.operators.tags import first_match, matches, rules_by_id, rules_by_name

    rng = random.Random(7)
    word = lambda lo, hi: "".join(rng.choice("abA.") for _ in range(rng.randint(lo, hi)))
    patterns = [(n, rng.choice("XYZ"), word(1, 4)) for n in range(40)]
    entities = sorted({word(1, 12) for _ in range(200)})
    table = tags(*patterns)
    data = hb(*[site("26 06:00:00", e) for e in entities])
    want = {(e, p.lower()) for e in entities for _, _, p in patterns if p.lower() in e.lower()}
    rules = rules_by_id(table)
    found = matches(data, rules.withColumn("info", rules["pattern"])).collect()
    assert {(r["entity"], r["info"]) for r in found} == want and len(found) == len(want)

    def first(order, last_tag):
        seen = {}
        for n, name, p in sorted(patterns, key=order):
            seen[p.lower()] = name if last_tag else seen.get(p.lower(), name)
        return {e: next((t for p, t in seen.items() if p in e.lower()), None) for e in entities}

    for rule, order, last_tag in ((rules_by_name, lambda r: (r[1], r[0]), True), (rules_by_id, lambda r: r[0], False)):
        got = {r["entity"]: r["tag_name"] for r in first_match(data, rule(table)).collect()}
        assert got == {e: t for e, t in first(order, last_tag).items() if t is not None}


def test_daily_report(hb, adjustments):
    data = hb(*steady("a", "26 06:00:00", 10), *steady("a", "26 06:10:00", 10, category="browsing", type="domain"),
              *steady("b", "26 06:00:00", 20, category="browsing"))
    adj = adjustments(("b", -50, "2024-01-26"), ("z", 100, "2024-01-26"), ("y", -3, "2024-01-26"))
    got = by(period.daily_report_users(data, adj, as_of=AS_OF), "user_id")
    assert (got["a"]["ide_coding_seconds"], got["a"]["browsing_seconds"], got["a"]["productivity"]) == (600, 600, 50)
    assert (got["a"]["file_heartbeats"], got["a"]["domain_heartbeats"]) == (3, 3)
    assert (got["b"]["ide_coding_seconds"], got["b"]["coding_seconds"], got["b"]["productivity"]) == (0, 1150, 0)
    assert (got["z"]["productivity"], got["y"]["productivity"], got["z"]["projects"]) == (100, 0, "-")
    team = one(period.daily_report_team(data, adj, as_of=AS_OF))
    assert (team["total_users"], team["avg_productivity"], team["team_productivity"]) == (4, 38, 28)


def test_range_report(hb, adjustments):
    data = hb(*steady("a", "23 06:00:00", 10), *steady("b", "23 06:05:00", 10), *steady("a", "24 22:00:00", 10))
    adj = adjustments(("a", 5, "2024-01-23"), ("z", -9, "2024-01-21"), ("z", 1, "2024-02-01"))
    at = {"as_of": AS_OF, "start": "2024-01-21", "end": "2024-01-24"}
    days = rows(period.range_report_days(data, adj, **at))
    assert days == [
        {"day": "2024-01-21", "heartbeats": 0, "active_users": 0, "coding_seconds": 0},
        {"day": "2024-01-23", "heartbeats": 6, "active_users": 2, "coding_seconds": 905},
    ]
    users = by(period.range_report_users(data, adj, **at), "user_id")
    assert users["a"]["active_days"] == 1 and users["a"]["coding_seconds"] == 605 and users["z"]["coding_seconds"] == 0
    assert one(period.range_report_team(data, adj, **at))["days"] == 4
    with pytest.raises(ValueError):
        period.range_report_days(data, adj, as_of=AS_OF, start="2024-01-24", end="2024-01-21")
    assert period.week_of(AS_OF, "2024-01-28") == {"start": date(2024, 1, 22), "end": date(2024, 1, 28)}


def test_report_rows(spark):
    cols = "user_id string, ide_coding_seconds bigint, browsing_seconds bigint, ai_coding_seconds bigint, productivity bigint, " \
           "first_active string, last_active string, active_days bigint, projects string, languages string"
    data = spark.createDataFrame([("u", 7500, 59, 0, 71, "09:00", "10:00", 3, "p" * 40, None)], cols)
    daily = one(export.report_rows(data, "daily"))
    assert (daily["ide_time"], daily["browsing_time"], daily["ai_time"]) == ("2sa 5dk", "0dk", "-")
    assert (daily["hours"], daily["productivity_text"], len(daily["projects"]), daily["languages"]) == ("09:00 - 10:00", "%71", 34, "-")
    ranged = one(export.report_rows(data, "range", 15))
    assert (ranged["active_days_text"], len(ranged["projects"])) == ("3/15", 32)


def test_productivity_consistency_can_exceed_100(hb):
    data = hb(*[{"at": f"{d} 08:00:00"} for d in range(19, 27)], *steady("u", "26 09:00:00", 10))
    got = one(productivity.productivity(data, as_of=AS_OF))
    assert (got["active_days"], got["consistency"], got["productivity"], got["score"]) == (8, 114, 100, 106)


def test_streaks(hb):
    def days(user, *numbers):
        return [r for d in numbers for r in steady(user, f"{d} 00:00:00", 600, 10)]

    data = hb(*days("three", 20, 21, 22, 24), *steady("three", "23 00:00:00", 10), *days("gap", 20, 22, 23))
    got = rows(alerts.alert_burnout(data, as_of=AS_OF))
    assert [r["user_id"] for r in got] == ["three"]
    assert got[0]["message"].startswith("Üst üste 3 gün 10 saatin")


def test_weekend_needs_long_days(hb):
    data = hb(*steady("a", "20 06:00:00", 150, 10), *steady("a", "21 06:00:00", 120, 10), *steady("b", "19 06:00:00", 300, 10))
    got = one(alerts.alert_weekend(data, as_of=AS_OF))
    assert got["user_id"] == "a" and "toplam 2 saat (1 gün)" in got["message"]


def test_inactive_and_leave_alerts(hb, users, leaves):
    off = leaves(("l", "2024-01-20", "2024-01-26"), ("m", "2024-01-27", "2024-01-28"))
    everyone = users("a", "b", "c", "d", "e", "f", "l", "z")
    data = hb({"at": "26 01:00:00", "user_id": "z"})
    got = one(alerts.alert_inactive(data, everyone, off, as_of=AS_OF))
    assert got["message"] == "6 kullanıcı bugün hiç aktif olmadı: a, b, c, d, e..." and got["alert_count"] == 6
    assert one(alerts.alert_on_leave(off, as_of=AS_OF))["message"] == "1 kişi izinli: l"
    early = when("26 07:59:59")  # 10:59 local
    assert rows(alerts.alert_inactive(data, everyone, off, as_of=early)) == []
    assert rows(alerts.alert_inactive(data, users("z"), off, as_of=AS_OF)) == []


def test_activity_drop(hb, leaves):
    data = hb(*[{"at": f"16 {h:02}:00:00", "user_id": u} for u in ("drop", "off") for h in range(20)],
              *[{"at": f"23 0{h}:00:00", "user_id": "drop"} for h in range(5)],
              *[{"at": f"16 {h:02}:00:00", "user_id": "same"} for h in range(20)],
              *[{"at": f"23 0{h}:00:00", "user_id": "same"} for h in range(6)])
    off = leaves(("off", "2024-01-20", "2024-01-21"), ("off", "2024-01-21", "2024-01-22"), ("drop", "2024-01-20", "2024-01-21"))
    got = one(alerts.alert_activity_drop(data, off, as_of=AS_OF, min_prev=19))
    assert got["user_id"] == "drop" and "%75" in got["message"]
    assert rows(alerts.alert_activity_drop(data, off, as_of=AS_OF)) == []


def test_entertainment_gaps_run_across_sites(hb, seed):
    data = hb(*[site(f"26 06:{m:02}:00", "https://x.com" if m % 2 else "https://www.netflix.com") for m in range(0, 60, 5)],
              site("26 06:01:00", "https://github.com"))
    assert one(alerts.alert_entertainment(data, seed, as_of=AS_OF, threshold=3299))["message"].startswith("Bugün 55 dakika")
    assert rows(alerts.alert_entertainment(data, seed, as_of=AS_OF, threshold=3300)) == []


def test_heartbeat_rate(hb):
    got = rows(platform.heartbeat_rate(hb({"at": "26 06:00:10"}, {"at": "26 06:00:50"}, {"at": "26 06:04:00"}), as_of=AS_OF))
    assert [(r["minute"][-5:], r["heartbeats"]) for r in got] == [
        ("06:01", 2), ("06:02", 2), ("06:03", 2), ("06:04", 2), ("06:05", 3), ("06:06", 1), ("06:07", 1), ("06:08", 1), ("06:09", 1)
    ]
    assert got[0]["per_minute"] == 0.4


def test_nested_languages(hb):
    data = hb(*steady("a", "26 06:00:00", 10, language="Go"), *steady("a", "26 07:00:00", 20, language="SQL"))
    (got,) = catalog.languages_by_user_nested(data, as_of=AS_OF).collect()
    assert [(i["name"], i["coding_seconds"]) for i in got["languages"]] == [("SQL", 1200), ("Go", 600)]
