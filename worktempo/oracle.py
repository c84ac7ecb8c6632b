"""The same results as plain SQL over the same Parquet tables, for checking.

Written from the rules, not from the plans: one LAG over the whole key per query, a nested loop for tags, scalar
SQL for the ledgers. Nothing here runs on Spark.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from types import SimpleNamespace

from worktempo.sources.derived import table_sql

# Bounds and fixed values are written out once more here, so that a wrong one in the plans shows.
AS_OF = datetime(2024, 1, 26, 12)
TODAY = AS_OF.date()
C = SimpleNamespace(
    today=datetime(2024, 1, 25, 21), week=datetime(2024, 1, 21, 21), prev_week=datetime(2024, 1, 14, 21),
    week_date=datetime(2024, 1, 22).date(),
    days_back=lambda n: datetime(2024, 1, 25, 21) - timedelta(days=n),
    day_start=lambda day: datetime(day.year, day.month, day.day) - timedelta(hours=3),
)
reg = SimpleNamespace(
    REPORT_DAY="2024-01-25", RANGE={"start": "2024-01-10", "end": "2024-01-24"},
    LEAVE_RANGE={"start": "2024-01-20", "end": "2024-01-27"}, LEISURE_SECONDS=300, MIN_PREV=10, BURNOUT_SECONDS=1800,
    WEEKEND_SECONDS=900, RETENTION_DAYS_AS_OF=datetime(2025, 1, 20, 12), INACTIVE_AS_OF=datetime(2024, 7, 20, 12),
    DELETE_COLUMNS={"adjustments": ["id", "user_id", "seconds"], "leaves": ["id", "user_id", "leave_type"],
                    "tags": ["id", "tag_name", "domain_pattern"]},
)
AI_EDITORS = ["cursor", "windsurf", "trae"]
AI_USERAGENT_KEYWORDS = ["claudecode", "copilot", "codeium", "tabnine", "supermaven", "cody"]
AI_CATEGORY = "ai coding"
LEAVE_TYPES = ["annual", "sick", "holiday", "other"]
LEISURE_TAGS = ["Eğlence", "Sosyal Medya"]
UNTAGGED, UNTAGGED_COLOR = "Etiketlenmemiş", "#475569"
BOXES = {'Aktif Kullanici': 'total_users',
 'IDE Sure': 'total_coding_seconds',
 'Tarayici Sure': 'total_browsing_seconds',
 'AI Sure': 'total_ai_seconds',
 'Takim Verimlilik': 'team_productivity'}
al = SimpleNamespace(TEXTS={
    "inactive": ("warning", "⚠️", "Bugün İnaktif Kullanıcılar",
        "{n} kullanıcı bugün hiç aktif olmadı: {names}"),
    "on_leave": ("info", "🏝️", "Bugün İzinli Kullanıcılar",
        "{n} kişi izinli: {names}"),
    "entertainment": ("danger", "🎮", "{user} — Yüksek Eğlence Kullanımı",
        "Bugün {minutes} dakika eğlence/sosyal medya sitelerinde"),
    "activity_drop": ("info", "📉", "{user} — Aktivite Düşüşü",
        "Bu hafta %{drop} daha az aktif (geçen hafta: {prev} HB, bu hafta: {this} HB)"),
    "burnout": ("danger", "🔥", "{user} — Burnout Riski",
        "Üst üste {streak} gün {hours} saatin üzerinde kod yazmış. Mola önerisi yerinde olabilir."),
    "weekend": ("warning", "🏖️", "{user} — Hafta Sonu Çalışması",
        "Son {days} günün hafta sonlarında toplam {hours} saat ({weekend_days} gün). İş-yaşam dengesi kontrol edilebilir."),
})
al.KINDS = list(al.TEXTS)
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def _ts(value: datetime) -> str:
    return f"TIMESTAMP '{value.isoformat(sep=' ')}'"


def _date(value) -> str:
    return f"DATE '{value}'"


_AI = " OR ".join(
    [f"lower(coalesce(editor, '')) LIKE '%{w}%'" for w in AI_EDITORS]
    + [f"lower(coalesce(user_agent, '')) LIKE '%{w}%'" for w in AI_USERAGENT_KEYWORDS]
    + [f"lower(coalesce(category, '')) = '{AI_CATEGORY}'"]
)
_HB = (
    "SELECT *, epoch_us(time) AS t, time + INTERVAL 3 HOUR AS lt, CAST(time + INTERVAL 3 HOUR AS DATE) AS day, "
    f"({_AI}) AS ai, lower(coalesce(category, '')) = 'browsing' AS br FROM ({table_sql('heartbeats')}) h "
    f"WHERE time <= {_ts(AS_OF)}"
)
_SITE = "type IN ('domain', 'url') AND entity <> ''"


def _with(*parts: str | tuple[str, str], hb: bool = True) -> str:
    """WITH clause: table names are taken from the derived tables, pairs are given as (name, SQL)."""
    found = [("hb", _HB)] if hb else []
    for part in parts:
        found.append((part, table_sql(part)) if isinstance(part, str) else part)
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in found) + " "


def _ordered(keys: str, where: str, name: str = "o") -> tuple[str, str]:
    """Rows of a range with the gap to the previous row of the key."""
    over = f"PARTITION BY {keys} ORDER BY t, id" if keys else "ORDER BY t, id"
    return name, f"SELECT *, t - lag(t) OVER ({over}) AS gap FROM hb WHERE {where}"


def _us(cond: str = "true") -> str:
    return f"coalesce(sum(CASE WHEN gap <= 600000000 AND {cond} THEN gap ELSE 0 END), 0)"


def _sec(us: str) -> str:
    return f"CAST(({us} + 500000) // 1000000 AS BIGINT)"


def _act(cond: str = "true") -> str:
    return _sec(_us(cond))


def _list(name: str) -> str:
    return f"string_agg(DISTINCT nullif({name}, ''), ', ' ORDER BY nullif({name}, ''))"


def _fmt(expr: str, pattern: str = "%H:%M") -> str:
    return f"strftime({expr}, '{pattern}')"


def _day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def _round(expr: str) -> str:
    return f"CAST(round_even({expr}, 0) AS BIGINT)"


def _pct(part: str, whole: str) -> str:
    return _round(f"CAST({part} AS DOUBLE) / greatest({whole}, 1) * 100")


def _big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def _since(start: datetime, end: datetime | None = None) -> str:
    return f"time >= {_ts(start)}" + (f" AND time < {_ts(end)}" if end else "")


def _days_back(n: int) -> str:
    return _since(C.days_back(n))


_FIRST_LAST = f"{_fmt('min(lt)')} AS first_active, {_fmt('max(lt)')} AS last_active"
_AI_COLS = f"count(*) FILTER (WHERE ai) AS ai_heartbeats, {_act('ai')} AS ai_coding_seconds"

_PERIOD_AGG = (
    "SELECT {keys}, count(*) AS heartbeats, count(DISTINCT nullif(project, '')) AS project_count, "
    f"{_list('project')} AS projects, {_list('language')} AS languages, {_list('editor')} AS editors, "
    f"count(DISTINCT day) AS active_days, {_FIRST_LAST}, {_act()} AS coding_seconds, "
    f"{_act('NOT br')} AS ide_coding_seconds, {_act('br')} AS browsing_seconds, {_act('ai')} AS ai_coding_seconds, "
    "count(*) FILTER (WHERE ai) AS ai_heartbeats, count(*) FILTER (WHERE type = 'file') AS file_heartbeats, "
    "count(*) FILTER (WHERE type IN ('domain', 'url')) AS domain_heartbeats FROM o GROUP BY {keys}"
)


def _adj(start=None, end=None, keys: str = "user_id") -> str:
    conds = []
    if start:
        conds.append(f"adjustment_date >= {_date(start)}")
    if end:
        conds.append(f"adjustment_date <= {_date(end)}")
    where = f" WHERE {' AND '.join(conds)}" if conds else ""
    return f"SELECT {keys}, sum(seconds) AS adj FROM adjustments{where} GROUP BY {keys}"


_dashes = "CASE WHEN s.heartbeats IS NULL THEN '-' ELSE {c} END AS {c}"


def _dash(*names: str) -> str:
    return ", ".join(_dashes.format(c=n) for n in names)


def _zero(*names: str) -> str:
    return ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)


def _daily(days: int | None, lists: list[str], adj_range: tuple | None) -> str:
    """User and day with adjustments of a date range (all dates if None)."""
    sums = (
        f"SELECT user_id, day, count(*) AS heartbeats, "
        + ", ".join(f"{_list(n)} AS {n}s" for n in lists)
        + f", {_FIRST_LAST}, {_act()} AS coding_seconds, {_AI_COLS} FROM o GROUP BY user_id, day"
    )
    adj = _adj(*(adj_range or (None, None)), keys="user_id, adjustment_date")
    return (
        _with("adjustments", _ordered("user_id, day", _days_back(days)), ("s", sums), ("a", adj))
        + f"SELECT {_day('coalesce(s.day, a.adjustment_date)')} AS day, coalesce(s.user_id, a.user_id) AS user_id, "
        f"{_zero('heartbeats')}, {_dash(*[f'{n}s' for n in lists], 'first_active', 'last_active')}, "
        f"{_big('greatest(coalesce(coding_seconds, 0) + coalesce(adj, 0), 0)')} AS coding_seconds, "
        f"{_big('coalesce(adj, 0)')} AS adjustment_seconds, {_zero('ai_heartbeats', 'ai_coding_seconds')} "
        "FROM s FULL JOIN a ON s.user_id = a.user_id AND s.day = a.adjustment_date"
    )


def _top(key: str, where: str, n: int, cols: str, aggs: str = "", order: str | None = None) -> str:
    order = order or f"coding_seconds DESC, {key}"
    return (
        _with(
            _ordered(f"user_id, {key}", where),
            ("s", f"SELECT user_id, {key}, count(*) AS heartbeats, {_act()} AS coding_seconds{aggs} FROM o GROUP BY user_id, {key}"),
            ("r", f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rank FROM s"),
        )
        + f"SELECT user_id, CAST(rank AS INT) AS rank, {cols}, heartbeats, coding_seconds FROM r WHERE rank <= {n}"
    )


def _period_users(start, end) -> tuple[list, str]:
    """CTEs up to ``u``: users of local days [start, end] merged with adjustments."""
    lo, hi = C.day_start(start), C.day_start(end + timedelta(days=1))
    merged = (
        "SELECT coalesce(s.user_id, a.user_id) AS user_id, "
        + _zero("heartbeats", "active_days", "browsing_seconds", "ai_coding_seconds", "file_heartbeats",
                "domain_heartbeats", "project_count")
        + ", " + _dash("projects", "languages", "editors", "first_active", "last_active")
        + f", {_big('greatest(coalesce(coding_seconds, 0) + coalesce(adj, 0), 0)')} AS coding_seconds"
        f", {_big('greatest(coalesce(ide_coding_seconds, 0) + coalesce(adj, 0), 0)')} AS ide_coding_seconds"
        f", {_big('coalesce(adj, 0)')} AS adjustment_seconds "
        "FROM s FULL JOIN a ON s.user_id = a.user_id"
    )
    scored = (
        "SELECT *, CASE WHEN ide_coding_seconds + browsing_seconds > 0 THEN "
        + _pct("ide_coding_seconds", "ide_coding_seconds + browsing_seconds")
        + " ELSE 0 END AS productivity, CASE WHEN ide_coding_seconds > 0 THEN "
        + _pct("ai_coding_seconds", "ide_coding_seconds") + " ELSE 0 END AS ai_pct FROM m"
    )
    ctes = [
        "adjustments", _ordered("user_id", _since(lo, hi)), ("s", _PERIOD_AGG.format(keys="user_id")),
        ("a", _adj(start, end)), ("m", merged), ("u", scored),
    ]
    return ctes, "u"


_TEAM = (
    "SELECT count(*) AS total_users, " + ", ".join(
        f"{_big(f'coalesce(sum({c}), 0)')} AS {a}" for c, a in [
            ("ide_coding_seconds", "total_coding_seconds"), ("browsing_seconds", "total_browsing_seconds"),
            ("ai_coding_seconds", "total_ai_seconds"), ("productivity", "productivity_sum"),
        ]
    ) + " FROM u"
)
_TEAM_PCT = _pct("total_coding_seconds", "total_coding_seconds + total_browsing_seconds")

_DAILY_COLS = (
    "user_id, heartbeats, projects, languages, editors, first_active, last_active, coding_seconds, ide_coding_seconds, "
    "browsing_seconds, adjustment_seconds, ai_coding_seconds, ai_pct, productivity, file_heartbeats, domain_heartbeats"
)
_RANGE_COLS = (
    "user_id, heartbeats, projects, languages, editors, active_days, first_active, last_active, coding_seconds, "
    "ide_coding_seconds, browsing_seconds, adjustment_seconds, ai_coding_seconds, productivity, project_count"
)


def _day_of(text: str):
    return datetime.fromisoformat(text).date()


def _period_cols(start, end, cols: str) -> str:
    ctes, name = _period_users(start, end)
    return _with(*ctes) + f"SELECT {cols} FROM {name}"


def _period_team(start, end, daily: bool) -> str:
    ctes, _ = _period_users(start, end)
    avg = _round("CAST(productivity_sum AS DOUBLE) / greatest(total_users, 1)")
    extra = f"{avg} AS avg_productivity" if daily else f"CAST({(end - start).days + 1} AS INT) AS days"
    return (
        _with(*ctes, ("w", _TEAM))
        + "SELECT total_users, total_coding_seconds, total_browsing_seconds, total_ai_seconds, "
        f"{extra}, {_TEAM_PCT} AS team_productivity FROM w"
    )


def _period_days(start, end) -> str:
    lo, hi = C.day_start(start), C.day_start(end + timedelta(days=1))
    return (
        _with(
            "adjustments", _ordered("day", _since(lo, hi)),
            ("s", f"SELECT day, count(*) AS heartbeats, count(DISTINCT user_id) AS active_users, {_act()} AS coding_seconds FROM o GROUP BY day"),
            ("a", _adj(start, end, keys="adjustment_date")),
        )
        + f"SELECT {_day('coalesce(day, adjustment_date)')} AS day, {_zero('heartbeats', 'active_users')}, "
        f"{_big('greatest(coalesce(coding_seconds, 0) + coalesce(adj, 0), 0)')} AS coding_seconds "
        "FROM s FULL JOIN a ON day = adjustment_date"
    )


def _duration(sec: str) -> str:
    return (
        f"CASE WHEN {sec} = 0 THEN '-' WHEN {sec} >= 3600 THEN concat({sec} // 3600, 'sa ', ({sec} % 3600) // 60, 'dk') "
        f"ELSE concat(({sec} % 3600) // 60, 'dk') END"
    )


def _rows(start, end, layout: str, days: int) -> str:
    ctes, _ = _period_users(start, end)
    clip = {"daily": 34, "range": 32, "weekly": 34}[layout]
    middle = (
        "concat(first_active, ' - ', last_active) AS hours" if layout == "daily"
        else f"concat(active_days, '/{days}') AS active_days_text"
    )
    return (
        _with(*ctes)
        + f"SELECT user_id, {middle}, {_duration('ide_coding_seconds')} AS ide_time, "
        f"{_duration('browsing_seconds')} AS browsing_time, {_duration('ai_coding_seconds')} AS ai_time, "
        f"concat('%', productivity) AS productivity_text, substring(coalesce(nullif(projects, ''), '-'), 1, {clip}) AS projects, "
        "substring(coalesce(nullif(languages, ''), '-'), 1, 30) AS languages FROM u"
    )


def _boxes(start, end) -> str:
    ctes, _ = _period_users(start, end)
    picks = []
    for n, (label, name) in enumerate(BOXES.items(), start=1):
        value = _duration(name)
        if name == "total_users":
            value = "CAST(total_users AS VARCHAR)"
        elif name == "team_productivity":
            value = f"concat('%', {_TEAM_PCT})"
        picks.append(f"SELECT CAST({n} AS INT) AS position, '{label}' AS label, {value} AS value FROM w")
    return _with(*ctes, ("w", _TEAM)) + " UNION ALL ".join(picks)


# --- tags -----------------------------------------------------------------------------------------------------

_RULES_BY_NAME = (
    "SELECT pattern, min(n) AS n, arg_max(tag_name, n) AS tag_name, arg_max(tag_color, n) AS tag_color, "
    "arg_max(tag_icon, n) AS tag_icon FROM (SELECT lower(domain_pattern) AS pattern, tag_name, tag_color, tag_icon, "
    "row_number() OVER (ORDER BY tag_name, id) AS n FROM tags) x GROUP BY pattern"
)
_RULES_BY_ID = "SELECT lower(domain_pattern) AS pattern, tag_name, tag_color, tag_icon, id AS n FROM tags"


def _tagging(rules: str, source: str) -> list[tuple[str, str]]:
    return [
        ("rules", rules),
        ("ent", f"SELECT DISTINCT entity FROM {source}"),
        ("hit", "SELECT entity, tag_name, tag_color, tag_icon, row_number() OVER (PARTITION BY entity ORDER BY n) AS k "
                "FROM ent JOIN rules ON contains(lower(entity), pattern)"),
        ("tagged", "SELECT entity, tag_name, tag_color, tag_icon FROM hit WHERE k = 1"),
    ]


_USER_SITES = (
    f"SELECT user_id, entity, count(*) AS heartbeats, {_act()} AS seconds, min(lt) AS a, max(lt) AS b, "
    "count(DISTINCT day) AS visit_days FROM o GROUP BY user_id, entity"
)


def _user_sites(select: str, by_day: bool = False) -> str:
    keys = "user_id, entity, day" if by_day else "user_id, entity"
    sums = f"SELECT {keys}, count(*) AS heartbeats, {_act()} AS seconds FROM o GROUP BY {keys}" if by_day else _USER_SITES
    return _with("tags", _ordered(keys, f"{_days_back(7)} AND {_SITE}"), ("s", sums), *_tagging(_RULES_BY_NAME, "s")) + select


def _day_sites(select: str) -> str:
    day = _day_of(reg.REPORT_DAY)
    where = f"{_since(C.day_start(day), C.day_start(day + timedelta(days=1)))} AND {_SITE}"
    sites = (
        f"SELECT s.user_id, coalesce(tag_name, '{UNTAGGED}') AS tag_name, s.entity, heartbeats, seconds "
        "FROM s LEFT JOIN tagged USING (entity)"
    )
    sums = f"SELECT user_id, entity, count(*) AS heartbeats, {_act()} AS seconds FROM o GROUP BY user_id, entity"
    return (
        _with("tags", _ordered("user_id, entity", where), ("s", sums), *_tagging(_RULES_BY_ID, "s"), ("d", sites)) + select
    )


# --- alerts ---------------------------------------------------------------------------------------------------


def _alert(kind: str, source: str, values: dict[str, str], user: str = "user_id", count: str = "NULL") -> str:
    level, icon, title, message = al.TEXTS[kind]

    def text(pattern: str) -> str:
        parts = []
        for piece in pattern.split("{"):
            name, closed, rest = piece.partition("}")
            parts += [values[name], f"'{rest}'"] if closed else [f"'{piece}'"]
        return f"concat({', '.join(parts)})"

    return (
        f"SELECT CAST({al.KINDS.index(kind) + 1} AS INT) AS alert_order, '{level}' AS type, '{icon}' AS icon, "
        f"{text(title)} AS title, {text(message)} AS message, CAST({user} AS VARCHAR) AS user_id, "
        f"CAST({count} AS BIGINT) AS alert_count FROM {source}"
    )


def _names(source: str, name: str) -> tuple[str, str]:
    return name, (
        "SELECT count(*) AS n, concat(string_agg(user_id, ', ' ORDER BY user_id) FILTER (WHERE k <= 5), "
        "CASE WHEN count(*) > 5 THEN '...' ELSE '' END) AS names "
        f"FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) AS k FROM {source}) x HAVING count(*) > 0"
    )


def _user_days(name: str, days: int) -> list[tuple[str, str]]:
    return [
        _ordered("user_id, day", f"user_id IS NOT NULL AND {_days_back(days)}", f"o_{name}"),
        (f"d_{name}", f"SELECT user_id, day, {_act()} AS sec FROM o_{name} GROUP BY user_id, day"),
    ]


_LEAVE_NOW = f"start_date <= {_date(TODAY)} AND end_date >= {_date(TODAY)}"
_LEISURE = ", ".join(f"'{t}'" for t in LEISURE_TAGS)

# kind -> (tables, CTEs, final select)
_ALERTS: dict[str, tuple[list, list, str]] = {
    "inactive": (
        ["users", "leaves"],
        [
            ("idle", "SELECT id AS user_id FROM users WHERE id NOT IN (SELECT user_id FROM hb WHERE "
                     f"user_id IS NOT NULL AND {_days_back(0)}) AND id NOT IN (SELECT user_id FROM leaves WHERE {_LEAVE_NOW})"),
            _names("idle", "idle_names"),
        ],
        _alert("inactive", "idle_names", {"n": "n", "names": "names"}, "NULL", "n"),
    ),
    "on_leave": (
        ["leaves"],
        [("off", f"SELECT DISTINCT user_id FROM leaves WHERE {_LEAVE_NOW}"), _names("off", "off_names")],
        _alert("on_leave", "off_names", {"n": "n", "names": "names"}, "NULL", "n"),
    ),
    "entertainment": (
        ["tags"],
        [
            _ordered("user_id", f"user_id IS NOT NULL AND {_days_back(0)} AND type IN ('domain', 'url') AND EXISTS (SELECT 1 FROM tags g "
                     f"WHERE g.tag_name IN ({_LEISURE}) AND contains(lower(entity), lower(g.domain_pattern)))", "o_fun"),
            ("fun", f"SELECT user_id, {_act()} AS sec FROM o_fun GROUP BY user_id HAVING {_us()} > {reg.LEISURE_SECONDS * 1_000_000}"),
        ],
        _alert("entertainment", "fun", {"user": "user_id", "minutes": _round("CAST(sec AS DOUBLE) / 60")}),
    ),
    "activity_drop": (
        ["leaves"],
        [
            ("this_week", f"SELECT user_id, count(*) AS hb FROM hb WHERE {_since(C.week)} GROUP BY user_id"),
            ("last_week", f"SELECT user_id, count(*) AS hb FROM hb WHERE user_id IS NOT NULL AND {_since(C.prev_week, C.week)} GROUP BY user_id"),
            ("free", "SELECT user_id FROM (SELECT DISTINCT user_id, unnest(generate_series(CAST(start_date AS TIMESTAMP), "
                     "CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM leaves) x WHERE "
                     f"d BETWEEN {_date(TODAY - timedelta(days=7))} AND {_date(TODAY)} GROUP BY user_id HAVING count(*) >= 3"),
            ("falling", "SELECT p.user_id, p.hb AS prev, coalesce(t.hb, 0) AS cur FROM last_week p LEFT JOIN this_week t "
                        f"ON p.user_id = t.user_id WHERE coalesce(t.hb, 0) < p.hb * 0.3 AND p.hb > {reg.MIN_PREV} "
                        "AND p.user_id NOT IN (SELECT user_id FROM free)"),
        ],
        _alert("activity_drop", "falling", {
            "user": "user_id", "drop": _round("(1 - CAST(cur AS DOUBLE) / greatest(prev, 1)) * 100"),
            "prev": "prev", "this": "cur",
        }),
    ),
    "burnout": (
        [],
        [
            *_user_days("long", 10),
            ("runs", "SELECT user_id, count(*) AS n FROM (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id "
                     f"ORDER BY day) AS INT) AS island FROM d_long WHERE sec >= {reg.BURNOUT_SECONDS}) x GROUP BY user_id, island"),
            ("tired", "SELECT user_id, max(n) AS streak FROM runs GROUP BY user_id HAVING max(n) >= 3"),
        ],
        _alert("burnout", "tired", {"user": "user_id", "streak": "streak", "hours": f"'{reg.BURNOUT_SECONDS / 3600:g}'"}),
    ),
    "weekend": (
        [],
        [
            *_user_days("two", 14),
            ("sat", "SELECT user_id, sum(sec) AS total, count(DISTINCT day) AS n FROM d_two WHERE "
                    f"extract(dow FROM day) IN (0, 6) AND sec > {reg.WEEKEND_SECONDS} GROUP BY user_id"),
        ],
        _alert("weekend", "sat", {
            "user": "user_id", "days": "'14'", "weekend_days": "n", "hours": _round("CAST(total AS DOUBLE) / 3600"),
        }),
    ),
}


def _alert_sql(*kinds: str) -> str:
    tables: list[str] = []
    ctes: list = []
    for kind in kinds:
        tables += [t for t in _ALERTS[kind][0] if t not in tables]
        ctes += _ALERTS[kind][1]
    return _with(*tables, *ctes) + " UNION ALL ".join(_ALERTS[k][2] for k in kinds)


# --- summary --------------------------------------------------------------------------------------------------


def _stats(name: str, source: str, lists: list[str], times: bool = True) -> tuple[str, str]:
    return name, (
        "SELECT user_id, count(*) AS heartbeats, count(DISTINCT project) AS project_count, "
        + ", ".join(f"{_list(n)} AS {n}s" for n in lists)
        + f", {_FIRST_LAST}, count(DISTINCT day) AS active_days, {_act()} AS coding_seconds, "
        f"{_act('NOT br')} AS ide_coding_seconds, {_AI_COLS} FROM {source} GROUP BY user_id"
    )


def _scorecard() -> str:
    past = C.week - timedelta(days=28)
    ctes = [
        "users", "adjustments",
        _ordered("user_id", _days_back(0), "ot"), _stats("t", "ot", ["project", "language", "editor"]),
        _ordered("user_id", _since(C.week), "ow"), _stats("w", "ow", ["project", "language"]),
        _ordered("user_id", _since(past, C.week), "op"),
        ("p", f"SELECT user_id, CAST({_act()} AS DOUBLE) / greatest(count(DISTINCT day), 1) AS avg_daily, "
              f"CAST({_act()} AS DOUBLE) / 4 AS avg_weekly FROM op GROUP BY user_id"),
        ("adj_t", _adj(TODAY, TODAY)), ("adj_w", _adj(C.week_date, TODAY)),
        ("j", "SELECT u.id AS user_id, u.email, t.user_id IS NOT NULL AS ht, w.user_id IS NOT NULL AS hw, "
              "t.heartbeats AS thb, t.projects AS tp, t.languages AS tl, t.editors AS te, t.first_active AS tf, "
              "t.last_active AS tla, t.project_count AS tpc, t.ai_heartbeats AS tah, t.ai_coding_seconds AS tas, "
              "t.ide_coding_seconds AS tis, w.heartbeats AS whb, w.projects AS wp, w.languages AS wl, w.active_days AS wd, "
              "w.project_count AS wpc, w.ai_heartbeats AS wah, w.ai_coding_seconds AS was, w.ide_coding_seconds AS wis, "
              "coalesce(adj_t.adj, 0) AS ta, coalesce(adj_w.adj, 0) AS wa, coalesce(avg_daily, 0) AS ad, coalesce(avg_weekly, 0) AS aw, "
              "greatest(coalesce(t.coding_seconds, 0) + coalesce(adj_t.adj, 0), 0) AS tc, "
              "greatest(coalesce(w.coding_seconds, 0) + coalesce(adj_w.adj, 0), 0) AS wc "
              "FROM users u LEFT JOIN t ON u.id = t.user_id LEFT JOIN w ON u.id = w.user_id LEFT JOIN p ON u.id = p.user_id "
              "LEFT JOIN adj_t ON u.id = adj_t.user_id LEFT JOIN adj_w ON u.id = adj_w.user_id"),
    ]
    dash = lambda flag, c: f"CASE WHEN {flag} THEN {c} ELSE '-' END"
    return _with(*ctes) + (
        "SELECT user_id, email, coalesce(thb, 0) AS today_heartbeats, "
        f"{dash('ht', 'tp')} AS today_projects, {dash('ht', 'tl')} AS today_languages, {dash('ht', 'te')} AS today_editors, "
        f"{dash('ht', 'tf')} AS today_first_active, {dash('ht', 'tla')} AS today_last_active, "
        f"coalesce(tpc, 0) AS today_project_count, {_big('tc')} AS today_coding_seconds, {_big('ta')} AS today_adjustment_seconds, "
        "coalesce(tah, 0) AS today_ai_heartbeats, coalesce(tas, 0) AS today_ai_coding_seconds, "
        f"{_pct('coalesce(tas, 0)', 'coalesce(tis, 0)')} AS today_ai_pct, "
        f"CASE WHEN ad >= 600 THEN {_round('(tc - ad) / ad * 100')} END AS today_trend_pct, {_round('ad')} AS avg_daily_4w, "
        f"coalesce(whb, 0) AS week_heartbeats, {dash('hw', 'wp')} AS week_projects, {dash('hw', 'wl')} AS week_languages, "
        f"coalesce(wd, 0) AS week_active_days, coalesce(wpc, 0) AS week_project_count, {_big('wc')} AS week_coding_seconds, "
        f"{_big('wa')} AS week_adjustment_seconds, coalesce(wah, 0) AS week_ai_heartbeats, "
        f"coalesce(was, 0) AS week_ai_coding_seconds, {_pct('coalesce(was, 0)', 'coalesce(wis, 0)')} AS week_ai_pct, "
        f"CASE WHEN aw >= 3600 THEN {_round('(wc - aw) / aw * 100')} END AS week_trend_pct, {_round('aw')} AS avg_weekly_4w FROM j"
    )


def _kpis() -> str:
    ctes = [
        "users", "adjustments",
        _ordered("user_id", _days_back(0), "ot"), _stats("t", "ot", ["project"]),
        _ordered("user_id", _since(C.week), "ow"), _stats("w", "ow", ["project"]),
        _ordered("user_id", _since(C.prev_week, C.week), "op"),
        ("x", "SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM t) AS active_today, "
              "(SELECT coalesce(sum(heartbeats), 0) FROM t) AS hbt, (SELECT coalesce(sum(ide_coding_seconds), 0) FROM t) AS idt, "
              "(SELECT coalesce(sum(ai_coding_seconds), 0) FROM t) AS ait, (SELECT coalesce(sum(ai_coding_seconds), 0) FROM w) AS aiw, "
              f"greatest((SELECT coalesce(sum(coding_seconds), 0) FROM t) + (SELECT coalesce(sum(adj), 0) FROM ({_adj(TODAY, TODAY)}) q), 0) AS ct, "
              f"greatest((SELECT coalesce(sum(coding_seconds), 0) FROM w) + (SELECT coalesce(sum(adj), 0) FROM ({_adj(C.week_date, TODAY)}) q), 0) AS cw, "
              f"(SELECT {_act()} FROM op) AS pw"),
    ]
    return _with(*ctes) + (
        f"SELECT total_users, active_today, total_users - active_today AS inactive_today, {_big('hbt')} AS heartbeats_today, "
        f"{_big('ct')} AS total_coding_today, {_big('cw')} AS total_coding_week, {_big('ait')} AS total_ai_today, "
        f"{_big('aiw')} AS total_ai_week, {_pct('ait', 'idt')} AS ai_pct_today, pw AS prev_week_coding, "
        f"CASE WHEN pw > 0 THEN {_round('CAST(cw - pw AS DOUBLE) / greatest(pw, 1) * 100')} ELSE 0 END AS week_delta_pct FROM x"
    )


# --- ledgers --------------------------------------------------------------------------------------------------

_NUM = (
    "CASE WHEN {c} IS NULL THEN 0 WHEN regexp_full_match(trim({c}, " + SPACE + "), "
    "'[+-]?([0-9]+(_[0-9]+)*(\\.([0-9]+(_[0-9]+)*)?)?|\\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?') "
    "THEN try_cast(replace(trim({c}, " + SPACE + "), '_', '') AS DOUBLE) END"
)
_ISO = "CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN CAST(try_strptime({c}, '%Y-%m-%d') AS DATE) END"


def _ingest_adjustments() -> str:
    step = (
        f"SELECT *, {_NUM.format(c='hours')} AS h, {_NUM.format(c='minutes')} AS m, "
        "lower(CASE WHEN coalesce(op, '') = '' THEN 'add' ELSE op END) AS o, trim(coalesce(adjustment_date, ''), " + SPACE + ") AS dt, "
        "user_id IN (SELECT id FROM users) AS known FROM adjustment_requests"
    )
    more = (
        f"SELECT *, round_even(h * 3600 + m * 60, 0) AS size, CASE WHEN dt = '' THEN {_date(TODAY)} ELSE {_ISO.format(c='dt')} END AS d FROM r1"
    )
    why = (
        "SELECT *, CASE WHEN size IS NULL THEN 'invalid number' WHEN o NOT IN ('add', 'sub') THEN 'invalid op' "
        "WHEN size <= 0 THEN 'not above zero' WHEN d IS NULL THEN 'invalid date' WHEN NOT known THEN 'unknown user' END AS why FROM r2"
    )
    return _with("users", "adjustments", "adjustment_requests", ("r1", step), ("r2", more), ("r3", why), hb=False) + (
        "SELECT CASE WHEN why IS NULL THEN 'accepted' ELSE 'rejected' END AS status, "
        "CASE WHEN why IS NULL THEN request_id + (SELECT max(id) FROM adjustments) ELSE request_id END AS ref, user_id, "
        "CASE WHEN why IS NULL THEN CAST(CAST(CASE WHEN o = 'add' THEN size ELSE -size END AS BIGINT) AS VARCHAR) END AS seconds, "
        f"CASE WHEN why IS NULL THEN {_day('d')} END AS adjustment_date, "
        "CASE WHEN why IS NULL THEN nullif(trim(coalesce(reason, ''), " + SPACE + "), '') END AS reason, why AS error FROM r3"
    )


def _ingest_leaves() -> str:
    kinds = ", ".join(f"'{k}'" for k in LEAVE_TYPES)
    step = (
        "SELECT *, trim(coalesce(start_date, '')) AS a, CASE WHEN coalesce(end_date, '') = '' THEN trim(coalesce(start_date, '')) "
        "ELSE trim(end_date) END AS b, CASE WHEN coalesce(leave_type, '') = '' THEN 'annual' ELSE trim(leave_type) END AS k, "
        "user_id IN (SELECT id FROM users) AS known FROM leave_requests"
    )
    more = f"SELECT *, {_ISO.format(c='a')} AS sd, {_ISO.format(c='b')} AS ed FROM r1"
    why = (
        f"SELECT *, CASE WHEN a = '' THEN 'start_date missing' WHEN k NOT IN ({kinds}) THEN 'invalid leave type' "
        "WHEN sd IS NULL OR ed IS NULL THEN 'invalid date' WHEN ed < sd THEN 'end before start' "
        "WHEN NOT known THEN 'unknown user' END AS why FROM r2"
    )
    return _with("users", "leaves", "leave_requests", ("r1", step), ("r2", more), ("r3", why), hb=False) + (
        "SELECT CASE WHEN why IS NULL THEN 'accepted' ELSE 'rejected' END AS status, "
        "CASE WHEN why IS NULL THEN request_id + (SELECT max(id) FROM leaves) ELSE request_id END AS ref, user_id, "
        f"CASE WHEN why IS NULL THEN {_day('sd')} END AS start_date, CASE WHEN why IS NULL THEN {_day('ed')} END AS end_date, "
        "CASE WHEN why IS NULL THEN k END AS leave_type, CASE WHEN why IS NULL THEN nullif(trim(coalesce(reason, ''), " + SPACE + "), '') END AS reason, "
        "why AS error FROM r3"
    )


def _tags_upsert() -> str:
    step = (
        "SELECT *, trim(coalesce(tag_name, '')) AS nm, trim(coalesce(domain_pattern, '')) AS pt, "
        "trim(coalesce(tag_color, '')) AS co, trim(coalesce(tag_icon, '')) AS ic FROM tag_requests"
    )
    return _with(
        "tags", "tag_requests", ("r1", step), ("ok", "SELECT * FROM r1 WHERE nm <> '' AND pt <> ''"),
        ("upd", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY request_id DESC) AS k FROM ok "
                "WHERE id IS NOT NULL) x WHERE k = 1"),
        hb=False,
    ) + (
        "SELECT 'kept' AS status, g.id AS ref, CASE WHEN u.id IS NULL THEN g.tag_name ELSE nm END AS tag_name, "
        "CASE WHEN u.id IS NULL THEN g.tag_color ELSE co END AS tag_color, CASE WHEN u.id IS NULL THEN g.tag_icon ELSE ic END AS tag_icon, "
        "CASE WHEN u.id IS NULL THEN g.domain_pattern ELSE pt END AS domain_pattern FROM tags g LEFT JOIN upd u ON g.id = u.id "
        "UNION ALL SELECT 'kept', request_id + (SELECT max(id) FROM tags), nm, "
        "CASE WHEN coalesce(tag_color, '') = '' THEN '#94a3b8' ELSE co END, CASE WHEN coalesce(tag_icon, '') = '' THEN '🏷️' ELSE ic END, pt "
        "FROM ok WHERE id IS NULL UNION ALL SELECT 'rejected', request_id, NULL, NULL, NULL, NULL FROM r1 WHERE nm = '' OR pt = ''"
    )


_APPROVED = "SELECT id FROM delete_requests WHERE decision = 'approved'"


def _ledger_delete(name: str) -> str:
    cols = ", ".join(reg.DELETE_COLUMNS[name])
    return _with(name, "delete_requests", hb=False) + f"SELECT {cols} FROM {name} WHERE id NOT IN ({_APPROVED})"


def _after(name: str, ingest: str, columns: str, numbers: str) -> str:
    """The stored ledger with the accepted rows of an ingest (its SQL); requests were checked against ``name``."""
    body = ingest.removeprefix("WITH ")
    cut = body.rindex("SELECT CASE WHEN why IS NULL THEN 'accepted'")
    return (
        f"WITH {body[:cut]}, outcome AS ({body[cut:]}) SELECT {columns} FROM {name} UNION ALL SELECT {numbers} FROM outcome "
        "WHERE status = 'accepted'"
    )


# --- streams --------------------------------------------------------------------------------------------------

# All heartbeats; mark: the watermark after the last one, ten minutes behind, in milliseconds.
_STREAM = [("s", f"SELECT *, epoch_us(time) AS t, ({_AI}) AS ai, lower(coalesce(category, '')) = 'browsing' AS br, "
                 f"CAST(time + INTERVAL 3 HOUR AS DATE) AS day FROM ({table_sql('heartbeats')}) h"),
           ("mark", "SELECT max(t) // 1000 * 1000 - 600000000 AS w FROM s")]


def _instant(us: str) -> str:
    return _fmt(f"make_timestamp(CAST({us} AS BIGINT))", "%Y-%m-%d %H:%M:%S.%f")


def _windows(minutes: int, keys: str, aggs: str) -> str:
    """Sliding windows of whole minutes."""
    return _with(
        *_STREAM,
        ("x", f"SELECT s.*, (t // 60000000 + k) * 60000000 AS stop FROM s, range(1, {minutes + 1}) r(k)"),
        hb=False,
    ) + f"SELECT {_instant('stop')} AS window_end, {keys}{aggs} FROM x GROUP BY {keys}stop"


_RETAINED = (
    f"SELECT id, user_id, {_fmt('time', '%Y-%m-%d %H:%M:%S.%f')} AS time FROM ({table_sql('heartbeats')}) h "
    f"WHERE time >= {_ts(reg.RETENTION_DAYS_AS_OF)} - INTERVAL 12 MONTH"
)
_CREATED = _fmt("created_at + INTERVAL 3 HOUR", "%d/%m/%Y %H:%M")


def _team_union(key: str, other: str, first_last: bool) -> str:
    cols = (
        f", {_fmt('min(lt)', '%d/%m/%Y')} AS first_activity, {_fmt('max(lt)', '%d/%m/%Y %H:%M')} AS last_activity, "
        "count(*) FILTER (WHERE ai) AS ai_heartbeats" if first_last else ""
    )
    return _with(_ordered(key, f"{_days_back(30)} AND {key} <> ''")) + (
        f"SELECT {key} AS name, count(*) AS heartbeats, count(DISTINCT user_id) AS user_count, {_list('user_id')} AS users, "
        f"{_list(other)} AS {other}s, count(DISTINCT day) AS active_days{cols}, {_act()} AS coding_seconds FROM o GROUP BY {key}"
    )


def oracle_sql() -> dict[str, str]:
    lo, hi = _day_of(reg.RANGE["start"]), _day_of(reg.RANGE["end"])
    one = _day_of(reg.REPORT_DAY)
    monday, sunday = C.week_date, C.week_date + timedelta(days=6)
    past = _since(C.week - timedelta(days=28), C.week)
    month_ago = f"{_days_back(30)} AND "
    leave_lo, leave_hi = _date(reg.LEAVE_RANGE["start"]), _date(reg.LEAVE_RANGE["end"])
    recent = _since(AS_OF - timedelta(minutes=10))
    ago = _sec(f"epoch_us({_ts(AS_OF)}) - max(t)")
    latest = ", ".join(f"last({c} ORDER BY t, id) AS latest_{c}" for c in ("project", "language", "editor", "type", "entity"))
    hours = "SELECT user_id, hour(lt) AS hour, count(*) AS n FROM hb WHERE " + _days_back(0) + " GROUP BY ALL"
    minutes = "SELECT t // 60000000 AS m, count(*) AS n FROM hb GROUP BY 1"
    found = {
        "realtime_active": _with(
            _ordered("user_id", _days_back(0)),
            ("d", f"SELECT user_id, {_act()} AS s FROM o GROUP BY user_id"),
            ("l", "SELECT user_id, max(editor) AS editor, max(project) FILTER (WHERE type = 'file') AS project, max(language) AS language, "
                  "max(type) AS last_type, max(entity) AS last_entity, count(*) AS recent_hb, "
                  f"{_fmt('max(lt)', '%H:%M:%S')} AS last_seen, bool_or(ai) AS is_ai, {ago} AS seconds_ago, {latest} "
                  f"FROM hb WHERE {recent} GROUP BY user_id"),
        ) + "SELECT l.*, coalesce(s, 0) AS today_coding_seconds, CASE WHEN seconds_ago < 120 THEN 'green' WHEN seconds_ago < 300 "
            f"THEN 'yellow' ELSE 'orange' END AS status, least({_round('CAST(coalesce(s, 0) AS DOUBLE) / 28800 * 100')}, 100) AS progress_pct "
            "FROM l LEFT JOIN d USING (user_id)",
        "today_by_user": _with(_ordered("user_id", _days_back(0)), _stats("s", "o", ["project", "language", "editor"]))
        + "SELECT * EXCLUDE (active_days) FROM s",
        "week_by_user": _with(_ordered("user_id", _since(C.week)), _stats("s", "o", ["project", "language"]))
        + "SELECT * EXCLUDE (first_active, last_active) FROM s",
        "prev_week_totals": _with(_ordered("user_id", _since(C.prev_week, C.week)))
        + f"SELECT count(DISTINCT user_id) AS active_users, count(*) AS heartbeats, {_act()} AS coding_seconds FROM o",
        "daily_breakdown": _daily(7, ["project", "language"], (TODAY - timedelta(days=7), TODAY)),
        "today_totals": _with() + f"SELECT count(DISTINCT user_id) AS active_users, count(*) AS heartbeats FROM hb WHERE {_days_back(0)}",
        "history_baseline": _with(_ordered("user_id", past), (
            "s", f"SELECT user_id, {_act()} AS total_seconds, count(DISTINCT day) AS active_days FROM o GROUP BY user_id"))
        + "SELECT *, CAST(total_seconds AS DOUBLE) / greatest(active_days, 1) AS avg_daily, CAST(total_seconds AS DOUBLE) / 4 AS avg_weekly FROM s",
        "user_scorecard": _scorecard(),
        "team_kpis": _kpis(),
        "user_daily": _daily(14, ["project", "language", "editor"], None),
        "user_projects": _top("project", month_ago + "project <> ''", 10, "project AS name"),
        "user_languages": _top("language", month_ago + "language <> ''", 10, "language AS name"),
        "user_editors": _top("editor", month_ago + "editor <> ''", 10, "editor AS name, ai_heartbeats, ai_coding_seconds", f", {_AI_COLS}"),
        "user_weekly_trend": _with(
            "adjustments", _ordered("user_id, day", _days_back(7)),
            ("s", f"SELECT user_id, day, count(*) AS heartbeats, {_act()} AS sec, count(*) FILTER (WHERE ai) AS ai_heartbeats FROM o GROUP BY user_id, day"),
            ("a", _adj(keys="user_id, adjustment_date")),
        ) + f"SELECT s.user_id, {_day('day')} AS day, heartbeats, {_big('greatest(sec + coalesce(adj, 0), 0)')} AS coding_seconds, "
            f"{_big('coalesce(adj, 0)')} AS adjustment_seconds, ai_heartbeats FROM s LEFT JOIN a ON s.user_id = a.user_id AND day = adjustment_date",
        "user_files": _with(
            _ordered("user_id, entity", f"{_days_back(7)} AND type = 'file' AND entity <> ''"),
            ("s", f"SELECT user_id, entity, project, language, count(*) AS heartbeats, {_act()} AS coding_seconds FROM o GROUP BY ALL"),
            ("r", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coding_seconds DESC, entity NULLS FIRST, project NULLS FIRST, "
                  "language NULLS FIRST) AS k FROM s"),
        ) + "SELECT user_id, CAST(k AS INT) AS rank, entity, project, language, heartbeats, coding_seconds FROM r WHERE k <= 30",
        "user_domains": _top("entity", f"{_days_back(7)} AND {_SITE}", 30, "entity"),
        "user_hourly": _with("users", ("h", hours)) + "SELECT u.id AS user_id, CAST(g.hour AS INT) AS hour, coalesce(n, 0) AS heartbeats "
        "FROM users u CROSS JOIN range(24) g(hour) LEFT JOIN h ON h.user_id = u.id AND h.hour = g.hour",
        "user_totals": _with() + "SELECT user_id, count(*) AS total_heartbeats, count(DISTINCT project) AS total_projects, "
        "count(DISTINCT language) AS total_languages, count(DISTINCT day) AS total_active_days, "
        f"{_fmt('min(lt)', '%d/%m/%Y')} AS first_seen, {_fmt('max(lt)', '%d/%m/%Y %H:%M')} AS last_seen FROM hb GROUP BY user_id",
        "user_machines": _top("machine", month_ago + "machine <> ''", 10, "machine AS name, os", ", max(operating_system) AS os"),
        "user_heatmap": _with() + f"SELECT user_id, {_day('day')} AS day, count(*) AS count FROM hb WHERE {_days_back(90)} GROUP BY user_id, hb.day",
        "user_ai_totals": _with(
            "users", _ordered("user_id", month_ago + "ai"),
            ("s", f"SELECT user_id, count(*) AS n, {_act()} AS sec FROM o GROUP BY user_id"),
        ) + "SELECT id AS user_id, coalesce(n, 0) AS ai_heartbeats, coalesce(sec, 0) AS ai_coding_seconds FROM users LEFT JOIN s ON id = user_id",
        "adjustments_list": _with("adjustments", hb=False)
        + f"SELECT id, user_id, seconds, reason, {_day('adjustment_date')} AS adjustment_date, {_CREATED} AS created_at FROM adjustments",
        "adjustment_totals": _with("adjustments", hb=False) + f"SELECT user_id, {_big('sum(seconds)')} AS total_seconds FROM adjustments GROUP BY user_id",
        "adjustments_ingest": _ingest_adjustments(),
        "ledger_delete": _ledger_delete("adjustments"),
        "leave_delete": _ledger_delete("leaves"),
        "tag_delete": _ledger_delete("tags"),
        "stored_adjustments": _with("delete_requests", hb=False) + "SELECT * FROM (" + _after(
            "adjustments", _ingest_adjustments(),
            f"id, user_id, CAST(seconds AS BIGINT) AS seconds, {_day('adjustment_date')} AS adjustment_date, reason",
            "ref, user_id, CAST(seconds AS BIGINT), adjustment_date, reason") + f") z WHERE id NOT IN ({_APPROVED})",
        "stored_leaves": _after(
            "leaves", _ingest_leaves(),
            f"id, user_id, {_day('start_date')} AS start_date, {_day('end_date')} AS end_date, leave_type, reason",
            "ref, user_id, start_date, end_date, leave_type, reason"),
        "stored_tags": "SELECT ref AS id, tag_name, tag_color, tag_icon, domain_pattern FROM (" + _tags_upsert()
        + ") z WHERE status = 'kept'",
        "leaves_list": _with("leaves", hb=False) + f"SELECT id, user_id, leave_type, reason, {_day('start_date')} AS start_date, "
        f"{_day('end_date')} AS end_date, end_date - start_date + 1 AS days, {_CREATED} AS created_at FROM leaves",
        "leave_totals": _with("leaves", hb=False) + f"SELECT user_id, {_big('sum(end_date - start_date + 1)')} AS total_days FROM leaves GROUP BY user_id",
        "leaves_ingest": _ingest_leaves(),
        "leave_days": _with("leaves", hb=False) + f"SELECT DISTINCT user_id, {_day('d')} AS day FROM (SELECT user_id, unnest(generate_series("
        f"CAST(greatest(start_date, {leave_lo}) AS TIMESTAMP), CAST(least(end_date, {leave_hi}) AS TIMESTAMP), INTERVAL 1 DAY)) AS d "
        f"FROM leaves WHERE start_date <= {leave_hi} AND end_date >= {leave_lo}) x",
        "on_leave": _with("leaves", hb=False) + f"SELECT DISTINCT user_id FROM leaves WHERE {_LEAVE_NOW}",
        "projects": _team_union("project", "language", True),
        "languages": _team_union("language", "project", False),
        **{f"{key}_figures": _with(_ordered(key, f"{_days_back(30)} AND {key} <> ''")) + (
            f"SELECT {key} AS name, count(*) AS heartbeats, count(DISTINCT user_id) AS user_count, "
            f"{_fmt('min(lt)', '%d/%m/%Y')} AS first_activity, {_fmt('max(lt)', '%d/%m/%Y %H:%M')} AS last_activity, "
            "count(DISTINCT day) AS active_days, count(*) FILTER (WHERE ai) AS ai_heartbeats, "
            f"{_act()} AS coding_seconds FROM o GROUP BY {key}") for key in ("project", "language")},
        **{name: _with() + f"SELECT {key} AS name, {other}, count(*) AS heartbeats FROM hb WHERE {month_ago}{key} <> '' "
           f"AND {other} <> '' GROUP BY {key}, {other}" for name, key, other in (
               ("project_users", "project", "user_id"), ("project_languages", "project", "language"),
               ("language_users", "language", "user_id"), ("language_projects", "language", "project"))},
        "tag_patterns": _with("tags", hb=False) + "SELECT tag_name, id, domain_pattern, tag_color, tag_icon FROM tags",
        "languages_by_user": _with(_ordered("user_id, language", month_ago + "language <> ''"))
        + f"SELECT user_id, language, count(*) AS heartbeats, {_act()} AS coding_seconds FROM o GROUP BY user_id, language",
        "users_overview": _with(
            "users", _ordered("user_id", "true"),
            ("s", "SELECT user_id, count(*) AS total_heartbeats, count(DISTINCT project) AS total_projects, count(DISTINCT language) AS total_languages, "
                  f"count(DISTINCT CAST(time AS DATE)) AS active_days, {_fmt('min(lt)', '%d/%m/%Y')} AS first_seen, "
                  f"{_fmt('max(lt)', '%d/%m/%Y %H:%M')} AS last_seen, {_act()} AS total_coding_seconds, "
                  f"count(*) FILTER (WHERE {_days_back(0)}) AS today_heartbeats, count(*) FILTER (WHERE {_since(C.week)}) AS week_heartbeats, "
                  f"count(*) FILTER (WHERE ai AND {_days_back(30)}) AS ai_heartbeats_30d FROM o GROUP BY user_id"),
        ) + f"SELECT id AS user_id, email, {_fmt('created_at', '%Y-%m-%d %H:%M:%S')} AS created_at, first_seen, last_seen, "
        + _zero("total_heartbeats", "total_projects", "total_languages", "active_days", "total_coding_seconds", "today_heartbeats",
                "week_heartbeats", "ai_heartbeats_30d") + " FROM users LEFT JOIN s ON id = user_id",
        "tags_grouped": _with("tags", hb=False) + "SELECT tag_name, first(tag_color ORDER BY domain_pattern, id) AS tag_color, "
        "first(tag_icon ORDER BY domain_pattern, id) AS tag_icon, count(*) AS pattern_count, "
        "string_agg(concat(id, ':', domain_pattern), ' ' ORDER BY domain_pattern, id) AS patterns FROM tags GROUP BY tag_name",
        "tags_upsert": _tags_upsert(),
        "untagged_domains": _with("tags") + f"SELECT DISTINCT entity FROM hb WHERE {month_ago}{_SITE} AND NOT EXISTS "
        "(SELECT 1 FROM tags WHERE contains(lower(entity), lower(domain_pattern)))",
        "user_sites": _user_sites(
            f"SELECT user_id, s.entity, heartbeats, seconds, {_fmt('a', '%d/%m %H:%M')} AS first_visit, {_fmt('b', '%d/%m %H:%M')} AS last_visit, "
            "visit_days, tag_name, tag_color, tag_icon FROM s LEFT JOIN tagged USING (entity)"),
        "user_tag_stats": _user_sites(
            f"SELECT user_id, tn AS tag_name, first(tc ORDER BY seconds DESC, heartbeats DESC, entity) AS tag_color, "
            "first(ti ORDER BY seconds DESC, heartbeats DESC, entity) AS tag_icon, "
            f"{_big('sum(seconds)')} AS seconds, {_big('sum(heartbeats)')} AS heartbeats FROM (SELECT user_id, s.entity, seconds, heartbeats, "
            f"coalesce(tag_name, '{UNTAGGED}') AS tn, CASE WHEN tag_name IS NULL THEN '{UNTAGGED_COLOR}' ELSE tag_color END AS tc, "
            "CASE WHEN tag_name IS NULL THEN '🏷️' ELSE tag_icon END AS ti FROM s LEFT JOIN tagged USING (entity)) x GROUP BY user_id, tn"),
        "user_sites_daily": _user_sites(
            f"SELECT user_id, {_day('day')} AS day, s.entity, heartbeats, seconds, tag_name, tag_color, tag_icon FROM s LEFT JOIN tagged USING (entity)",
            by_day=True),
        "daily_report_users": _period_cols(one, one, _DAILY_COLS),
        "daily_report_site_tags": _day_sites("SELECT * FROM d"),
        "daily_report_tag_totals": _day_sites(
            f"SELECT user_id, tag_name, {_big('sum(seconds)')} AS seconds, {_big('sum(heartbeats)')} AS heartbeats, count(*) AS sites FROM d GROUP BY user_id, tag_name"),
        "daily_report_team": _period_team(one, one, True),
        "range_report_users": _period_cols(lo, hi, _RANGE_COLS),
        "range_report_days": _period_days(lo, hi),
        "range_report_team": _period_team(lo, hi, False),
        "weekly_report_users": _period_cols(monday, sunday, _RANGE_COLS),
        "weekly_report_days": _period_days(monday, sunday),
        "weekly_report_team": _period_team(monday, sunday, False),
        "report_rows_daily": _rows(one, one, "daily", 1),
        "report_rows_range": _rows(lo, hi, "range", 15),
        "report_rows_weekly": _rows(monday, sunday, "weekly", 7),
        "report_boxes": _boxes(lo, hi),
        "report_dates": _with() + f"SELECT {_day('day')} AS day, count(*) AS heartbeats, count(DISTINCT user_id) AS users FROM hb "
        f"WHERE {_since(AS_OF - timedelta(days=90))} GROUP BY hb.day",
        "productivity": _with(
            _ordered("user_id", _days_back(7)),
            ("s", f"SELECT user_id, count(*) AS heartbeats, count(DISTINCT day) AS active_days, {_act('NOT br')} AS ide_seconds, "
                  f"{_act('br')} AS browsing_seconds, {_act('ai')} AS ai_seconds FROM o GROUP BY user_id"),
            ("p", "SELECT *, CASE WHEN ide_seconds + browsing_seconds > 0 THEN "
                  f"{_pct('ide_seconds', 'ide_seconds + browsing_seconds')} ELSE 0 END AS productivity, "
                  f"{_round('CAST(active_days AS DOUBLE) / 7 * 100')} AS consistency FROM s"),
        ) + f"SELECT *, {_round('CAST(productivity AS DOUBLE) * CAST(0.6 AS DOUBLE) + CAST(consistency AS DOUBLE) * CAST(0.4 AS DOUBLE)')} AS score FROM p",
        **{f"alert_{kind}": _alert_sql(kind) for kind in al.KINDS},
        "alerts": _alert_sql(*al.KINDS),
        "leaderboard_7d": _with("users", _ordered("user_id", _since(AS_OF - timedelta(days=7))))
        + f"SELECT user_id, '7_days' AS interval, {_big(_us() + ' * 1000')} AS total FROM o JOIN users ON users.id = user_id AND public_leaderboard GROUP BY user_id",
        "daily_activity_text": _with(("s", "SELECT user_id, count(*) AS heartbeats, string_agg(DISTINCT project, ', ' ORDER BY project) AS projects, "
            f"string_agg(DISTINCT language, ', ' ORDER BY language) AS languages, {_FIRST_LAST} FROM hb WHERE {_days_back(0)} GROUP BY user_id"))
        + "SELECT *, concat('👤 ', user_id, chr(10), '   Heartbeats: ', heartbeats, chr(10), '   Aktif: ', first_active, ' - ', last_active, chr(10), "
          "'   Projeler: ', coalesce(projects, ''), chr(10), '   Diller: ', coalesce(languages, '')) AS block FROM s",
        "inactive_today": _with("users") + f"SELECT id, concat('⚠️  ', id, ' - bugün aktivite yok') AS line FROM users WHERE id NOT IN "
        f"(SELECT user_id FROM hb WHERE {_days_back(0)})",
        "share_flags_update": _with(("u", f"SELECT *, share_data_max_days = 0 OR public_leaderboard = false AS shut FROM ({table_sql('users')}) z"), hb=False)
        + "SELECT id, email, CAST(CASE WHEN shut THEN -1 ELSE share_data_max_days END AS INT) AS share_data_max_days, "
        + ", ".join(f"(shut OR {c}) AS {c}" for c in ("public_leaderboard", "share_projects", "share_languages", "share_editors", "share_oss",
                                                      "share_machines", "share_labels")) + " FROM u",
        "platform_totals": _with("users", _ordered("user_id", "true")) + "SELECT (SELECT count(DISTINCT id) FROM users) AS users_total, "
        f"count(DISTINCT user_id) FILTER (WHERE {_since(AS_OF - timedelta(days=7))}) AS users_active_total, {_act()} AS seconds_total, "
        "count(*) AS heartbeats_total FROM o",
        "heartbeat_rate": _with(("c", minutes)) + f"SELECT {_fmt('make_timestamp(x.m * 60000000)', '%Y-%m-%d %H:%M')} AS minute, "
        f"{_big('sum(c.n)')} AS heartbeats, CAST(sum(c.n) AS DOUBLE) / 5 AS per_minute FROM (SELECT DISTINCT c.m + k AS m FROM c, range(1, 6) r(k)) x "
        f"JOIN c ON c.m BETWEEN x.m - 5 AND x.m - 1 WHERE x.m <= epoch_us({_ts(AS_OF)}) // 60000000 GROUP BY x.m",
        "retention_kept": _RETAINED,
        "stored_heartbeats": _RETAINED,
        "inactive_accounts": _with("users", hb=False) + f"SELECT id, email FROM users WHERE id NOT IN (SELECT user_id FROM ({table_sql('heartbeats')}) h "
        f"WHERE user_id IS NOT NULL AND time >= {_ts(reg.INACTIVE_AS_OF)} - INTERVAL 6 MONTH)",
        "stream_active_now": _windows(
            10, "user_id, ", f"count(*) AS recent_hb, {_instant('max(t)')} AS last_ts, bool_or(ai) AS is_ai, "
            "max(project) FILTER (WHERE type = 'file') AS project, max(language) AS language, max(editor) AS editor, "
            "max(type) AS last_type, max(entity) AS last_entity"),
        "stream_heartbeat_rate": _windows(5, "", "count(*) AS heartbeats, CAST(count(*) AS DOUBLE) / 5 AS per_minute"),
        "stream_sessions": _with(
            *_STREAM,
            ("g", "SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, id) AS gap FROM s"),
            ("n", "SELECT *, count(*) FILTER (WHERE gap > 600000000) OVER (PARTITION BY user_id ORDER BY t, id) AS part FROM g"),
            ("z", "SELECT user_id, min(t) AS a, max(t) AS b, count(*) AS heartbeats FROM n GROUP BY user_id, part"),
            hb=False,
        ) + f"SELECT user_id, {_instant('a')} AS first_ts, {_instant('b')} AS last_ts, heartbeats, b - a AS active_us, "
            "b + 600000000 <= (SELECT w FROM mark) AS closed FROM z",
        "stream_attributed": _with(
            *_STREAM,
            ("o", "SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, id) AS gap FROM s"),
            hb=False,
        ) + f"SELECT user_id, count(*) AS heartbeats, {_act()} AS coding_seconds, {_act('NOT br')} AS ide_coding_seconds, "
            f"{_act('br')} AS browsing_seconds, {_act('ai')} AS ai_coding_seconds FROM o GROUP BY user_id",
    }
    def nested(flat: str, key: str, items: dict[str, str], order: str, most: int, name: str) -> str:
        """Rows of a query as JSON arrays of the first `most` per key."""
        item = ", ".join(f"'{k}': {v}" for k, v in items.items())
        return (f"SELECT {key}, CAST(to_json(list({{{item}}} ORDER BY k) FILTER (k <= {most})) AS VARCHAR) AS {name}, "
                f"greatest(count(*) - {most}, 0) AS more_{name} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k "
                f"FROM ({flat}) f) r GROUP BY {key}")

    found["languages_by_user_nested"] = nested(
        found["languages_by_user"], "user_id", {"name": "language", "heartbeats": "heartbeats", "coding_seconds": "coding_seconds"},
        "coding_seconds DESC, language", 2, "languages")
    found["tags_nested"] = nested(
        table_sql("tags"), "tag_name", {"id": "id", "pattern": "domain_pattern", "color": "tag_color"}, "domain_pattern, id", 5, "patterns")
    found["daily_breakdown_nested"] = nested(
        found["daily_breakdown"], "day",
        {c: c for c in ("user_id", "coding_seconds", "heartbeats", "adjustment_seconds")}, "coding_seconds DESC, user_id NULLS FIRST", 10, "users")
    found["entity_estimates"] = (
        f"SELECT user_id, count(DISTINCT entity) AS entities, true AS close FROM ({table_sql('heartbeats')}) h GROUP BY user_id")
    found["kept_user_tag_stats"] = found["user_tag_stats"]
    found["live_active_now"] = found["realtime_active"]
    found["live_ai_totals"] = found["user_ai_totals"]
    found["live_attributed"] = _with(_ordered("user_id", "true")) + (
        f"SELECT user_id, count(*) AS heartbeats, {_act()} AS coding_seconds, {_act('NOT br')} AS ide_coding_seconds, "
        f"{_act('br')} AS browsing_seconds, {_act('ai')} AS ai_coding_seconds FROM o GROUP BY user_id")
    found["live_daily_counts"] = _with() + f"SELECT user_id, {_day('day')} AS day, count(*) AS heartbeats FROM hb GROUP BY user_id, hb.day"
    found["bucketed_attribution"] = found["stream_attributed"]
    found["stored_week_by_user"] = found["week_by_user"]
    found["stored_range_report_users"] = found["range_report_users"]
    found["stored_leave_activity"] = _with(
        "leaves",
        ("all_hb", f"SELECT *, epoch_us(time) AS t, CAST(time + INTERVAL 3 HOUR AS DATE) AS day FROM ({table_sql('heartbeats')}) h"),
        ("d", f"SELECT DISTINCT user_id, CAST(unnest(generate_series(greatest(start_date, {leave_lo}), least(end_date, {leave_hi}), "
              f"INTERVAL 1 DAY)) AS DATE) AS day FROM leaves WHERE start_date <= {leave_hi} AND end_date >= {leave_lo} AND start_date <= end_date"),
        ("o", "SELECT *, t - lag(t) OVER (PARTITION BY user_id, day ORDER BY t, id) AS gap FROM all_hb JOIN d USING (user_id, day)"),
        hb=False,
    ) + f"SELECT user_id, {_day('day')} AS day, count(*) AS heartbeats, {_act()} AS coding_seconds FROM o GROUP BY user_id, day"
    found["week_by_user_dense"] = found["week_by_user"]
    found["range_report_users_dense"] = found["range_report_users"]
    found["stored_users"] = found["share_flags_update"]
    found["stored_leaderboard"] = found["leaderboard_7d"]
    return found
