"""Tables of this domain derived from the given star-schema Parquet files.

Every table is a chain of projections over one whole input table, so it grows with it. The expressions are text
that Spark and an SQL engine read alike; ``table_sql`` gives the same tables to the SQL oracle.

Shape of the heartbeats: a third of all rows belong to ``user0``, a feed that never sleeps (the hot key); the rest
go to users who work about 90 minutes a day. Four neighbouring users of the input make one user here; its number mod 8
sets the role: 0-3 work 10:00-11:30 local, 4-5 work across local midnight, 6-7 around the reference instant; role 3
mostly visits leisure sites; role 5 hands nine tenths of its last week to role 7.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktempo.sources import schemas

_HEARTBEATS = [
    [
        "event_id", "ts", "event_type", "epoch_us(ts) AS us", "user_id % 32 AS part",
        "CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(user_id / 4) AS BIGINT) END AS h",
        "(event_id % 5 < 2 OR (user_id % 32 BETWEEN 12 AND 15 AND event_id % 5 < 4)) AS site",
    ],
    [
        "event_id AS id",
        # Some rows before the reference day have no user.
        "CASE WHEN event_id % 101 = 7 AND ts < TIMESTAMP '2024-01-25 12:00:00' THEN NULL "
        "ELSE concat('user', CAST(h + CASE WHEN h % 8 = 5 AND ts >= TIMESTAMP '2024-01-21 21:00:00' AND event_id % 10 < 9 "
        "THEN 2 ELSE 0 END AS STRING)) END AS user_id",
        # The role's window begins at 11:15, 20:15 or 07:00; a day's seconds pass sixteen times as fast in it.
        "make_timestamp(CASE WHEN event_id % 3 = 0 THEN us ELSE us - us % 86400000000 + CASE WHEN part >= 24 THEN 40500000000 "
        "WHEN part >= 16 THEN 72900000000 ELSE 25200000000 END + CAST((us % 86400000000 - us % 1000000) / 16 AS BIGINT) END) AS time",
        "CASE WHEN site AND event_id % 16 = 3 THEN 'url' WHEN site THEN 'domain' WHEN event_id % 29 = 1 THEN 'app' "
        "ELSE 'file' END AS type",
        "CASE WHEN site AND part BETWEEN 12 AND 15 THEN CASE event_id % 2 WHEN 0 THEN 'https://www.netflix.com' ELSE 'https://x.com' END "
        "WHEN site THEN CASE event_id % 9 WHEN 0 THEN 'https://www.netflix.com' WHEN 1 THEN 'https://x.com' "
        "WHEN 2 THEN 'https://github.com' WHEN 3 THEN 'http://127.0.0.1:59838' WHEN 4 THEN 'https://Claude.ai' "
        "WHEN 5 THEN 'https://docs.google.com' WHEN 6 THEN 'https://unlisted.example.org' WHEN 7 THEN '' "
        "ELSE concat('https://App', CAST(event_id % 997 AS STRING), '.example') END "
        "ELSE concat('/src/f', CAST(event_id % 17 AS STRING), '.py') END AS entity",
        "CASE WHEN site THEN 'browsing' WHEN event_type = 'purchase' THEN 'AI Coding' "
        "WHEN event_type = 'error' THEN 'debugging' WHEN event_type = 'signup' THEN NULL ELSE 'coding' END AS category",
        "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN NULL "
        "ELSE concat('proj', CAST(event_id % 5 AS STRING)) END AS project",
        "CASE event_id % 6 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' WHEN 2 THEN 'SQL' WHEN 3 THEN '' WHEN 4 THEN NULL "
        "ELSE 'Rust' END AS language",
        "CASE event_id % 10 WHEN 0 THEN 'Cursor' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'Windsurf' "
        "ELSE 'VS Code' END AS editor",
        "CASE event_id % 4 WHEN 0 THEN 'Linux' WHEN 1 THEN 'Windows' ELSE 'Darwin' END AS operating_system",
        "CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('m', CAST(event_id % 3 AS STRING)) END AS machine",
        "CASE event_id % 9 WHEN 0 THEN 'plugin/1.0 vscode Copilot/1.0' WHEN 1 THEN NULL ELSE 'plugin/1.0' END AS user_agent",
    ],
]

_USERS = [[
    "concat('user', CAST(c_custkey AS STRING)) AS id",
    "concat(lower(c_name), '@mail.example') AS email",
    "TIMESTAMP '2023-06-01 22:30:00' AS created_at",
    "(c_custkey % 4 <> 3) AS public_leaderboard",
    "CAST(CASE c_custkey % 3 WHEN 0 THEN 0 ELSE 30 END AS INT) AS share_data_max_days",
    *[f"(c_custkey % 2 = 0) AS share_{what}" for what in
      ("projects", "languages", "editors", "oss", "machines", "labels")],
]]

_ADJUSTMENTS = [
    [
        "o_orderkey", "o_orderpriority",
        "concat('user', CAST(CAST(floor(o_custkey / 4) AS BIGINT) AS STRING)) AS user_id",
        "CAST(CAST(floor(o_totalprice) AS BIGINT) % 5400 - 1800 AS INT) AS seconds",
        "CAST(o_orderkey % 40 AS INT) AS d",
    ],
    [
        "o_orderkey AS id", "user_id", "seconds",
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE DATE '2024-01-01' + d END AS adjustment_date",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS reason",
        "CAST(DATE '2024-01-01' + d AS TIMESTAMP) + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL '9' HOUR "
        "WHEN 1 THEN INTERVAL '20' HOUR ELSE INTERVAL '22' HOUR END AS created_at",
    ],
]

_LEAVES = [
    [
        "s_suppkey", "s_nationkey",
        "concat('user', CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS STRING)) AS user_id",
        "DATE '2024-01-18' + CAST(s_suppkey % 12 AS INT) AS start_date",
    ],
    [
        "s_suppkey AS id", "user_id", "start_date",
        "start_date + CAST(s_nationkey % 6 AS INT) AS end_date",
        "CASE s_suppkey % 4 WHEN 0 THEN 'annual' WHEN 1 THEN 'sick' WHEN 2 THEN 'holiday' ELSE 'other' END AS leave_type",
        "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('note ', CAST(s_nationkey AS STRING)) END AS reason",
        "CAST(start_date AS TIMESTAMP) - INTERVAL '3' HOUR AS created_at",
    ],
]

_MORE_TAGS = [[
    "s_suppkey + 32 AS id",
    "CASE s_nationkey % 6 WHEN 0 THEN 'İş' WHEN 1 THEN 'Eğlence' WHEN 2 THEN 'Sosyal Medya' WHEN 3 THEN 'AI Araçları' "
    "ELSE concat('Team ', CAST(s_nationkey AS STRING)) END AS tag_name",
    "CASE WHEN s_suppkey % 2 = 0 THEN '#4ade80' ELSE '#38bdf8' END AS tag_color",
    "CASE WHEN s_suppkey % 3 = 0 THEN '🏷️' ELSE '💼' END AS tag_icon",
    "CASE WHEN s_suppkey % 25 = 7 THEN 'GitHub.com' ELSE concat('app', CAST(s_suppkey AS STRING), '.example') END "
    "AS domain_pattern",
    "TIMESTAMP '2023-06-02 08:00:00' AS created_at",
]]

_ADJUSTMENT_REQUESTS = [[
    "o_orderkey + 1 AS request_id",
    "CASE WHEN o_orderkey % 13 = 0 THEN concat('ghost', CAST(o_custkey AS STRING)) "
    "ELSE concat('user', CAST(o_custkey AS STRING)) END AS user_id",
    "CASE o_orderkey % 9 WHEN 0 THEN 'abc' WHEN 1 THEN NULL WHEN 2 THEN '0' WHEN 3 THEN '1.5' WHEN 4 THEN ' 2 ' "
    "WHEN 5 THEN '-1' WHEN 6 THEN CASE o_orderkey % 5 WHEN 0 THEN '2d' WHEN 1 THEN '0x1p3' WHEN 2 THEN '1_0' WHEN 3 THEN '1e1' ELSE '.5' END ELSE CAST(o_custkey % 7 AS STRING) END AS hours",
    "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '2.125' ELSE '30' END AS minutes",
    "CASE o_orderkey % 11 WHEN 0 THEN 'SUB' WHEN 1 THEN 'mul' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'sub' "
    "ELSE 'add' END AS op",
    "CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE concat(chr(9), o_orderpriority, chr(10)) END AS reason",
    "CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '2024-13-01' WHEN 3 THEN '26/01/2024' "
    "WHEN 4 THEN '2024-1-5' WHEN 5 THEN ' 2024-02-29 ' ELSE '2024-01-20' END AS adjustment_date",
]]

_LEAVE_REQUESTS = [[
    "p_partkey + 1 AS request_id",
    "CASE WHEN p_partkey % 11 = 0 THEN 'ghost' ELSE concat('user', CAST(p_partkey % 150 AS STRING)) END AS user_id",
    "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '2024-01-10' WHEN 2 THEN ' 2024-01-12 ' WHEN 3 THEN '2024-02-30' "
    "ELSE '2024-01-15' END AS start_date",
    "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '2024-01-11' WHEN 2 THEN '' WHEN 3 THEN 'soon' "
    "ELSE '2024-01-20' END AS end_date",
    "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'party' WHEN 2 THEN ' sick ' ELSE 'holiday' END AS leave_type",
    "CASE WHEN p_size % 2 = 0 THEN concat(' ', p_name) ELSE ' ' END AS reason",
]]

_TAG_REQUESTS = [[
    "p_partkey + 1 AS request_id",
    "CASE WHEN p_partkey % 4 = 0 THEN CAST(floor(p_partkey / 8) AS BIGINT) + 1 ELSE NULL END AS id",
    "CASE WHEN p_partkey % 10 = 9 THEN ' ' ELSE concat(' ', p_brand) END AS tag_name",
    "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '#112233' END AS tag_color",
    "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '📚' END AS tag_icon",
    "CASE WHEN p_partkey % 12 = 11 THEN NULL ELSE concat('part', CAST(p_partkey AS STRING), '.example ') END "
    "AS domain_pattern",
]]

# Requests to delete a row; the decision is part of the request, so that no input row is left out of the table.
_DELETE_REQUESTS = [[
    "l_orderkey AS id", "CAST(l_linenumber AS BIGINT) AS line",
    "CASE l_returnflag WHEN 'R' THEN 'approved' WHEN 'A' THEN 'refused' ELSE 'open' END AS decision",
]]

# name -> (input table, projections, schema)
_TABLES = {
    "heartbeats": ("events", _HEARTBEATS, schemas.HEARTBEATS),
    "users": ("customer", _USERS, schemas.USERS),
    "adjustments_raw": ("orders", _ADJUSTMENTS, schemas.TIME_ADJUSTMENTS),
    "leaves": ("supplier", _LEAVES, schemas.LEAVES),
    "adjustment_requests": ("orders", _ADJUSTMENT_REQUESTS, schemas.ADJUSTMENT_REQUESTS),
    "leave_requests": ("part", _LEAVE_REQUESTS, schemas.LEAVE_REQUESTS),
    "tag_requests": ("part", _TAG_REQUESTS, schemas.TAG_REQUESTS),
    "delete_requests": ("lineitem", _DELETE_REQUESTS, schemas.DELETE_REQUESTS),
}

AS_OF = datetime(2024, 1, 26, 12, 0, 0)


# Functions that Spark names differently.
_SPARK_NAMES = {"epoch_us(ts)": "unix_micros(CAST(ts AS TIMESTAMP))", "make_timestamp(": "timestamp_micros("}


def _for_spark(text: str) -> str:
    for other, own in _SPARK_NAMES.items():
        text = text.replace(other, own)
    return text


def _project(df: DataFrame, stages: Sequence[Sequence[str]], schema) -> DataFrame:
    for stage in stages:
        df = df.selectExpr(*[_for_spark(e) for e in stage])
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def _sql(source: str, stages: Sequence[Sequence[str]]) -> str:
    text = source
    for stage in stages:
        text = f"(SELECT {', '.join(stage)} FROM {text} s)"
    return f"SELECT * FROM {text} s"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(str(PurePath(sf_dir) / f"{table}.parquet"))


def heartbeats_from(events: DataFrame) -> DataFrame:
    return _project(events, _HEARTBEATS, schemas.HEARTBEATS)


def heartbeats(
    spark: SparkSession, sf_dir: str, *, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """The heartbeats view. A UTC range becomes a predicate on ``events.ts`` that the Parquet reader can use:
    the view moves an event by less than a day."""
    events = _read(spark, sf_dir, "events")
    if start is not None:
        events = events.where(F.col("ts") >= F.lit(str(start - timedelta(days=1))).cast("timestamp_ntz"))
    if end is not None:
        events = events.where(F.col("ts") <= F.lit(str(end + timedelta(days=1))).cast("timestamp_ntz"))
    return heartbeats_from(events)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "heartbeats":
        return heartbeats(spark, sf_dir)
    if name == "tags":
        more = _project(_read(spark, sf_dir, "supplier"), _MORE_TAGS, schemas.DOMAIN_TAGS)
        return schemas.seed_tags(spark, datetime(2023, 6, 1)).unionByName(more)
    if name == "adjustments":
        from worktempo.operators.ledger import backfill_dates

        return backfill_dates(table(spark, sf_dir, "adjustments_raw"))
    source, stages, schema = _TABLES[name]
    return _project(_read(spark, sf_dir, source), stages, schema)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def table_sql(name: str) -> str:
    """The same table as SQL text."""
    if name == "tags":
        rows = ", ".join(
            f"({n}, {', '.join(_quoted(v) for v in rest)})" for n, *rest in schemas.seed_rows()
        )
        return (
            "SELECT *, TIMESTAMP '2023-06-01 00:00:00' AS created_at FROM (VALUES " + rows +
            ") v(id, tag_name, tag_color, tag_icon, domain_pattern) UNION ALL " + _sql("supplier", _MORE_TAGS)
        )
    if name == "adjustments":
        return (
            "SELECT id, user_id, seconds, coalesce(adjustment_date, CAST(created_at + INTERVAL '3' HOUR AS DATE)) "
            f"AS adjustment_date, reason, created_at FROM ({_sql('orders', _ADJUSTMENTS)}) a"
        )
    source, stages, _ = _TABLES[name]
    return _sql(source, stages)
