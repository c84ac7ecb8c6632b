from __future__ import annotations

import sys
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from helpers import when  # noqa: E402
from worktempo.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def _frame(spark, schema, rows, defaults):
    names = schema.fieldNames()
    return spark.createDataFrame([tuple({**defaults(n), **row}.get(c) for c in names) for n, row in enumerate(rows)], schema)


@pytest.fixture
def hb(spark):
    """Heartbeats from dicts; ``at`` is the time text, ids follow the order of the rows."""

    def build(*rows):
        plain = [{**r, "time": when(r["at"])} if "at" in r else r for r in rows]
        return _frame(spark, schemas.HEARTBEATS, plain, lambda n: {
            "id": n, "user_id": "u", "type": "file", "entity": "/f", "category": "coding", "project": "p",
            "language": "Go", "editor": "VS Code", "operating_system": "Linux", "machine": "m", "user_agent": "x",
        })

    return build


@pytest.fixture
def users(spark):
    def build(*ids, **columns):
        return _frame(spark, schemas.USERS, [{"id": i} for i in ids], lambda n: {
            "email": "e", "created_at": datetime(2023, 1, 1), "public_leaderboard": True, "share_data_max_days": 30,
            **columns,
        })

    return build


@pytest.fixture
def adjustments(spark):
    def build(*rows):
        plain = [{"user_id": u, "seconds": s, "adjustment_date": date.fromisoformat(d)} for u, s, d in rows]
        return _frame(spark, schemas.TIME_ADJUSTMENTS, plain, lambda n: {"id": n})

    return build


@pytest.fixture
def leaves(spark):
    def build(*rows):
        plain = [{"user_id": u, "start_date": date.fromisoformat(a), "end_date": date.fromisoformat(b)} for u, a, b in rows]
        return _frame(spark, schemas.LEAVES, plain, lambda n: {"id": n, "leave_type": "annual"})

    return build


@pytest.fixture
def tags(spark):
    def build(*rows):
        plain = [{"id": i, "tag_name": n, "domain_pattern": p} for i, n, p in rows]
        return _frame(spark, schemas.DOMAIN_TAGS, plain, lambda n: {"tag_color": "#1", "tag_icon": "i"})

    return build
