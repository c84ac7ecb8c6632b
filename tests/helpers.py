"""Small readers of test results; a module of its own, since every folder of tests has a conftest."""

from __future__ import annotations

from datetime import datetime


def when(text: str) -> datetime:
    """'05 21:00:00.5' is that instant of January 2024, UTC."""
    return datetime.fromisoformat(f"2024-01-{text}")


def rows(df):
    return [r.asDict() for r in df.collect()]


def one(df):
    (row,) = rows(df)
    return row
