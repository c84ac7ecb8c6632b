"""Time bounds derived from an explicit ``as_of`` instant (naive UTC).

Nothing in this package reads the wall clock: a replay with the same ``as_of`` gives the same result.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

EPOCH = datetime(1970, 1, 1)
MINUTE_US = 60 * 1_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def micros(instant: datetime) -> int:
    """Microseconds since the epoch of a naive UTC instant."""
    return (instant - EPOCH) // timedelta(microseconds=1)


def day_number(day: date) -> int:
    """Days since the epoch; the integer form of a local day."""
    return (day - EPOCH.date()).days


@dataclass(frozen=True)
class Clock:
    """Calendar bounds, all returned as naive UTC instants unless named local."""

    as_of: datetime
    tz_hours: int = 3

    @classmethod
    def at(cls, as_of: datetime | str, tz_hours: int = 3) -> Clock:
        if isinstance(as_of, str):
            as_of = datetime.fromisoformat(as_of)
        return cls(as_of, tz_hours)

    @property
    def offset(self) -> timedelta:
        return timedelta(hours=self.tz_hours)

    @property
    def local_now(self) -> datetime:
        return self.as_of + self.offset

    @property
    def local_date(self) -> date:
        return self.local_now.date()

    @property
    def today(self) -> datetime:
        return self.day_start(self.local_date)

    @property
    def week_date(self) -> date:
        """Local date of this week's Monday."""
        return monday(self.local_date)

    @property
    def week(self) -> datetime:
        return self.day_start(self.week_date)

    @property
    def prev_week(self) -> datetime:
        return self.week - timedelta(days=7)

    def day_start(self, day: date) -> datetime:
        """UTC instant of local midnight."""
        return datetime(day.year, day.month, day.day) - self.offset

    def days_back(self, days: int) -> datetime:
        """Local midnight ``days`` days ago, so the window spans days + 1 calendar days."""
        return self.today - timedelta(days=days)


def monday(day: date) -> date:
    return day - timedelta(days=day.weekday())


def as_date(value: date | str) -> date:
    return date.fromisoformat(value) if isinstance(value, str) else value
