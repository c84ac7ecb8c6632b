"""Tables kept by a stream: after each trigger equal to the batch figures of what has arrived."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_gaps import busy_rows

from worktempo.functions.clock import Clock
from worktempo.operators.scan import with_slots
from worktempo.operators.stats import activity
from worktempo.plans.realtime import realtime_active
from worktempo.plans.user_detail import user_ai_totals
from worktempo.sources import schemas, stored
from worktempo.streaming import active, live, slots


@pytest.fixture(autouse=True)
def state_store(spark):
    live.configure(spark)


class Feed:
    """A stream that gets files one by one, and the tables kept of it."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path = spark, tmp_path
        self.database = stored.new_database(spark, str(tmp_path / "db"))
        slots.create(spark, self.database)
        active.create(spark, f"{self.database}.minutes")

    def arrive(self, df):
        df.coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        for start, name in ((slots.run, self.database), (active.run, f"{self.database}.minutes")):
            stream = self.spark.readStream.schema(schemas.HEARTBEATS).parquet(str(self.path / "in"))
            start(stream, name, str(self.path / f"checkpoint-{start.__module__[-5:]}")).awaitTermination()

    def table(self, name):
        return self.spark.table(f"{self.database}.{name}")

    def arrived(self):
        return self.spark.read.schema(schemas.HEARTBEATS).parquet(str(self.path / "in"))


@pytest.fixture
def feed(spark, tmp_path):
    made = Feed(spark, tmp_path)
    yield made
    spark.sql(f"DROP DATABASE {made.database} CASCADE")


def parts_of(made, late_every):
    """Three parts by time; some rows come with the last one, however old."""
    made = sorted(made, key=lambda r: r["time"])
    cut = len(made) // 3
    last = [r for n, r in enumerate(made) if n % late_every == 0]
    return [[r for n, r in enumerate(made) if n // cut == k and n % late_every] for k in range(2)] + [
        [r for n, r in enumerate(made) if n // cut >= 2 and n % late_every] + last]


def as_set(df):
    return sorted(map(str, rows(df)))


@pytest.mark.parametrize("late_every", [7, 10**9])
def test_slots_equal_the_batch_after_each_trigger(spark, hb, feed, users, late_every):
    columns = ["user_id", "heartbeats", "coding_seconds", "ide_coding_seconds", "browsing_seconds", "ai_coding_seconds"]
    made = [{**r, "id": n} for n, r in enumerate(busy_rows(21))]
    people = users(*{r["user_id"] for r in made if r["user_id"]})
    for part in parts_of(made, late_every):
        feed.arrive(hb(*part))
        data = feed.arrived()
        days = stored.stored_days(spark, f"{feed.database}.slots")
        want = activity(with_slots(data), ["user_id"], slots.FLAGS).select(*columns)
        assert as_set(slots.attributed(feed.table("slots"), days[0], days[-1]).select(*columns)) == as_set(want)
        as_of = max(r["time"] for r in made) + timedelta(minutes=1)
        assert as_set(slots.ai_totals(feed.table("slots"), people, as_of=as_of)) == as_set(user_ai_totals(data, people, as_of=as_of))


def test_a_repeated_batch_adds_nothing(spark, hb, feed):
    add = slots.add_batch(feed.database)
    one, two = hb({"id": 1, "at": "05 06:00:00"}, {"id": 2, "at": "05 06:03:00"}), hb({"id": 3, "at": "05 06:05:00"})
    for batch, number in ((one, 0), (two, 1), (two, 1), (one.where("false"), 2)):
        add(batch, number)
    (got,) = rows(slots.attributed(feed.table("slots"), date(2024, 1, 5), date(2024, 1, 5)))
    assert (got["heartbeats"], got["coding_seconds"]) == (3, 300)


def test_a_batch_is_added_without_its_slots_being_made_again(spark, hb, feed, monkeypatch):
    """In time order nothing overlaps; a late row overlaps in its own slot only."""
    old = slots.slot_rows(hb({"id": 1, "at": "05 06:00:00"}, {"id": 2, "at": "05 06:04:00"}, {"id": 3, "at": "05 07:00:00"}))
    for at, count in (("05 06:05:00", 0), ("05 06:02:00", 1), ("05 06:04:00", 1), ("05 05:50:01", 0)):
        new = slots.slot_rows(hb({"id": 9, "at": at})).withColumn("applied", F.lit(1).cast("bigint"))
        whole = slots.merged(old.withColumn("applied", F.lit(0).cast("bigint")), new)
        assert whole.where("overlaps").count() == count, at


def test_who_is_active_after_each_trigger(spark, hb, feed):
    rng = random.Random(4)
    start = datetime(2024, 1, 5, 6)
    made, at = [], start
    for n in range(240):
        at += timedelta(seconds=rng.choice([1, 5, 20, 60, 200]))
        back = timedelta(seconds=rng.choice([0, 0, 0, 90, 400]))
        made.append({"id": n, "time": at - back, "user_id": rng.choice(["a", "b", "c", None, f"u{n // 30}"]),
                     "editor": rng.choice(["VS Code", "Cursor", None]), "project": rng.choice(["p", "q", None]),
                     "type": rng.choice(["file", "domain"]), "entity": f"/f{n % 5}"})
    gone = set()
    for k in range(4):
        feed.arrive(hb(*made[60 * k:60 * k + 60]))
        minutes = stored.current(spark, f"{feed.database}.minutes")
        now = active.instant(minutes)
        day = Clock.at(now).local_date
        got = active.active_now(minutes, slots.attributed(feed.table("slots"), day, day), as_of=now)
        want = realtime_active(feed.arrived(), as_of=now)
        assert rows(got) == rows(want) and rows(got)
        users = {r["user_id"] for r in rows(got)}
        gone |= {f"u{j}" for j in range(8)} - users
        assert minutes.count() <= 10 * len(users | {None}) + 10
        assert {r["user_id"] for r in rows(minutes)} <= users
    assert {"u0", "u1"} <= gone


def test_stale_days_are_found_and_only_they_are_made_again(spark, hb, feed):
    made = []

    def figure(df):
        made.append(sorted({r["local_day"] for r in rows(df.select("local_day").distinct())}))
        return df.groupBy("user_id", "local_day").agg(F.count("*").alias("n"))

    counts = f"{feed.database}.counts"
    stored.create_by_day(spark, counts, spark.createDataFrame([], "user_id string, n bigint").schema)
    feed.arrive(hb({"id": 1, "at": "05 06:00:00"}, {"id": 2, "at": "06 06:00:00"}, {"id": 3, "at": "07 06:00:00"}))
    assert slots.refresh_stale(spark, feed.database, counts, figure) == [date(2024, 1, d) for d in (5, 6, 7)]
    assert slots.refresh_stale(spark, feed.database, counts, figure) == []
    feed.arrive(hb({"id": 4, "at": "06 05:00:00"}))
    assert [r["late"] for r in rows(feed.table("notes").where("batch = 1"))] == [1]
    assert slots.refresh_stale(spark, feed.database, counts, figure) == [date(2024, 1, 6)]
    assert made == [[date(2024, 1, d) for d in (5, 6, 7)], [date(2024, 1, 6)]]
    assert {(r["local_day"].day, r["n"]) for r in rows(spark.table(counts))} == {(5, 1), (6, 2), (7, 1)}


def test_nothing_has_arrived(spark, hb, feed):
    assert active.instant(stored.current(spark, f"{feed.database}.minutes")) is None
    assert slots.stale_days(spark, feed.database) == []
    assert feed.table("slots").count() == 0


def test_a_batch_of_minutes_is_computed_once(spark, hb, feed):
    """However often its rows are used: a batch is a read of the stream and a pass over its state."""
    made = [{"id": n, "at": f"05 06:{n:02d}:00"} for n in range(40)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    changed = active.minutes(hb(*made))
    active.keep(f"{feed.database}.minutes")(changed.mapInArrow(count, changed.schema), 0)
    assert seen.value == 40
    kept = rows(stored.current(spark, f"{feed.database}.minutes"))
    assert sorted(r["max_id"] for r in kept) == list(range(30, 40))
