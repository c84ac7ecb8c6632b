"""Attributed active time of a stream as a table of slots by local day that each batch adds to.

A slot row holds what its heartbeats amount to: first and last instant, the gaps between them summed per flag of the later
heartbeat, the flags of the first, counts, and the same span for AI rows alone. Two rows of a slot whose times do not
overlap add up without their heartbeats: the gap between them belongs to the first heartbeat of the later one. Where late
heartbeats fall between earlier ones that is not possible, and just these slots are made again from the kept heartbeats.

``add_batch`` is a ``foreachBatch`` function: it keeps the batch's heartbeats by (batch, day), so a repeated batch replaces
its own rows, and swaps the slots of the days it touched (``stored.swap_days``). A slot remembers the batch it has seen last, so
a batch that is repeated after a crash is not added twice. Every batch also notes its days, with how many of their heartbeats
were late: from the notes ``stale_days`` tells for which days a figure has to be made again, and ``refresh_stale`` does it.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from worktempo.functions.clock import Clock, day_number
from worktempo.functions.columns import is_ai, or_zero, seconds
from worktempo.operators.gaps import active_us, flagged_slot_rows, linked
from worktempo.operators.scan import with_slots
from worktempo.operators.stats import ATTRIBUTED, gap_flags
from worktempo.sources import schemas, stored

FLAGS = ["ide", "browsing", "ai"]
KEYS = ["user_id", "day_number", "slot"]
SUMS = ["heartbeats", "ai_heartbeats"]
SLOTS = T.StructType(
    [T.StructField("user_id", T.StringType()), T.StructField("day_number", T.IntegerType()), T.StructField("slot", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("first_t", "last_t", "inner_us", *(f"inner_{f}_us" for f in FLAGS))]
    + [T.StructField(f"first_{f}", T.BooleanType()) for f in FLAGS]
    + [T.StructField(c, T.LongType()) for c in (*SUMS, "ai_first_t", "ai_last_t", "applied")]
)


def create(spark: SparkSession, database: str) -> None:
    """The empty tables ``heartbeats``, ``slots``, ``notes`` and ``refreshed`` of a stream."""
    stored.create_by_day(spark, f"{database}.slots", SLOTS)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.HEARTBEATS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.heartbeats ({columns}, batch bigint, local_day date) USING parquet "
              "PARTITIONED BY (batch, local_day)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.notes (heartbeats bigint, late bigint, latest timestamp_ntz, local_day date, "
              "batch bigint) USING parquet PARTITIONED BY (batch)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.refreshed (local_day date, batch bigint) USING parquet")


def slot_rows(hb: DataFrame, *, idle_minutes: int = 10, tz_hours: int = 3) -> DataFrame:
    """Slots of some heartbeats, each by itself."""
    rows = with_slots(hb, tz_hours=tz_hours, idle_minutes=idle_minutes).withColumn("own_ai", is_ai())
    ai_t = F.when(F.col("own_ai"), F.col("t"))
    found = flagged_slot_rows(
        rows, ["user_id"], gap_flags(FLAGS), F.count("*").alias("heartbeats"), F.count_if("own_ai").alias("ai_heartbeats"),
        F.min(ai_t).alias("ai_first_t"), F.max(ai_t).alias("ai_last_t"),
    ).withColumnRenamed("local_day", "day_number")
    return found.withColumns({f"inner_{f}_us": or_zero(f"inner_{f}_us") for f in FLAGS})


def _added(early: str, late: str) -> dict[str, Column]:
    """The figures of a slot from those of two stretches of it, one before the other."""
    gap = F.col(f"{late}.first_t") - F.col(f"{early}.last_t")
    found = {"first_t": F.col(f"{early}.first_t"), "last_t": F.col(f"{late}.last_t"),
             "inner_us": F.col(f"{early}.inner_us") + F.col(f"{late}.inner_us") + gap}
    for f in FLAGS:
        across = F.when(F.col(f"{late}.first_{f}"), gap).otherwise(F.lit(0))
        found[f"inner_{f}_us"] = F.col(f"{early}.inner_{f}_us") + F.col(f"{late}.inner_{f}_us") + across
        found[f"first_{f}"] = F.col(f"{early}.first_{f}")
    return found


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per slot of the old rows and a batch's (with ``applied``); ``overlaps`` where their times do."""
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEYS]
    both = old.select(F.struct(*SLOTS.fieldNames()).alias("o")).join(
        new.select(F.struct(*SLOTS.fieldNames()).alias("n")), same[0] & same[1] & same[2], "full")
    known, fresh = F.col("o").isNotNull(), F.col("n").isNotNull() & ~F.coalesce(F.col("o.applied") >= F.col("n.applied"), F.lit(False))
    before = F.col("o.last_t") < F.col("n.first_t")
    after = F.col("n.last_t") < F.col("o.first_t")
    forwards, backwards = _added("o", "n"), _added("n", "o")
    figures = {c: F.when(before, forwards[c]).when(after, backwards[c]) for c in forwards}
    figures |= {c: F.col(f"o.{c}") + F.col(f"n.{c}") for c in SUMS}
    figures |= {"ai_first_t": F.least("o.ai_first_t", "n.ai_first_t"), "ai_last_t": F.greatest("o.ai_last_t", "n.ai_last_t"),
                "applied": F.col("n.applied")}

    def chosen(name: str) -> Column:
        together = figures.get(name, F.col(f"n.{name}"))
        return F.when(~fresh, F.col(f"o.{name}")).when(known, together).otherwise(F.col(f"n.{name}")).alias(name)

    return both.select(*[chosen(f.name) for f in SLOTS], (known & fresh & ~before & ~after).alias("overlaps"))


def add_batch(database: str, *, idle_minutes: int = 10, tz_hours: int = 3, delay_minutes: int = 10, files_per_day: int = 8):
    """The function for ``foreachBatch``."""
    options = {"idle_minutes": idle_minutes, "tz_hours": tz_hours}

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept, slots = f"{database}.heartbeats", f"{database}.slots"
        day = F.to_date(F.col("time") + F.expr(f"INTERVAL '{tz_hours}' HOUR"))
        spread = F.pmod(F.xxhash64("user_id", F.date_trunc("minute", F.col("time"))), F.lit(files_per_day))
        dealt = (batch.select(*schemas.HEARTBEATS.fieldNames(), day.alias("local_day")).withColumn("_file", spread)
                 .repartition("local_day", "_file").drop("_file"))
        stored.overwrite_batch(dealt, kept, batch_id, "local_day")
        mine = spark.table(kept).where(F.col("batch") == batch_id)
        # Late: behind what the batches before had reached, less the delay.
        reached = spark.table(f"{database}.notes").where(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        limit = F.lit(None if reached is None else reached.isoformat(sep=" ")).cast("timestamp_ntz")
        late = F.count_if(F.coalesce(F.col("time") < limit - F.expr(f"INTERVAL '{delay_minutes}' MINUTE"), F.lit(False)))
        noted = mine.groupBy("local_day").agg(F.count("*").alias("heartbeats"), late.alias("late"), F.max("time").alias("latest"))
        stored.overwrite_batch(noted.select("heartbeats", "late", "latest", "local_day"), f"{database}.notes", batch_id)
        days = [r.local_day for r in spark.table(f"{database}.notes").where(F.col("batch") == batch_id).select("local_day").collect()]
        if not days:
            return
        applied = F.lit(batch_id).cast("bigint").alias("applied")
        new = slot_rows(mine.drop("local_day", "batch"), **options).select("*", applied)
        whole = merged(spark.table(slots).where(F.col("local_day").isin(days)).drop("local_day"), new)
        doubtful = whole.where("overlaps").select(*[F.col(k).alias(f"_{k}") for k in KEYS])
        rows = spark.table(kept).where(F.col("local_day").isin(days) & (F.col("batch") <= batch_id)).drop("local_day", "batch")
        asked = F.col("user_id").eqNullSafe(F.col("_user_id")) & (F.col("local_day") == F.col("_day_number")) & (F.col("slot") == F.col("_slot"))
        again = with_slots(rows, **options).join(doubtful, asked, "left_semi").drop("t", "local_day", "slot")
        made = slot_rows(again, **options).select("*", applied).select(*SLOTS.fieldNames())
        result = whole.where(~F.col("overlaps")).drop("overlaps").unionByName(made)
        stored.swap_days(spark, slots, result.withColumn("local_day", F.date_from_unix_date("day_number")), days)

    return add


def run(stream: DataFrame, database: str, checkpoint: str, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Keep the tables of ``create`` from a stream of heartbeats; by default work off what is there and stop."""
    writer = stream.writeStream.foreachBatch(add_batch(database, **options)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _days(slots: DataFrame, first: date, last: date) -> DataFrame:
    days = slots.where(F.col("local_day").between(F.lit(first), F.lit(last)))
    return days.withColumn("local_day", F.col("day_number"))


def attributed(slots: DataFrame, first: date, last: date, *, idle_minutes: int = 10, tz_hours: int = 3) -> DataFrame:
    """Heartbeats and seconds per user over the local days [first, last]."""
    opts = {"idle_minutes": idle_minutes, "tz_hours": tz_hours}
    return linked(_days(slots, first, last), ["user_id"]).groupBy("user_id").agg(
        F.sum("heartbeats").alias("heartbeats"), seconds(F.sum(active_us(**opts))).alias("coding_seconds"),
        *[seconds(F.sum(active_us(f, **opts))).alias(ATTRIBUTED[f]) for f in FLAGS],
    )


def ai_totals(
    slots: DataFrame, users: DataFrame, *, as_of: datetime, days: int = 30, idle_minutes: int = 10, tz_hours: int = 3
) -> DataFrame:
    """The figures of ``user_ai_totals``: gaps between AI heartbeats only."""
    clock = Clock.at(as_of, tz_hours)
    since = F.lit(day_number((clock.days_back(days) + clock.offset).date()))
    ai = slots.where((F.col("ai_heartbeats") > 0) & (F.col("local_day") >= F.date_from_unix_date(since)))
    own = ai.select("user_id", "slot", "ai_heartbeats", F.col("day_number").alias("local_day"), F.col("ai_first_t").alias("first_t"),
                    F.col("ai_last_t").alias("last_t"), (F.col("ai_last_t") - F.col("ai_first_t")).alias("inner_us"))
    sums = linked(own, ["user_id"]).groupBy("user_id").agg(
        F.sum("ai_heartbeats").alias("n"), seconds(F.sum(active_us(idle_minutes=idle_minutes))).alias("s"))
    return users.select(F.col("id").alias("user_id")).join(sums, "user_id", "left").select(
        "user_id", or_zero("n").alias("ai_heartbeats"), or_zero("s").alias("ai_coding_seconds"))


def stale_days(spark: SparkSession, database: str) -> list[date]:
    """Days that got heartbeats, in time or late, since they were last refreshed."""
    noted = spark.table(f"{database}.notes").groupBy("local_day").agg(F.max("batch").alias("batch"))
    done = spark.table(f"{database}.refreshed").groupBy("local_day").agg(F.max("batch").alias("done"))
    found = noted.join(done, "local_day", "left").where(F.col("done").isNull() | (F.col("batch") > F.col("done")))
    return sorted(r.local_day for r in found.select("local_day").collect())


def refresh_stale(spark: SparkSession, database: str, figures: str, figure) -> list[date]:
    """Make the stored table ``figures`` again for the stale days, from their kept heartbeats (with ``local_day``) by
    ``figure``; returns the days. Other days are not read."""
    days = stale_days(spark, database)
    if days:
        upto = spark.table(f"{database}.notes").agg(F.max("batch")).first()[0]
        rows = spark.table(f"{database}.heartbeats").where(F.col("local_day").isin(days)).drop("batch")
        stored.swap_days(spark, figures, figure(rows), days)
        done = spark.createDataFrame([(d, upto) for d in days], "local_day date, batch bigint")
        stored.append(done, f"{database}.refreshed")
    return days
