"""Reading and writing the tables.

Heartbeats are laid out as Parquet by ``local_day`` (yyyy-MM-dd), sorted by (user_id, time) inside a file, so a
range scan reads only its days and row-group statistics help a single-user filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktempo.sources import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A live relational table; pass partitionColumn, lowerBound, upperBound, numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def replace_partitions(rows: DataFrame, path: str, column: str, values: Sequence[str], present: Sequence[str]) -> None:
    """Replace the named partitions of a table by ``rows``; other partitions stay.

    ``present`` names those that have rows. A dynamic overwrite leaves a partition alone for which there are none, so
    the others of ``values`` are emptied one by one.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    for value in sorted(set(values) - set(present)):
        empty_partition(rows, path, column, value)


def empty_partition(like: DataFrame, path: str, column: str, value: str) -> None:
    """Overwrite a partition's folder with no rows."""
    like.where("false").drop(column).write.mode("overwrite").parquet(f"{path}/{column}={value}")


def dealt_by_day(hb: DataFrame, tz_hours: int = 3, files_per_day: int = 32) -> DataFrame:
    """The heartbeats with ``local_day``, dealt out and sorted as they are stored.

    ``files_per_day`` spreads a day over that many files by user and minute, so neither a busy day nor a busy
    user ends in one task. Small partitions of the shuffle are merged by Spark, so a quiet day has fewer files.
    """
    local = F.col("time") + F.expr(f"INTERVAL '{tz_hours}' HOUR")
    spread = F.pmod(F.xxhash64("user_id", F.date_trunc("minute", F.col("time"))), F.lit(files_per_day))
    return (
        hb.withColumn("local_day", F.to_date(local))
        .withColumn("_file", spread)
        .repartition("local_day", "_file")
        .drop("_file")
        .sortWithinPartitions("local_day", "user_id", "time", "id")
    )


def write_heartbeats(hb: DataFrame, path: str, *, tz_hours: int = 3, files_per_day: int = 32) -> None:
    """Write the heartbeats, replacing only the local days present in ``hb``."""
    (
        dealt_by_day(hb, tz_hours, files_per_day)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("local_day")
        .parquet(path)
    )


def read_heartbeats(
    spark: SparkSession,
    path: str,
    *,
    start: datetime | None = None,
    end: datetime | None = None,
    tz_hours: int = 3,
) -> DataFrame:
    """Heartbeats with the partition predicate implied by a UTC range [start, end)."""
    schema = T.StructType([*schemas.HEARTBEATS.fields, T.StructField("local_day", T.DateType())])
    hb = spark.read.schema(schema).parquet(path)
    offset = timedelta(hours=tz_hours)
    if start is not None:
        hb = hb.where(F.col("local_day") >= F.lit((start + offset).date()))
    if end is not None:
        hb = hb.where(F.col("local_day") <= F.lit((end + offset).date()))
    return hb.drop("local_day")
