"""Tables that jobs change, kept in the session's catalog and written by Spark's own writers.

Ledgers, tags and users are plain tables. An addition is an INSERT. A change that reads what it replaces is written in full to
a staging table first, which the catalog knows only once it is complete, and then INSERT OVERWRITE copies it; a job that dies
in between leaves the staging table, and the next one (``settle``) finishes the copy.

Heartbeats and slots are partitioned by local day. Days are replaced as a whole by ``swap_days``: the new rows are written to
a folder of their own, then the catalog's partition is pointed at it, which is one step of the catalog; only then the old
folder goes. Readers list no folders: the catalog says where a day is.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktempo.sources.tables import dealt_by_day

STAGING = "__next_"


def new_database(spark: SparkSession, folder: str) -> str:
    """A database of its own below a shared folder."""
    name = f"worktempo_{uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    return name


def _as_stored(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def create(rows: DataFrame, name: str) -> None:
    rows.write.format("parquet").saveAsTable(name)


def stage(rows: DataFrame, name: str) -> str:
    """The rows as a staging table of the named one; registered only when they are all written."""
    staged = f"{name}{STAGING}{uuid4().hex}"
    create(rows, staged)
    return staged


def settle(spark: SparkSession, name: str) -> None:
    """Finish a replacement that an earlier job has staged and not copied."""
    database, _, table = name.rpartition(".")
    found = spark.catalog.listTables(database or None, f"{table}{STAGING}*")
    for staged in sorted(t.name for t in found):
        full = f"{database}.{staged}" if database else staged
        spark.table(full).write.mode("overwrite").insertInto(name)
        spark.sql(f"DROP TABLE {full}")


def replace(rows: DataFrame, name: str) -> None:
    """These rows alone; they may be read from the table itself."""
    spark = rows.sparkSession
    stage(_as_stored(rows, spark.table(name).schema), name)
    settle(spark, name)


def append(rows: DataFrame, name: str) -> None:
    _as_stored(rows, rows.sparkSession.table(name).schema).write.insertInto(name)


def current(spark: SparkSession, name: str) -> DataFrame:
    """Rows of a table, after what an earlier job left to finish. A stream's batches run in a session of their own, so what this
    session remembers of the table's files is forgotten."""
    settle(spark, name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def overwrite_batch(rows: DataFrame, name: str, batch: int, *more: str) -> None:
    """Put the rows in the place of those of one batch, in a table partitioned by ``batch`` (and then by ``more``)."""
    spark, view = rows.sparkSession, f"rows_{uuid4().hex}"
    rows.createOrReplaceTempView(view)
    parts = ", ".join([f"batch = {batch}", *more])
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({parts}) SELECT * FROM {view}")
    spark.catalog.dropTempView(view)


# Tables by local day.


def create_by_day(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """An empty table with the partition column ``local_day``."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "local_day")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, local_day date) USING parquet PARTITIONED BY (local_day)")


def store_heartbeats(hb: DataFrame, name: str, *, tz_hours: int = 3, files_per_day: int = 32) -> None:
    """Heartbeats as a new table by local day, sorted by (user, time) inside a file."""
    dealt_by_day(hb, tz_hours, files_per_day).write.format("parquet").partitionBy("local_day").saveAsTable(name)


def stored_days(spark: SparkSession, name: str) -> list[date]:
    """Days of a table, from the catalog."""
    parts = spark.sql(f"SHOW PARTITIONS {name}").collect()
    return sorted(date.fromisoformat(p.partition.split("=")[1]) for p in parts)


def location(spark: SparkSession, name: str, day: date | None = None) -> str:
    """Where a table or one of its days is."""
    part = f" PARTITION (local_day = '{day}')" if day else ""
    rows = spark.sql(f"DESCRIBE FORMATTED {name}{part}").where("col_name = 'Location'").collect()
    # A day's description names its own folder first, then the table's.
    return rows[0].data_type


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_days(spark: SparkSession, name: str, days: Iterable[date]) -> None:
    """Forget days; their rows are not read."""
    parts = ", ".join(f"PARTITION (local_day = '{d}')" for d in days)
    if parts:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {parts}")


def point_day(spark: SparkSession, name: str, day: date, folder: str, known: bool) -> None:
    """The one step that replaces a day."""
    part = f"PARTITION (local_day = '{day}')"
    if known:
        spark.sql(f"ALTER TABLE {name} {part} SET LOCATION '{folder}'")
    else:
        spark.sql(f"ALTER TABLE {name} ADD {part} LOCATION '{folder}'")


def swap_days(spark: SparkSession, name: str, rows: DataFrame, days: Iterable[date]) -> None:
    """Replace the given days by ``rows`` (with ``local_day``), which may be read from the table itself. A day that is left
    without rows is dropped. Stopped at any step, each day has either its old or its new rows, whole."""
    folder = f"{location(spark, name)}/_days-{uuid4().hex}"
    columns = spark.table(name).schema.fieldNames()
    rows.select(*columns).write.partitionBy("local_day").parquet(folder)
    written = spark.read.option("basePath", folder).parquet(folder) if _has_files(spark, folder) else None
    made = set() if written is None else {r.local_day for r in written.select("local_day").distinct().collect()}
    known = set(stored_days(spark, name))
    for day in sorted(days):
        old = location(spark, name, day) if day in known else None
        if day in made:
            point_day(spark, name, day, f"{folder}/local_day={day}", day in known)
            if old:
                remove_folder(spark, old)
        elif old:
            drop_days(spark, name, [day])
    spark.catalog.refreshTable(name)


def _has_files(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return any(f.isDirectory() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def heartbeats_by_day(spark: SparkSession, name: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Heartbeats of a stored table with ``local_day``, the days outside [first, last] not listed."""
    hb = spark.table(name)
    if first is not None:
        hb = hb.where(F.col("local_day") >= F.lit(first))
    if last is not None:
        hb = hb.where(F.col("local_day") <= F.lit(last))
    return hb
