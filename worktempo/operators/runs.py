"""Runs of consecutive days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def longest_run(days: DataFrame, key: str = "user_id", day: str = "local_day") -> DataFrame:
    """Longest run of consecutive integer days per key, as ``streak``. One row per (key, day) expected."""
    order = Window.partitionBy(key).orderBy(day)
    islands = days.withColumn("_island", F.col(day) - F.row_number().over(order))
    runs = islands.groupBy(key, "_island").agg(F.count("*").alias("streak"))
    return runs.groupBy(key).agg(F.max("streak").alias("streak"))
