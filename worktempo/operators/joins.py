"""Lookup join that stays even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join ``rows`` with a ``lookup`` of one row per key.

    Rows of one key are spread over ``salts`` partitions by a hash of the ``spread`` columns and every lookup row
    is repeated that often. No size is assumed: where the lookup turns out small, Spark broadcasts it by its own
    size threshold.
    """
    salted = rows.withColumn("_salt", F.pmod(F.hash(*spread), F.lit(salts)))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
