"""Groups as arrays of structs, bounded.

An array per key grows with the group, so it holds the first `n` rows by an order, and the number of the others stands beside
it. The first rows are a ranked window, which Spark cuts to n rows per key before the shuffle; the numbers are counts that
are combined before theirs. No task gathers a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.operators.stats import null_safe_join, top_per_key


def nested(df: DataFrame, keys: Sequence[str], items: Sequence[str], n: int, name: str, *order: Column) -> DataFrame:
    """Per key the array `name` of structs of the columns `items`, in order, and `more_<name>`, how many were left out."""
    first = top_per_key(df, keys, n, *order)
    item = F.struct("rank", *items)
    arrays = first.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("found"))
    plain = F.transform("found", lambda i: F.struct(*[i[c].alias(c) for c in items]))
    counts = df.groupBy(*keys).agg(F.count("*").alias("total"))
    both = null_safe_join(arrays, counts, keys)
    return both.select(*keys, plain.alias(name), (F.col("total") - F.size("found")).alias(f"more_{name}"))
