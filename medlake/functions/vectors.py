"""Vector expressions over array<double> columns; callers cast floats to double first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products (M2)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: str | Column, floor: float = 1e-9) -> Column:
    """Unit length, with the norm floored (M1)."""
    n = F.greatest(norm(v), F.lit(floor))
    return F.get(F.transform(F.array(n), lambda m: F.transform(v, lambda x: x / m)), F.lit(0))


def mean_vector(rows: DataFrame, by: list[str], v: str, out: str) -> DataFrame:
    """Element-wise mean of each group (A15): partial sums by (group, position), then one row a group."""
    each = rows.select(*by, F.posexplode(v).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg("_x").alias("_m"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out))
