"""Global row numbers without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.plans.shared import materialize


def with_ordinal(rows: DataFrame, order: list[Column], out: str = "ordinal", value: Column | None = None) -> DataFrame:
    """``rows`` numbered from 0 in ascending ``order`` of the expressions, which must be total.

    With ``value``, ``out`` is the sum of it over all earlier rows instead.

    Rows are dealt to ranges and written once; a window numbers each range, and a prefix
    sum over one row for each range does the rest.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *(c.alias(k) for c, k in zip(order, keys)))
    ranged = materialize(keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ordinal", release=False)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    each = F.lit(1).cast("long") if value is None else value
    sums = ranged.groupBy("_part").agg(F.sum(each).alias("_sum"))
    base = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*keys)
    run = F.row_number().over(inside) - 1 if value is None else F.coalesce(F.sum(each).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(base, "_part").withColumn(out, run + F.col("_base")).drop("_part", "_base", *keys)
