"""Joins of rows to what their class shares, where a class may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS, HOT_CLASSES = 1024, 8192


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], count: str = "n", how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` to ``classes``, which has one row for each key and, in ``count``, its number of rows.

    A class of ``HOT_ROWS`` rows or one in ``HOT_CLASSES`` of all rows, whichever is more,
    is hot.  There can be no more than ``HOT_CLASSES`` of them, so they are broadcast and
    their rows stay where they are; no other class weighs on a task of the exchange.
    """
    total = classes.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, -(-total // HOT_CLASSES))
    hot, cold = classes.where(F.col(count) >= least).drop(count), classes.where(F.col(count) < least).drop(count)
    own = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys, how)
    return own.unionByName(rest)
