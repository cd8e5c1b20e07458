"""Helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def registrar(queries: dict, oracle: dict[str, str]) -> Callable:
    """A decorator that registers a query under its name, with its SQL where there is one."""

    def query(name: str, sql: str | None = None):
        def put(f):
            queries[name] = f
            if sql:
                oracle[name] = sql
            return f

        return put

    return query


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
