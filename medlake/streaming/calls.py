"""Calls of an outside function for each row, with retries, and resumable by key."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_each(rows: DataFrame, key: str, text: str, call: Callable[[str, int], str], attempts: int = 3, wait: float = 1.0, factor: float = 2.0) -> DataFrame:
    """(key, result, error, attempts): ``call(text, attempt)`` for each row, tried again after growing pauses.

    A row whose last attempt fails has the error's text and a null result, and doesn't stop
    the others.  Null texts aren't sent.  A task that is lost is run again, so calls must
    bear repeating; ``done`` rows are left out by :func:`pending`.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for x in batch.column(1).to_pylist():
                result, error, tried = None, None, 0
                while x is not None and tried < attempts and result is None:
                    if tried:
                        time.sleep(wait * factor ** (tried - 1))
                    tried += 1
                    try:
                        result, error = call(x, tried), None
                    except Exception as e:  # whatever the service's client raises
                        error = f"{type(e).__name__}: {e}"
                for c, v in zip(out, (result, error, tried)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], names=["key", "result", "error", "attempts"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {kind}, result string, error string, attempts int").withColumnRenamed("key", key)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a result yet; failed ones come again."""
    return rows.join(done.where("result is not null").select(key), key, "left_anti")
