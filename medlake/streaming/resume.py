"""Incremental forms of batch steps: resume by key, and upsert of a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from medlake.sources.readers import upsert_latest


def append_new(stream: DataFrame, key: str, at: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key hasn't been seen within the watermark; restarts go on from the checkpoint."""
    once = stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_summary(stream: DataFrame, keys: list[str], version: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest version of each key: each batch is merged into a new folder of the table.

    The folder of batch n is written from that of batch n - 1, so a repeated batch gives
    the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{path}/{number - 1}") if number else batch.limit(0)
        upsert_latest(old, batch, keys, version).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
