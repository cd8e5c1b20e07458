"""Results kept by content: computed once for the same plan and inputs, then read."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from medlake.plans.shared import shared_dir


def content_key(df: DataFrame, *parts: str) -> str:
    """A key of the plan's meaning, its input files with sizes and times, and ``parts``."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    seen = hashlib.sha256(f"{df.semanticHash()}|{df.schema.simpleString()}|{'|'.join(parts)}".encode())
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.update(f"{name}|{status.getLen()}|{status.getModificationTime()}".encode())
    return seen.hexdigest()


def cached(df: DataFrame, name: str, root: str | None = None, parts: tuple[str, ...] = ()) -> DataFrame:
    """``df`` from the folder of its content key, written there first if it isn't complete.

    A folder counts from the moment its success marker is there, so a run that was lost
    halfway is done again.
    """
    spark = df.sparkSession
    path = f"{(root or shared_dir(spark)).rstrip('/')}/{name}-{content_key(df, *parts)[:32]}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
