"""Working tables in the folder that driver and executors share.

Iterative plans cut their lineage by writing Parquet to ``spark.checkpoint.dir``: the
files outlive a lost executor, their size is known to the optimizer, and the shuffle
files behind them can be released.  Where the setting is absent on a local master
(tests), a temporary folder is set once for the session; elsewhere that is an error, as
driver and executors would write to folders of their own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='medlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/medlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, release: bool = True) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    ``release`` lets the JVM collect what the finished plan held, so that its shuffle
    files go before the next one writes its own.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._medlake_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Working tables written inside go at the end, but for those that are handed to what this yields.

    A lazy result must hand over the tables that it still reads; they then belong to the
    scope around this one, if any.
    """
    own: list[DataFrame] = []
    held: set[str] = set()
    _scopes.append(own)
    try:
        yield lambda *tables: held.update(t._medlake_path for t in tables)
    finally:
        _scopes.remove(own)
        discard(*(t for t in own if t._medlake_path not in held))
        if _scopes:
            _scopes[-1] += [t for t in own if t._medlake_path in held]


def discard(*tables: DataFrame) -> None:
    """Delete working tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_medlake_path", None)
        if path:
            jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def beside(rows: DataFrame, few: DataFrame, key: Column, most: int = 4096) -> DataFrame:
    """Every row of ``rows`` with every row of ``few``, which has one for each value of ``key`` in it.

    The values are counted first: up to ``most`` of them, ``few`` is broadcast; beyond, Spark
    deals the product over tasks.
    """
    n = few.select(key).limit(most + 1).count()
    return rows.crossJoin(F.broadcast(few) if n <= most else few)


def small_batches(spark: SparkSession, rows: int = 500, size: str = "8m") -> None:
    """Bound what is held at once: rows and bytes of an Arrow batch, and rows of a Parquet batch.

    Long texts make vectors of the reader's default of 4096 rows so large that the heap
    has to grow for them.
    """
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
