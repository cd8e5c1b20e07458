"""Mixture-controlled packing of texts into fixed token windows, by deficit round-robin.

Every source is a queue of its texts' tokens.  In each round, a source's deficit counter
grows by its quantum, the target share of one window; the next packet (a text or a part
of one, of at most ``packet`` tokens) is served in the first round in which the counter
covers it, and what is left of the counter is carried on.  As a queue's credit after k
rounds is k times its quantum, the round of a packet is a function of where it ends in
its queue: rounds, and with them deficits, run through windows and partitions without
any task having to wait for another.  Served packets follow one another without gaps;
every ``window`` tokens end a sequence, so that only the last one is short.

Queue positions and the places of (round, source) groups are prefix sums, taken over
range partitions; no window function sees more than a partition's rows, or one row for
each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.llm.word_tokens import word_ids
from medlake.llm.words import tidy
from medlake.plans.shared import materialize, scratch

END_ID = 1


def tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end_id: int = END_ID) -> DataFrame:
    """(id, source, n_tokens, ids): ids with the end id, as zstd-packed unsigned 32-bit; null texts are empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, z = word_ids(path), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = [t.encode(x or "") + end for x in batch.column(2).to_pylist()]
            n = [len(r) // 4 for r in rows]
            packed = [z.compress(r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["id", "source", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(work), "id long, source string, n_tokens long, ids binary")


def prefix_sum(rows: DataFrame, within: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over earlier rows of the same ``within`` key, in ``order``."""
    ranged = rows.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged", release=False)
    sums = ranged.groupBy(*within, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*within, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*within, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return run.join(base, [*within, "_part"]).withColumn(out, F.col(out) + F.col("_base")).drop("_base", "_part")


def _quanta(lens: DataFrame, window: int, shares: dict[str, float] | None) -> tuple[DataFrame, Column]:
    """Sources with their quantum: the target share of a window, by default the source's share of all tokens."""
    sums = lens.groupBy("source").agg(F.sum("n_tokens").alias("_all"))
    if shares is None:
        total = lens.agg(F.sum("n_tokens")).first()[0] or 1
        quantum = F.col("_all") * F.lit(window / total)
    else:
        known = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))
        quantum = F.coalesce(known[F.col("source")], F.lit(1e-9)) * F.lit(window / sum(shares.values()))
    return sums.select("source", quantum.alias("_quantum"))


def _packets(lens: DataFrame, window: int, packet: int, shares: dict[str, float] | None) -> DataFrame:
    """(row, source, i, begin, size, round) of each packet of (row, id, source, n_tokens)."""
    queue = prefix_sum(lens, ["source"], ["id", "row"], "n_tokens", "at")
    queue = queue.join(_quanta(lens, window, shares), "source")
    parts = queue.select("row", "source", "n_tokens", "at", "_quantum", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / packet))).alias("i"))
    size = F.least(F.lit(packet), F.col("n_tokens") - F.col("i") * packet)
    parts = parts.select("row", "source", "i", (F.col("at") + F.col("i") * packet).alias("begin"), size.cast("long").alias("size"), "_quantum")
    parts = parts.select("row", "source", "i", "begin", "size", F.ceil((F.col("begin") + F.col("size")) / F.col("_quantum")).alias("round"))
    return materialize(parts, "packets")


def pack(docs: DataFrame, path: str, window: int = 2048, packet: int = 256, shares: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of all rows of ``docs``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.  A null text
    is empty and gives the end id alone; a null source is the source "".  Rows that share
    an id are packed each on its own, and null ids stay null.  ``shares`` maps sources to
    target weights; sources without one are served last.  Without ``shares`` all queues run
    dry together, so every window has the mixture of the whole table to within a packet
    of each source.
    """
    packed = materialize(tokens(docs, path, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id()), "tokens")
    lens = packed.select("row", "id", "source", "n_tokens")
    with scratch() as hand_over:
        parts = _packets(lens, window, packet, shares)
        hand_over(parts)
    groups = parts.groupBy("round", "source").agg(F.sum("size").alias("size"), F.min("begin").alias("first"))
    groups = prefix_sum(groups.withColumn("_one", F.lit(0)), ["_one"], ["round", "source"], "size", "base").drop("_one", "size")
    placed = parts.join(groups, ["round", "source"]).select("row", F.struct("i", (F.col("base") + F.col("begin") - F.col("first")).alias("place")).alias("p"))
    placed = placed.groupBy("row").agg(F.sort_array(F.collect_list("p")).alias("p"))
    full = packed.join(placed, "row").select("id", "n_tokens", "ids", F.col("p.place").alias("place"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                out: list[tuple] = []
                for own, n, raw, place in zip(*(c.to_pylist() for c in part.columns)):
                    ids = z.decompress(raw)
                    at = np.array(place, np.int64)
                    begin = np.arange(len(at)) * packet
                    fresh = np.ones(len(at), bool)
                    fresh[1:] = (at[1:] - at[:-1] != packet) | (at[1:] % window == 0)
                    runs = np.flatnonzero(fresh)
                    for b, e, p in zip(begin[runs].tolist(), [*begin[runs[1:]].tolist(), n], at[runs].tolist()):
                        while b < e:
                            size = min(e - b, window - p % window)
                            out.append((own, b, size, ids[4 * b : 4 * (b + size)], n, p // window, p % window))
                            b, p = b + size, p + size
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    pieces = full.mapInArrow(tidy(cut), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("id", id_col)


