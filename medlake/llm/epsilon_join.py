"""Cosine neighbours by an epsilon grid order join.

Unit vectors with cosine of at least c lie within epsilon = sqrt(2 - 2c) of each other.
They are centred and turned to as many principal axes as hold most of their variance,
and sorted by the epsilon-wide grid cells of these axes, first axis first, then by their
halves, quarters and eighths.  Ranges of this sequence are blocks, and short runs inside them leaves, each with a box around its
vectors; the length of what the axes leave out counts as one more axis, as two such
lengths differ by no more than the vectors do.

Which vectors meet is settled on the boxes, before any row moves: blocks are paired if
their cell intervals on the first axis come within one cell and their boxes within
epsilon, and of a pair of blocks only those leaves are sent that have a leaf within
epsilon on the other side.  Inside a task the join recurs: intervals of the sequence are
halved, and pairs of halves whose boxes are further apart than epsilon are skipped, until
the rest is one small product in double precision.

Equal vectors are one class with a count.  A pair of blocks returns, for each class, how
many vectors it is linked to there, and at most one link for a class and component, so
nothing grows with the number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medlake.llm.components import connected_components
from medlake.llm.skew import join_classes
from medlake.llm.words import tidy
from medlake.plans.shared import discard, materialize, scratch

#: Share of the variance that the axes hold, and the most of them; vectors in a box, in a product, and in a block.
SHARE, AXES, LEAF, PRODUCT, BLOCK = 0.9, 16, 16, 256, 8192
#: Grid cells are told apart by ever finer ones, all axes at a time, so that neighbours in the sequence stay close.
FINER = (1, 2, 4, 8)
SLACK = 1e-9
Batches = Iterator[pa.RecordBatch]


@dataclass
class Frame:
    """Where vectors are centred, and the axes they are turned to; vectors are rows."""

    mean: np.ndarray
    axes: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """Coordinates on the axes, and last the length of the rest."""
        c = x - self.mean
        lead = c @ self.axes
        rest = np.sqrt(np.maximum((c * c).sum(1) - (lead * lead).sum(1), 0))
        return np.hstack([lead, rest[:, None]])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, unit): null for vectors that are null, empty, zero or not finite throughout."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = v.values
                x = None if x is None or x.null_count or not len(x) else x.to_numpy(zero_copy_only=False).astype(np.float64)
                if x is not None and np.isfinite(x).all() and (big := np.abs(x).max()) > 0:
                    x = x / big
                    out.append((x / math.sqrt(x @ x)).tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "unit"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(work, "id long, unit binary")


def frame(classes: DataFrame, size: int, share: float = SHARE, most: int = AXES) -> Frame:
    """Mean and leading principal axes: as many as hold ``share`` of the variance, ``most`` at most."""
    wide = size + 1

    def work(batches: Batches) -> Batches:
        total = np.zeros((wide, wide))
        for batch in batches:
            if batch.num_rows:
                x = np.hstack([_matrix(batch.column(0)), np.ones((batch.num_rows, 1))])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    sums = classes.select("unit").mapInArrow(work, "m binary").select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.substring("m", i * (8 * wide) + 1, F.lit(8 * wide)))).alias("row", "m"))

    def add(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[r] = total.get(r, 0) + np.frombuffer(m, np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["row", "m"])

    rows = sums.repartition("row").mapInArrow(add, "row int, m binary").collect()  # one row for each dimension and one
    m = np.stack([np.frombuffer(r.m, np.float64) for r in sorted(rows, key=lambda r: r.row)])
    mean = m[:size, size] / m[size, size]
    values, vectors = np.linalg.eigh(m[:size, :size] / m[size, size] - np.outer(mean, mean))
    held = np.cumsum(np.maximum(values[::-1], 0))
    k = int(np.searchsorted(held, share * held[-1])) + 1
    return Frame(mean, np.ascontiguousarray(vectors[:, ::-1][:, : min(k, most, size)]))


def _placed(classes: DataFrame, f: Frame, eps: float) -> DataFrame:
    k = f.axes.shape[1]

    def work(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                lead = f.place(_matrix(batch.column(1)))[:, :k] / eps
                cells = np.hstack([np.floor(lead * finer) for finer in FINER]).clip(-(2**15), 2**15 - 1).astype(np.int16)
                at = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * (k * len(FINER)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(cells.reshape(-1)))], names=["id", "unit", "n", "cell"])

    return classes.select("id", "unit", "n").mapInArrow(work, "id long, unit binary, n long, cell array<smallint>")


def _apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap) > eps * eps + SLACK


class _Side:
    def __init__(self, t: pa.Table, f: Frame):
        self.ids, self.n = t.column("id").to_numpy(), t.column("n").to_numpy()
        self.x = _matrix(t.column("unit").combine_chunks())
        self.lead = f.place(self.x)


def ego_pairs(a: _Side, b: _Side, same: bool, least: float, eps: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """Offsets and hit matrices of the leaves where vectors of ``a`` and ``b`` are within epsilon."""
    stack = [(0, len(a.ids), 0, len(b.ids))]
    while stack:
        i, j, k, m = stack.pop()
        if i == j or k == m:
            continue
        p, q = a.lead[i:j], b.lead[k:m]
        if _apart(p.min(0), p.max(0), q.min(0), q.max(0), eps):
            continue
        if j - i <= PRODUCT and m - k <= PRODUCT:
            hit = a.x[i:j] @ b.x[k:m].T >= least
            if same:
                hit &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
            if hit.any():
                yield i, k, hit
            continue
        if j - i >= m - k:
            h = (i + j) // 2
            parts = [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            parts = [(i, j, k, h), (i, j, h, m)]
        stack += [x for x in parts if not same or x[0] < x[3]]


def _forest(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after links (u, v): the root of every linked tree hangs on a smaller one until none is crossed.

    Roots are their own labels, and all labels are roots, before and after; so links of
    earlier calls hold for all members of a tree, not only for those linked now.
    """
    labels = labels.copy()
    while True:
        a, b = labels[u], labels[v]
        cross = a != b
        if not cross.any():
            return labels
        np.minimum.at(labels, np.maximum(a, b)[cross], np.minimum(a, b)[cross])
        while ((up := labels[labels]) != labels).any():
            labels = up


def join_blocks(t: pa.Table, f: Frame, least: float, eps: float) -> pa.RecordBatch | None:
    """(id, links, other): vectors linked to each class in this pair of blocks, and one link into its component."""
    side = t.column("side").to_numpy()
    a = _Side(t.filter(pa.array(side == 0)), f)
    same = not (side == 1).any()
    b = a if same else _Side(t.filter(pa.array(side == 1)), f)
    if not len(a.ids) or not len(b.ids):
        return None
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    shift = 0 if same else len(a.ids)
    links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, k, hit in ego_pairs(a, b, same, least, eps):
        links[i : i + hit.shape[0]] += hit @ b.n[k : k + hit.shape[1]]
        links[shift + k : shift + k + hit.shape[1]] += a.n[i : i + hit.shape[0]] @ hit
        u, v = np.nonzero(hit)
        labels = _forest(labels, u + i, v + k + shift)
    some = links > 0
    if not some.any():
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[labels[some]])], names=["id", "links", "other"])


def _sequence(placed: DataFrame, blocks: int, size: int) -> DataFrame:
    """Rows in grid order with the block and the leaf they fall into."""
    parts = materialize(placed.repartitionByRange(blocks, "cell", "id").withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    base = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("cell", "id")) - 1 + F.col("_base")
    numbered = parts.join(base, "_part").withColumn("_place", place).drop("_part", "_base")
    out = materialize(numbered.select("id", "unit", "n", "cell", F.floor(F.col("_place") / size).cast("int").alias("block"), F.floor(F.col("_place") % size / LEAF).cast("int").alias("leaf")), "sequence")
    discard(parts)
    return out


def _boxes(sequence: DataFrame, f: Frame) -> DataFrame:
    """(block, low, high, leaves): the box of each block, and those of its leaves as (leaf, low, high)."""
    k = f.axes.shape[1] + 1

    def work(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
                x = f.place(_matrix(batch.column(2)))
                order = np.argsort(key, kind="stable")
                known, at = np.unique(key[order], return_index=True)
                low, high = np.minimum.reduceat(x[order], at), np.maximum.reduceat(x[order], at)
                yield pa.RecordBatch.from_arrays([pa.array((known >> 32).astype(np.int32)), pa.array((known & 0xFFFFFFFF).astype(np.int32)), pa.array(low.tolist()), pa.array(high.tolist())], names=["block", "leaf", "low", "high"])

    found = sequence.select("block", "leaf", "unit").mapInArrow(tidy(work), "block int, leaf int, low array<double>, high array<double>")
    each = lambda g, low, high: g.agg(*(F.min(F.col(low)[i]).alias(f"l{i}") for i in range(k)), *(F.max(F.col(high)[i]).alias(f"h{i}") for i in range(k)))
    box = [F.array(*(f"{x}{i}" for i in range(k))).alias(name) for x, name in (("l", "low"), ("h", "high"))]
    leaves = materialize(each(found.groupBy("block", "leaf"), "low", "high").select("block", "leaf", *box), "leaves")
    whole = each(leaves.groupBy("block"), "low", "high").select("block", *box)
    listed = leaves.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("leaf", "low", "high"))).alias("leaves"))  # a block's leaves are few
    return materialize(whole.join(listed, "block"), "boxes")


def _sides(boxes: DataFrame, eps: float) -> DataFrame:
    """(a, b, block, leaf, side): the leaves that each pair of blocks needs."""
    cell = lambda c: F.floor(F.col(c)[0] / eps)
    left = boxes.select(F.col("block").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence(cell("low") - 1, cell("high") + 1)).alias("c"))
    right = boxes.select(F.col("block").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.explode(F.sequence(cell("low"), cell("high"))).alias("c"))
    gap = F.aggregate(F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    pairs = left.join(right, "c").where("a <= b").where(gap <= eps * eps + SLACK).select("a", "b").distinct()
    full = pairs.join(boxes.select(F.col("block").alias("a"), F.col("leaves").alias("x")), "a").join(boxes.select(F.col("block").alias("b"), F.col("leaves").alias("y")), "b").select("a", "b", "x", "y")

    def work(batches: Batches) -> Batches:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for row in range(batch.num_rows):
                a, b = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                x, y = (batch.column(c)[row].values for c in (2, 3))
                ids = [v.field("leaf").to_numpy() for v in (x, y)]
                lo_x, hi_x, lo_y, hi_y = (np.array(v.field(n).to_pylist()) for v in (x, y) for n in ("low", "high"))
                near = np.zeros((len(lo_x), len(lo_y)), bool)
                for i in range(len(lo_x)):
                    gap = np.maximum(0, np.maximum(lo_x[i] - hi_y, lo_y - hi_x[i]))
                    near[i] = (gap * gap).sum(1) <= eps * eps + SLACK
                for side, block, leaf in ((0, a, ids[0][near.any(1)]), (1, b, ids[1][near.any(0)])):
                    if near.any() and (side == 0 or a != b):
                        for c, v in zip(out, ([a] * len(leaf), [b] * len(leaf), [block] * len(leaf), leaf.tolist(), [side] * len(leaf))):
                            c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in out], names=["a", "b", "block", "leaf", "side"])

    return full.mapInArrow(tidy(work), "a int, b int, block int, leaf int, side int")


def _joined(sequence: DataFrame, f: Frame, least: float, eps: float) -> DataFrame:
    sides = materialize(_sides(_boxes(sequence, f), eps), "sides")
    dealt = sides.join(sequence, ["block", "leaf"]).select("a", "b", "side", "cell", "id", "unit", "n").repartition("a", "b").sortWithinPartitions("a", "b", "side", "cell", "id").drop("cell")

    def work(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if held and tuple(keys[s]) != last:
                    if (out := join_blocks(pa.Table.from_batches(held), f, least, eps)) is not None:
                        yield out
                    held = []
                last = tuple(keys[s])
                held.append(batch.slice(s, e - s))
        if held and (out := join_blocks(pa.Table.from_batches(held), f, least, eps)) is not None:
            yield out

    return dealt.mapInArrow(tidy(work), "id long, links long, other long")


def pruned_share(classes: DataFrame, least: float, block: int = BLOCK) -> dict[str, float]:
    """What the boxes save on a table of :func:`unit_vectors` classes: rows, rows dealt, and the share of vector pairs not sent."""
    eps = math.sqrt(2 - 2 * least)
    size, n = classes.select(F.octet_length("unit")).first()[0] // 8, classes.count()
    f = frame(classes, size)
    sequence = _sequence(_placed(classes, f, eps), max(1, -(-n // block)), block)
    rows = sequence.groupBy("block", "leaf").count()
    per = _sides(_boxes(sequence, f), eps).join(rows, ["block", "leaf"]).groupBy("a", "b").agg(F.sum(F.when(F.col("side") == 0, F.col("count"))).alias("x"), F.sum(F.when(F.col("side") == 1, F.col("count"))).alias("y"))
    got = per.agg(F.sum(F.col("x") + F.coalesce("y", F.lit(0))), F.sum(F.when(F.col("a") == F.col("b"), F.col("x") * F.col("x") / 2).otherwise(F.col("x") * F.col("y")))).first()
    return {"rows": n, "axes": f.axes.shape[1], "dealt": got[0], "skipped": 1 - got[1] / max(n * n / 2, 1)}


def near_vectors(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors link if their cosine is at least ``least``.  Null, empty, zero or non-finite
    vectors, and rows with a null id, link with nothing.  Vectors must have one length;
    those of another length link only among their own.  Rows that share an id count as
    two vectors with one component.  Further columns of ``rows`` are ignored.
    """
    with scratch() as hand_over:
        eps = math.sqrt(2 - 2 * least)
        units = materialize(unit_vectors(rows, id_col, vec_col), "units")
        valid = units.where("unit is not null and id is not null")
        classes = materialize(valid.groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
        parts = []
        for size, count in classes.groupBy(F.octet_length("unit")).count().collect():  # one row for each vector length
            own = classes.where(F.octet_length("unit") == size)
            f = frame(own, size // 8)
            parts.append(_joined(_sequence(_placed(own, f, eps), max(1, -(-count // block)), block), f, least, eps))
        found = parts[0] if parts else units.limit(0).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("other"))
        for p in parts[1:]:
            found = found.union(p)
        found = materialize(found, "found")
        comp = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        per_class = classes.join(links, "id", "left").join(comp, "id", "left").select("unit", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        per_class = materialize(per_class, "linked")
        hand_over(units, per_class)
    linked = join_classes(valid, per_class, ["unit"]).select("id", "n_links", "component_id")
    alone = units.where("unit is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone).withColumnRenamed("id", id_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
