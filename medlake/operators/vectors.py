"""Similarity search, bank projection, alignment and centroid analysis over (id, v) tables.

``v`` is array<double>.  A search is done in blocks of both sides: each pair of blocks keeps
its own best rows for its queries, and a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.functions.vectors import dot, mean_vector, norm, normalize
from medlake.plans.shared import beside

#: Queries a task holds; rows of either side in one product.
QUERY_BLOCK, TILE = 8192, 2048
#: Tasks of a search at most; beyond, a task takes several pairs of blocks, one after the other.
MAX_TASKS = 8192


class _Best:
    """The k best bank rows so far of a few queries, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str, digits: int):
        self.ids, self.q, self.k, self.metric, self.digits = ids, q, k, metric, digits
        self.row, self.bank, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def add(self, bank: np.ndarray, x: np.ndarray) -> None:
        s = self.q @ x.T
        if self.metric == "l2":
            s = -((self.q * self.q).sum(1)[:, None] - 2 * s + (x * x).sum(1)[None, :])
        least = self.least
        if s.shape[1] > self.k and np.isinf(least).any():
            least = np.fmax(least, -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1])
        row, col = np.nonzero(~(s < least[:, None] - 2 * 10.0**-self.digits))  # more than rounding can move; NaN stays
        row, bank, score = np.append(self.row, row), np.append(self.bank, bank[col]), np.append(self.score, np.round(s[row, col], self.digits))
        order = np.lexsort((bank, -score, row))
        first = np.searchsorted(row[order], np.arange(len(self.ids)))
        order = order[np.arange(len(order)) - first[row[order]] < self.k]
        self.row, self.bank, self.score = row[order], bank[order], score[order]
        full = np.bincount(self.row, minlength=len(self.ids)) == self.k
        last = np.searchsorted(self.row, np.arange(len(self.ids)), "right") - 1
        self.least[full] = np.nan_to_num(self.score[last[full]], nan=-np.inf, posinf=np.inf, neginf=-np.inf)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.bank), pa.array(self.score)], names=["query_id", "bank_id", "score"])


def top_k(queries: DataFrame, bank: DataFrame, k: int, metric: str = "dot", digits: int = 9) -> DataFrame:
    """(query_id, bank_id, score, rank): the ``k`` best bank rows of each query, ties to the smaller id.

    Scores are dots, or negated squared distances for ``metric="l2"``.  Blocks of queries
    meet parts of the bank, each pair in one task, which returns k rows a query at most; a
    window merges them.  The bank is cut only while query blocks are fewer than twice the
    cores, so these rows grow with the queries alone.  Neither side is collected.
    """
    n_q = max(1, -(-queries.count() // QUERY_BLOCK))
    n_b = -(-2 * bank.sparkSession.sparkContext.defaultParallelism // n_q)
    tile = TILE
    dealt = lambda id_, n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = lambda rows, id_, n, qb, bb: rows.select(qb.alias("qb"), bb.alias("bb"), F.lit(n).alias("side"), F.col(id_).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    both = side(queries, "query_id", 0, dealt("query_id", n_q), every(n_b)).union(side(bank, "bank_id", 1, every(n_q), dealt("bank_id", n_b)))
    both = both.repartition(min(n_q * n_b, MAX_TASKS), "qb", "bb").sortWithinPartitions("qb", "bb", "side")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Best] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if tuple(keys[s, :2]) != last:
                    yield from (h.batch() for h in held)
                    held, last = [], tuple(keys[s, :2])
                for i in range(s, e, tile):
                    part = batch.slice(i, min(tile, e - i))
                    ids, x = part.column(3).to_numpy(), part.column(4).flatten().to_numpy().reshape(part.num_rows, -1)
                    if keys[s, 2] == 0:
                        held.append(_Best(ids, x, k, metric, digits))
                    else:
                        for h in held:
                            h.add(ids, x)
        yield from (h.batch() for h in held)

    found = both.mapInArrow(work, "query_id long, bank_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "bank_id")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def projection_matrix(bank: DataFrame, a: str, b: str) -> DataFrame:
    """(i, g): rows of the sum of outer products of two vector columns (M4).

    The bank is read once; images then meet this small matrix instead of every concept.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for x in batches:
            if not x.empty:
                g = np.stack(x[a].to_numpy()).T @ np.stack(x[b].to_numpy())
                total = g if total is None else total + g
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "g": list(total)})

    return mean_vector(bank.select(a, b).mapInPandas(sums, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("g")), ["i"], "g", "g")


def project(images: DataFrame, bank: DataFrame, a: str, b: str) -> DataFrame:
    """Images through the bank, ``(v A') B``, as one product with the summed matrix; unit length (M4)."""
    rows = projection_matrix(bank, a, b).orderBy("i").collect()  # one row a dimension
    g = images.sparkSession.sparkContext.broadcast(np.array([r.g for r in rows]))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not x.empty:
                p = np.stack(x["v"].to_numpy()) @ g.value
                yield pd.DataFrame({"id": x["id"], "p": list(p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9))})

    return images.select("id", "v").mapInPandas(apply, "id long, p array<double>")


def centred(bank: DataFrame, v: str, out: str) -> DataFrame:
    """Vectors less the bank's mean, at unit length (M5)."""
    mean = mean_vector(bank.withColumn("_a", F.lit(0)), ["_a"], v, "_m").select("_m")
    return bank.crossJoin(F.broadcast(mean)).withColumn(out, normalize(F.zip_with(v, "_m", lambda x, m: x - m))).drop("_m")  # one row


def zero_shot(positive: Column, negative: Column) -> Column:
    """Two-way softmax without a temperature (M3)."""
    return 1 / (1 + F.exp(negative - positive))


def unit_distance(cosine: Column) -> Column:
    """Distance of unit vectors from their cosine (M8)."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def masked_pool(parts: list[Column], size: int) -> Column:
    """Mean of the parts that are there, beside their number; absent ones count as zeros."""
    zero = F.array_repeat(F.lit(0.0), size)
    total = zero
    for p in parts:
        total = F.zip_with(total, F.coalesce(p, zero), lambda a, b: a + b)
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.transform(total, lambda x: x / F.greatest(n, F.lit(1)))


def rerank(candidates: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, bank_id, distance, place): candidate pairs by exact distance, without a row's own."""
    v = vectors.select("vec_id", "v")
    pairs = candidates.where("query_id <> bank_id").select("query_id", "bank_id")
    full = pairs.join(v.toDF("query_id", "_q"), "query_id").join(v.toDF("bank_id", "_b"), "bank_id")
    scored = full.select("query_id", "bank_id", F.round(unit_distance(dot("_q", "_b")), 6).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "bank_id")
    return scored.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


#: Fixed value: words that negate a phrase, for the choice of an anchor.
NEGATED = r"\b(no|without|negative|absent|absence|not|unremarkable|resolved|ruled out|free of)\b"


def anchors(bank: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(term, anchor, n, same_family): a bank of (vec_id, label, s, v) searched from a phrase for each term.

    The anchor is the shortest phrase that holds the term, affirmative ones first.  Of its
    neighbours, those with its own text go and each other text counts once; then the share
    of the nearest ``k`` that have its label.
    """
    spark = bank.sparkSession
    term = spark.createDataFrame([(t,) for t in terms], "term string")
    held = bank.join(F.broadcast(term), F.contains("s", "term"))  # the list of terms
    chosen = held.groupBy("term").agg(F.min(F.struct(F.col("s").rlike(NEGATED).alias("no"), F.length("s").alias("size"), "vec_id")).alias("m"))
    rows = chosen.select("term", F.col("m.vec_id").alias("anchor")).join(bank.select(F.col("vec_id").alias("anchor"), F.col("label").alias("family"), F.col("s").alias("own"), F.col("v").alias("q")), "anchor")
    near = bank.crossJoin(F.broadcast(rows)).where((F.col("vec_id") != F.col("anchor")) & (F.col("s") != F.col("own")))  # one anchor for each term
    near = near.select("term", "anchor", "family", "vec_id", "s", "label", F.round(dot("q", "v"), 9).alias("score"))
    once = near.groupBy("term", "anchor", "family", "s").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("o"), "label")).alias("b"))
    w = Window.partitionBy("term").orderBy(F.col("b.score").desc(), F.col("b.o").desc())
    best = once.withColumn("_z", F.row_number().over(w)).where(F.col("_z") <= k)
    return best.groupBy("term", "anchor").agg(F.count("*").alias("n"), F.avg((F.col("b.label") == F.col("family")).cast("double")).alias("same_family"))


def neighbour_purity(rows: DataFrame, k: int) -> DataFrame:
    """(label, purity): mean share of same-label rows among each row's k nearest others."""
    near = top_k(rows.select(F.col("id").alias("query_id"), "v"), rows.select(F.col("id").alias("bank_id"), "v"), k + 1).where("query_id <> bank_id")
    first = near.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_r") <= k)
    own, other = rows.select(F.col("id").alias("query_id"), "label"), rows.select(F.col("id").alias("bank_id"), F.col("label").alias("near_label"))
    j = first.join(own, "query_id").join(other, "bank_id")
    return j.groupBy("label").agg(F.avg((F.col("label") == F.col("near_label")).cast("double")).alias("purity"))


def centroid_pairs(groups: DataFrame, key: str, v: str) -> DataFrame:
    """(a, b, distance): 1 - Pearson's r between all pairs of a small table of centroids (M9)."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x)
    c = groups.select(key, F.transform(F.arrays_zip(F.col(v).alias("x")), lambda s: s["x"]).alias("x")).withColumn("m", mean(F.col("x")))
    c = c.select(key, F.transform("x", lambda x: x - F.col("m")).alias("x"))
    c = c.select(key, "x", norm("x").alias("n"))
    left, right = (c.select(F.col(key).alias(s), F.col("x").alias(f"x{s}"), F.col("n").alias(f"n{s}")) for s in "ab")
    pair = beside(left, right, F.col("b"))
    r = dot("xa", "xb") / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0))
    return pair.where("a < b").select("a", "b", F.least(F.greatest(1 - r, F.lit(0.0)), F.lit(2.0)).alias("distance"))
