"""Linear probes over frozen vectors, concept sets and bottlenecks, and controls of clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.functions.vectors import dot, normalize
from medlake.operators import ml
from medlake.operators.evaluation import auc
from medlake.operators.relational import keep_top


def importance(rows: DataFrame, v: str, positive: Column) -> DataFrame:
    """``rows`` with the sum of vector entries times raw-space weights.

    Weights are the difference of the classes' mean z-scores over the deviation, from one
    pass over (position, class).
    """
    long = rows.select(positive.alias("y"), F.posexplode(v).alias("i", "x"))
    part = long.groupBy("i", "y").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    whole = part.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.when(F.col("y"), F.col("s") / F.col("n"))).alias("p"), F.sum(F.when(~F.col("y"), F.col("s") / F.col("n"))).alias("o"))
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))) + 1e-8
    w = whole.select("i", ((F.col("p") - F.col("o")) / sd / sd).alias("w")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("_w"))  # one row
    return rows.crossJoin(F.broadcast(w)).withColumn("importance", dot(v, "_w")).drop("_w")


def per_label(rows: DataFrame, z: str, label: str, labels: list, c: float = 1.0, balanced: bool = False) -> DataFrame:
    """(label, intercept, coefficients) of one-against-rest logistic regressions.

    ``balanced`` weighs the classes to equal totals.  A label that all rows or none have
    gets the constant logit of its clipped share.
    """
    out = []
    for x in labels:
        own = rows.withColumn("_y", (F.col(label) == x).cast("int"))
        weight = None
        if balanced:
            n, pos = own.agg(F.count("*"), F.sum("_y")).first()
            if n and pos not in (0, n):
                own, weight = own.withColumn("_w", F.when(F.col("_y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))), "_w"
        out.append(ml.probe(own, z, "_y", c, weight).withColumn("label", F.lit(x)))
    return reduce(DataFrame.unionByName, out).select("label", "intercept", "coefficients")


def bootstrap_weight(key: Column, seed: int) -> Column:
    """Multiplicity of a row in a resample: a Poisson draw of mean one from a hash of seed and key."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    edges, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        edges.append(total)
    return reduce(lambda acc, e: acc + (u > e).cast("int"), edges, F.lit(0))


def bootstrap_signs(rows: DataFrame, key: str, z: str, y: str, seeds: int = 20, c: float = 1.0) -> DataFrame:
    """(dimension, coefficient, consistency): how often a resampled probe agrees in sign with the plain one."""
    plain = ml.probe(rows, z, y, c).select(F.posexplode("coefficients").alias("dimension", "coefficient"))
    turns = []
    for seed in range(seeds):
        drawn = rows.withColumn("_w", bootstrap_weight(F.col(key), seed).cast("double")).where("_w > 0")
        turns.append(ml.probe(drawn, z, y, c, "_w").select(F.posexplode("coefficients").alias("dimension", "_c")))
    same = (F.signum("_c") == F.signum("coefficient")).cast("double")
    return reduce(DataFrame.unionByName, turns).join(plain, "dimension").groupBy("dimension", "coefficient").agg(F.avg(same).alias("consistency"))


def bottleneck(rows: DataFrame, concepts: DataFrame, v: str, c: str, most: int = 4096) -> DataFrame:
    """``rows`` with ``s``: similarities to every concept, in order of concept, as the only features of a probe.

    The concepts are the features of a linear model, so there are few; more than ``most`` is an error.
    """
    listed = concepts.agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("concept", c))), lambda x: x[c]).alias("_c"))
    n = concepts.count()
    if n > most:
        raise ValueError(f"{n} concepts as features; {most} at most")
    return rows.crossJoin(F.broadcast(listed.select("_c"))).withColumn("s", F.transform("_c", lambda x: dot(F.col(v), x))).drop("_c")  # one row


def multilabel(rows: DataFrame, key: str, v: str, label: str, labels: list, epochs: int = 30, patience: int = 5, rate: float = 0.05, decay: float = 1e-4) -> DataFrame:
    """One row (epochs, best_epoch, val_auroc) of one linear head for several labels (G1).

    Whole-table gradients of the mean logistic loss are summed in each partition and
    followed by Adam on the driver, which holds (dimensions + 1) x labels numbers.  A
    fifth of the rows, by a hash of their key, scores each epoch by macro AUROC; training
    stops when that hasn't risen for ``patience`` epochs, and the best epoch counts.
    """
    spark = rows.sparkSession
    held = F.pmod(F.xxhash64(F.lit("probe"), key), F.lit(5)) == 0
    y = F.array(*((F.col(label) == x).cast("double") for x in labels))
    data = rows.select(F.col(v).alias("v"), y.alias("y"), held.alias("held")).persist()
    try:
        first = data.select(F.size("v")).first()
        if first is None:
            return spark.createDataFrame([], "epochs int, best_epoch int, val_auroc double")
        shape = (first[0] + 1, len(labels))
        w, m, s = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        best, best_epoch, epoch = -1.0, 0, 0
        for epoch in range(1, epochs + 1):
            total, n = _gradient(data.where(~F.col("held")), w)
            g = total / max(n, 1) + decay * w
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(s / (1 - 0.999**epoch)) + 1e-8)
            score = _macro(data.where("held"), w)
            if score > best + 1e-6:
                best, best_epoch = score, epoch
            elif epoch - best_epoch >= patience:
                break
        return spark.createDataFrame([(epoch, best_epoch, float(best))], "epochs int, best_epoch int, val_auroc double")
    finally:
        data.unpersist()


def _stacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x, y = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (0, 1))
    return np.hstack([x, np.ones((len(x), 1))]), y


def _gradient(data: DataFrame, w: np.ndarray) -> tuple[np.ndarray, int]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(w.shape), 0
        for batch in batches:
            if batch.num_rows:
                x, y = _stacked(batch)
                total += x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()]), pa.array([n])], names=["g", "n"])

    parts = data.select("v", "y").mapInArrow(work, "g array<double>, n long")
    sums = parts.select(F.posexplode("g").alias("i", "g"), F.lit(0).alias("n")).groupBy("i").agg(F.sum("g").alias("g")).collect()  # one for each weight
    n = parts.agg(F.sum("n")).first()[0] or 0
    out = np.zeros(w.size)
    for r in sums:
        out[r.i] = r.g
    return out.reshape(w.shape), n


def _macro(data: DataFrame, w: np.ndarray) -> float:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _stacked(batch)
                p = x @ w
                for j in range(w.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), j, np.int32)), pa.array(p[:, j]), pa.array(y[:, j].astype(np.int32))], names=["label", "score", "y"])

    scored = data.select("v", "y").mapInArrow(work, "label int, score double, y int")
    got = auc(scored, ["label"], "y", "score").agg(F.avg("auc")).first()[0]
    return float("nan") if got is None else got


def concept_sets(rows: DataFrame, top: int, most: int) -> DataFrame:
    """(label, concept, method, place): the first by score, and the trusted and the direct ones, each once."""
    each = [
        ("original", rows, [F.col("score").desc(), F.col("concept")], top),
        ("trusted", rows.where("tier is not null"), [F.col("score").desc(), F.col("tier"), F.col("concept")], most),
        ("direct", rows.where("tier = 'direct'"), [F.col("score").desc(), F.col("concept")], most),
    ]
    parts = []
    for name, own, order, n in each:
        once = own.dropDuplicates(["label", "concept"])
        parts.append(keep_top(once, ["label"], order, n, "place").select("label", "concept", F.lit(name).alias("method"), F.col("place").cast("bigint").alias("place")))
    return reduce(DataFrame.unionByName, parts)


def random_vectors(rows: DataFrame, key: str, size: int, seed: str) -> DataFrame:
    """``rows`` with a unit vector of Gaussian entries from hashes of seed, key and position."""
    part = lambda i, at: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), i.cast("string"))), at, 8), 16, 10).cast("double")
    entry = lambda i: F.sqrt(-2 * F.ln((1 + part(i, 1)) / 4294967297.0)) * F.cos(2 * math.pi * part(i, 9) / 4294967296.0)
    return rows.withColumn("v", normalize(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), entry)))


def adjusted_mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (mi, expected, ami) from the contingency table of two clusterings.

    The expected information sums over the hypergeometric counts of every cell; one task
    for each row of the table, and the logarithms of factorials from a series.
    """
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    ra, rb, t = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb")), cells.agg(F.sum("n").alias("t"))
    whole = cells.join(ra, "a").join(rb, "b").crossJoin(t)  # one row
    mi = whole.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda r, c: r.crossJoin(t).agg((-F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))).alias(f"h_{c}"))

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = np.vectorize(math.lgamma)
        total = 0.0
        for batch in batches:
            for na, nb, n in zip(*(c.to_pylist() for c in batch.columns)):
                for s in range(int(max(1, na + nb - n)), int(min(na, nb)) + 1, 1 << 16):
                    k = np.arange(s, min(s + (1 << 16), int(min(na, nb)) + 1), dtype=float)
                    chance = log(na + 1) + log(nb + 1) + log(n - na + 1) + log(n - nb + 1) - log(n + 1) - log(k + 1) - log(na - k + 1) - log(nb - k + 1) - log(n - na - nb + k + 1)
                    total += float((k / n * np.log(n * k / (na * nb)) * np.exp(chance)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["e"])

    pairs = ra.select("na").crossJoin(rb.select("nb")).crossJoin(t)  # clusters, not rows
    e = pairs.mapInArrow(expected, "e double").agg(F.sum("e").alias("expected"))
    one = mi.crossJoin(e).crossJoin(entropy(ra, "na")).crossJoin(entropy(rb, "nb"))  # one row each
    return one.select("mi", "expected", ((F.col("mi") - F.col("expected")) / F.nullif((F.col("h_na") + F.col("h_nb")) / 2 - F.col("expected"), F.lit(0.0))).alias("ami"))
