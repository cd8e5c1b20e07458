"""Evaluation statistics over long score tables (label, key, y, score[, weight])."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _running(by: list[str], order: list[Column], upto: int = 0):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)


def auc(scores: DataFrame, by: list[str], y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """Exact area under the ROC curve with ties counted half (W1, W3); null for a single class.

    Rows are first summed for each distinct score, so the window sorts scores, not rows.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    tie = scores.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("_n"))
    below = F.coalesce(F.sum("_n").over(_running(by, [F.col(score)], -1)), F.lit(0.0))
    part = tie.withColumn("_a", F.col("_p") * (below + F.col("_n") / 2))
    out = part.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.sum("_a").alias("_a"))
    return out.withColumn("auc", F.col("_a") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0.0))).drop("_a")


def macro(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean over labels that have a defined value (W2); NaN counts as undefined."""
    return values.groupBy(*by).agg(F.avg(F.nullif(F.col(value), F.lit(float("nan")))).alias(f"macro_{value}"), F.count(F.nullif(F.col(value), F.lit(float("nan")))).alias("n_labels"))


def ranking(scores: DataFrame, by: list[str], key: str, k: int = 10, y: str = "y", score: str = "score") -> DataFrame:
    """Average precision, precision and recall at k and reciprocal rank from one descending sort.

    Ties go to the smaller key; ranks beyond the list count as misses in precision at k.
    """
    order = [F.col(score).desc(), F.col(key)]
    ranked = scores.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("_c", F.sum(y).over(_running(by, order)))
    hits = F.sum(y)
    return ranked.groupBy(*by).agg(
        hits.cast("long").alias("n_pos"),
        (F.sum(F.when(F.col(y) == 1, F.col("_c") / F.col("_r"))) / F.nullif(hits, F.lit(0))).alias("ap"),
        (F.sum(F.when(F.col("_r") <= k, F.col(y)).otherwise(0)) / k).alias("p_at_k"),
        (F.sum(F.when(F.col("_r") <= k, F.col(y)).otherwise(0)) / F.nullif(hits, F.lit(0))).alias("r_at_k"),
        (1.0 / F.min(F.when(F.col(y) == 1, F.col("_r")))).alias("rr"),
    )


def zscore(rows: DataFrame, by: list[str], value: str, out: str, floor: float = 1e-8) -> DataFrame:
    """Population z-scores inside groups."""
    w = Window.partitionBy(*by)
    return rows.withColumn(out, (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + floor))


def pooled_retrieval(scores: DataFrame, by: list[str], pool: int = 64, ks: tuple[int, ...] = (1, 5), y: str = "y", score: str = "score") -> DataFrame:
    """Expected recall at k and reciprocal rank of each positive among pool - 1 random negatives.

    With q the share of negatives scored above it, the positive's rank is 1 + Binomial(pool - 1, q).
    """
    neg = _running(by, [F.col(score).desc()], -1)
    tie = scores.groupBy(*by, score).agg(F.sum(y).alias("_p"), F.sum(1 - F.col(y)).alias("_n"))
    q = tie.withColumn("_q", F.coalesce(F.sum("_n").over(neg), F.lit(0)) / F.nullif(F.sum("_n").over(Window.partitionBy(*by)), F.lit(0))).where("_p > 0")
    n = pool - 1

    def tail(k: int) -> Column:
        return reduce(lambda a, b: a + b, [F.lit(float(math.comb(n, i))) * F.pow("_q", F.lit(i)) * F.pow(1 - F.col("_q"), F.lit(n - i)) for i in range(k)])

    rr = F.when(F.col("_q") == 0, 1.0).otherwise((1 - F.pow(1 - F.col("_q"), F.lit(pool))) / (pool * F.col("_q")))
    mean = lambda e: F.sum(e * F.col("_p")) / F.sum("_p")
    return q.groupBy(*by).agg(*(mean(tail(k)).alias(f"r_at_{k}") for k in ks), mean(rr).alias("mrr"))


def youden(scores: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """The threshold with the largest TPR - FPR, the highest of equals."""
    tie = scores.groupBy(*by, score).agg(F.sum(y).alias("_p"), F.sum(1 - F.col(y)).alias("_n"))
    w, whole = _running(by, [F.col(score).desc()]), Window.partitionBy(*by)
    at = tie.select(*by, score, (F.sum("_p").over(w) / F.nullif(F.sum("_p").over(whole), F.lit(0))).alias("tpr"), (F.sum("_n").over(w) / F.nullif(F.sum("_n").over(whole), F.lit(0))).alias("fpr"))
    best = F.max_by(F.struct(F.col(score).alias("threshold"), "tpr", "fpr"), F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), score))
    return at.groupBy(*by).agg(best.alias("m")).select(*by, "m.*")


def prf(rows: DataFrame, by: list[str], truth: str = "y", pred: str = "pred") -> DataFrame:
    """Confusion counts and precision, recall and F1; an undefined ratio is null (A5)."""
    tp, fp, fn = (F.count_if(c) for c in ((F.col(truth) == 1) & (F.col(pred) == 1), (F.col(truth) == 0) & (F.col(pred) == 1), (F.col(truth) == 1) & (F.col(pred) == 0)))
    n = rows.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    zero = F.lit(0)
    return n.select(
        *by, "tp", "fp", "fn",
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), zero)).alias("precision"),
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), zero)).alias("recall"),
        (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), zero)).alias("f1"),
    )


def hanley_mcneil(auc_: Column, n_pos: Column, n_neg: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Analytic confidence limits of an AUC, clipped to [0, 1]."""
    q1, q2 = auc_ / (2 - auc_), 2 * auc_ * auc_ / (1 + auc_)
    var = (auc_ * (1 - auc_) + (n_pos - 1) * (q1 - auc_ * auc_) + (n_neg - 1) * (q2 - auc_ * auc_)) / (n_pos * n_neg)
    half = z * F.sqrt(F.greatest(var, F.lit(0.0)))
    return F.greatest(auc_ - half, F.lit(0.0)), F.least(auc_ + half, F.lit(1.0))


def multiplicities(clusters: DataFrame, draws: int, cluster: str = "cluster") -> DataFrame:
    """(draw, cluster, mult): reproducible resampling weights from a hash of both.

    ``cluster`` is numbered by ``_n`` in the caller's table, so that any engine can redo it.
    """
    b = F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")
    return clusters.select(cluster, "_n", b).select("draw", cluster, ((F.col("_n") * 7919 + F.col("draw") * 104729) % 3).alias("mult"))


def interval(values: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Percentile limits with linear interpolation, and by sorted position."""
    low, high = F.percentile(value, F.lit(alpha / 2)), F.percentile(value, F.lit(1 - alpha / 2))
    n = F.count(value)
    ordered = F.sort_array(F.collect_list(value))  # one value for each draw
    at = F.greatest(F.floor(n * (alpha / 2)).cast("int") - 1, F.lit(0))
    return values.groupBy(*by).agg(low.alias("low"), high.alias("high"), F.get(ordered, at).alias("low_at"), F.stddev_pop(value).alias("sd"))


def holm(tests: DataFrame, by: list[str], p: str, key: str) -> DataFrame:
    """Holm's step-down adjusted p-values."""
    order = [F.col(p), F.col(key)]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(*by))
    raw = tests.withColumn("_a", F.least(F.lit(1.0), (n - rank + 1) * F.col(p)))
    return raw.withColumn("p_adjusted", F.max("_a").over(_running(by, order))).drop("_a")


def average_ranks(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks with ties averaged."""
    w = Window.partitionBy(*by).orderBy(value)
    return rows.withColumn(out, F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0)


def correlation(a: str, b: str) -> Column:
    """Pearson's r, null where either side is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation: Pearson's r of averaged ranks."""
    both = average_ranks(average_ranks(rows, by, a, "_ra"), by, b, "_rb")
    return both.groupBy(*by).agg(correlation("_ra", "_rb").alias("rho"), F.count("*").alias("n"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / d
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d), 1 + top / c
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def welch(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Welch's t for group 1 against 0: t, degrees of freedom, and the one-sided p-value.

    Moments are aggregated by Spark; the tail is computed on one row for each test.
    """
    mom = [f(F.when(F.col(group) == g, F.col(value))).alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    m = rows.groupBy(*by).agg(*mom)
    s = lambda g: F.col(f"v{g}") / F.nullif(F.col(f"n{g}"), F.lit(0))
    m = m.withColumn("t", (F.col("m1") - F.col("m0")) / F.sqrt(F.nullif(s(1) + s(0), F.lit(0.0))))
    m = m.withColumn("df", F.pow(s(1) + s(0), F.lit(2)) / F.nullif(s(1) * s(1) / (F.col("n1") - 1) + s(0) * s(0) / (F.col("n0") - 1), F.lit(0.0)))

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        def one(a: float, d: float) -> float | None:
            if a != a or d != d:
                return None
            p = incomplete_beta(d / 2, 0.5, d / (d + a * a)) / 2
            return p if a > 0 else 1 - p

        return pd.Series([one(a, d) for a, d in zip(t, df)], dtype="float64")

    return m.withColumn("p_greater", tail("t", "df")).select(*by, "t", "df", "p_greater")


def mean_sem(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and 1.96 standard errors: null without values, 0 for one."""
    n = F.count(value)
    half = F.when(n == 0, None).when(n == 1, 0.0).otherwise(1.96 * F.stddev_samp(value) / F.sqrt(n))
    return rows.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), half.alias("half_width"))


def seed_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation (0 for one value), least and largest of finite values."""
    v = F.nullif(F.col(value), F.lit(float("nan")))
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
