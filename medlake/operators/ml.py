"""Model fits on MLlib with the conventions of the evaluation code, and clustering scores."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.functions.vectors import mean_vector


def probe(rows: DataFrame, v: str = "v", y: str = "y", c: float = 1.0, weight: str | None = None, max_iter: int = 100) -> DataFrame:
    """One row (intercept, coefficients) of an L2 logistic regression on z-scored inputs.

    A single class gives the constant logit of its clipped share and no coefficients.
    """
    spark = rows.sparkSession
    n, pos = rows.agg(F.count("*"), F.sum(y)).first()
    if not n or pos in (0, n):
        share = min(max((pos or 0) / max(n, 1), 1e-6), 1 - 1e-6)
        return spark.createDataFrame([(float(math.log(share / (1 - share))), [])], "intercept double, coefficients array<double>")
    data = rows.select(array_to_vector(F.col(v)).alias("features"), F.col(y).cast("double").alias("label"), *([F.col(weight)] if weight else []))
    lr = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    m = (lr.setWeightCol(weight) if weight else lr).fit(data)
    return spark.createDataFrame([(float(m.intercept), [float(x) for x in m.coefficients])], "intercept double, coefficients array<double>")


def standardize(rows: DataFrame, v: str, out: str, floor: float = 1e-8) -> DataFrame:
    """z-scores of each vector position with population deviations."""
    one = rows.withColumn("_a", F.lit(0))
    stats = one.select("_a", F.posexplode(v).alias("i", "x")).groupBy("_a", "i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    packed = stats.groupBy("_a").agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("_s")).select("_s")
    return rows.crossJoin(F.broadcast(packed)).withColumn(out, F.zip_with(v, "_s", lambda x, s: (x - s["m"]) / (s["s"] + floor))).drop("_s")  # one row


def pca(rows: DataFrame, v: str, k: int, out: str) -> DataFrame:
    """Scores on the first ``k`` principal components, of centred vectors; signs are arbitrary."""
    mean = mean_vector(rows.withColumn("_a", F.lit(0)), ["_a"], v, "_m").select("_m")
    c = rows.crossJoin(F.broadcast(mean)).withColumn("_x", array_to_vector(F.zip_with(v, "_m", lambda x, m: x - m))).drop("_m")  # one row
    return PCA(k=k, inputCol="_x", outputCol="_p").fit(c).transform(c).withColumn(out, vector_to_array("_p")).drop("_x", "_p")


def kmeans(rows: DataFrame, v: str, k: int, seed: int = 0) -> DataFrame:
    """Rows with their cluster."""
    x = rows.withColumn("features", array_to_vector(F.col(v)))
    return KMeans(k=k, seed=seed).fit(x).transform(x).withColumnRenamed("prediction", "cluster").drop("features")


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari), from the contingency table."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    ij = cells.agg(two("n").alias("ij"), F.sum("n").alias("all"))
    ra = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two("n").alias("a"))
    rb = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two("n").alias("b"))
    one = ij.crossJoin(ra).crossJoin(rb)  # one row each
    expected = F.col("a") * F.col("b") / F.nullif(F.col("all") * (F.col("all") - 1) / 2, F.lit(0.0))
    return one.select(((F.col("ij") - expected) / F.nullif((F.col("a") + F.col("b")) / 2 - expected, F.lit(0.0))).alias("ari"))
