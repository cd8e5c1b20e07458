"""Connected components by repeated contraction of the edge list.

Each round maps every vertex to the smallest vertex in its closed neighbourhood and
rewrites the edges between the images.  An edge keeps its ends' images connected, the
smallest vertex of a component maps to itself, and every other component member that
isn't a local minimum merges, so the edge list shrinks quickly and the last image is the
component's smallest vertex.  Rounds are written to the shared folder; nothing about the
graph is collected but the number of edges left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.plans.shared import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each vertex of ``edges``; self-loops, repeats and nulls are ignored.

    An empty edge list gives an empty table.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    left = materialize(left, "edges")
    labels = None
    while True:
        both = left.union(left.select("b", "a"))
        step = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "id")
        step = materialize(step, "step")
        if labels is None:
            labels = step.withColumnRenamed("m", "component")
            labels._medlake_path = step._medlake_path  # the same table
        else:
            joined = labels.join(step.withColumnRenamed("id", "component"), "component", "left")
            new = materialize(joined.select("id", F.coalesce("m", "component").alias("component")), "labels")
            discard(labels)
            labels = new
        ma, mb = step.toDF("a", "ma"), step.toDF("b", "mb")
        rest = left.join(ma, "a").join(mb, "b").select(F.col("ma").alias("a"), F.col("mb").alias("b")).where("a <> b")
        rest = materialize(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(left)
        if labels._medlake_path != step._medlake_path:
            discard(step)
        left = rest
        if left.isEmpty():
            discard(left)
            return labels
