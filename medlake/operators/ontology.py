"""Class hierarchies as edge tables: closure, distances, and grounding of phrases."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medlake.functions.text import tokens
from medlake.plans.shared import materialize


def descendants(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(node, depth) reachable from ``root(node)`` over ``edges(parent, child)``, least depth.

    Breadth first, a level a round, however many there are; cycles end because visited
    nodes don't come again.
    """
    edges = materialize(edges.select("parent", "child").distinct(), "edges", release=False)
    seen = frontier = materialize(root.select("node").distinct().withColumn("depth", F.lit(0)), "level", release=False)
    for depth in count(1):
        step = frontier.select(F.col("node").alias("parent")).join(edges, "parent").select(F.col("child").alias("node")).distinct()
        frontier = materialize(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "level", release=False)
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
        if depth % 16 == 0:  # a plan of few files, also in a deep hierarchy
            seen = materialize(seen, "seen", release=False)


def hops(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(source, node, hops): fewest undirected steps from each source, up to a bound."""
    both = edges.select(F.col("parent").alias("x"), F.col("child").alias("y"))
    both = materialize(both.union(both.select("y", "x")).distinct(), "edges", release=False)
    seen = frontier = materialize(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("hops", F.lit(0)), "level", release=False)
    for h in range(1, max_hops + 1):
        step = frontier.join(both, frontier["node"] == both["x"]).select("source", F.col("y").alias("node")).distinct()
        frontier = materialize(step.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(h)), "level", release=False)
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def ground(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """(phrase_id, outcome, node): the one node a phrase names.

    Terms with several nodes are ambiguous and unused.  Token spans that equal a term,
    of any length, are kept unless a longer kept span contains them.  A phrase is grounded
    if its spans name one node, and the span has two tokens or is the whole phrase.
    """
    t = terms.select(F.array_join(tokens(F.col("term")), " ").alias("gram"), "node").where("gram <> ''").distinct()
    t = t.groupBy("gram").agg(F.min("node").alias("node"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    longest = t.agg(F.max(F.size(F.split("gram", " ")))).first()[0] or 1
    p = phrases.select("phrase_id", tokens(F.col("phrase")).alias("w"))
    span = p.select("phrase_id", F.size("w").alias("size"), "w", F.posexplode("w").alias("s", "_w"))
    span = span.select("phrase_id", "size", "s", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("size") - F.col("s")))).alias("n"))
    span = span.select("phrase_id", "size", "s", (F.col("s") + F.col("n")).alias("e"), F.array_join(F.slice("w", F.col("s") + 1, F.col("n")), " ").alias("gram"))
    hit = span.join(t, "gram")
    w = Window.partitionBy("phrase_id").orderBy("s", F.col("e").desc()).rowsBetween(Window.unboundedPreceding, -1)
    maximal = hit.withColumn("_m", F.max("e").over(w)).where("_m is null or e > _m")
    g = maximal.groupBy("phrase_id").agg(F.count_distinct("node").alias("nodes"), F.min("node").alias("node"), F.max(F.col("e") - F.col("s")).alias("longest"), F.first("size").alias("size"))
    outcome = F.when(F.col("nodes").isNull(), "no_term").when(F.col("nodes") > 1, "several_nodes").when((F.col("longest") >= 2) | (F.col("size") == 1), "grounded").otherwise("unsafe_single_token")
    out = phrases.select("phrase_id").join(g, "phrase_id", "left")
    return out.select("phrase_id", outcome.alias("outcome"), F.when(outcome == "grounded", F.col("node")).alias("node"))
