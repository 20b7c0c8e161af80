"""Bounded traversal and staged lookup over edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def callers_bfs(edges: DataFrame, roots: list, depth: int, max_frontier: int | None = None, hub: int | None = None) -> DataFrame:
    """(hop, src, dst): callers of the roots, their callers and so on, to ``depth`` hops; a node is followed once, at its first hop.

    With ``max_frontier`` a hop follows its first nodes by name only; with ``hub`` nodes with that many callers in a hop aren't followed. The frontier
    stays a DataFrame; a plan has ``depth`` joins at most, and the cluster's checkpoint folder, where there is one, cuts it after each.
    """
    spark = edges.sparkSession
    kind = edges.schema["dst"].dataType
    cut = (lambda df: df.checkpoint()) if spark.conf.get("spark.checkpoint.dir", None) else (lambda df: df)
    frontier = spark.createDataFrame([(r,) for r in roots], f"node {kind.simpleString()}")
    seen, out = frontier, []
    for hop in range(1, min(depth, 5) + 1):
        found = cut(edges.join(frontier, edges.dst == frontier.node, "left_semi").select(F.lit(hop).alias("hop"), "src", "dst"))
        out.append(found)
        following = found.select(F.col("src").alias("node")).distinct().join(seen, "node", "left_anti")
        if hub is not None:
            busy = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") >= hub).select("node")
            following = following.join(busy, "node", "left_anti")
        if max_frontier is not None:
            following = following.orderBy("node").limit(max_frontier)
        frontier = cut(following)
        seen = seen.union(frontier)
    return reduce(DataFrame.union, out)


def first_match(names: DataFrame, definitions: DataFrame) -> DataFrame:
    """For each name the definition of the earliest stage, then order, then path: (name, stage, ord, path)."""
    best = definitions.groupBy("name").agg(F.min(F.struct("stage", "ord", "path")).alias("best"))
    return names.join(best, "name").select("name", "best.stage", "best.ord", "best.path")


def second_hop(edges: DataFrame, root, most: int = 10) -> DataFrame:
    """Callers of the root's callers, if the root has at most ``most`` distinct ones; without edges of the first hop."""
    first = edges.filter(F.col("dst") == root).select("src").distinct()
    few = first.agg((F.count("*") <= most).alias("few"))
    second = edges.join(first.withColumnRenamed("src", "via"), edges.dst == F.col("via"), "left_semi").filter(F.col("dst") != root)
    return second.crossJoin(F.broadcast(few)).filter("few").select("src", "dst").distinct()  # few is one row


def unique_chains(edges: DataFrame, hops: int = 2) -> DataFrame:
    """(src, dst) joined by exactly one chain of ``hops`` edges."""
    a, b = edges.select(F.col("src"), F.col("dst").alias("via")), edges.select(F.col("src").alias("via"), "dst")
    return a.join(b, "via").groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("via").alias("via")).filter("n = 1").select("src", "dst", "via")


def multiset_compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """For each key how many rows both sides have, and how many only one: INTERSECT ALL and both EXCEPT ALL, from counts."""
    l, r = left.groupBy(key).agg(F.count("*").alias("l")), right.groupBy(key).agg(F.count("*").alias("r"))  # noqa: E741
    both = l.join(r, key, "full_outer").na.fill(0, ["l", "r"])
    return both.select(key, F.least("l", "r").alias("common"), F.greatest(F.lit(0), F.col("l") - F.col("r")).cast("long").alias("left_only"), F.greatest(F.lit(0), F.col("r") - F.col("l")).cast("long").alias("right_only"))


def best_per_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rank = 1").drop("__rank")
