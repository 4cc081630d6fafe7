"""Classes of linked nodes: connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpanel.session import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the larger (or the smaller) neighbours of each node on its least neighbour.

    Least neighbours are merged per task before the shuffle, and the join back splits a hot node's rows.
    """
    near = _both_ways(edges)
    if large:
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        moved = near.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b")
    else:
        down = near.filter("b < a")
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        hung = down.join(low, "a").select(F.col("low").alias("a"), "b")
        moved = hung.unionAll(low.select(F.col("low").alias("a"), F.col("a").alias("b")))
    return moved.filter("a < b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``edges(a, b)``; the root is the least node of its class.

    Nodes without an edge are not returned. Ends when every node hangs on one root only and no root hangs on another
    node, which is proven by a join over the whole table, not by a fingerprint. Null ends are ignored.
    """
    stars = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    )
    while True:
        deeper = stars.select("a").join(stars.select(F.col("b").alias("a")), "a", "left_semi")
        twice = stars.groupBy("b").count().filter("count > 1").select("b")
        if deeper.isEmpty() and twice.isEmpty():
            break
        stars = materialize(_star(materialize(_star(stars, True)), False))
    roots = stars.select(F.col("a").alias("node")).distinct()
    return stars.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root"))
    )
