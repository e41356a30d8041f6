"""Connected components over an edge list, without collecting edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campovia.session import discard, durable


#: Rows of a node from which on it may be a hub, and the most hubs there can be.
HUB_ROWS, MOST_HUBS = 500, 10_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.hash("child", "parent").cast("long")), F.bit_xor(F.xxhash64("child", "parent"))).first()
    return tuple(row)


def _towards_minimum(pairs: DataFrame, rows: int) -> DataFrame:
    """Each (node, near) row with the smallest neighbour of node, node itself included. rows: how many rows there are, at most.

    A node with a ten-thousandth of all rows or more is a hub, of which there can be no more than 10,000: hubs are broadcast, so
    that their rows need not meet in one task; all others are joined by a shuffle.
    """
    least = pairs.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"), F.count("*").alias("n"))
    bound = max(HUB_ROWS, rows // MOST_HUBS + 1)
    hubs = F.broadcast(least.where(F.col("n") >= bound).drop("n"))
    plain = pairs.join(hubs.select("node"), "node", "left_anti").join(least.where(F.col("n") < bound).drop("n"), "node")
    return pairs.join(hubs, "node").unionByName(plain)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Components of the undirected graph whose edges are the rows (left, right).

    Alternates large-star and small-star rounds: each links nodes to the smallest neighbour, until
    every component is a star around its smallest node. Each round ends in a written table, so a lost
    executor costs that round at most. Returns (node, root), one row for each node that has an edge
    to another node. Rows with a null end and loops are no edges. An empty input gives an empty result.
    """
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    stars = durable(ends.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct())
    before = _state(stars)
    while before[0]:
        both = stars.selectExpr("child AS node", "parent AS near").union(stars.selectExpr("parent AS node", "child AS near"))
        large = _towards_minimum(both, 2 * before[0]).where("near > node").selectExpr("near AS child", "least AS parent").distinct()
        large = durable(large)
        found = _towards_minimum(large.selectExpr("child AS node", "parent AS near"), 2 * before[0])
        small = found.where("near > least").selectExpr("near AS child", "least AS parent").union(found.selectExpr("node AS child", "least AS parent"))
        last, stars = stars, durable(small.distinct())
        after = _state(stars)
        discard(large)
        discard(last)
        if after == before:
            break
        before = after
    return stars.selectExpr("child AS node", "parent AS root").union(stars.selectExpr("parent AS node", "parent AS root").distinct())
