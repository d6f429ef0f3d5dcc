"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _least(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """Least neighbour of each node. Written, so that both sides of the join after it come from
    exchanges of their own and Spark can split a node with many links over tasks."""
    return ws.save(links.groupBy("u").agg(F.min("v").alias("m")), f"{name}_least")


def _large_star(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = _least(ws, both, f"{name}_large").withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(ws, down, f"{name}_small")
    out = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v")))


def connected_components(ws: Workspace, links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node of ``links`` (two long columns); component is its least node.

    Each round is two aggregations and joins whose rows never exceed the links; rounds grow
    with the logarithm of the number of nodes. The tables of a round are written to the
    workspace, so a lost executor repeats a task and not the rounds before.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    state = ws.save(links.distinct(), f"{name}_0")
    before, k = None, 0
    while True:
        k += 1
        large = ws.save(_large_star(ws, state, name).distinct(), f"{name}_half")
        now = ws.save(_small_star(ws, large, name).distinct(), f"{name}_{k}")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if k > 1:
            ws.drop(f"{name}_{k - 1}")
        state = now
        if mark == before or not mark[0]:
            break
        before = mark
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
