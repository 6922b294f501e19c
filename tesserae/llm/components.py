"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no node's neighbours are ever gathered in one place, and
each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"] or 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node is linked to the node's smallest; small: the smaller ones and the node itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_k"), F.least("u", "m").alias("m"))
    least = common.staged(least, "least")  # a table of its own, so that a node of very many edges is split in the join
    joined = both.join(least, both["u"] == least["_k"])
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component) of every node on an edge, component being the smallest node reached."""
    big, small = F.greatest(a, b), F.least(a, b)
    now = common.staged(edges.filter(F.col(a) != F.col(b)).select(big.alias("u"), small.alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds if mark[0] else 0):
        then = common.staged(_star(_star(now, True), False), "edges")
        common.discard(now)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components have not settled after {rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
