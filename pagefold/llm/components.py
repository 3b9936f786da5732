"""Connected components of a link frame, by alternating large and small stars.

Minima are aggregated with map-side partial rows, and the links of a hub, which a third of all links may touch, are joined with
its minimum by broadcast, so they never meet in one task. The result of every round is a written table; the driver sees row
counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_ROWS, keyed_join, materialize


def connected_components(links: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that a link names; the component is its smallest node.

    Self links and nulls are ignored, links may repeat and point either way; no links give an empty frame.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges = materialize(edges, "links")
    before: tuple | None = None
    rows = edges.count()
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True, 2 * rows)
        if rows > HEAVY_ROWS:
            large = materialize(large, "large")
        edges = materialize(_star(large, False, 2 * rows), "star")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, rows = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(pairs: DataFrame, larger: bool, rows: int) -> DataFrame:
    """rows: a bound on the pairs. Links (u, v) with u > v. Large star: each node's larger neighbours go to its smallest neighbour or itself. Small star: its smaller neighbours and itself do."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = keyed_join(pairs, least, ["u"], rows=rows)
    if larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()
