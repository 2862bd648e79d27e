"""Connected components of an edge table by alternating stars.

Each round links every node's larger neighbours to its smallest neighbour, and
then every node and its smaller neighbours to the smallest of them. Rounds grow
with the logarithm of the nodes; each writes its edges to the shared folder,
which cuts the lineage. Only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize_tidy as materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, after one star operation on edges (u, v) with u > v."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # every node has its smallest neighbour, itself included
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = near.join(least, "u")
    if large:
        moved = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, root) for every node of the edges (u, v) but the roots, the smallest nodes."""
    now = materialize(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            return now.select("u", F.col("v").alias("root"))
        mark = tuple(state)
        now = materialize(_star(materialize(_star(now, True), name), False), name)
