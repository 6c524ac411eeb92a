"""Connected components of an edge table, without gathering any component in one place.

Alternating large-star and small-star rounds by aggregation and equi-joins; the edge table between rounds
is written to the shared folder. Each edge ends at the least id of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.storage import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every end of an edge ``a, b`` (long ids); component is the least id reachable.

    Loops and repeated edges are allowed; edges with a null end are ignored; no edges give no rows."""
    stars = materialise(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )  # u > v
    before = None
    for _ in range(max_rounds):
        # Large star: each larger neighbour of u is linked to the least of u and its neighbours.
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        up = stars.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u", "left")
        large = up.select(F.col("w").alias("u"), F.coalesce("m", "u").alias("v"))
        down = stars.join(least, "u").where(F.col("v") == F.col("m")).select("u", "v")
        linked = large.unionByName(down).where(F.col("u") != F.col("v")).distinct()
        # Small star: the smaller neighbours of u and u itself are linked to the least of them.
        least = linked.groupBy("u").agg(F.min("v").alias("m"))
        small = linked.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        stars = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
