"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges``; component is the smallest id reachable.

    Alternates large-star and small-star rewiring: in each pass every node hangs its neighbours on the smallest
    one it knows, until only stars are left. Each pass is one aggregation and one join on the node,
    both of which Spark can pre-aggregate or split for a hub; the edges are written to the shared folder between
    passes, and nothing of them comes to the driver. Nulls and self-links carry no link; an empty
    table gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    now = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _is_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError("connected components did not settle")
    leaves = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = now.select(F.col("v").alias("id")).distinct().join(leaves.select("id"), "id", "left_anti")
    return leaves.unionByName(roots.select("id", F.col("id").alias("component")))


def _is_stars(edges: DataFrame) -> bool:
    """Every node hangs on one node at most, and no node that others hang on hangs itself."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    node = ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return node.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()
