"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.runtime import cut_counted, discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than u is hung on the least of u and u's neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and the neighbours below u are hung on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node of its group.

    edges: pairs of one orderable type, in any direction, repeats and loops allowed.
    Large-star and small-star rounds halve the depth of every tree, so the rounds grow with
    the logarithm of the diameter. Every round is cut to a table in the shared folder, whose
    row count and hash, taken while it is written, tell when nothing moves any more. A hub is one pre-aggregated row on the minimum
    side of the join and its edges may be split by the skew join. Empty input gives no rows.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    now, seen = cut_counted(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        before, (now, mark) = now, cut_counted(_small_star(_large_star(now)), "cc")
        discard(before)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)
