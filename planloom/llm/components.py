"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planloom.session import staged


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the lowest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the lowest of them."""
    lowest = _lowest(edges)
    moved = edges.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Each node of an edge (``node``) with the lowest node of its component (``root``).

    Every round writes its edges, a forest at the end, to the shared folder; nothing is collected but a count
    and a checksum per round. Null ends and loops are left out.
    """
    ends = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    now = staged(ends.where(F.col(left).isNotNull() & F.col(right).isNotNull()).where("u <> v").distinct(), "edges")
    mark = F.struct(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"))
    before = now.agg(mark).first()[0]
    while before[0]:
        now = staged(_small_star(_large_star(now)), "stars")
        after = now.agg(mark).first()[0]
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
