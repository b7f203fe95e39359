"""Connected components of a graph held as an edge table.

Alternates the two star operations of Kiveris et al. (2014): every node's larger
neighbours are linked to its smallest one, then its smaller ones, until each
component is a star around its smallest node.  Both keep connectivity and need a
logarithmic number of rounds.  Every round is a grouping and a join on written
tables; a node with very many neighbours is one partly aggregated row on one side of
the join, and its rows on the other side may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketlens.session import durable


def _digest(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.min("u"), F.max("v")).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.where(F.col("v") > F.col("u")).join(lowest, "u")
    return linked.select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # edges run from the smaller to the larger node, so v owns its smaller neighbours
    lowest = edges.groupBy("v").agg(F.min("u").alias("m"))
    linked = edges.join(lowest, "v")
    moved = linked.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
    return moved.where(F.col("u") < F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) of all nodes with an edge; the root is the smallest node."""
    low, high = F.least(a, b), F.greatest(a, b)
    current = durable(edges.where(F.col(a) != F.col(b)).select(low.alias("u"), high.alias("v")).distinct())
    before = _digest(current)
    while before[0]:
        current = durable(_small_star(_large_star(current)))
        after = _digest(current)
        if after == before:
            break
        before = after
    return current.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(
        current.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
