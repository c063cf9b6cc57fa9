"""Connected components of a graph given by its edges, by alternating star contraction.

In a round, every node first hands its larger neighbours to its smallest neighbour, then its smaller
ones. The smallest neighbour comes from an aggregation that is combined before its
shuffle, and no neighbour list is ever collected; the edges of a node with very many of them are dealt over
several tasks when they meet it. The edges of each round are written to
the shared folder; the rounds end when the edges no longer change, about the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift.operators.lookup import lookup_join
from venuesift.session import cut_lineage, remove_tables


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a, b``, no loops); the label is the
    smallest node of its component."""
    stars = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _state(stars)
    while state[0]:
        before = stars
        wide = cut_lineage(_large_star(stars), "large-stars")
        stars = cut_lineage(_small_star(wide), "stars")
        remove_tables(before, wide)
        before, state = state, _state(stars)
        if before == state:
            break
    centers = stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centers)


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges and two sums of hashes, to see whether a round changed them."""
    row = edges.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)),
        F.coalesce(F.sum(F.hash("v", "u").cast("decimal(38,0)")), F.lit(0)),
    ).first()
    return int(row[0]), int(row[1]), int(row[2])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _with_least(both).withColumn("m", F.least("u", "m")).filter(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    met = _with_least(edges)
    moved = met.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(met.select("u", F.col("m").alias("v"))).distinct()


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges with ``m``, the smallest neighbour of ``u``."""
    least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least-neighbours")
    return lookup_join(edges, least.drop("n"), ["u"], counts=least, spread=["v"])
