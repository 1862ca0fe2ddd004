"""Connected components of an edge table by alternating large and small stars.

Every round is a group-by with partial aggregation and a join; each is written to the shared folder,
which cuts the lineage.  Nothing is collected but one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellsight.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect all larger neighbours of a node to the least of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of a node, and the node, to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    pairs = edges.join(least, "a")
    return pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of an edge: the root is the least node of its component.

    `edges` has long columns a and b; loops and repeats are allowed.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = materialise(ordered, "stars")
    before = _checksum(stars)
    if not before[0]:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        # Both stars keep a > b.
        stars = materialise(_small_star(_large_star(stars).distinct()).distinct(), "stars")
        after = _checksum(stars)
        if after == before:
            break
        before = after
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return materialise(leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct()), "components")
