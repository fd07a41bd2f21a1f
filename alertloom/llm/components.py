"""Connected components of a link table by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.session import stage


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them.  Takes a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with a link, the root being the smallest node of its component.

    ``edges`` has two columns of one ordered type; direction, repeats and self-links do not matter, rows with a
    null end are ignored.  Each round is one written table, which cuts lineage; the rounds grow with the logarithm
    of the number of nodes, not with a component's diameter.  A node with very many links meets map-side
    aggregation (the minimum) and a join that adaptive execution splits.
    """
    a, b = edges.columns
    current = stage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").distinct(), "links")
    mark = _mark(current)
    while mark[0]:
        after = stage(_small_star(_large_star(current)), "links")
        after_mark = _mark(after)
        current = after
        if after_mark == mark:
            break
        mark = after_mark
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
