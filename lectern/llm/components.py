"""Connected components by alternating large-star and small-star steps over staged edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _both(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around."""
    around = _both(e)
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    m = F.least("a", "m")
    return around.join(least, "a").where("b > a").select(F.col("b").alias("a"), m.alias("b")).where("a != b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for each node a that isn't the least of its component, b being the least. Edges: (a, b), comparable."""
    print_of = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    current = staged(edges.where("a != b").select("a", "b").distinct(), "edges")
    seen = print_of(current)
    while True:
        new = staged(_small_star(_large_star(current)), "edges")
        mark = print_of(new)
        discard(current)
        current = new
        if mark == seen:
            return current
        seen = mark
