"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableprep.plans.scratch import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("least").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    moved = edges.join(least, "b").select(F.col("least"), F.explode(F.array("a", "b")).alias("to"))
    return moved.filter("to <> least").select(F.col("least").alias("a"), F.col("to").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (columns a, b) but the smallest of each component, which is the label.

    Minima are pre-aggregated in each task; the joins back to a node with many links are split by Spark's skew
    handling. The number of rounds grows with the logarithm of the longest chain. Null ends and loops are dropped.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges, before = materialize(edges, "links"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
        before = mark
        edges = materialize(_small_star(_large_star(edges)), "stars")
