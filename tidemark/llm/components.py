"""Connected components of a graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub_join, written


def _print(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).collect()[0]
    return row["n"], int(row["h"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from edges (a, b) of longs: root is the smallest node that node reaches.

    Nodes that are their own root are left out, as are loops.  Each round is two joins with the
    smallest neighbour, which reaches the edges of hubs by broadcast; rounds are about logarithmic
    in the longest path.  An empty graph gives no rows.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = _print(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m")), "least")
        large = written(hub_join(both.filter("b > a"), least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = hub_join(large, least, "a", "n").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _print(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
