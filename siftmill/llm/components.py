"""Connected components of a graph given by edges, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """From ``a, b`` (long): ``node, root`` for each node of an edge, root the smallest node of its
    component. No edges: an empty result. Edges with a null end, and those from a node to itself, join
    nothing, and a node with no others is not in the result.

    Alternates large-star and small-star steps (Kiveris et al., Connected Components in MapReduce
    and Beyond, 2014) until nothing changes. Each round is written to the shared folder, so lineage
    stays short and a lost executor repeats one round at most. The minimum of a node's neighbours
    is a partial aggregate; only its join back sees a hub's rows, and an equi-join can be split.
    """
    now = written(_oriented(edges), "edges")
    before = None
    while before != (mark := _mark(now)):
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _oriented(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        now = written(_oriented(small), "edges")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
