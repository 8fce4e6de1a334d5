"""Connected components of a graph given as a table of edges, as Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unievents.llm.common import keep


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node
    that can be reached. Null ends and self-loops are ignored, repeated edges do no harm,
    no edges give no rows.

    Alternating large and small stars: every round hangs each node below the smallest
    neighbour of a neighbour, so that rounds grow with the logarithm of the longest path.
    Minima are pre-aggregated, joins on a hub are plain equi-joins that AQE can split, and
    each round is written to the shared folder. Nothing but a checksum reaches the driver.
    """
    if max_rounds < 1:
        raise ValueError("max_rounds must be positive")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    state = keep(edges.where("a != b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    mark = _mark(state)
    if not mark[0]:
        return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(down.select("a", F.col("m").alias("b"))).distinct())
        state = keep(small, "edges")
        before, mark = mark, _mark(state)
        if mark == before:
            roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
