"""Connected components of a graph of links, by alternating large-star and small-star steps on DataFrames.

Every step is a grouped minimum (combined before the shuffle) and a join with it, so a node with very many links is
never gathered in one task. Each round's links are written to the shared folder, which cuts lineage, in files by their
size. Rounds end when the links are stars: every node with links has the same one smaller end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, gathered


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Links are (smaller a, larger b)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    own = least.select(F.col("m").alias("a"), "b")
    rest = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return own.unionAll(rest).distinct()


def stars(edges: DataFrame) -> bool:
    """Whether every node is the smaller end of all its links, or the larger end of one."""
    ends = edges.select("a", F.col("b").alias("node")).unionAll(edges.select("a", F.col("a").alias("node")))
    return ends.groupBy("node").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x <> y").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(b, a): for each node with links that is not the smallest of its component, the smallest. edges: longs a < b."""
    kept = scratch.write(gathered(edges.distinct(), edges), "links0")
    for step in range(1, 100):
        if stars(kept):
            return kept.select("b", "a")
        kept = scratch.write(gathered(small_star(large_star(kept)), kept), f"links{step}")
        scratch.drop(f"links{step - 1}")
    raise RuntimeError("the components did not settle")
