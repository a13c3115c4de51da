"""Linked groups: the least of all that can be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.plans.session import release, written

c = F.col


def least_reachable(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (a, b) of any ordered type: root is the least node that links lead to.

    In turn, a node's greater neighbours are handed to the least node it knows, and then its lesser ones. Edges never
    multiply, rounds grow with the logarithm of the longest chain, and each is written to the shared folder. No edges, no rounds.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            low = now.groupBy("a").agg(F.min("b").alias("root")).select(c("a").alias("node"), "root")
            return low.unionByName(low.select(c("root").alias("node"), "root").distinct())
        before = seen
        both = now.unionByName(now.select(c("b").alias("a"), c("a").alias("b")))
        handed = _with_least(both).where("b > a").select(c("b").alias("a"), F.least("a", "least").alias("b")).where("a <> b")
        large = written(handed.distinct(), "edges")
        release(now)
        drawn = _with_least(large).select(F.when(c("b") == c("least"), c("a")).otherwise(c("b")).alias("a"), c("least").alias("b"))
        now = written(drawn.where("a <> b").distinct(), "edges")
        release(large)
    raise RuntimeError(f"least_reachable: no end after {most_rounds} rounds")


def _with_least(edges: DataFrame) -> DataFrame:
    # merged, as edges of like nodes are small files of many rows
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("least")).hint("merge"), "a")
