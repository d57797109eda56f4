"""Connected components of a link table, as DataFrame operations only.

Distributed union-find: every round hangs each node's larger neighbours on its smallest
(large star), then its smaller ones (small star), until a round changes nothing. Stars are
found by partial aggregates; a node with a large share of all links gets its star by broadcast, so its links never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, settle, spread_join


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"), F.count("*").alias("links"))
    hung = spread_join(both.where("b > a"), least, "a", "links", 2 * total).select(F.col("least").alias("a"), "b")
    return hung.where("a < b").distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """``links`` have a < b: b's smaller neighbours are its a's."""
    least = links.groupBy("b").agg(F.min("a").alias("least"), F.count("*").alias("links"))
    hung = spread_join(links, least, "b", "links", total)
    moved = hung.where("a > least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(hung.select(F.col("least").alias("a"), "b")).distinct()


def components(links: DataFrame, work: Workspace, name: str, rounds: int = 50) -> DataFrame:
    """``node, component`` of every node that is linked; the component is its smallest node.

    ``links`` are pairs ``a, b`` of longs in any order; loops and repeats do no harm. Each
    round is staged, and its shuffle files are freed. Raises if ``rounds`` do not suffice; they grow with the logarithm of the longest path.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = work.stage(pairs, f"{name}-0")
    state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for i in range(1, 2 * rounds, 2):
        half = work.stage(_large_star(pairs, state[0]), f"{name}-{i}")
        pairs = work.stage(_small_star(half, state[0]), f"{name}-{i + 1}")
        work.drop(f"{name}-{i - 1}", f"{name}-{i}")
        settle(work.spark)
        before, state = state, pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            members = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
            heads = pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            return members.unionByName(heads)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
