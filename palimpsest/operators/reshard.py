"""Shard maps: the physical shard of each virtual partition, and what moves when a map changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.scalar import shard_of


@dataclass(frozen=True)
class ShardMap:
    """A revision of the map; ``shards`` has the shard of each virtual partition."""

    revision: int
    shards: tuple[int, ...]

    def successor(self, shards: tuple[int, ...]) -> "ShardMap":
        """The next revision, which keeps the virtual partitions."""
        if len(shards) != len(self.shards):
            raise ValueError("a map keeps its virtual partitions")
        return ShardMap(self.revision + 1, tuple(shards))

    def moves(self, other: "ShardMap") -> list[tuple[int, int, int]]:
        """(partition, from, to) of every partition that changes its shard."""
        if other.revision <= self.revision:
            raise ValueError("a map's revision must rise")
        return [(p, a, b) for p, (a, b) in enumerate(zip(self.shards, other.shards)) if a != b]


def plan(spark: SparkSession, old: ShardMap, new: ShardMap) -> DataFrame:
    """The moves as rows ``partition, source, target``: a row a partition, whatever the data."""
    return spark.createDataFrame(old.moves(new), "partition int, source int, target int")


def moving(rows: DataFrame, partition: Column, old: ShardMap, new: ShardMap) -> DataFrame:
    """The rows that a change of map moves, with ``source`` and ``target``; found by their partition, without a shuffle."""
    marked = rows.withColumns({"source": shard_of(partition, list(old.shards)), "target": shard_of(partition, list(new.shards))})
    return marked.where(F.col("source") != F.col("target"))
