"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At every level each child draws
``-ln(u) / weight`` with ``u`` a hash of the key and of the child's name, and the
smallest draw wins, so a child is chosen with probability proportional to its
weight. A child's draw depends on nothing but the key, its own name and its own
weight: if one weight changes, keys move only into or out of that subtree, level by
level. Names are paths, so siblings elsewhere never change a draw.

``HashTree.grown`` opens a region of its own for the new shard. Its region draw is the
only new draw at the top and below it there is nothing else to choose, so every row
that moves lands in the new shard (law ``key``).

All of it compiles to one Column expression; the slots need narrow shuffles alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, utf8

#: Bytes that a stored row takes beside its text.
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class Node:
    """A subtree: ``name`` seeds its draws, ``weight`` is its share among siblings,
    ``shard`` is set on leaves only."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def _inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


@dataclass(frozen=True)
class HashTree:
    root: Node

    @classmethod
    def build(cls, layout: list[list[list[float]]]) -> "HashTree":
        """``layout[region][rack]`` lists the weights of a rack's shards; shard numbers
        run in that order. Weights must be positive."""
        number, regions = 0, []
        for r, racks in enumerate(layout):
            rack_nodes = []
            for k, weights in enumerate(racks):
                shards = []
                for s, weight in enumerate(weights):
                    if weight <= 0:
                        raise ValueError("shard weights must be positive")
                    shards.append(Node(f"{r}/{k}/{s}", float(weight), shard=number))
                    number += 1
                rack_nodes.append(_inner(f"{r}/{k}", shards))
            regions.append(_inner(str(r), rack_nodes))
        if not number:
            raise ValueError("a tree needs a shard")
        return cls(_inner("", regions))

    @classmethod
    def uniform(cls, regions: int, racks: int, shards: int) -> "HashTree":
        return cls.build([[[1.0] * shards for _ in range(racks)] for _ in range(regions)])

    @property
    def shards(self) -> int:
        def count(node: Node) -> int:
            return 1 if node.shard is not None else sum(map(count, node.children))

        return count(self.root)

    def grown(self, weight: float = 1.0) -> "HashTree":
        """One more shard, in a region of its own."""
        r, n = len(self.root.children), self.shards
        leaf = Node(f"{r}/0/0", float(weight), shard=n)
        region = _inner(str(r), [_inner(f"{r}/0", [leaf])])
        return HashTree(_inner("", [*self.root.children, region]))

    def shard_of(self, key: Column) -> Column:
        """The shard of a key. A null key is a key like any other."""

        def descend(node: Node) -> Column:
            if node.shard is not None:
                return F.lit(node.shard)
            if len(node.children) == 1:
                return descend(node.children[0])
            draws = [F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(node.children)]
            chosen = F.array_min(F.array(*draws)).getField("child")
            branches = [descend(c) for c in node.children]
            if all(c.shard is not None for c in node.children):
                return F.element_at(F.array(*branches), chosen + 1)
            out = F.when(F.lit(False), F.lit(0))
            for i, branch in enumerate(branches):
                out = out.when(chosen == i, branch)
            return out

        return descend(self.root).cast("int")


#: Hexadecimal digits of a digest that make a draw: as many as a double holds exactly.
DIGITS = 13


def _draw(key: Column, node: Node) -> Column:
    """An exponential draw of rate ``node.weight``, from a digest of the key and of the node's name."""
    named = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{node.name}"))
    bits = F.conv(F.substring(F.md5(named.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(16**DIGITS))) / F.lit(node.weight)


def assign(docs: DataFrame, tree: HashTree, spark: SparkSession, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards and slots of all rows of ``docs``.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: the size in bytes
    (UTF-8 text plus 16), the checksum of the text, the shard, a gapless place in it from 0,
    and the shard if there were one more. Null text counts as empty; null and repeated
    keys follow their hash, each row with a slot of its own; an empty table gives no rows;
    other columns are not read.

    A shard's slots are in the order of doc_id (null first), checksum and row. No shard is ever gathered in one task: rows are written in ranges of
    that order, counts per shard and range give each range its first slot, and rows are numbered inside their own shard and range.
    """
    work = Workspace(spark, "shards")
    body = utf8(F.col(text))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        tree.shard_of(F.col(key)).alias("shard"),
        tree.grown().shard_of(F.col(key)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = work.stage(rows, "rows")
    order = ["shard", "doc_id", "text_crc32", "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    placed = work.stage(placed.withColumns({"split": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "placed")
    work.drop("rows")
    counts = placed.groupBy("shard", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "split").orderBy("row")
    numbered = placed.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(firsts, ["shard", "split"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("rank")).cast("long").alias("slot"),
        "grown_shard",
    )
