"""Point-in-time visibility: the newest state of each key at a sequence.

One exchange by key serves every operator here: the head of a key comes from a window or
a partial aggregate, and merge operands are folded in the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.log import DELETE, KIND, MERGE, OP, PUT, SEQ, SnapshotTooOld


def _values(log: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in log.columns if c not in (*keys, SEQ, OP, KIND)]


def up_to(log: DataFrame, seq: int | Column | None) -> DataFrame:
    return log if seq is None else log.where(F.col(SEQ) <= seq)


def last_of_commit(log: DataFrame, keys: list[str]) -> DataFrame:
    """State keeps a key's last operation of each commit; feeds keep them all."""
    rest = [c for c in log.columns if c not in (*keys, SEQ, OP)]
    last = log.groupBy(*keys, SEQ).agg(F.max_by(F.struct(*rest), F.col(OP)).alias("last"), F.max(OP).alias(OP))
    return last.select(*keys, SEQ, OP, *[F.col(f"last.{c}").alias(c) for c in rest])


def current(log: DataFrame, keys: list[str], seq: int | None = None) -> DataFrame:
    """Keys, values, ``seq`` of every key whose newest operation at ``seq`` is a put.

    A partial aggregate takes the head, so only one row of each key and task is shuffled. A merge at the head is an error: the table has no
    operator to resolve it.
    """
    values = _values(log, keys)
    seen = up_to(log, seq)
    head = seen.groupBy(*keys).agg(F.max_by(F.struct(KIND, SEQ, *values), F.struct(SEQ, OP)).alias("head"))
    fail = F.raise_error(F.lit("a merge needs a merge operator")).cast("string")
    kind = F.when(F.col("head.kind") == MERGE, fail).otherwise(F.col("head.kind"))
    return head.where(kind == PUT).select(*keys, *[F.col(f"head.{c}").alias(c) for c in values], F.col("head.seq").alias(SEQ))


def resolve(log: DataFrame, keys: list[str], operators: dict[str, "object"], seq: int | None = None, single: bool = False, heavy: int | None = None) -> DataFrame:
    """Keys and values at ``seq`` with merge operands folded in commit order onto the newest put or
    delete below them. ``operators`` has a merge operator for each value column; ``single`` promises that
    no commit touches a key twice.

    A key's rows meet in one task to find its base. ``heavy`` spares keys with more rows than that: their bases, of which there are at most
    the log's rows divided by ``heavy``, are broadcast to the rows, and partial aggregates fold them. Ordered operators (``Append``, ``Fold``) still
    gather a key's operands, which are their result.
    """
    seen = up_to(log, seq)
    seen = seen if single else last_of_commit(seen, keys)
    newest = F.max(F.when(F.col(KIND) != MERGE, F.col(SEQ)))
    if heavy is None:
        return _fold(seen.withColumn("__base", newest.over(Window.partitionBy(*keys))), keys, operators)
    named = {k: F.col(k).alias(f"__{k}") for k in keys}
    bases = seen.groupBy(*named.values()).agg(newest.alias("__base"), F.count("*").alias("__n")).where(F.col("__n") > heavy).drop("__n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    many = seen.join(F.broadcast(bases), same).drop(*[f"__{k}" for k in keys])
    few = seen.join(F.broadcast(bases.drop("__base")), same, "left_anti").withColumn("__base", newest.over(Window.partitionBy(*keys)))
    return _fold(many, keys, operators).unionByName(_fold(few, keys, operators))


def _fold(based: DataFrame, keys: list[str], operators: dict[str, "object"]) -> DataFrame:
    """Rows with their key's base folded from there on."""
    live = based.where(F.col("__base").isNull() | (F.col(SEQ) >= F.col("__base")))
    folded = [operator.fold(F.col(name)).alias(name) for name, operator in operators.items()]
    out = live.groupBy(*keys).agg(*folded, F.max(SEQ).alias(SEQ), F.bool_or(F.col(KIND) != DELETE).alias("__exists"))
    return out.where("__exists").drop("__exists")


def rewrite_merges(log: DataFrame, keys: list[str], operators: dict[str, "object"], single: bool = False) -> DataFrame:
    """Every merge row as the put of its resolved values at its own sequence, for merge operators of any kind. A commit's last
    operation of a key counts, as in ``resolve``; ``single`` promises that there is but one."""
    rows = log if single else last_of_commit(log, keys)
    order = Window.partitionBy(*keys).orderBy(SEQ, OP)
    epoch = F.sum(F.when(F.col(KIND) == MERGE, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    frame = Window.partitionBy(*keys, "__epoch").orderBy(SEQ, OP).rowsBetween(Window.unboundedPreceding, 0)
    folded = {n: F.when(F.col(KIND) == MERGE, o.running(F.col(n), frame)).otherwise(F.col(n)) for n, o in operators.items()}
    return rows.withColumn("__epoch", epoch).withColumns(folded | {KIND: F.when(F.col(KIND) == MERGE, F.lit(PUT)).otherwise(F.col(KIND))}).drop("__epoch")


def merges_as_puts(log: DataFrame, keys: list[str], name: str, running) -> DataFrame:
    """``rewrite_merges`` of one column of a log that touches a key once a commit. ``running`` folds a column over a window frame."""
    return rewrite_merges(log, keys, {name: _Running(running)}, single=True)


class _Running:
    def __init__(self, running) -> None:
        self.running = running


def horizon(current_seq: int, retained: int | None, oldest_snapshot: int | None = None) -> int | None:
    """The oldest sequence that history must answer; none if history is unbounded."""
    if retained is None:
        return None
    floor = max(0, current_seq - (retained - 1))
    return floor if oldest_snapshot is None else min(floor, oldest_snapshot)


def trim(log: DataFrame, keys: list[str], at: int) -> DataFrame:
    """All rows above the horizon and, of each key, the newest at or below it."""
    below = F.max(F.when(F.col(SEQ) <= at, F.struct(SEQ, OP))).over(Window.partitionBy(*keys))
    own = F.struct(SEQ, OP)
    return log.withColumn("__newest", below).where((F.col(SEQ) > at) | (own == F.col("__newest"))).drop("__newest")


def compact(log: DataFrame, keep: Column, oldest_snapshot: int | None = None) -> DataFrame:
    """Drop rows that a compaction filter rejects. Rows that a snapshot may see are never offered to it."""
    safe = F.lit(False) if oldest_snapshot is None else F.col(SEQ) >= oldest_snapshot
    return log.where(safe | F.coalesce(keep, F.lit(True)))


def ttl(expires_at: Column, now) -> Column:
    """The filter of rows that live: no tombstone, and none without an expiry, ever expires."""
    return (F.col(KIND) == DELETE) | expires_at.isNull() | (expires_at > F.lit(now))


def check_readable(seq: int, oldest: int) -> None:
    if seq < oldest:
        raise SnapshotTooOld(seq, oldest)
