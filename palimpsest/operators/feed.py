"""Change feeds: every write after a cursor, in commit order, up to a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.log import OP, SEQ, SnapshotTooOld


def after(seq: int, op_index: int) -> Column:
    """Strictly behind a cursor."""
    return (F.col(SEQ) > seq) | ((F.col(SEQ) == seq) & (F.col(OP) > op_index))


def changes_since(log: DataFrame, cursor: tuple[int, int], bound: int | None = None, limit: int | None = None, oldest: int | None = None) -> DataFrame:
    """Rows after ``cursor``, at or below ``bound`` (the visible or the durable sequence), ordered by cursor.

    A cursor below the retained floor ``oldest`` raises ``SnapshotTooOld``.
    """
    if oldest is not None and cursor[0] + 1 < oldest:
        raise SnapshotTooOld(cursor[0], oldest)
    found = log.where(after(*cursor))
    if bound is not None:
        found = found.where(F.col(SEQ) <= bound)
    found = found.orderBy(SEQ, OP)
    return found if limit is None else found.limit(limit)


def floor(log: DataFrame) -> DataFrame:
    """The oldest and the newest sequence that the log still has."""
    return log.agg(F.min(SEQ).alias("oldest"), F.max(SEQ).alias("newest"))


def retention_floor(logical: int | None, physical: int | None) -> int:
    return max(logical or 0, physical or 0)


def merged(logs: list[DataFrame]) -> DataFrame:
    """The feeds of shards as one, in cursor order."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.orderBy(SEQ, OP)


def lag(durable: Column, frontier: Column) -> Column:
    """How far a consumer is behind; never negative."""
    return F.greatest(F.lit(0), durable - F.coalesce(frontier, F.lit(0)))


def floors(log: DataFrame, by: list[str], logical: int) -> DataFrame:
    """Each table's change-feed floor: what retention allows, or the oldest commit that is still there, whichever is later."""
    return log.groupBy(*by).agg(F.greatest(F.lit(logical).cast("long"), F.min(SEQ)).alias("floor"))


def frontiers(log: DataFrame, by: list[str], durable: int) -> DataFrame:
    """Each table's visible and durable sequence, and how many operations wait to become durable."""
    at = F.coalesce(F.max(F.when(F.col(SEQ) <= durable, F.col(SEQ))), F.lit(0).cast("long"))
    return log.groupBy(*by).agg(F.max(SEQ).alias("visible"), at.alias("durable"), F.count_if(F.col(SEQ) > durable).alias("pending"))
