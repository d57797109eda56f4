"""Merge operators: how operands fold onto a base.

``fold`` is an aggregate over a key's live rows: at most one base (put or delete) and the operands above it; ``running`` is the same up to each
row of a window frame. Algebraic operators keep partial aggregation; ordered ones sort the operands of one key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.log import KIND, MERGE, PUT, SEQ



def _put() -> Column:
    return F.col(KIND) == PUT


def _operand() -> Column:
    return F.col(KIND) == MERGE


def _either() -> Column:
    return _put() | _operand()


@dataclass(frozen=True)
class Sum:
    start: int = 0

    def fold(self, value: Column) -> Column:
        base = F.coalesce(F.max(F.when(_put(), value)), F.lit(self.start))
        return base + F.coalesce(F.sum(F.when(_operand(), value)), F.lit(self.start))

    def running(self, value: Column, frame) -> Column:
        return F.coalesce(F.sum(F.when(_either(), value)).over(frame), F.lit(self.start))


@dataclass(frozen=True)
class Extreme:
    """The least or the greatest of base and operands."""

    largest: bool = True

    def fold(self, value: Column) -> Column:
        return (F.max if self.largest else F.min)(F.when(_either(), value))

    def running(self, value: Column, frame) -> Column:
        return self.fold(value).over(frame)


@dataclass(frozen=True)
class FirstNonNull:
    """The oldest value that is not NULL."""

    def fold(self, value: Column) -> Column:
        return F.min_by(value, F.when(_either() & value.isNotNull(), F.col(SEQ)))

    def running(self, value: Column, frame) -> Column:
        return F.first(F.when(_either(), value), ignorenulls=True).over(frame)


@dataclass(frozen=True)
class LastNonNull:
    """The newest value that is not NULL."""

    def fold(self, value: Column) -> Column:
        return F.max_by(value, F.when(_either() & value.isNotNull(), F.col(SEQ)))

    def running(self, value: Column, frame) -> Column:
        return F.last(F.when(_either(), value), ignorenulls=True).over(frame)


@dataclass(frozen=True)
class Append:
    """Base and operands joined in commit order; the order matters, so one key's operands are sorted together."""

    separator: str = ""

    def fold(self, value: Column) -> Column:
        parts = F.array_sort(F.collect_list(F.when(_either(), F.struct(F.col(SEQ).alias("s"), value.alias("v")))))
        return F.array_join(F.transform(parts, lambda p: p["v"]), self.separator)

    def running(self, value: Column, frame) -> Column:
        return F.array_join(F.collect_list(F.when(_either(), value)).over(frame), self.separator)


@dataclass(frozen=True)
class Fold:
    """Any ordered fold: ``step(accumulated, operand)`` from ``start``, as Column functions."""

    start: Column
    step: object

    def fold(self, value: Column) -> Column:
        parts = F.array_sort(F.collect_list(F.when(_either(), F.struct(F.col(SEQ).alias("s"), value.alias("v")))))
        return F.aggregate(parts, self.start, lambda total, part: self.step(total, part["v"]))

    def running(self, value: Column, frame) -> Column:
        parts = F.collect_list(F.when(_either(), F.struct(value.alias("v")))).over(frame)
        return F.aggregate(parts, self.start, lambda total, part: self.step(total, part["v"]))
