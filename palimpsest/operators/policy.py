"""Row-level access policies: who sees, and who may write, which rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalar import json_path, render


class Denied(PermissionError):
    """A request that no row of the policy could answer."""


@dataclass(frozen=True)
class Clause:
    """``literal`` and ``context`` compare a JSON path of the row; ``any`` and ``all`` combine. A missing path is false."""

    kind: str
    path: str = ""
    value: Any = None
    parts: tuple["Clause", ...] = ()

    def on(self, row: Column, context: dict) -> Column:
        if self.kind in ("any", "all"):
            out = F.lit(self.kind == "all")
            for part in self.parts:
                one = part.on(row, context)
                out = out & one if self.kind == "all" else out | one
            return out
        value = self.value if self.kind == "literal" else context.get(self.value)
        if value is None:
            return F.lit(False)
        return F.coalesce(json_path(row, self.path) == F.lit(str(value)), F.lit(False))


@dataclass(frozen=True)
class Policy:
    """``prefix`` (a template), ``predicate`` (a clause over the row as JSON), ``index`` or ``procedure``."""

    kind: str
    template: str = ""
    clause: Clause | None = None

    #: What each kind may be asked for. Aggregates and queries over several tables: none.
    SHAPES = {"prefix": ("point", "prefix", "write"), "predicate": ("point", "prefix", "write"), "index": ("point", "prefix"), "procedure": ()}

    def check(self, shape: str) -> None:
        if shape not in self.SHAPES[self.kind]:
            raise Denied(f"a {self.kind} policy answers no {shape} query")

    def prefix(self, context: dict) -> str:
        return render(self.template, context)

    def key(self, own: Column, context: dict) -> Column:
        """A key as stored: under the subject's prefix."""
        return F.concat(F.lit(self.prefix(context)), own)

    def visible(self, rows: DataFrame, context: dict, row_id: str, row: Column | None = None, grants: DataFrame | None = None) -> DataFrame:
        """The rows that the subject sees."""
        if self.kind == "prefix":
            return rows.where(F.col(row_id).startswith(self.prefix(context)))
        if self.kind == "predicate":
            return rows.where(self.clause.on(row, context))
        if self.kind == "index":
            return rows.join(grants.select(F.col("row_id").alias(row_id)).distinct(), row_id, "left_semi")
        return rows.where(F.lit(False))


def audit(rows: DataFrame, visible: Column) -> DataFrame:
    """How many rows were scanned, returned and filtered."""
    seen = F.coalesce(visible, F.lit(False))
    return rows.agg(F.count("*").alias("scanned"), F.count_if(seen).alias("returned"), F.count_if(~seen).alias("filtered"))


def page(rows: DataFrame, visible: Column, key: str, size: int) -> DataFrame:
    """The first ``size`` scanned rows that are visible; ``resume`` is the last scanned key, if there may be more."""
    scanned = rows.orderBy(key).limit(size)
    n = scanned.agg(F.max(key).alias("__last"), F.count("*").alias("__n"))
    resume = F.when(F.col("__n") == size, F.col("__last"))
    return scanned.where(visible).crossJoin(F.broadcast(n)).withColumn("resume", resume).drop("__last", "__n")


def writable(changes: DataFrame, before: Column, after: Column, has_before: str, covered: str) -> DataFrame:
    """Writes with ``allowed``: both images must be visible, and an image before must be in the read set."""
    pre = ~F.col(has_before) | (F.col(covered) & F.coalesce(before, F.lit(False)))
    return changes.withColumn("allowed", pre & F.coalesce(after, F.lit(False)))
