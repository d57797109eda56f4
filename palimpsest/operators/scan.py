"""Scans: point, range, prefix, reverse, limit, projection and a conjunctive predicate."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.spec import SpecError, TableSpec


@dataclass(frozen=True)
class Predicate:
    """``true``, ``all``, ``equals`` (NULL equals NULL, NaN equals nothing), ``at_least`` (int64) or ``is`` (bool)."""

    kind: str
    column: str = ""
    value: Any = None
    parts: tuple["Predicate", ...] = ()

    def flat(self) -> list["Predicate"]:
        """The clauses of nested conjunctions, without the trivial ones."""
        if self.kind == "all":
            return [c for p in self.parts for c in p.flat()]
        return [] if self.kind == "true" else [self]

    def check(self, spec: TableSpec) -> None:
        fields = {f.name: f for f in spec.fields}
        for clause in self.flat():
            f = fields.get(clause.column)
            if f is None:
                raise SpecError(f"unknown field {clause.column}")
            if clause.value is None:
                if clause.kind != "equals" or not f.nullable:
                    raise SpecError(f"{clause.column} is never NULL here")
                continue
            wanted = {"at_least": "int64", "is": "bool"}.get(clause.kind, f.type)
            kinds = {bool: "bool", int: "int64", float: "float64", str: "string", bytes: "bytes"}
            if f.type != wanted or kinds.get(type(clause.value)) != wanted:
                raise SpecError(f"{clause.kind} does not fit field {clause.column}")

    def column_filter(self) -> Column:
        out = F.lit(True)
        for clause in self.flat():
            c = F.col(clause.column)
            if clause.kind == "equals":
                nan = isinstance(clause.value, float) and clause.value != clause.value
                out = out & (F.lit(False) if nan else c.isNull() if clause.value is None else c == F.lit(clause.value))
            elif clause.kind == "at_least":
                out = out & (c >= F.lit(clause.value))
            elif clause.kind == "is":
                out = out & (c == F.lit(clause.value))
            else:
                raise SpecError(f"unknown predicate {clause.kind}")
        return out


@dataclass(frozen=True)
class ScanOptions:
    columns: tuple[str, ...] | None = None
    predicate: Predicate = field(default_factory=lambda: Predicate("true"))
    reverse: bool = False
    limit: int | None = None


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; none if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def point(table: DataFrame, key: dict[str, Any]) -> DataFrame:
    match = F.lit(True)
    for name, value in key.items():
        match = match & (F.col(name) == F.lit(value))
    return table.where(match)


def _order(table: DataFrame, keys: list[str], options: ScanOptions) -> DataFrame:
    way = F.desc if options.reverse else F.asc
    out = table.orderBy(*[way(k) for k in keys])
    return out if options.limit is None else out.limit(options.limit)


def scan(table: DataFrame, keys: list[str], start=None, end=None, options: ScanOptions = ScanOptions(), spec: TableSpec | None = None) -> DataFrame:
    """Rows with ``start <= key < end`` by the first key column, in key order; the limit counts rows after the predicate.

    Only the projection and the keys are read from the files; range and predicate reach the Parquet reader. A row-format
    table (``spec`` None) takes no predicate and ignores the projection.
    """
    if spec is None and options.predicate.flat():
        raise SpecError("row tables take no predicate")
    if spec is not None:
        options.predicate.check(spec)
    out = table
    if start is not None:
        out = out.where(F.col(keys[0]) >= F.lit(start))
    if end is not None:
        out = out.where(F.col(keys[0]) < F.lit(end))
    out = out.where(options.predicate.column_filter())
    return _project(_order(out, keys, options), keys, options, spec)


def scan_prefix(table: DataFrame, keys: list[str], prefix: str | bytes, options: ScanOptions = ScanOptions(), spec: TableSpec | None = None) -> DataFrame:
    """Rows whose first key column starts with ``prefix``, otherwise as ``scan``. A prefix of bytes is the range up to the least key above it."""
    if isinstance(prefix, bytes):
        return scan(table, keys, bytearray(prefix), None if prefix_end(prefix) is None else bytearray(prefix_end(prefix)), options, spec)
    return scan(table.where(F.col(keys[0]).startswith(prefix)), keys, None, None, options, spec)


def _project(out: DataFrame, keys: list[str], options: ScanOptions, spec: TableSpec | None) -> DataFrame:
    if options.columns is None or spec is None:
        return out
    unknown = set(options.columns) - {f.name for f in spec.fields}
    if unknown:
        raise SpecError(f"unknown columns {sorted(unknown)}")
    return out.select(*keys, *[c for c in dict.fromkeys(options.columns) if c not in keys])


def keyset_page(table: DataFrame, key: str, after, size: int) -> tuple[DataFrame, DataFrame]:
    """A page of rows above a cursor, and one row with the next cursor, NULL if no more rows follow. Each reads the first ``size + 1`` rows once."""
    above = table if after is None else table.where(F.col(key) > F.lit(after))
    more = above.orderBy(key).limit(size + 1).withColumn("__n", F.row_number().over(Window.orderBy(key)))
    cursor = more.agg(F.max(F.when(F.col("__n") <= size, F.col(key))).alias("last"), F.count("*").alias("n"))
    return more.where(F.col("__n") <= size).drop("__n"), cursor.select(F.when(F.col("n") > size, F.col("last")).alias("next_cursor"))


def overlay(snapshot: DataFrame, pending: DataFrame, keys: list[str], deleted: str = "deleted") -> DataFrame:
    """A transaction's view: its own pending writes over the snapshot; a pending delete removes. A null key part equals null."""
    values = [c for c in snapshot.columns if c not in keys]
    mine = pending.select(*[F.col(c).alias(f"__{c}") for c in (*keys, *values)], F.col(deleted).alias("__deleted"), F.lit(True).alias("__mine"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = snapshot.join(mine, same, "full_outer").where(~F.coalesce(F.col("__deleted"), F.lit(False)))
    return both.select(*[F.when(F.col("__mine"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in (*keys, *values)])


def whiteout_overlay(base: DataFrame, delta: DataFrame, whiteouts: DataFrame, path: str) -> DataFrame:
    """Base rows that neither the delta replaces nor a whiteout path or an ancestor of it hides, and all delta rows.

    Ancestors come from the row's own path, so the whiteouts are joined by equality.
    """
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hidden = base.select(path, F.explode(ancestors).alias("__at")).join(whiteouts.select(F.col(path).alias("__at")), "__at", "left_semi").select(path).distinct()
    kept = base.join(delta.select(path), path, "left_anti").join(hidden, path, "left_anti")
    return kept.unionByName(delta)


def key_windows(table: DataFrame, key: str, part: Column, start, end) -> DataFrame:
    """The key window of each part, ``part, first, rows, overlaps``: from its first key to the first key of the next part, and whether a scan
    of ``[start, end)`` meets it. Parts are few beside their rows."""
    parts = table.groupBy(part.alias("part")).agg(F.min(key).alias("first"), F.count("*").alias("rows"))
    after = F.lead("first").over(Window.orderBy("first"))
    overlaps = F.lit(True)
    if end is not None:
        overlaps = overlaps & (F.col("first") < F.lit(end))
    if start is not None:
        overlaps = overlaps & (F.col("__next").isNull() | (F.col("__next") > F.lit(start)))
    return parts.withColumn("__next", after).withColumn("overlaps", overlaps).drop("__next")


def report(table: DataFrame, key: str, part: Column, start, end) -> DataFrame:
    """What a range scan does, as one row: ``considered`` and ``pruned`` parts, rows ``scanned`` in the parts it reads and rows ``returned``."""
    windows = key_windows(table, key, part, start, end)
    inside = (F.col(key) >= F.lit(start)) & (F.col(key) < F.lit(end))
    seen = windows.agg(F.count("*").alias("considered"), F.count_if(~F.col("overlaps")).alias("pruned"), F.coalesce(F.sum(F.when(F.col("overlaps"), F.col("rows"))), F.lit(0)).alias("scanned"))
    return seen.crossJoin(F.broadcast(table.agg(F.count_if(inside).alias("returned"))))


def skip_index(table: DataFrame, key: str, part: Column, bits: int = 256) -> DataFrame:
    """What each part may hold, ``part, least, most, marks``: the bounds of its keys and the marks (key modulo ``bits``) that occur."""
    rows = table.where(F.col(key).isNotNull()).select(part.alias("part"), F.col(key).alias("key"), F.pmod(F.col(key), F.lit(bits)).alias("mark"))
    return rows.groupBy("part").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.collect_set("mark").alias("marks"))


def probe(index: DataFrame, value: int, bits: int = 256) -> DataFrame:
    """The parts that a read of one key cannot skip."""
    inside = F.lit(value).between(F.col("least"), F.col("most"))
    return index.where(inside & F.array_contains("marks", F.lit(value % bits).cast("long"))).select("part")


# Selections: which positions of a batch are still wanted, as boolean Columns over a position.


def all_selected() -> Column:
    return F.lit(True)


def from_positions(position: Column, positions: list[int]) -> Column:
    return position.isin(positions)


def slice_of(position: Column, start: int, end: int) -> Column:
    return (position >= start) & (position < end)


def intersect(*masks: Column) -> Column:
    out = all_selected()
    for mask in masks:
        out = out & F.coalesce(mask, F.lit(False))
    return out


def survivors(rows: DataFrame, mask: Column) -> DataFrame:
    """How many positions a selection has and how many it leaves out, as one row."""
    return rows.agg(F.count_if(intersect(mask)).alias("selected"), F.count_if(~intersect(mask)).alias("dropped"))


def execution_report(df: DataFrame) -> dict[str, Any]:
    """What a scan does: rows returned, files considered, and the filters pushed to the reader."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = sorted({p for line in plan.splitlines() if "PushedFilters: [" in line for p in line.split("PushedFilters: [")[1].split("]")[0].split(", ") if p})
    return {"rows": df.count(), "files": len(df.inputFiles()), "pushed": pushed}
