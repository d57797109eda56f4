"""Table specifications: fields, defaults, evolution, record normalization."""

from __future__ import annotations

from dataclasses import dataclass, field, fields as dataclass_fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The five scalar types of a field.
TYPES: dict[str, T.DataType] = {
    "int64": T.LongType(), "float64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "bool": T.BooleanType(),
}
_PYTHON = {"int64": int, "float64": float, "string": str, "bytes": bytes, "bool": bool}


class SpecError(ValueError):
    """A table specification, or a record, that breaks the rules."""


@dataclass(frozen=True)
class FieldSpec:
    id: int
    name: str
    type: str
    nullable: bool = True
    default: Any = None

    def check(self) -> None:
        if self.id == 0 or not self.name.strip():
            raise SpecError("a field needs an id other than 0 and a name")
        if self.type not in TYPES:
            raise SpecError(f"unknown type {self.type}")
        if self.default is not None and type(self.default) is not _PYTHON[self.type]:
            raise SpecError(f"the default of {self.name} is no {self.type}")


@dataclass(frozen=True)
class TableSpec:
    name: str
    key: tuple[str, ...]
    fields: tuple[FieldSpec, ...]
    version: int = 1
    history: int | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def check(self) -> "TableSpec":
        if self.version <= 0 or not self.fields:
            raise SpecError("a schema needs a version above 0 and a field")
        for f in self.fields:
            f.check()
        for what in ("id", "name"):
            seen = [getattr(f, what) for f in self.fields]
            if len(set(seen)) < len(seen):
                raise SpecError(f"field {what}s repeat")
        return self

    def by_id(self) -> dict[int, FieldSpec]:
        return {f.id: f for f in self.fields}

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, TYPES[f.type], f.nullable, {"field_id": f.id}) for f in self.fields])


def check_successor(old: TableSpec, new: TableSpec) -> None:
    """A successor keeps types by field id, moves no name to another id, and adds only fields that old rows can have."""
    new.check()
    if new.version <= old.version:
        raise SpecError("a successor's version must rise")
    before, names = old.by_id(), {f.name: f.id for f in old.fields}
    for f in new.fields:
        if f.id in before:
            if f.type != before[f.id].type:
                raise SpecError(f"field {f.id} changes its type")
        elif not f.nullable and f.default is None:
            raise SpecError(f"new field {f.name} must be nullable or have a default")
        if names.get(f.name, f.id) != f.id:
            raise SpecError(f"name {f.name} moves to another field")


def evolve(df: DataFrame, old: TableSpec, new: TableSpec) -> DataFrame:
    """Rows of ``old`` as rows of ``new``: renamed by field id, missing fields filled, dropped ones gone."""
    check_successor(old, new)
    before = old.by_id()
    extra = [F.col(k) for k in new.key if k not in {f.name for f in new.fields}]
    columns = [normalized(F.col(before[f.id].name) if f.id in before else None, f).alias(f.name) for f in new.fields]
    return df.select(*extra, *columns)


def normalized(column: Column | None, f: FieldSpec) -> Column:
    """A put's field. A missing column (``None``) is the default, else NULL, else an error; a NULL is legal only where nullable."""
    kind = TYPES[f.type]
    missing = F.raise_error(F.lit(f"field {f.name} has no value")).cast(kind)
    if column is None:
        if f.default is not None:
            return F.lit(f.default).cast(kind)
        return F.lit(None).cast(kind) if f.nullable else missing
    column = column.cast(kind)
    return column if f.nullable else F.coalesce(column, missing)


def normalize_records(df: DataFrame, spec: TableSpec, operand: bool = False) -> DataFrame:
    """Records with all fields of ``spec``. Unknown columns are an error. Missing fields take
    defaults in puts and NULL in merge operands, where NULL is always legal."""
    unknown = set(df.columns) - {f.name for f in spec.fields} - set(spec.key)
    if unknown:
        raise SpecError(f"unknown fields {sorted(unknown)}")
    keys = [F.col(k) for k in spec.key if k not in {f.name for f in spec.fields}]
    out = []
    for f in spec.fields:
        column = F.col(f.name) if f.name in df.columns else None
        out.append((F.lit(None).cast(TYPES[f.type]) if operand and column is None else column.cast(TYPES[f.type]) if operand else normalized(column, f)).alias(f.name))
    return df.select(*keys, *out)


def differences(stored: TableSpec, opened: TableSpec) -> list[str]:
    """The properties in which two specifications differ."""
    return [f.name for f in dataclass_fields(TableSpec) if getattr(stored, f.name) != getattr(opened, f.name)]


@dataclass(frozen=True)
class Precondition:
    """A migration's condition: ``exists``, ``missing``, ``version``, ``metadata``, ``all``, ``any``, ``not``."""

    kind: str
    table: str = ""
    value: Any = None
    parts: tuple["Precondition", ...] = ()

    def holds(self, catalog: dict[str, TableSpec]) -> bool:
        spec = catalog.get(self.table)
        match self.kind:
            case "exists":
                return spec is not None
            case "missing":
                return spec is None
            case "version":
                return spec is not None and spec.version == self.value
            case "metadata":
                return spec is not None and spec.metadata.get(self.value[0]) == self.value[1]
            case "all":
                return all(p.holds(catalog) for p in self.parts)
            case "any":
                return any(p.holds(catalog) for p in self.parts)
            case "not":
                return not self.parts[0].holds(catalog)
        raise SpecError(f"unknown precondition {self.kind}")


def migrate(catalog: dict[str, TableSpec], action: str, spec: TableSpec | None = None, when: Precondition | None = None, table: str = "", metadata: dict[str, str] | None = None) -> dict[str, TableSpec]:
    """A catalog after one action: ``ensure`` a table, ``install`` a successor, or ``metadata``."""
    if when is not None and not when.holds(catalog):
        raise SpecError("the precondition does not hold")
    if action == "ensure":
        return catalog if spec.name in catalog else catalog | {spec.name: spec.check()}
    if action == "install":
        check_successor(catalog[spec.name], spec)
        return catalog | {spec.name: spec}
    if action == "metadata":
        old = catalog[table]
        changed = {f.name: getattr(old, f.name) for f in dataclass_fields(TableSpec)} | {"metadata": old.metadata | (metadata or {})}
        return catalog | {table: TableSpec(**changed)}
    raise SpecError(f"unknown action {action}")
