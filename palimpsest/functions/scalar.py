"""Scalar functions that answers depend on, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.codecs import canonical_json


def route(key: Column, partitions: int) -> Column:
    """The virtual partition of a key: its checksum modulo the partitions."""
    return F.pmod(F.crc32(key.cast("binary")), F.lit(partitions)).cast("int")


def shard_of(partition: Column, shards: list[int]) -> Column:
    """The physical shard of a virtual partition, by the shard map."""
    return F.element_at(F.array(*[F.lit(s) for s in shards]), partition + 1)


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits; other letters separate. Only ASCII is lowered, and all at once, so nothing is
    evaluated token by token."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.array_distinct(F.split(lowered, "[^a-z0-9]+")), "")


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data.cast("binary"), 256))


def number_term(label: str, number: Column) -> Column:
    """A number as text that sorts like it."""
    return F.concat(F.lit(f"{label}:"), F.lpad(number.cast("string"), 20, "0"))


def json_term(label: str, **fields: Column) -> Column:
    """The exact-match term of an object: its canonical JSON, lower-cased."""
    return F.concat(F.lit(f"{label}:"), F.lower(canonical_json(**fields)))


def json_path(document: Column, path: str) -> Column:
    return F.get_json_object(document, f"$.{path}")


def render(template: str, context: dict[str, str]) -> str:
    """``{field}`` replaced from the context; an unknown field is an error."""
    return re.sub(r"\{(\w+)\}", lambda m: str(context[m[1]]), template)


def json_row(rows: DataFrame) -> Column:
    """A row as JSON, for predicates over paths."""
    return F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
