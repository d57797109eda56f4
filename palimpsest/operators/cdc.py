"""Change data capture: envelope decoding, row predicates, event log, mirror, transitions.

Events are rows with ``op`` (c, u, d, r), ``before`` and ``after`` structs (NULL where absent), ``snapshot``,
``tombstone``, a source table and a source position.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.codecs import entry_key
from palimpsest.log import DELETE, KIND, MERGE, PUT


@dataclass(frozen=True)
class RowPredicate:
    """``all``, ``none``, ``and``, ``or``, ``not``, ``column``, ``key``, ``operation``, ``snapshot``."""

    kind: str
    column: str = ""
    value: Any = None
    parts: tuple["RowPredicate", ...] = ()

    def on(self, image: str) -> Column:
        """True, or false, for the image; where the image is absent every leaf is false, and so is ``not``."""
        there = F.col(image).isNotNull()
        match self.kind:
            case "all":
                return there
            case "none":
                return F.lit(False)
            case "and":
                out = there
                for p in self.parts:
                    out = out & p.on(image)
                return out
            case "or":
                out = F.lit(False)
                for p in self.parts:
                    out = out | p.on(image)
                return out
            case "not":
                return there & ~self.parts[0].on(image)
            case "column":
                return there & F.col(image).getField(self.column).eqNullSafe(F.lit(self.value))
            case "key":
                return there & F.col("primary_key").getField(self.column).eqNullSafe(F.lit(self.value))
            case "operation":
                return there & F.col("op").eqNullSafe(F.lit(self.value))
            case "snapshot":
                return there & F.col("snapshot").eqNullSafe(F.lit(self.value))
        raise ValueError(f"unknown predicate {self.kind}")


def decode(raw: DataFrame, row_schema: str, value: str = "value") -> DataFrame:
    """Postgres-style JSON envelopes as typed events. A null value is a tombstone. ``error`` says what breaks the rules:
    an unknown op, a create, update or read without ``after``, a delete with it."""
    schema = f"before struct<{row_schema}>, after struct<{row_schema}>, op string, source struct<db string, schema string, table string, snapshot string, lsn bigint, txId bigint, ts_ms bigint>, ts_ms bigint"
    parsed = raw.withColumn("e", F.from_json(F.col(value), schema))
    out = parsed.select(
        *[c for c in raw.columns if c != value],
        F.col("e.op").alias("op"), F.col("e.before").alias("before"), F.col("e.after").alias("after"),
        F.col("e.source").alias("source"), F.coalesce(F.col("e.source.snapshot"), F.lit("false")).alias("snapshot"),
        F.col(value).isNull().alias("tombstone"),
    )
    error = (
        F.when(F.col("tombstone"), None)
        .when(F.col("op").isNull() | ~F.col("op").isin("c", "u", "d", "r"), F.lit("unknown operation"))
        .when(F.col("op").isin("c", "u", "r") & F.col("after").isNull(), F.lit("after image missing"))
        .when((F.col("op") == "d") & F.col("after").isNotNull(), F.lit("delete with an after image"))
    )
    return out.withColumn("error", error)


def decode_with(raw: DataFrame, decoder, row_schema: str, value: str = "value") -> DataFrame:
    """Envelopes of another kind: ``decoder`` (a Column function) makes the usual JSON of a value; the rules stay."""
    return decode(raw.withColumn(value, decoder(F.col(value))), row_schema, value)


def check_topic(events: DataFrame, topic: str = "topic") -> DataFrame:
    """Marks events whose topic is not the one of their source table."""
    bound = F.concat("source.db", F.lit("."), "source.schema", F.lit("."), "source.table")
    fits = F.col("tombstone") | F.coalesce(F.endswith(F.col(topic), bound), F.lit(False))
    return events.withColumn("error", F.coalesce("error", F.when(~fits, F.lit("topic does not match its table"))))


def membership(events: DataFrame, predicate: RowPredicate) -> DataFrame:
    return events.withColumns({"was_in": predicate.on("before"), "is_in": predicate.on("after")})


def tables(events: DataFrame, selected: list[str] | None, column: str = "source_table") -> DataFrame:
    return events if selected is None else events.where(F.col(column).isin(selected))


def transitions(events: DataFrame, predicate: RowPredicate) -> DataFrame:
    """Events that enter or leave the predicate's rows, as ``transition`` (entered, exited)."""
    marked = membership(events, predicate)
    kind = F.when(F.col("is_in") & ~F.col("was_in"), "entered").when(F.col("was_in") & ~F.col("is_in"), "exited")
    return marked.withColumn("transition", kind).where(F.col("transition").isNotNull()).drop("was_in", "is_in")


def transition_entries(events: DataFrame, predicate: RowPredicate, partition: str, offset: str) -> DataFrame:
    """Transitions keyed by the entry of their source, ``entry`` (partition and offset, big-endian), so that an entry that comes again
    is the same row."""
    found = transitions(events, predicate)
    return found.withColumn("entry", entry_key(F.col(partition), F.col(offset)))


def event_log(events: DataFrame, predicate: RowPredicate) -> DataFrame:
    """Events that the log keeps: tombstones, and those with an image that matches."""
    marked = membership(events, predicate)
    return marked.where(F.col("tombstone") | F.col("was_in") | F.col("is_in")).drop("was_in", "is_in")


def mirror_changes(events: DataFrame, predicate: RowPredicate) -> DataFrame:
    """The mirror's log: a put where the row is in now, a delete where it may have been, nothing for the rest."""
    marked = membership(events, predicate)
    kind = F.when(F.col("tombstone"), None).when(F.col("is_in"), PUT).when(F.col("op").isin("u", "d") | F.col("was_in"), DELETE)
    return marked.withColumn(KIND, kind).where(F.col(KIND).isNotNull()).drop("was_in", "is_in")


def materialize(events: DataFrame, predicate: RowPredicate, mode: str = "hybrid") -> dict[str, DataFrame]:
    """``log`` and ``mirror``, as the mode (``event_log``, ``mirror``, ``hybrid``) asks."""
    out = {}
    if mode in ("event_log", "hybrid"):
        out["log"] = event_log(events, predicate)
    if mode in ("mirror", "hybrid"):
        out["mirror"] = mirror_changes(events, predicate)
    if not out:
        raise ValueError(f"unknown mode {mode}")
    return out


def projected(image: Column, keep: list[str], redact: dict[str, str]) -> Column:
    """Kept columns of an image with redacted values; a redaction appears even where its column is not kept."""
    names = [*keep, *[c for c in redact if c not in keep]]
    fields = [(F.lit(redact[c]) if c in redact else image.getField(c)).alias(c) for c in names]
    return F.when(image.isNotNull(), F.struct(*fields))


def snapshot_phase(snapshot: Column) -> Column:
    """live, initial, first, last, last_in_collection or incremental."""
    known = {"true": "initial", "first": "first", "first_in_data_collection": "first", "last": "last", "last_in_data_collection": "last_in_collection", "incremental": "incremental"}
    out = F.when(snapshot.isNull() | (snapshot == "false"), "live")
    for marker, phase in known.items():
        out = out.when(snapshot == marker, phase)
    return out.otherwise("initial")


def admits(policy: str) -> Column:
    """Which events a consumer takes: ``all``, ``no_snapshots``, ``no_snapshots_or_tombstones``, ``derived`` (none)."""
    live = F.coalesce(F.col("snapshot"), F.lit("false")) == "false"
    return {
        "all": F.lit(True), "no_snapshots": live, "no_snapshots_or_tombstones": live & ~F.col("tombstone"), "derived": F.lit(False),
    }[policy]


def state_transitions(rows: DataFrame, entity: list[str], order: list[str], predicate: Column) -> DataFrame:
    """Rows at which an entity's predicate flips, against its row before."""
    from pyspark.sql import Window

    frame = Window.partitionBy(*entity).orderBy(*order)
    now = F.coalesce(predicate, F.lit(False))
    marked = rows.withColumn("__now", now).withColumn("__was", F.coalesce(F.lag("__now").over(frame), F.lit(False)))
    kind = F.when(F.col("__now") & ~F.col("__was"), "entered").when(F.col("__was") & ~F.col("__now"), "exited")
    return marked.withColumn("transition", kind).where("transition IS NOT NULL").drop("__now", "__was")


def map_kafka(records: DataFrame, kind: Column) -> DataFrame:
    """Kafka records as a mirror's log: ``kind`` says put, delete or NULL (ignore); partition and offset order it."""
    return records.withColumn(KIND, kind).where(F.col(KIND).isin(PUT, DELETE, MERGE))
