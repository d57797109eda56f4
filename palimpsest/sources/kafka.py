"""Kafka records: stream and batch sources, filters, append-only tables and mirrors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.log import KIND, OP, PUT, SEQ, Database


def start_position(persisted: dict[str, dict[str, int]], bootstrap: str) -> str | dict:
    """Where to start: persisted offsets, else the bootstrap policy (``earliest``, ``latest``)."""
    if bootstrap not in ("earliest", "latest"):
        raise ValueError(f"unknown bootstrap policy {bootstrap}")
    return persisted or bootstrap


def stream(spark: SparkSession, servers: str, topics: list[str], persisted: dict | None = None, bootstrap: str = "earliest") -> DataFrame:
    """A Kafka stream; needs Spark's Kafka package on the classpath."""
    import json

    start = start_position(persisted or {}, bootstrap)
    offsets = start if isinstance(start, str) else json.dumps(start)
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    return reader.option("startingOffsets", offsets).load()


def retained(records: DataFrame, keep: Column) -> DataFrame:
    """Records that a filter keeps; the rest still moves the offsets, as the checkpoint covers all."""
    return records.where(F.coalesce(keep, F.lit(False)))


def as_append_only(records: DataFrame) -> DataFrame:
    """Records as rows keyed by partition and offset."""
    return records.select("topic", "partition", "offset", "key", "value", "timestamp")


def as_log(records: DataFrame, kind: Column) -> DataFrame:
    """Records as a log. Offsets order a partition, and a key stays in its partition."""
    return records.withColumns({SEQ: F.col("offset").cast("long"), OP: F.lit(0), "kind": kind}).where(F.col("kind").isNotNull())


def progress(records: DataFrame) -> DataFrame:
    """The next offset of each partition."""
    return records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def start_positions(partitions: DataFrame, persisted: DataFrame, bootstrap: str) -> DataFrame:
    """Where each partition (topic, partition, earliest, latest) starts: at its persisted ``next_offset``, else by the bootstrap policy."""
    if bootstrap not in ("earliest", "latest"):
        raise ValueError(f"unknown bootstrap policy {bootstrap}")
    both = partitions.join(persisted, ["topic", "partition"], "left")
    return both.select("topic", "partition", F.coalesce("next_offset", bootstrap).alias("start"))


def ingest(db: Database, records: DataFrame, keys: list[str], keep: Column | None = None, kind: Column | None = None, appended: str = "records", mirrored: str = "mirror", offsets: str = "offsets") -> int | None:
    """Take a batch of records (topic, partition, offset, values) into tables: the kept ones appended by partition and offset, and mirrored
    by ``keys`` as ``kind`` says (put, delete, or null to ignore), with the next offset of each partition beside them, all in one commit.

    Records below a partition's offset are in already and count no more, so a batch that comes again does no harm. Skipped
    records still move the offsets. Returns the commit's sequence; without new records there is none.
    """
    from palimpsest.operators.visibility import current

    at = current(db.log(offsets), ["topic", "partition"]).drop(SEQ)
    new = records.join(F.broadcast(at), ["topic", "partition"], "left").where(F.col("offset") >= F.coalesce("next_offset", F.lit(0))).drop("next_offset")
    if not new.take(1):
        return None
    kept = new if keep is None else retained(new, keep)
    frames = {appended: kept.withColumns({OP: F.lit(0), KIND: F.lit(PUT)})}
    if kind is not None:
        # The order of one key's records in the commit; a key stays in its partition.
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("offset")) - 1
        frames[mirrored] = kept.withColumn(KIND, kind).where(F.col(KIND).isNotNull()).withColumn(OP, nth)
    frames[offsets] = progress(new).withColumns({OP: F.lit(0), KIND: F.lit(PUT)})
    return db.append_all(frames)
