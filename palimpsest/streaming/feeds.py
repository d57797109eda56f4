"""Streams over logs: feeds, mirrors, counters, transitions, timers.

Streams read files as they come; ``incremental`` follows a database commit by commit where a commit must never be split. Sinks write by
batch id into a folder of their own and replace it when a batch is run again, so results are the same after a retry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palimpsest.log import KIND, OP, SEQ


def read_log(spark: SparkSession, path: str, schema: T.StructType, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_batches(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Apply a function to every micro-batch that is there, then stop."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _put(rows: DataFrame, out: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def append_feed(stream: DataFrame, checkpoint: str, out: str, keep: Column | None = None) -> StreamingQuery:
    """The feed, or the part of it that a filter keeps, as an append-only table."""
    chosen = stream if keep is None else stream.where(keep)
    return run_batches(chosen, checkpoint, lambda df, i: _put(df, out, i))


def _heads(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in df.columns if c not in keys]
    head = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(SEQ, OP)).alias("head"))
    return head.select(*keys, *[F.col(f"head.{c}").alias(c) for c in rest])


def mirror(stream: DataFrame, checkpoint: str, out: str, keys: list[str], log_out: str | None = None) -> StreamingQuery:
    """Each batch's newest row of a key; the mirror is the newest over all batches (``read_mirror``). ``log_out`` takes the rows themselves."""

    def apply(df: DataFrame, i: int) -> None:
        if log_out is not None:
            _put(df, log_out, i)
        _put(_heads(df, keys), out, i)

    return run_batches(stream, checkpoint, apply)


def compact_mirror(spark: SparkSession, out: str, into: str, keys: list[str]) -> None:
    """All batches of a stopped mirror as one folder, in a new place, so that reads fold one batch. A mirror that goes on writes
    there, with later batch numbers."""
    _put(_heads(spark.read.parquet(out).drop("batch"), keys), into, 0)


def read_mirror(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    from palimpsest.operators.visibility import current

    return current(spark.read.parquet(out).drop("batch"), keys)


def counter(stream: DataFrame, checkpoint: str, out: str, by: list[str]) -> StreamingQuery:
    """Partial counts a batch; their sum is the counter (``read_counter``)."""
    return run_batches(stream, checkpoint, lambda df, i: _put(df.groupBy(*by).agg(F.count("*").alias("n")), out, i))


def read_counter(spark: SparkSession, out: str, by: list[str]) -> DataFrame:
    return spark.read.parquet(out).groupBy(*by).agg(F.sum("n").alias("n"))


def both(stream: DataFrame, checkpoint: str, log_out: str, mirror_out: str, keys: list[str]) -> StreamingQuery:
    """Append-only table and mirror from one pass."""
    return mirror(stream, checkpoint, mirror_out, keys, log_out)


def outbox_relay(stream: DataFrame, checkpoint: str, deliver: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each batch of messages over; the checkpoint moves only after that."""
    return run_batches(stream.where(F.col(KIND) == "put"), checkpoint, deliver)


def windowed_counts(stream: DataFrame, ts: str, by: list[str], width: str, late: str) -> DataFrame:
    """Event-time buckets with a watermark."""
    return stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width)).agg(F.count("*").alias("n")).select(*by, F.col("window.start").alias("bucket"), "n")


def stateful_transitions(stream: DataFrame, entity: str, order: str, predicate: Column) -> DataFrame:
    """Enter and exit events with the last verdict kept as state: ``entity, at, transition``."""
    marked = stream.select(F.col(entity).cast("string").alias("entity"), F.col(order).cast("long").alias("at"), F.coalesce(predicate, F.lit(False)).alias("now"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else False
        # Of rows with one time the false ones come first, whatever order they arrive in.
        rows = pd.concat(list(parts)).sort_values(["at", "now"])
        out = []
        for at, now in zip(rows["at"], rows["now"]):
            if bool(now) != was:
                out.append((key[0], at, "entered" if now else "exited"))
            was = bool(now)
        state.update((was,))
        yield pd.DataFrame(out, columns=["entity", "at", "transition"])

    return marked.groupBy("entity").applyInPandasWithState(step, "entity string, at long, transition string", "was boolean", "append", "NoTimeout")


def progress(query: StreamingQuery) -> list[dict]:
    """Rows of each finished batch: what a watermark subscriber sees."""
    return [{"batch": p.batchId, "rows": p.numInputRows} for p in query.recentProgress]
