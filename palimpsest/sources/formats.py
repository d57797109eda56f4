"""Tables and logs in Spark's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, format: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON lines or text. Text formats need a schema: nothing is inferred."""
    if schema is None and format in ("csv", "json"):
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_log(log: DataFrame, path: str, keys: list[str], files: int, bloom: bool = False) -> None:
    """A log in files sorted by key, so that ranges prune row groups; optionally with key bloom filters for point reads."""
    writer = log.repartitionByRange(files, *keys).sortWithinPartitions(*keys, "seq").write.mode("append")
    if bloom:
        for key in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)


def write_pruned(state: DataFrame, path: str, columns: list[str]) -> None:
    """A covering projection: some columns of a table on their own."""
    state.select(*columns).write.mode("overwrite").parquet(path)


def statistics(log: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes and bounds of a log."""
    return log.agg(
        F.count("*").alias("rows"), F.approx_count_distinct(F.struct(*keys)).alias("keys"), F.min("seq").alias("oldest"),
        F.max("seq").alias("newest"), F.count_if(F.col("kind") == "delete").alias("deletes"), F.count_if(F.col("kind") == "merge").alias("merges"),
    )
