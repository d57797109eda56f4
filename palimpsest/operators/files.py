"""A file tree kept in tables: inodes (inode, kind, size), entries (parent, name, inode), chunks (inode, chunk_index, data).

Paths resolve by one equality join a level, so a read touches the entries on its way and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = 0


def resolve(entries: DataFrame, path: str) -> DataFrame:
    """One row with the ``inode`` of a path below the root, or none."""
    found = None
    for name in [p for p in path.split("/") if p]:
        here = entries.where(F.col("name") == name)
        here = here.where(F.col("parent") == ROOT) if found is None else here.join(found.withColumnRenamed("inode", "parent"), "parent", "left_semi")
        found = here.select("inode")
    return entries.sparkSession.createDataFrame([(ROOT,)], "inode long") if found is None else found


def stat(inodes: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    """``inode, kind, size`` of a path, if it is there."""
    return inodes.join(resolve(entries, path), "inode", "left_semi").select("inode", "kind", "size")


def readdir(inodes: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    """``name, inode, kind, size`` of a folder's members."""
    members = entries.join(resolve(entries, path).withColumnRenamed("inode", "parent"), "parent", "left_semi")
    return members.join(inodes, "inode").select("name", "inode", "kind", "size")


def chunked(files: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """Files' bytes as chunks of ``size`` bytes; an empty file has none."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    each = files.select(F.col(key).alias("inode"), F.col(data).cast("binary").alias("__data"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index")).where("chunk_index >= 0 AND octet_length(__data) > 0")
    return each.select("inode", "chunk_index", F.substr("__data", F.col("chunk_index") * size + 1, F.lit(size)).alias("data"))


def pread(chunks: DataFrame, size: int, offset: int, length: int) -> DataFrame:
    """``inode, data`` of a byte range of every file in ``chunks``; only the chunks that the range meets are read."""
    first, last = offset // size, (offset + length - 1) // size
    met = chunks.where(F.col("chunk_index").between(first, last)).groupBy("inode").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "data"))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    return met.select("inode", F.substr(joined, F.lit(offset - first * size + 1), F.lit(length)).alias("data"))
