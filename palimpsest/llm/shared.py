"""Staging of intermediate tables and small Column helpers for the llm operators."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"
#: Java and Python pattern of a run of it.
WHITE_RUN = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Where a session on one machine leaves that unset, as in
    tests, a temporary folder of this process takes its place; on a cluster there is none.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(f"file://{tempfile.mkdtemp(prefix='palimpsest-')}")
    return _own_dir[0]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as all executors see it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more. It does so when the driver's JVM collects
    garbage, which may be long after tables were staged and their shuffles are of no use. Then the driver's JVM hands back native memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def settle_fully(spark: SparkSession, most: int = 10) -> None:
    """``settle`` until the shuffles that can go are gone: one collection leaves some that only the next one finds, and Spark deletes them in the
    background, so that what is written next would lie beside them. Two calls in turn that free none end it, or ``most`` calls."""
    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    idle = 0
    for _ in range(most):
        before = known.size()
        settle(spark)
        time.sleep(0.4)
        idle = idle + 1 if known.size() == before else 0
        if idle == 2 or not known.size():
            return


def trim(spark: SparkSession) -> None:
    """Give native memory that the driver's JVM has freed back to the system. Hundreds of short-lived planning and compiler threads leave
    it in pools of the C library, where it adds up over the steps of a session."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # The server's own class is closed to callers; its interface is open.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = new_array(jvm.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = new_array(jvm.Object, 0), new_array(jvm.String, 0)
    try:
        invoke.invoke(server, given)
    except Py4JJavaError:  # another JVM, or one without the GNU C library
        pass


#: The workspaces that were opened inside each ``scratch`` block that is entered.
_scratch: list[list["Workspace"]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete all workspaces that are opened inside the block when it ends; what they led to must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for found in _scratch.pop():
            found.remove()


class Workspace:
    """Tables written under the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        settle(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
        if _scratch:
            _scratch[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.read(df, name)

    def read(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete staged tables that nothing reads any more."""
        for name in names:
            self._delete(self.path(name))

    def remove(self) -> None:
        """Delete the whole workspace."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def system_memory() -> None:
    """From now on Arrow takes this worker's memory from the system, which can have it back."""
    import pyarrow

    pyarrow.set_memory_pool(pyarrow.system_memory_pool())


def hand_back() -> None:
    """Give freed memory back to the system: Python workers live on and would keep it beside the next stage's."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function for mapInArrow, in a worker that keeps no memory after the task."""

    def wrapped(tables: Iterator) -> Iterator:
        system_memory()
        yield from run(tables)
        hand_back()

    return wrapped


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; a lambda variable keeps the
    optimizer from copying the expression into every use."""
    return F.transform(F.array(value), body).getItem(0)


def utf8(text: Column) -> Column:
    """The text's bytes; of null, none."""
    return F.coalesce(text, F.lit("")).cast("binary")


def held_out(doc_id: Column) -> Column:
    """The rows whose labels no model may learn: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that is not among ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys that are joined by broadcast hold more than one in so many of all rows each, so there are no more of them.
HEAVY_KEYS = 2_000


def spread_join(left: DataFrame, right: DataFrame, on: str, count: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, whose ``on`` is unique and whose ``count`` says how many rows of ``left`` have it.

    ``total`` is the sum of the counts, so that at most HEAVY_KEYS keys hold more than a share of 1 / HEAVY_KEYS of all rows. These
    go to the rows by broadcast, a table of proven size; the others meet by shuffle, none of them in a large group. ``count`` is dropped.
    """
    heavy = F.col(count) > max(1_000, total / HEAVY_KEYS)
    big, small = right.where(heavy).drop(count), right.where(~heavy).drop(count)
    met = left.join(F.broadcast(big), on)
    others = left.join(F.broadcast(big.select(on)), on, "left_anti")
    return met.unionByName(others.join(small, on))


def rows_in(df: DataFrame) -> int:
    """Row count; of a staged Parquet table a matter of its footers."""
    return df.count()
