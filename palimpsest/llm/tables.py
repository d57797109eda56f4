"""Sorted tables of numbers by 64-bit key, written by Spark and looked up in Python workers."""

from __future__ import annotations

import fcntl
import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from palimpsest.llm.shared import Workspace, qualified

_open: dict[str, tuple[np.ndarray, list[np.ndarray]]] = {}


def _local_dir() -> str:
    """A folder that goes with the executor."""
    try:
        return SparkFiles.getRootDirectory()
    except Exception:
        return tempfile.gettempdir()


@dataclass(frozen=True)
class Table:
    """``key long`` and float columns in Parquet files at ``uri``, in the order of ``key``.

    A process maps a copy of the columns in a file of its machine, which the workers there share and
    the system pages in and out, so a worker's own memory does not grow with the table.
    """

    uri: str
    columns: tuple[str, ...]

    @staticmethod
    def write(rows: DataFrame, work: Workspace, name: str, ranges: bool = False) -> Table:
        """``ranges`` says that the rows' partitions are ranges of keys in order already."""
        work.stage(rows.sortWithinPartitions("key") if ranges else rows.orderBy("key"), name)
        return Table(qualified(work.spark, work.path(name)), tuple(c for c in rows.columns if c != "key"))

    def _map(self) -> tuple[np.ndarray, list[np.ndarray]]:
        if self.uri in _open:
            return _open[self.uri]
        system, path = pafs.FileSystem.from_uri(self.uri)
        files = sorted(f.path for f in system.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet"))
        parts = [pq.ParquetFile(system.open_input_file(f)) for f in files]
        n = sum(p.metadata.num_rows for p in parts)
        if not n:
            return np.zeros(0, np.int64), [np.zeros(0, np.float32) for _ in self.columns]
        at = os.path.join(_local_dir(), self.uri.rstrip("/").replace("/", "_").replace(":", "_")[-120:])
        with open(f"{at}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(at):
                self._copy(parts, n, f"{at}.part")
                os.replace(f"{at}.part", at)
        keys = np.memmap(at, np.int64, "r", 0, (n,))
        values = [np.memmap(at, np.float32, "r", n * (8 + 4 * i), (n,)) for i in range(len(self.columns))]
        _open[self.uri] = keys, values
        return _open[self.uri]

    def _copy(self, parts: list[pq.ParquetFile], n: int, at: str) -> None:
        with open(at, "wb") as f:
            f.truncate(n * (8 + 4 * len(self.columns)))
        keys = np.memmap(at, np.int64, "r+", 0, (n,))
        values = [np.memmap(at, np.float32, "r+", n * (8 + 4 * i), (n,)) for i in range(len(self.columns))]
        done = 0
        for part in parts:
            for batch in part.iter_batches():
                here = slice(done, done + len(batch))
                keys[here] = batch.column("key").to_numpy()
                for column, out in zip(self.columns, values):
                    out[here] = batch.column(column).to_numpy()
                done += len(batch)
        for x in (keys, *values):
            x.flush()

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys are in the table."""
        own, _ = self._map()
        if not len(own):
            return np.zeros(len(keys), bool)
        return own[np.minimum(np.searchsorted(own, keys), len(own) - 1)] == keys

    def get(self, keys: np.ndarray, column: int, default: float) -> np.ndarray:
        """The column's value at each key, or the default."""
        own, values = self._map()
        if not len(own) or not len(keys):
            return np.full(len(keys), default)
        asked, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
        return np.where(own[at] == asked, values[column][at].astype(np.float64), default)[back]
