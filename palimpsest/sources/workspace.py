"""A shared folder for tables that a query writes on its way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name under ``spark.checkpoint.dir``; a session on one machine that leaves that unset gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='palimpsest-core-')}")
        root = _own[0]
    return f"{root.rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex}"
