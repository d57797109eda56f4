"""Token ids in binary files with a shared zstandard dictionary.

A shard file holds documents in ascending order, each its own zstandard frame, then
the index, then a fixed footer. One dictionary, trained on a bounded sample of serialized id
arrays, serves all shards; each footer keeps its hash, so a file is never read
with another one. Any document opens with one index lookup and one short read.

Layout, little-endian: frames | index: for each document doc_id int64, null flag uint8 padded to
int64, frame offset uint64, ids before it in the file uint64 | footer: documents uint64, ids uint64,
index offset uint64, dictionary SHA-256 (32 bytes), magic (8 bytes).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, lean, qualified
from palimpsest.llm.tokenizing import KEPT_PIECES, WordEncoder, batches

END_ID = 2
MAGIC = b"PLMPTOK1"
#: The dictionary and its sample: rows, and bytes of each row. They bear on sizes only.
DICTIONARY_BYTES = 64 * 1024
SAMPLE_ROWS = 2_000
SAMPLE_ROW_BYTES = 16 * 1024
#: Ids that a shard file is meant to hold.
IDS_PER_FILE = 4_000_000

_FOOTER = "<QQQ32s8s"
_FOOTER_BYTES = struct.calcsize(_FOOTER)
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("offset", "<u8"), ("before", "<u8")])
_MANIFEST = "shard int, name string, n_docs long, n_tokens long, n_bytes long"
_READ = "doc_id long, shard int, start long, n_tokens long, ids binary"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class TokenFile:
    """A shard file open for reading."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        import zstandard

        system, path = _filesystem(uri)
        self._file = system.open_input_file(path)
        size = self._file.size()
        docs, self.n_tokens, at, digest, magic = struct.unpack(_FOOTER, self._file.read_at(_FOOTER_BYTES, size - _FOOTER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.index = np.frombuffer(self._file.read_at(docs * _INDEX.itemsize, at), _INDEX)
        self._ends = np.append(self.index["offset"][1:], np.uint64(at)).astype("u8")
        used = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._unpack = zstandard.ZstdDecompressor(dict_data=used)

    def __len__(self) -> int:
        return len(self.index)

    def __enter__(self) -> "TokenFile":
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def document(self, i: int) -> bytes:
        start = int(self.index["offset"][i])
        return self._unpack.decompress(self._file.read_at(int(self._ends[i]) - start, start))

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """Key, ids before it in the file, and ids of each document, read in order."""
        self._file.seek(0)
        for entry, end in zip(self.index, self._ends):
            ids = self._unpack.decompress(self._file.read(int(end) - int(entry["offset"])))
            yield None if entry["null"] else int(entry["doc_id"]), int(entry["before"]), ids


def write_file(uri: str, docs: Iterator[tuple[int | None, bytes]], dictionary: bytes, level: int = 3) -> tuple[int, int, int]:
    """Write documents in the order given; returns documents, ids and bytes.

    A task that is run again, or twice at once, must write under another name each time; readers take the
    name that the manifest has.
    """
    import zstandard

    used = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=used)
    system, path = _filesystem(uri)
    index, at, before = [], 0, 0
    with system.open_output_stream(path) as out:
        for key, ids in docs:
            frame = packer.compress(ids)
            index.append((key or 0, key is None, at, before))
            out.write(frame)
            at += len(frame)
            before += len(ids) // 4
        packed = np.array(index, _INDEX).tobytes()
        out.write(packed)
        out.write(struct.pack(_FOOTER, len(index), before, at, hashlib.sha256(dictionary).digest(), MAGIC))
    return len(index), before, at + len(packed) + _FOOTER_BYTES


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, packed`` of every row, end id included; null text counts as empty. ``packed`` are the ids,
    compressed without a dictionary, so that sorting them moves little."""
    end = end_id.to_bytes(4, "little")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, pack = WordEncoder.shared(tokenizer, drops_space=False), zstandard.ZstdCompressor(level=1).compress
        for table in tables:
            keys, texts = table.column(0), table.column(1).to_pylist()
            for a, b in batches(texts):
                ids = [x + end for x in encoder.encode(texts[a:b])]
                lengths = pa.array([len(x) // 4 for x in ids], pa.int64())
                packed = pa.array([pack(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lengths, packed], names=["doc_id", "n_tokens", "packed"])
        encoder.forget(KEPT_PIECES)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return narrow.mapInArrow(lean(run), "doc_id long, n_tokens long, packed binary")


def train_dictionary(encoded: DataFrame) -> bytes:
    """A dictionary from at most SAMPLE_ROWS rows of at most SAMPLE_ROW_BYTES packed bytes each, the first by a hash.
    Too small a sample gives none (empty bytes)."""
    import zstandard

    short = encoded.where(F.octet_length("packed") <= SAMPLE_ROW_BYTES)
    hashed = short.select(F.xxhash64("doc_id", "n_tokens").alias("h"), "packed")
    # First the hashes alone: tasks that each returned so many rows of ids would flood the driver.
    last = hashed.select("h").orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    rows = hashed.where(F.col("h") <= last).limit(SAMPLE_ROWS).collect() if last is not None else []
    unpack = zstandard.ZstdDecompressor().decompress
    sample = [unpack(bytes(r.packed)) for r in sorted(rows)]
    if len(sample) < 64 or sum(map(len, sample)) < 8 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()


def write(docs: DataFrame, spark: SparkSession, tokenizer: str, text: str = "text", end_id: int = END_ID) -> tuple[DataFrame, str, bytes]:
    """Write all rows of ``docs``; returns the manifest, the files' folder and the dictionary.

    Rows are in ascending doc_id order, null first, equal ids by their tokens. Null and empty
    texts are the end id alone; repeated rows are written as often as they come; an empty
    table writes no file.
    """
    work = Workspace(spark, "tokens")
    encoded = work.stage(encode(docs, tokenizer, end_id, text), "encoded")
    dictionary = train_dictionary(encoded)
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    files = max(1, -(-total // IDS_PER_FILE))
    folder = qualified(spark, work.path("files"))
    system, path = _filesystem(folder)
    system.create_dir(path)
    with system.open_output_stream(f"{path}/dictionary.zstd") as out:
        out.write(dictionary)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        unpack = zstandard.ZstdDecompressor().decompress
        shard = TaskContext.get().partitionId()
        first = next(tables, None)
        if first is None:
            return

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for table in chain([first], tables):
                for at in range(0, len(table), 1000):
                    part = table.slice(at, 1000)
                    yield from zip(part.column(0).to_pylist(), map(unpack, part.column(1).to_pylist()))

        # A name for each try: only the one that the committed manifest has is ever read.
        name = f"shard-{shard:05d}-{uuid.uuid4().hex}.bin"
        made = write_file(f"{folder}/{name}", rows(), dictionary)
        if made[0]:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["shard", "name", "n_docs", "n_tokens", "n_bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((shard, name, *made), kinds)], names=names)

    # Equal ids may be many, so the ranges go by the tokens too.
    ordered = encoded.select("doc_id", "packed", F.xxhash64("packed").alias("tie")).repartitionByRange(files, "doc_id", "tie")
    ordered = ordered.sortWithinPartitions("doc_id", "tie", "packed").select("doc_id", "packed")
    manifest = work.stage(ordered.mapInArrow(lean(run), _MANIFEST), "manifest")
    work.drop("encoded")
    return manifest, folder, dictionary


def read(manifest: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """All documents of the files: ``doc_id, shard, start, n_tokens, ids``, with ``start`` the
    ids of all documents before it in all files."""

    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for shard, name, first in zip(*(c.to_pylist() for c in table.columns)):
                with TokenFile(f"{folder}/{name}", dictionary) as found:
                    out, size = [], 0
                    for key, before, ids in found.documents():
                        out.append((key, shard, first + before, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    # The manifest has a row a file, so its running sum is small whatever the corpus; it goes to the readers with the names.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", "name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    return files.repartition(max(1, manifest.count())).mapInArrow(lean(run), _READ)
