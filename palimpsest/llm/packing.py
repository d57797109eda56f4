"""Packing of token sequences by bounded-space online best-fit.

Documents become ids plus an end id; only those longer than a sequence are cut, into full
pieces and a rest. Pieces arrive in any order at a packer, which holds a fixed number of
open bins in stacks by free space, with a bitset whose bit f says that a bin with f free
places is open. The lowest set bit at or above a piece's length is the best fit. If none fits, a bin
is opened; at the limit the fullest is closed first.

Ids are staged once and never shuffled: a packer gets lengths and checksums only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, lean, rows_in
from palimpsest.llm.tokenizing import KEPT_PIECES, WordEncoder, batches

SEQUENCE = 2048
END_ID = 0
OPEN_BINS = 1024
#: Pieces that one packer takes; with more, packers work side by side.
PIECES_PER_PACKER = 400_000

_PIECES = "row long, doc_id long, piece int, start long, length long, ids binary"
_PLACED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """The packer. ``add`` takes an item and yields bins that close; ``rest`` yields the open ones.

    A bin is the list of its items in order.
    """

    def __init__(self, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.limit = capacity, open_bins
        self._stacks: list[list[list]] = [[] for _ in range(capacity + 1)]
        self._open = 0
        self._bits = 0

    def _take(self, free: int) -> list:
        found = self._stacks[free].pop()
        if not self._stacks[free]:
            self._bits &= ~(1 << free)
        self._open -= 1
        return found

    def add(self, length: int, item) -> Iterator[list]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"an item of {length} does not fit")
        fitting = self._bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            if self._open == self.limit:
                yield self._take((self._bits & -self._bits).bit_length() - 1)
            free, chosen = self.capacity, []
        chosen.append(item)
        free -= length
        if not free:
            yield chosen
            return
        self._stacks[free].append(chosen)
        self._bits |= 1 << free
        self._open += 1

    def rest(self) -> Iterator[list]:
        while self._bits:
            yield self._take((self._bits & -self._bits).bit_length() - 1)


def tokenize(docs: DataFrame, tokenizer: str, text: str = "text", end_id: int = END_ID, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces of every row: ``row, doc_id, piece, start, length, ids``.

    Null text counts as empty and gives one piece, the end id alone. ``ids`` are little-endian
    unsigned 32-bit integers.
    """
    end = end_id.to_bytes(4, "little")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(tokenizer, drops_space=True)
        for table in tables:
            rows, keys, texts = (table.column(i).to_pylist() for i in range(3))
            for a, b in batches(texts):
                out = []
                for row, key, ids in zip(rows[a:b], keys[a:b], encoder.encode(texts[a:b])):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * sequence)):
                        part = ids[at : at + 4 * sequence]
                        out.append((row, key, n, at // 4, len(part) // 4, part))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                names = ("row", "doc_id", "piece", "start", "length", "ids")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=list(names))
        encoder.forget(KEPT_PIECES)

    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return narrow.mapInArrow(lean(run), _PIECES)


def place(pieces: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Sequences for all rows of ``pieces`` (a stored table with tokenize's columns and
    ``ids_crc32`` for ``ids``): those columns, ``sequence_id`` and ``offset``."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = BestFit(sequence, open_bins)
        sequence_id = TaskContext.get().partitionId() << 40
        schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in [x.split()[0] for x in _PLACED.split(", ")]])
        out: list[tuple] = []

        def close(items: list[tuple]) -> None:
            nonlocal sequence_id
            offset = 0
            for item in items:
                out.append((*item, sequence_id, offset))
                offset += item[4]
            sequence_id += 1

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return found

        for item in (item for table in tables for item in zip(*(c.to_pylist() for c in table.columns))):
            for closed in packer.add(item[4], item):
                close(closed)
            if len(out) >= 20_000:
                yield flush()
        for closed in packer.rest():
            close(closed)
        if out:
            yield flush()

    packers = max(1, -(-rows_in(pieces) // per_packer))
    return pieces.repartition(packers).mapInArrow(lean(run), _PLACED)


def pack(docs: DataFrame, spark: SparkSession, tokenizer: str, text: str = "text") -> DataFrame:
    """Places for all rows of ``docs``: ``row, doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``, one row per piece.

    Every row is packed, repeated ones too; null and empty texts are the end id alone; null
    ids are carried along; an empty table gives no rows; other columns are not read.
    """
    return packed(docs, spark, tokenizer, text)[0]


def packed(docs: DataFrame, spark: SparkSession, tokenizer: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``pack``'s places, and the stored pieces with their ids."""
    work = Workspace(spark, "packing")
    pieces = work.stage(tokenize(docs, tokenizer, text), "pieces")
    narrow = work.stage(pieces.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "lengths")
    # Arrivals come in any order, so one packing is written and everybody reads that one.
    places = work.stage(place(narrow), "places")
    work.drop("lengths")
    return places, pieces


def sequences(places: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, n_tokens, ids``; a sequence holds
    at most 2048 ids, so its pieces may be gathered."""
    both = places.select("row", "piece", "sequence_id", "offset").join(pieces.select("row", "piece", "length", "ids"), ["row", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids")
    )
