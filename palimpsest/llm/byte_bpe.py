"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are cut into pre-tokens, the matches of the tokenizer's pattern. Their positions are not
shuffled one by one: a block of documents numbers its distinct pre-tokens, so the
exploded positions become a stream of numbers beside a word list. The stream stays in a file of the
shared folder; the words go to the global shuffle, dealt by their hash and packed by block and
bucket. All copies of a word meet in one task, which encodes it once. The ids come back to their
block in the words' order, and every document is reassembled by position. Decoding joins the ids
with the token-byte table.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, hand_back, lean, qualified, system_memory
from palimpsest.llm.tokenizing import _LOOSE_SPACE, _PIECE, batches

#: Characters of a block of documents; a longer document is a block of its own.
BLOCK_CHARS = 8_000_000
#: Pieces whose cut into pre-tokens, and words whose ids, a task remembers.
KNOWN_PIECES = 150_000
KNOWN_WORDS = 200_000

_BLOCKS = "block string, bucket int, words binary"
_ENCODED = "block string, bucket int, ids binary"
_DOCS = "doc_id long, n_tokens long, ids binary"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _cut(text: str) -> list[str]:
    """The text in pieces that no pre-token crosses; see ``tokenizing``."""
    if _LOOSE_SPACE.search(text):
        return _PIECE.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def number_words(texts: list[str], pattern) -> tuple[list[str], list[bytes]]:
    """The distinct pre-tokens of some texts, and each text as int32 numbers of them."""
    numbers: dict[str, int] = {}
    known: dict[str, bytes] = {}
    streams = []
    for text in texts:
        pieces = _cut(text) if text else []
        if len(known) > KNOWN_PIECES:
            known.clear()
        for piece in set(pieces).difference(known):
            found = [numbers.setdefault(word, len(numbers)) for word in pattern.findall(piece)]
            known[piece] = np.array(found, "<i4").tobytes()
        streams.append(b"".join(map(known.__getitem__, pieces)))
    return list(numbers), streams


def _pack(parts: list[bytes]) -> bytes:
    """Byte strings as one: their number, their lengths, themselves; compressed."""
    import zstandard

    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unpack(packed: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate(([4 + 4 * n], ends[:-1])) if n else ends
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _write(folder: str, name: str, data: bytes) -> None:
    system, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
    with system.open_output_stream(path) as out:
        out.write(data)


def _read(folder: str, name: str) -> bytes:
    system, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
    with system.open_input_file(path) as found:
        return found.read()


def _blocks(docs: DataFrame, text: str, pattern: str, folder: str, buckets: int) -> DataFrame:
    """Writes the streams of all blocks; returns their words by bucket."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard
        from pyspark import TaskContext

        compiled = regex.compile(pattern)
        task = TaskContext.get().partitionId()
        for table in tables:
            keys, texts = table.column(0).to_pylist(), table.column(1).to_pylist()
            for a, b in batches(texts, BLOCK_CHARS):
                words, streams = number_words(texts[a:b], compiled)
                encoded = [w.encode() for w in words]
                of = np.array([zlib.crc32(w) % buckets for w in encoded], np.int64)
                # By bucket, in order of the words: neighbours are alike and pack well.
                order = np.array(sorted(range(len(words)), key=encoded.__getitem__), np.int64)
                order = order[np.argsort(of[order], kind="stable")]
                place = np.empty(len(words), "<i4")
                place[order] = np.arange(len(words), dtype="<i4")
                numbers = place[np.frombuffer(b"".join(streams), "<i4")]
                # The bytes of the numbers one plane after another: high bytes hardly vary and pack well.
                planes = np.frombuffer(numbers.tobytes(), np.uint8).reshape(-1, 4).T.tobytes()
                nulls = [k is None for k in keys[a:b]]
                head = [np.array([k or 0 for k in keys[a:b]], "<i8").tobytes(), np.array(nulls, np.uint8).tobytes(), np.array([len(s) // 4 for s in streams], "<i8").tobytes()]
                # A name for each try: only those that the committed table of words has are ever read.
                block = f"{task:06d}-{uuid.uuid4().hex}"
                _write(folder, block, _pack([*head, zstandard.ZstdCompressor(level=3).compress(planes)]))
                bounds = np.searchsorted(of[order], np.arange(buckets + 1))
                some = [i for i in range(buckets) if bounds[i] < bounds[i + 1] or i == 0]
                packed = [_pack([encoded[j] for j in order[bounds[i] : bounds[i + 1]]]) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some)), pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["block", "bucket", "words"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return narrow.mapInArrow(lean(run), _BLOCKS)


def _encode_words(words: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``words``, dealt by bucket, with ids for each word in the place of the word."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})._core_bpe.encode_ordinary
        known: dict[bytes, bytes] = {}
        for table in tables:
            out = []
            for packed in table.column(2).to_pylist():
                found = _unpack(packed)
                if len(known) > KNOWN_WORDS:
                    known.clear()
                for word in found:
                    if word not in known:
                        known[word] = array("I", encode(word.decode())).tobytes()
                out.append(_pack([known[word] for word in found]))
            yield pa.RecordBatch.from_arrays([table.column(0), table.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])

    return words.mapInArrow(lean(run), _ENCODED)


def _token_bytes(ranks: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    found = load_ranks(ranks)
    table = [b""] * (max(found.values(), default=-1) + 1)
    for token, rank in found.items():
        table[rank] = token
    return table


def _reassemble(folder: str, ranks: str | None):
    tables: list[list[bytes]] = []

    def run(table: pa.Table) -> pa.Table:
        """One block: the ids of its words, by bucket, for the documents of its stream."""
        import zstandard

        system_memory()
        packed = sorted(zip(table.column("bucket").to_pylist(), table.column("ids").to_pylist()))
        parts = [ids for _, x in packed for ids in _unpack(x)]
        keys, nulls, lengths, planes = _unpack(_read(folder, table.column("block")[0].as_py()))
        numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(planes), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
        out, at = [], 0
        for length in np.frombuffer(lengths, "<i8").tolist():
            out.append(b"".join(map(parts.__getitem__, numbers[at : at + length].tolist())))
            at += length
        del parts, numbers, packed
        ids = pa.array(np.frombuffer(keys, "<i8"), pa.int64(), mask=np.frombuffer(nulls, np.uint8).astype(bool))
        columns = {"doc_id": ids, "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64()), "ids": pa.array(out, pa.binary())}
        if ranks is not None:
            if not tables:
                tables.append(_token_bytes(ranks))
            columns["text_bytes"] = pa.array([_decoded(x, tables[0]) for x in out], pa.binary())
        del out
        hand_back()
        return pa.table(columns)

    return run


def _decoded(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, spark: SparkSession, ranks: str, pattern: str, decoded: bool = False, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row; ids are little-endian unsigned 32-bit integers. ``decoded`` adds ``decode``'s
    ``text_bytes``, where the documents are put together.

    Null and empty texts have no ids; very long texts are a block of their own; repeated rows are encoded each; an empty table gives no
    rows; other columns are not read.
    """
    work = Workspace(spark, "bpe")
    folder = qualified(spark, work.path("streams"))
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = work.stage(_blocks(docs, text, pattern, folder, buckets), "words")
    encoded = _encode_words(words.repartition(buckets, "bucket"), ranks, pattern)
    # Blocks hold a bounded amount of text, so a block is a group that fits one task.
    schema = f"{_DOCS}, text_bytes binary" if decoded else _DOCS
    return encoded.groupBy("block").applyInArrow(_reassemble(folder, ranks if decoded else None), schema)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` with ``text_bytes``, the joined bytes of its ids; of null ids, null. The token-byte table is the
    vocabulary, a file of fixed size, and is read once a task. Columns besides ``encode``'s are not read; an empty table gives no rows."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_bytes = _token_bytes(ranks)
        for table in tables:
            out = [None if x is None else _decoded(x, table_bytes) for x in table.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(out, pa.binary())], names=[*table.schema.names, "text_bytes"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(lean(run), f"{_DOCS}, text_bytes binary")
