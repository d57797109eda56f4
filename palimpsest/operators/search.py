"""Inverted-index search over metadata and chunked text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalar import number_term, tokens

CHUNK_BYTES = 256
SNIPPET_CHARS = 120


def chunk(text: str, limit: int = CHUNK_BYTES) -> list[str]:
    """Greedy chunks of at most ``limit`` UTF-8 bytes; no character is split."""
    data, out, start = text.encode(), [], 0
    while start < len(data):
        end = min(len(data), start + limit)
        while end < len(data) and end > start and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == start:
            raise ValueError("a character does not fit in a chunk")
        out.append(data[start:end].decode())
        start = end
    return out


def chunks(docs: DataFrame, key: str, text: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """``key, chunk_index, chunk``. In ASCII texts bytes are characters, and a pattern cuts them; a byte budget over wider
    characters has no built-in form, so those texts go through Arrow."""
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for at in range(0, len(table), 256):
                part = table.slice(at, 256)
                rows = [(k, i, c) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for i, c in enumerate(chunk(t, limit))]
                types = (part.schema.field(0).type, pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "chunk_index", "chunk"])

    narrow_only = F.octet_length("text") == F.char_length("text")
    plain = narrow.where(narrow_only).select("key", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{limit}}}"), F.lit(0))).alias("chunk_index", "chunk"))
    wide = narrow.where(~narrow_only).mapInArrow(run, f"key {kind}, chunk_index int, chunk string")
    return plain.unionByName(wide).select(F.col("key").alias(key), "chunk_index", "chunk")


def postings(rows: DataFrame, key: list[str], text: str, terms: list[str] | None = None) -> DataFrame:
    """``term`` and key, once for each distinct term of a row; only of ``terms``, if given, so that a query makes no rows of the rest."""
    found = tokens(F.col(text))
    if terms is not None:
        found = F.array_intersect(found, F.array(*[F.lit(t) for t in sorted(set(terms))]))
    return rows.select(*key, F.explode(found).alias("term"))


def index_terms(catalog: DataFrame, key: str, metadata: dict[str, Column], numbers: dict[str, Column], tags: Column, parts: DataFrame) -> DataFrame:
    """The search index: ``term, kind`` and key, once each, from exact metadata values (canonical JSON), numbers (zero-padded), tags (an array)
    and the tokens of text chunks ``parts`` (key, chunk)."""
    exact = F.array(*[F.concat(F.lit(f"{n}:"), F.lower(F.to_json(F.struct(c.alias("v"))))) for n, c in sorted(metadata.items())])
    padded = F.array(*[number_term(n, c) for n, c in sorted(numbers.items())])
    out = parts.select(key, F.explode(tokens(F.col("chunk"))).alias("term")).withColumn("kind", F.lit("text"))
    for kind, terms in (("metadata", exact), ("number", padded), ("tag", F.transform(tags, lambda t: F.concat(F.lit("tag:"), F.lower(t))))):
        one = catalog.select(key, F.explode(F.filter(terms, lambda t: t.isNotNull())).alias("term")).withColumn("kind", F.lit(kind))
        out = out.unionByName(one)
    return out.distinct()


def matches_all(index: DataFrame, key: list[str], terms: list[str], among: DataFrame | None = None) -> DataFrame:
    """Keys that have all terms. Without terms every key of ``among`` matches."""
    wanted = sorted(set(terms))
    if not wanted:
        return among.select(*key).distinct()
    hits = index.where(F.col("term").isin(wanted)).groupBy(*key).agg(F.count_distinct("term").alias("n"))
    return hits.where(F.col("n") == len(wanted)).select(*key)


def fetch(ids: DataFrame, catalog: DataFrame, key: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Catalog rows of the ids; ids without a row are skipped."""
    found = catalog.join(ids, key, "left_semi").orderBy(*order)
    return found if limit is None else found.limit(limit)


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, chars)


def snippets(parts: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """The snippet of each key's first chunk that contains all terms."""
    fits = F.lit(True)
    for term in terms:
        fits = fits & F.contains(F.lower("chunk"), F.lit(term.lower()))
    first = parts.where(fits).groupBy(key).agg(F.min_by("chunk", "chunk_index").alias("chunk"))
    return first.select(key, snippet(F.col("chunk")).alias("snippet"))


def blob_filter(prefix: str | None = None, content_type: str | None = None, tags: dict | None = None, metadata: dict | None = None, size: tuple | None = None, created: tuple | None = None) -> Column:
    """The conjunction of a catalog query; ranges are inclusive."""
    out = F.lit(True)
    if prefix is not None:
        out = out & F.col("alias").startswith(prefix)
    if content_type is not None:
        out = out & (F.col("content_type") == content_type)
    for column, wanted in (("tags", tags), ("metadata", metadata)):
        for name, value in (wanted or {}).items():
            out = out & (F.col(column).getItem(name) == F.lit(value))
    for column, bounds in (("size_bytes", size), ("created_at", created)):
        for at, below in zip(bounds or (None, None), (False, True)):
            if at is not None:
                out = out & ((F.col(column) <= at) if below else (F.col(column) >= at))
    return out
