"""Packing, byte-level BPE and token files, against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import byte_bpe, packing, token_files
from palimpsest.llm.tokenizing import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library(path, texts):
    t = Tokenizer.from_file(path)
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def pack32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("path, drops", [(BYTES, False), (WORDS, True)])
def test_encoder_is_the_library(path, drops):
    rng = random.Random(3)
    alphabet = "ab'sStre SİΣσςé é  \n\t\x00\x1c\x85\xa0　3½١!?.<|>ǅ́​א中😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + ["", " ", "<|endoftext|>", "a <|endoftext|> b"]
    encoder = WordEncoder(path, drops, cache_pieces=500)
    for a in range(0, len(texts), 100):
        assert encoder.encode(texts[a : a + 100]) == [pack32(x) for x in library(path, texts[a : a + 100])]


def test_vocabulary_is_encoded_like_the_library():
    for path, drops in ((BYTES, False), (WORDS, True)):
        t = Tokenizer.from_file(path)
        tokens = [t.decode([i]) for i in range(0, t.get_vocab_size() - 2, 7)]
        words = [a.strip() + b.strip() for a, b in zip(tokens, tokens[3:])]
        assert WordEncoder(path, drops).encode(words) == [pack32(x) for x in library(path, words)]


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing(spark, request, table):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text").collect()
    wanted = Counter()
    for r, ids in zip(rows, library(WORDS, [r.text or "" for r in rows])):
        ids = [*ids, 0]
        for n, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            wanted[r.doc_id, n, a, len(part), zlib.crc32(pack32(part))] += 1
    places, pieces = packing.packed(df, spark, WORDS)
    found = places.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.1 * sum(r.length for r in found) / 2048 + 1
    whole = packing.sequences(places, pieces).collect()
    assert len(whole) == len(bins) and all(len(r.ids) == 4 * r.n_tokens for r in whole)


def test_best_fit_bounds_its_bins():
    packer, closed, rng = packing.BestFit(100, 5), [], random.Random(1)
    items = [rng.randint(1, 60) for _ in range(2000)] + [100]
    for i, n in enumerate(items):
        closed += packer.add(n, (i, n))
        assert packer._open <= 5
    closed += packer.rest()
    assert sorted(i for b in closed for i, _ in b) == list(range(len(items))) and max(sum(n for _, n in b) for b in closed) <= 100
    tight = packing.BestFit(100, 3)
    assert not [*tight.add(60, "a"), *tight.add(50, "b"), *tight.add(45, "c")]  # c goes to b, the fuller fit
    assert [sorted(b) for b in tight.add(5, "d")] == [["b", "c", "d"]]
    with pytest.raises(ValueError):
        list(packer.add(101, "x"))


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_byte_bpe(spark, request, table):
    df = request.getfixturevalue(table)
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    wanted = Counter((r.doc_id, pack32(encoding.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in df.select("doc_id", "text").collect())
    for both in (byte_bpe.encode(df, spark, RANKS, public_tokenizers.PATTERN, decoded=True), byte_bpe.decode(byte_bpe.encode(df, spark, RANKS, public_tokenizers.PATTERN), RANKS)):
        found = both.collect()
        assert Counter((r.doc_id, bytes(r.ids), bytes(r.text_bytes)) for r in found) == wanted and all(len(r.ids) == 4 * r.n_tokens for r in found)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_token_files(spark, request, table, monkeypatch):
    monkeypatch.setattr(token_files, "IDS_PER_FILE", 20_000)
    monkeypatch.setattr(token_files, "SAMPLE_ROWS", 500)
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text").collect()
    wanted = Counter((r.doc_id, pack32([*ids, 2])) for r, ids in zip(rows, library(BYTES, [r.text or "" for r in rows])))
    manifest, folder, dictionary = token_files.write(df, spark, BYTES)
    found = token_files.read(manifest, folder, dictionary).orderBy("start").collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == wanted
    at = 0
    for r in found:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert keys == sorted(keys)
    one = manifest.orderBy("shard").first()
    with token_files.TokenFile(f"{folder}/{one.name}", dictionary) as f:
        assert len(f) == one.n_docs and f.document(len(f) - 1) == bytes(found[len(f) - 1].ids)
    with pytest.raises(ValueError, match="dictionary"):
        token_files.TokenFile(f"{folder}/{one.name}", dictionary + b"x")


def test_empty_tables(spark, empty):
    assert packing.pack(empty, spark, WORDS).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(empty, spark, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    assert token_files.read(*token_files.write(empty, spark, BYTES)).count() == 0


def test_digests_come_from_the_ids(spark, docs):
    found = byte_bpe.encode(docs.limit(3), spark, RANKS, public_tokenizers.PATTERN).select("ids", F.sha2("ids", 256).alias("h")).collect()
    assert all(hashlib.sha256(bytes(r.ids)).hexdigest() == r.h for r in found)
