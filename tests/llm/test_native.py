"""Sharding, quality rules and exact deduplication."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, quality, queries, sharding
from palimpsest.llm.shared import Workspace

WORD = r"[^\x20\x09-\x0D]+"


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_shards(spark, request, table):
    df = request.getfixturevalue(table)
    texts = Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    found = sharding.assign(df, queries.SHARD_TREE, spark).collect()
    wanted = Counter()
    for (k, t), n in texts.items():
        wanted[k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())] += n
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == wanted
    for shard in {r.shard for r in found}:
        assert 0 <= shard < 40
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    assert all(r.grown_shard in (r.shard, 40) and r.law == "key" for r in found)
    by_key = {}
    assert all(by_key.setdefault(r.doc_id, r.shard) == r.shard for r in found)


def test_shares_follow_weights_and_movement_is_confined(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "k")
    layout = [[[1, 1], [2]], [[4]]]
    heavier = [[[1, 1], [3]], [[4]]]
    before, after = sharding.HashTree.build(layout), sharding.HashTree.build(heavier)
    rows = keys.select(before.shard_of(F.col("k")).alias("a"), after.shard_of(F.col("k")).alias("b"), before.grown(2).shard_of(F.col("k")).alias("c")).collect()
    share = Counter(r.a for r in rows)
    for shard, weight in enumerate((1, 1, 2, 4)):
        assert abs(share[shard] / 40_000 - weight / 8) < 0.01
    assert all(r.a == r.b or r.b in (0, 1, 2) for r in rows)  # only into the subtree that grew
    assert all(r.a == r.b for r in rows if r.a == 2)
    assert all(r.c in (r.a, 4) for r in rows)
    with pytest.raises(ValueError):
        sharding.HashTree.build([[[0]]])
    with pytest.raises(ValueError):
        sharding.HashTree.build([])


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_quality(request, table):
    df = request.getfixturevalue(table)
    texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    for r in quality.measure(df).collect():
        t = texts[r.doc_id]
        w = re.findall(WORD, t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_rules_are_a_table(odd):
    strict = (quality.Rule("none", "n_words", "n_words", high=0.5),)
    assert quality.measure(odd, strict).where("kept").count() == 0
    assert quality.measure(odd, ()).where("kept").count() > 0


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_exact(spark, request, table):
    df = request.getfixturevalue(table)
    texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    groups = {}
    for k, t in texts:
        groups.setdefault(strip(t), []).append((-len(t), k is None, k or 0, k))
    found = exact_dedup.groups(df, spark).collect()
    assert Counter(r.doc_id for r in found) == Counter(k for k, _ in texts)
    sha = {hashlib.sha256(b.encode()).hexdigest(): (min(g)[3], len(g)) for b, g in groups.items()}
    assert all(sha[r.text_sha256] == (r.keep_id, r.group_size) for r in found)
    assert sum(r.kept for r in found) == len(groups) and all(r.doc_id == r.keep_id for r in found if r.kept)
    kept = exact_dedup.deduplicate(df, spark)
    assert kept.columns == df.columns and kept.count() == len(groups)


def test_chunks_join_to_the_text_and_move_with_it(spark):
    text = "abcde ther" * 700
    rows = spark.createDataFrame([(text,), ("inserted " + text,)], "t string").select(exact_dedup.chunks_of(F.col("t")).alias("c")).collect()
    assert ["".join(r.c) for r in rows] == [text, "inserted " + text]
    assert len(set(rows[0].c) & set(rows[1].c)) > 0


def test_colliding_fingerprints_are_told_apart(spark, tmp_path):
    pairs = [(1, "x" * 300 + "er" + "y" * 300), (2, "x" * 300 + "er" + "z" * 300), (3, "x" * 300 + "er" + "y" * 300), (4, "y" * 300)]
    path = f"{tmp_path}/c"
    spark.createDataFrame(pairs, "doc_id long, text string").write.parquet(path)
    same = lambda c: F.length(c).cast("long")
    rows = exact_dedup.recipes(spark.read.parquet(path), Workspace(spark, "test"), fingerprint=same).collect()
    recipe = {r.doc_id: tuple(r.recipe) for r in rows}
    assert recipe[1] == recipe[3] and len({recipe[1], recipe[2], recipe[4]}) == 3


def test_empty_tables(spark, empty):
    assert sharding.assign(empty, queries.SHARD_TREE, spark).count() == 0
    assert quality.measure(empty).count() == 0
    assert exact_dedup.groups(empty, spark).count() == 0
