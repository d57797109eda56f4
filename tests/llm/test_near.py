"""Near-duplicate documents and lines, and components, against brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, line_dedup, near_dedup
from palimpsest.llm.components import components
from palimpsest.llm.shared import Workspace, spread_join


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def add(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(a, b):
    shared = len(a & b)
    return bool(a) and bool(b) and 100 * shared >= 75 * (len(a) + len(b) - shared)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_documents(spark, request, table):
    df = request.getfixturevalue(table).where("doc_id IS NOT NULL")
    sets = {r.doc_id: shingles(r.text) for r in df.select("doc_id", "text").collect()}
    union = Union()
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            if linked(sets[a], sets[b]):
                union.add(a, b)
    found = near_dedup.near_duplicates(df, spark).collect()
    assert len(found) == df.count()
    for r in found:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), union.find(r.doc_id))
        assert r.kept == (r.doc_id == r.component_id)


def test_hot_lists_are_compared_whole(spark, odd, monkeypatch):
    """With every shared value hot and no star round, blocks alone must find the same components."""
    df = odd.where("doc_id >= 10")
    wanted = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df, spark).collect()}
    monkeypatch.setattr(near_dedup, "HOT", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df, spark).collect()} == wanted


def test_null_ids_and_filter(spark, odd, empty):
    found = near_dedup.near_duplicates(odd, spark).where("doc_id IS NULL").collect()
    assert len(found) == 2 and all(r.kept and r.component_id is None for r in found)
    kept = near_dedup.deduplicate(odd, spark)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[6] == 1 and ids[10] == 1 and ids[11] == 0 and ids[None] == 1 and all(ids[i] for i in (1, 2, 3, *range(40, 120)))
    assert near_dedup.near_duplicates(empty, spark).count() == 0


def line_groups(spark, rows):
    """Of (doc_id, text) rows, each line's place and its component, by sets of five characters."""
    lines = {}
    for key, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            body = line.strip(" \t\n\x0b\x0c\r").lower()
            if body:
                lines[key, i] = frozenset(body[j : j + 5] for j in range(max(1, len(body) - 4)))
    union = Union()
    names = sorted(lines)
    for i, a in enumerate(names):
        for b in names[:i]:
            if linked(lines[a], lines[b]):
                union.add(a, b)
    return lines, union


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_lines(spark, request, table, empty):
    df = request.getfixturevalue(table).where("doc_id IS NOT NULL AND doc_id < 60")
    lines, union = line_groups(spark, [(r.doc_id, r.text) for r in df.select("doc_id", "text").distinct().collect()])
    found = line_dedup.near_lines(df, spark).collect()
    for r in found:
        at = (r.doc_id, r.line_no)
        assert (r.component_doc, r.component_line) == (union.find(at) if at in lines else at)
    assert sum(r.kept for r in found if (r.doc_id, r.line_no) in lines) == len({union.find(x) for x in lines})
    assert line_dedup.near_lines(empty, spark).count() == 0


def test_hot_bands_are_compared_whole(spark, odd, monkeypatch):
    """With every shared band hot and no leader, cells of small blocks alone find the same components."""
    df = odd.where("doc_id >= 10")
    wanted = {(r.doc_id, r.line_no, r.component_doc, r.component_line) for r in line_dedup.near_lines(df, spark).collect()}
    monkeypatch.setattr(near_dedup, "HOT", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    assert {(r.doc_id, r.line_no, r.component_doc, r.component_line) for r in line_dedup.near_lines(df, spark).collect()} == wanted


def test_lines_dropped_by_row(spark):
    """Rows with no id, or with one id, each lose the lines that another one keeps, and no other."""
    one, other, third = ("".join(chr(97 + (i * k) % 26) for i in range(40)) for k in (3, 5, 7))
    rows = [(None, f"{one}\n{other}"), (None, f"{third}\n{other}!"), (4, f"{one}\nalone in here"), (4, third), (5, None), (6, ""), (7, "\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __row string").coalesce(1)
    kept = line_dedup.deduplicate(df, spark)
    assert kept.columns == df.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert found == Counter([(None, other), (None, ""), (4, f"{one}\nalone in here"), (4, third), (5, None), (6, ""), (7, "\n")])
    assert line_dedup.deduplicate(df.limit(0), spark).count() == 0


def test_unrelated_documents_stay(spark):
    """Documents without ids, and different ones under one id, are no copies of each other."""
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (6, texts[3]), (6, texts[4]), (None, texts[2]), (7, texts[0])]
    kept = near_dedup.deduplicate(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, __row int"), spark)
    assert kept.columns == ["doc_id", "text", "__row"]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(7, texts[0]), (None, texts[1]), (None, texts[2]), (6, texts[3]), (6, texts[4])])


@pytest.mark.parametrize("drop", [near_dedup.deduplicate, exact_dedup.deduplicate, line_dedup.deduplicate])
def test_rows_are_the_same_however_files_are_split(spark, tmp_path, drop):
    """Rows without ids, whose files are split in another way when they are read again."""
    rows = [(None, " ".join(f"w{i % 40}x{j}" for j in range(20))) for i in range(400)]
    path = f"{tmp_path}/d"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 4096).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        kept = drop(spark.read.parquet(path), spark)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        assert Counter(r.text for r in kept.collect() if r.text) == Counter({t for _, t in rows})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_hub_is_joined_by_broadcast(spark, monkeypatch):
    """Keys that hold more than their share of the rows meet them without a shuffle, with the same result."""
    left = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(5000)], "k long, v long")
    right = left.groupBy("k").count().withColumn("w", F.col("k") * 2)
    found = spread_join(left, right, "k", "count", 5000)
    assert {(r.k, r.v, r.w) for r in found.collect()} == {(0 if i % 2 else i, i, 0 if i % 2 else 2 * i) for i in range(5000)}
    assert found.columns == ["k", "v", "w"]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    found = components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test"), "c").collect()
    got = {r.node: r.component for r in found}
    assert len(found) == len(got) and all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == 299
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test"), "e").count() == 0


def test_sketch_bound():
    assert near_dedup._least(64) >= 20
