"""Language identification, toxicity, and the pipeline."""

import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from palimpsest.llm import language, near_dedup, queries, toxicity
from palimpsest.llm.hashing import hash_words

MIDDLE = "/root/testdata/sf0.01"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 12])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    assert code.shape[0] == n and all((code[i] != code[j]).sum() >= min(2, code.shape[1]) for i in range(n) for j in range(i))


def test_languages(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = queries.op2_ecoc_language(spark, MIDDLE).collect()
    assert len(found) == len(lang) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in found)
    right = [r.lang_pred == lang[r.doc_id] for r in found if r.held_out]
    assert np.mean(right) > 0.97


def test_languages_of_odd_texts(spark, odd, empty):
    model = language.train(odd)
    assert model.languages == ("en", "fr")
    found = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].ambiguous for i in (1, 2, 3)) and found[8].lang_pred == "fr"
    none = language.train(empty)
    assert none.languages == () and {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_whole_texts_count(spark):
    model = language.fit([b"the and of the with", b"der die das und mit"] * 20, ["en", "de"] * 20)
    long = spark.createDataFrame([(1, "the and of " * 10 + "der die und mit " * 500)], "doc_id long, text string")
    assert language.predict(long, model).first().lang_pred == "de"


def test_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    found = queries.op8_kneser_ney_toxicity(spark, MIDDLE).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id) for r in found)
    out = [r for r in found if r.held_out and r.doc_id in labels]
    toxic, clean = [[r.score for r in out if labels[r.doc_id] == t] for t in (1, 0)]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.7 and np.mean([s < 0.3 for s in clean]) > 0.9


def test_toxicity_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(10, 1), (11, 0), (12, None), (None, 1), (10, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    found = toxicity.score(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    blank = {r.score for r in found if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1
    none = toxicity.train(empty, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.5}
    assert toxicity.score(empty, model).count() == 0


def test_word_hashes():
    data = np.frombuffer(b"one two one  three", np.uint8)
    hashes, at = hash_words(data, data != 32)
    assert at.tolist() == [0, 4, 8, 13] and hashes[0] == hashes[2] and len(set(hashes.tolist())) == 3


def test_registry():
    names = entry.queries()
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline(spark):
    """Stages against what each must do with its own input."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        path = f"{corpus_pipeline.Workspace(spark, 'test').root}/{name}"
        after.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        before = after
    assert near_dedup.near_duplicates(before, spark).where("NOT kept").count() == 0
    places = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in places.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
