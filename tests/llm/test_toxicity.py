"""What the toxicity models count."""

import random
import zlib

from palimpsest.llm import toxicity
from palimpsest.llm.shared import Workspace
from palimpsest.llm.tables import Table


def usable(n):
    """Ids that are not held out."""
    return [i for i in range(1, 2 * n) if zlib.crc32(str(i).encode()) % 4 != 2][:n]


def scores(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(rows, model).collect()}
    return [found[i] for i in range(len(texts))]


def tables(spark, rows):
    docs = spark.createDataFrame([(i, text) for i, text, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, toxic) for i, _, toxic in rows], "doc_id long, toxic int")


def test_only_the_sample_is_not_counted(spark, monkeypatch):
    """With a sample of one document, every other labelled document's word is learnt."""
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 1)
    seen = []
    ratios = toxicity.log_ratios
    monkeypatch.setattr(toxicity, "log_ratios", lambda counts, work: seen.append(counts.selectExpr("sum(toxic + ordinary)").first()[0]) or ratios(counts, work))
    ids = usable(60)
    toxicity.train(*tables(spark, [(i, f"word{'abc'[i % 3]} here", i % 2) for i in ids]))
    assert seen == [2 * 59]


def test_counts_are_exact(spark):
    """Every word has a count of its own, and all its left neighbours count, beyond any fixed number of classes."""
    text = " ".join(f"{a}{b}{c} every" for a in "bcdfghjklmnp" for b in "aeiouyvwxz" for c in "qrstbcdfghjklmnpvwxz")
    texts = spark.createDataFrame([(1, bytearray(text.encode())), (2, bytearray(b"every"))], "doc_id long, text binary")
    labels = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 1.0)], "key long, toxic float, ordinary float")
    counts = toxicity._count(texts, Table.write(labels, Workspace(spark, "test"), "labels"))
    rows = counts.collect()
    every = toxicity.words([b"every"])[0][0]
    assert len({r.word for r in rows}) == 2401
    assert sum(r.word == every for r in rows) == 2401 and sum(r.toxic for r in rows if r.word == every) == 2400
    assert sum(r.ordinary for r in rows) == 1


def test_expressions_of_ordinary_words(spark):
    """Two words that are each as common in either class are toxic only one after the other."""
    rng, filler = random.Random(8), [f"f{c}" for c in "abcdefghijkl"]
    rows = []
    for n, i in enumerate(usable(400)):
        a, b, c, d = (rng.choice(filler) for _ in range(4))
        rows.append((i, f"{a} red dog {b} {c} {d}" if n % 2 else f"{a} dog {b} red {c} {d}", n % 2))
    model = toxicity.train(*tables(spark, rows))
    toxic, ordinary = scores(spark, model, ["fa red dog fb fc fd", "fa dog fb red fc fd"])
    assert toxic > 0.7 and ordinary < 0.3


def test_shuffle_files_go_after_each_table(spark, monkeypatch):
    """Finished shuffles are freed before the pairs are shuffled, and again before every machine copies the table of the pairs."""
    order = []
    settle_fully, write, logistic = toxicity.settle_fully, Table.write, toxicity._logistic
    monkeypatch.setattr(toxicity, "settle_fully", lambda s: order.append("freed") or settle_fully(s))
    monkeypatch.setattr(Table, "write", staticmethod(lambda rows, work, name, **more: order.append(name) or write(rows, work, name, **more)))
    monkeypatch.setattr(toxicity, "_logistic", lambda *of: order.append("fit") or logistic(*of))
    toxicity.train(*tables(spark, [(i, f"word{'abc'[i % 3]} here", i % 2) for i in usable(60)]))
    assert order == ["labels", "ratios", "freed", "pairs", "freed", "fit"]
