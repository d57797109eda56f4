import zlib

from palimpsest.llm import language


def test_whole_texts_teach(spark):
    """What tells two languages apart may stand far behind in their texts."""
    ids = [i for i in range(1, 80) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "abc " * 2_000 + ("xyx yxy " if i % 2 else "qwq wqw ") * 1_000, "one" if i % 2 else "two") for i in ids]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = language.predict(spark.createDataFrame([(1, "xyx yxy"), (2, "qwq wqw")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {1: "one", 2: "two"}
