import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that the operators use."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = words(80), words(70)
    rows = [
        (1, None, "en", "s", 1, 9, "x"), (2, "", None, None, None, None, None), (3, " \t\n", "en", "s", 0, 0, "x"), (None, "no id at all", None, "s", 1, 1, "x"),
        (4, " ".join(words(30_000)), "en", "s", 1, 1, "x"), (8, "Été　ça va? 1½ <|endoftext|>  two\n\nlines \x1c end ", "fr", "s", 1, 1, "x"),
        (6, "one two three", "en", "s", 1, 1, "x"), (6, "one two three", "en", "s", 1, 1, "x"), (7, "ONE\ntwo  three", "en", "s", 1, 1, "x"), (5, "one twothree", "en", "s", 1, 1, "x"),
    ]
    for i in range(10, 40):  # a family of near copies
        copy = list(base)
        copy[rng.randrange(80)] = "changed"
        rows.append((i, " ".join(copy), "en", "s", 1, 1, "x"))
    for i in range(40, 120):  # documents that share no more than a passage
        rows.append((i, " ".join(words(60) + passage), "en", "s", 1, 1, "x"))
    for i in range(120, 130):
        rows.append((i, " ".join(base), "en", "s", 1, 1, "x"))
    rows.append((None, "no id at all", None, "s", 1, 1, "x"))
    path = f"{tmp_path_factory.mktemp('odd')}/documents"
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, shard string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(odd, spark):
    return spark.createDataFrame([], odd.schema)
