"""The corpus pipeline: documents to packed training sequences.

Each stage takes the table that the stage before wrote, drops or places its rows, and
hands on documents with the columns they came with; the last one returns places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import exact_dedup, language, near_dedup, packing, toxicity
from palimpsest.llm.shared import Workspace, scratch


# What holds for every stage: an empty table gives an empty one; extra columns come along whatever their names; very long
# texts are read whole; repeated rows are judged each by the filters, and one of them stays in the two stages that drop copies.


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Rejected are null and empty texts, texts without letters, and ambiguous ones (ties too)."""
    return language.keep(docs, language.train(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not call toxic; a score at the threshold is. A null text or id teaches nothing, and a null
    text is judged like an empty one."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id (null last), then the first row. Null and
    empty texts are one group."""
    return exact_dedup.deduplicate(docs, spark)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the smallest id (null last), then the first row. Texts without
    words, null ones too, stay."""
    return near_dedup.deduplicate(docs, spark)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents that are left; a null or empty text is its end id alone, null ids are carried along."""
    return packing.pack(docs, spark, public_tokenizers.path("word_bpe_49k.json")).drop("row")


STAGES = [
    ("identify_language", identify_language),
    ("drop_toxic", drop_toxic),
    ("drop_copies", drop_copies),
    ("drop_near_copies", drop_near_copies),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. What a stage wrote on its way, and the table of the stage before, go when
    its own table is written."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with scratch():
            docs = work.stage(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs


#: SQL has no fitted models and no tokenizer.
ORACLE_SQL: str | None = None
