"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own content says so, so equal passages give equal chunks. Frequent letter pairs
end small pieces; a chunk ends where the hash of the piece before is one of a rare kind, so after an insertion the cuts
fall in step again at once, wherever the last cut was.
Each chunk is stored once under a 64-bit fingerprint; fingerprints that two different
chunks share are found by comparing the chunks themselves and get an ordinal, which makes
(fingerprint, ordinal) a verified identifier. A document is then its ordered identifier
list, its recipe, and two documents are equal when their recipes are. Only a chunk's first
copy in each task and the recipes are shuffled, never whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import WHITE, Workspace, fresh, settle, spread_join

#: A piece ends behind a boundary pair, or at PIECE_CHARS. A chunk ends behind one piece of PIECES, by hash; one over LONG_CHARS, as
#: periodic text makes, every MAX_PIECES pieces too.
PIECE_CHARS = 256
PIECES = 32
LONG_CHARS, MAX_PIECES = 2048, 64
#: The boundary: a vowel and a frequent consonant, or a frequent letter of other scripts.
BOUNDARY = r"(?:[aeiou][nrst]|[\x{0430}\x{0435}\x{0627}\x{0644}\x{306E}\x{3044}\x{7684}\x{4E00}])"


def normalized(text: Column) -> Column:
    """The text without white space; of null, the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def chunks_of(body: Column, piece: int = PIECE_CHARS, pieces: int = PIECES) -> Column:
    """The chunks of a text without white space, in order; joined they are the text."""
    one = rf".{{0,{piece - 2}}}?{BOUNDARY}|.{{1,{piece}}}"
    pattern = f"(?s){one}"
    ends = lambda p: F.xxhash64(p).bitwiseAND(F.lit(pieces - 1)) == 0
    # The text has no line feed, so one can stand for a cut.
    marked = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda p: F.when(ends(p), F.concat(p, F.lit("\n"))).otherwise(p))
    cut = F.filter(F.split(F.array_join(marked, ""), "\n"), lambda c: c != "")
    short = lambda c: F.when(F.char_length(c) <= LONG_CHARS, F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(rf"(?s)(?:{one}){{1,{MAX_PIECES}}}"), F.lit(0)))
    return F.flatten(F.transform(cut, short))


def recipes(docs: DataFrame, work: Workspace, text: str = "text", fingerprint=F.xxhash64, row: str | None = None) -> DataFrame:
    """Every row's recipe: ``row, doc_id, n_points, text_sha256, recipe``.

    ``row`` names a column with a long of each row's own; without one rows are numbered, once, as they are stored with
    their chunks. ``fingerprint`` is a parameter so that tests can force collisions.
    """
    chunked = docs.select(
        (F.col(row).cast("long") if row else F.monotonically_increasing_id()).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("n_points"),
        normalized(F.col(text)).alias("body"),
    )
    sha = F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")
    chunked = work.stage(chunked.select("row", "doc_id", "n_points", sha, chunks_of(F.col("body")).alias("chunks")), "chunked")
    prints = chunked.select("row", "doc_id", "n_points", "text_sha256", F.transform("chunks", lambda c: fingerprint(c)).alias("prints"))
    store = chunked.select(F.explode("chunks").alias("chunk"))
    store = store.select(fingerprint(F.col("chunk")).alias("print"), "chunk").distinct()
    shared = work.stage(_shared_prints(store), "shared")
    if not shared.take(1):
        return prints.withColumnRenamed("prints", "recipe")
    # Some fingerprints stand for several chunks: their places get the chunk's ordinal.
    order = Window.partitionBy("print").orderBy("chunk")
    ordinals = store.join(shared, "print", "left_semi").withColumn("ordinal", F.row_number().over(order).cast("long"))
    places = chunked.select("row", F.posexplode("chunks").alias("pos", "chunk"))
    places = places.withColumn("print", fingerprint(F.col("chunk"))).join(shared, "print", "left_semi")
    fixed = places.join(ordinals, ["print", "chunk"]).groupBy("row")
    fixed = fixed.agg(F.array_sort(F.collect_list(F.struct("pos", "ordinal"))).alias("fixed"))
    numbers = F.flatten(F.transform("fixed", lambda x: F.array(x["pos"].cast("long"), x["ordinal"])))
    return prints.join(fixed, "row", "left").select(
        "row", "doc_id", "n_points", "text_sha256",
        F.concat("prints", F.coalesce(numbers, F.array().cast("array<long>"))).alias("recipe"),
    )


def _shared_prints(store: DataFrame) -> DataFrame:
    return store.groupBy("print").count().where("count > 1").select("print")


def groups(docs: DataFrame, spark: SparkSession, text: str = "text", row: str | None = None) -> DataFrame:
    """The group of equal texts that each row of ``docs`` belongs to.

    Texts are equal when identical without white space. Returns one row per row of
    ``docs``: ``row, doc_id, keep_id, group_size, kept, text_sha256``. The row with the most
    code points in its text stays, then the smallest doc_id (null last), then the first row, so
    exactly one row of a group is kept even if rows repeat. Null text counts as empty; very long texts are many chunks; an
    empty table gives no rows. ``row`` names a column with a long of each row's own; without one rows are numbered. Other columns are not read.
    """
    work = Workspace(spark, "exact")
    rows = work.stage(recipes(docs, work, text, row=row), "recipes")
    work.drop("chunked", "shared")
    settle(spark)  # the chunks' shuffle
    rank = F.struct((-F.col("n_points")).alias("longer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    best = rows.groupBy("recipe").agg(F.min(rank).alias("best"), F.count("*").alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    # Groups are formed by recipes; their rows find them by the text's digest, which is short however long the text.
    best = work.stage(best.select("text_sha256", "best", "group_size", F.col("group_size").alias("copies")), "best")
    return spread_join(rows.drop("recipe"), best, "text_sha256", "copies", rows.count()).select(
        "row",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, spark: SparkSession, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns, whatever their names, and no others.

    Of ties the first row stays, of repeated rows one; null and empty texts are one group. An empty table gives no rows. The
    rows are written with a number each before they are compared, so that they are the same rows whenever they are read again.
    """
    row = fresh("__row", docs.columns)
    numbered = Workspace(spark, "exact-rows").stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = groups(numbered, spark, text, row).where("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
