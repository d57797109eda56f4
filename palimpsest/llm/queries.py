"""The llm operators as queries over whole tables, and the SQL that some can be held against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import byte_bpe, exact_dedup, language, line_dedup, near_dedup, packing, quality, sharding, token_files, toxicity
from palimpsest.llm.shared import held_out

#: 5 regions of 2 racks of 4 shards.
SHARD_TREE = sharding.HashTree.uniform(5, 2, 4)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_documents(spark, sf_dir), SHARD_TREE, spark)


def op2_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_minhash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_lines(_documents(spark, sf_dir), spark).drop("row")


def op4_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), spark).drop("row", "component")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_documents(spark, sf_dir), spark, tokenizer).drop("row")


def op6_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_documents(spark, sf_dir), spark).drop("row")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = byte_bpe.encode(_documents(spark, sf_dir), spark, ranks, pattern, decoded=True)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text_bytes", 256).alias("decoded_sha256")
    )


def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    found = token_files.read(*token_files.write(_documents(spark, sf_dir), spark, tokenizer))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_hash_tree_shards": op1_hash_tree_shards,
    "op2_ecoc_language": op2_ecoc_language,
    "op3_minhash_line_dedup": op3_minhash_line_dedup,
    "op4_bottom_k_near_dedup": op4_bottom_k_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_chunk_recipe_dedup": op6_chunk_recipe_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_kneser_ney_toxicity": op8_kneser_ney_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_files": op10_token_files,
}

#: SQL of the checksum: its table, by bits, and the fold over the hexadecimal digits of a body.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) ORDER BY i) AS t FROM range(0, 256) x(i))"""
_CRC_OF = """xor(list_reduce(list_transform(regexp_extract_all(hex(body), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                        lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"""

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


def _least(level: str, names: str, weight: str) -> str:
    """SQL of the child with the least draw for ``k``: the children numbered by ``level``, named and weighted by it."""
    return f"""list_reduce(list_transform({level}, lambda i: {{'d': -ln((CAST('0x' || substr(md5(k || '/' || {names}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {weight}, 'i': i}}),
                        lambda a, b: CASE WHEN a.d <= b.d THEN a ELSE b END).i"""


ORACLE_SQL = {
    # 5 regions of weight 8, racks of 4, shards of 1; a new shard is a region of weight 1.
    "op1_hash_tree_shards": f"""
        WITH d AS (
            SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, encode(coalesce(text, '')) AS body FROM documents
        ), {_CRC_TABLE}, r AS (
            SELECT *, {_least("range(0, 5)", "i", "8.0")} AS region, {_least("range(0, 6)", "i", "CASE WHEN i = 5 THEN 1.0 ELSE 8.0 END")} AS grown FROM d
        ), c AS (
            SELECT *, {_least("range(0, 2)", "region || '/' || i", "4.0")} AS rack FROM r
        ), s AS (
            SELECT *, region * 8 + rack * 4 + {_least("range(0, 4)", "region || '/' || rack || '/' || i", "1.0")} AS leaf FROM c
        ), p AS (
            SELECT doc_id, octet_length(body) + 16 AS size, CAST(leaf AS INTEGER) AS shard, CAST(CASE WHEN grown = 5 THEN 40 ELSE leaf END AS INTEGER) AS grown_shard, {_CRC_OF} AS text_crc32 FROM s, crc_table
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard FROM p
    """,
    # Lines that are alike share one of their rarest shingles, of which a line has as many as may be missing in the other, and one more.
    "op3_minhash_line_dedup": r"""
        WITH RECURSIVE parts AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents
        ), l AS (
            SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, lower(trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) AS body
            FROM (SELECT doc_id, unnest(x) AS x, unnest(range(0, len(x))) AS line_no FROM parts)
        ), u AS (
            SELECT row_number() OVER (ORDER BY body) AS id, body FROM (SELECT DISTINCT body FROM l WHERE body <> '')
        ), s AS (
            SELECT id, unnest(list_distinct(CASE WHEN length(body) < 5 THEN [body] ELSE list_concat(
                regexp_extract_all(body, '(?s).{5}'), regexp_extract_all(substr(body, 2), '(?s).{5}'), regexp_extract_all(substr(body, 3), '(?s).{5}'),
                regexp_extract_all(substr(body, 4), '(?s).{5}'), regexp_extract_all(substr(body, 5), '(?s).{5}')) END)) AS g FROM u
        ), f AS (
            SELECT *, count(*) OVER (PARTITION BY g) AS c, count(*) OVER (PARTITION BY id) AS n FROM s
        ), rare AS (
            SELECT id, g FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c, g) AS r FROM f) WHERE r <= n - ceil(0.75 * n) + 1 AND c > 1
        ), met AS (
            SELECT DISTINCT a.id AS a, b.id AS b FROM rare a JOIN rare b ON a.g = b.g AND a.id < b.id
        ), sets AS (
            SELECT id, list(g) AS gs FROM s GROUP BY id
        ), near AS (
            SELECT a, b FROM (SELECT a, b, len(x.gs) + len(y.gs) AS n, len(list_intersect(x.gs, y.gs)) AS shared FROM met JOIN sets x ON x.id = a JOIN sets y ON y.id = b)
            WHERE 100 * shared >= 75 * (n - shared)
        ), links AS (
            SELECT a, b FROM near UNION ALL SELECT b, a FROM near
        ), reached AS (
            SELECT id, id AS other FROM u UNION SELECT r.id, k.b FROM reached r JOIN links k ON r.other = k.a
        ), c AS (
            SELECT id, min(other) AS component FROM reached GROUP BY id
        ), m AS (
            SELECT l.doc_id, l.line_no, CASE WHEN l.body <> '' THEN first_value(struct_pack(d := l.doc_id, n := l.line_no)) OVER (PARTITION BY component ORDER BY l.doc_id, l.line_no)
                                             ELSE struct_pack(d := l.doc_id, n := l.line_no) END AS first
            FROM l LEFT JOIN u ON l.body = u.body LEFT JOIN c ON c.id = u.id
        )
        SELECT doc_id, line_no, first.d AS component_doc, first.n AS component_line, first.d = doc_id AND first.n = line_no AS kept FROM m
    """,
    "op4_bottom_k_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), met AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
        )
        SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id, min(other) = d.doc_id AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reached r ON r.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op6_chunk_recipe_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents
        ), g AS (
            SELECT doc_id,
                   first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op9_quality_rules": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                               lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), tri AS (
            SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
        ), twice AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri
        ), rep AS (
            SELECT doc_id, count(DISTINCT i + k) AS n
            FROM twice, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY doc_id
        ), m AS (
            SELECT d.doc_id, len(w) AS n_words,
                   length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(rep.n, 0) AS n_repeat_words,
                   len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
                   len(lines) AS n_lines
            FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id
        ), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars BETWEEN 2.5 * n_words AND 12.0 * n_words
               AND n_symbols::DOUBLE / n_words <= 0.1 AND n_stop_words::DOUBLE / n_words >= 0.02
               AND n_dup_lines::DOUBLE / n_lines <= 0.3 AS kept,
               n_stop_words, n_lines
        FROM f
    """,
}
