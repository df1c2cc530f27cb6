"""The queries of this package: each operator over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquary.llm import (
    language_model, line_dedup, mixing, packing, prefix_trie, quality_classifier, quality_rules, simhash, token_counts,
    token_files, toxicity, vector_lists, whitening)
from colloquary.llm.common import table
from colloquary.llm.vocabularies import path_of
from colloquary.session import shared_folder

TOKEN_LIMIT = 4096
TOXIC_FROM = 0.3
WORD_IDS = 49_408


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.prefix_counts(
        table(spark, sf, "documents"), path_of("piece_bpe_32k.model"))
    tokens = token_counts.token_count()
    return counted.select("doc_id", "n_bytes", tokens.alias("n_tokens"),
                          (tokens > TOKEN_LIMIT).alias("over_limit"))


def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    model = quality_classifier.train(documents)
    return quality_classifier.score_quality(documents, model).withColumn(
        "kept", F.col("score") >= quality_classifier.THRESHOLD)


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge_texts(table(spark, sf, "documents"))


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents)


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), path_of("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fourth document, by id; a null id is one like ''."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(4)) == 2


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").where(~held_out()).select(
        "doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(documents, labels)
    return toxicity.score_toxicity(documents, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "passages")


def op8_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "token-file")
    token_files.write_token_file(table(spark, sf, "documents"), folder,
                                 path_of("word_bpe_49k.json"), WORD_IDS)
    return token_files.read_token_file(spark, folder)


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents")).select(
        "doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op10_vector_lists(spark: SparkSession, sf: str) -> DataFrame:
    return vector_lists.search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return language_model.learn_and_score(table(spark, sf, "documents"))[1]


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


# crc32 of the decimal id, bit by bit; prefixes are lists of turns, and a node's subtree is what
# the smallest conversation of each node below it leads through
_OP13 = """
WITH said AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id
                              ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))
               AS place
    FROM conversations WHERE conv_id IS NOT NULL),
names AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base,
           xor(4294967295::BIGINT, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(
                   string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: list_reduce(
                   list_prepend(xor(c, b), range(8)),
                   lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))))
               % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM said)),
parts AS (
    SELECT n.conv_id, 0 AS own, s.place, s.role, s.text
    FROM names n JOIN said s ON s.conv_id = n.base AND s.place <= n.h
    UNION ALL
    SELECT n.conv_id, 1, s.place, s.role, s.text
    FROM names n JOIN said s ON s.conv_id = n.conv_id AND s.place > n.h),
turns AS (
    SELECT conv_id, text, {'role': role, 'text': text} AS turn,
           row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth
    FROM parts),
prefixes AS (
    SELECT conv_id, depth, length(text) AS chars,
           list(turn) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM turns
    UNION ALL SELECT conv_id, 0, 0, [] FROM names),
members AS (
    SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node,
           max(depth) OVER (PARTITION BY conv_id) AS last FROM prefixes),
nodes AS (
    SELECT node, depth, count(*) AS n_convs, any_value(chars) AS chars,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                           FILTER (WHERE last = depth), '')) AS ends_sha256
    FROM members GROUP BY node, depth),
ways AS (
    SELECT n.node, n.depth, a.node AS above, a.depth AS above_depth
    FROM nodes n JOIN members a ON a.conv_id = n.node AND a.depth <= n.depth),
children AS (
    SELECT above, above_depth, count(*) AS n_children FROM ways
    WHERE above_depth = depth - 1 GROUP BY above, above_depth),
facts AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n
    LEFT JOIN children c ON c.above = n.node AND c.above_depth = n.depth)
SELECT f.node AS conv_id, f.depth AS depth, p.above AS parent_conv_id, f.n_convs AS n_convs,
       f.n_children AS n_children, s.n_leaves AS n_leaves, s.saved_tokens AS saved_tokens,
       f.ends_sha256 AS ends_sha256
FROM facts f
JOIN (SELECT w.above, w.above_depth,
             count(*) FILTER (WHERE d.n_children = 0) AS n_leaves,
             sum((d.n_convs - 1) * d.chars)::BIGINT AS saved_tokens
      FROM ways w JOIN facts d ON d.node = w.node AND d.depth = w.depth
      GROUP BY w.above, w.above_depth) s ON s.above = f.node AND s.above_depth = f.depth
LEFT JOIN ways p ON p.node = f.node AND p.depth = f.depth AND p.above_depth = f.depth - 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_prefix_trie": _OP13}
