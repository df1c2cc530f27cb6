"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes the rows that its predecessor left and returns the columns of documents;
the last returns pieces of sequences.  Null and empty texts go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquary.llm import line_dedup, mixing, packing, quality_classifier, simhash
from colloquary.llm.common import keep, table, word_count
from colloquary.llm.vocabularies import path_of


def _measured(docs: DataFrame) -> DataFrame:
    """With ``n_chars`` as long as the text now is."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these, does not reject."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line matches; without a word left they go."""
    return _measured(line_dedup.dedup_lines(docs).where(word_count("text") > 0))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _measured(mixing.take(docs, keep(mixing.mix(docs), "mixed")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack_documents(docs, path_of("byte_bpe_50k.json"))


STAGES = [("quality classifier", drop_poor), ("line dedup", drop_lines),
          ("SimHash near-dedup", drop_copies), ("mixing", mix), ("packing", pack)]

# SQL can't express the classifier, nor fingerprints and token ids; tests/llm holds each
# stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
