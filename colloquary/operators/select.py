"""Selection: which discussions are worth keeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquary.functions.tokens import explode_words, words
from colloquary.plans.skew import keep_listed


def discussion_stats(messages: DataFrame) -> DataFrame:
    """Turns, distinct authors and characters per discussion."""
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.countDistinct("author").alias("authors"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars"))


def value_score(stats: DataFrame, weights: dict[str, tuple[float, float]]) -> DataFrame:
    """Weighted sum of capped ratios: column -> (weight, cap), as ``w * least(x / cap, 1)``.

    What makes a discussion valuable is the caller's decision.
    """
    parts = [F.lit(float(w)) * F.least(F.col(c) / F.lit(float(cap)), F.lit(1.0))
             for c, (w, cap) in weights.items()]
    return stats.withColumn("score", F.round(reduce(Column.__add__, parts), 4))


def top_discussions(scored: DataFrame, k: int, per: str | None = None) -> DataFrame:
    """The best k by ``score``, overall or per group; ties go to the smaller ``conv_id``."""
    best = [F.col("score").desc(), F.col("conv_id").asc()]
    if per is None:
        return scored.orderBy(*best).limit(k)
    return (scored.withColumn("rk", F.row_number().over(Window.partitionBy(per).orderBy(*best)))
            .where(F.col("rk") <= k))


def term_filter(messages: DataFrame, terms: DataFrame, min_terms: int) -> DataFrame:
    """Discussions that use at least ``min_terms`` distinct words of the caller's list ``term``.

    What counts as technical is the caller's decision.  A listed term is cut as texts are
    ("C++" is "c"); one that comes to several words ends the job with an error, because it
    would never be found.
    """
    cut = words("term")
    only = F.when(F.size(cut) > 1, F.raise_error(F.concat(
        F.lit("not one word: "), F.col("term")))).otherwise(F.get(cut, F.lit(0)))
    used = keep_listed(explode_words(messages, "conv_id", distinct=True),
                       terms.select(only.alias("term")), "term")
    return (used.groupBy("conv_id").agg(F.countDistinct("term").alias("terms"))
            .where(F.col("terms") >= min_terms))


def dedupe_exact(df: DataFrame, id: str, text: str) -> DataFrame:
    """One row per identical text: its lowest id and the number of copies.

    Copies are counted before the shuffle, and only a digest of the text travels.
    """
    return (df.groupBy(F.unhex(F.sha2(text, 256)).alias("__digest"))
            .agg(F.min(id).alias(id), F.count(F.lit(1)).alias("copies"))
            .drop("__digest"))
