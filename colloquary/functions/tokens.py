"""Words of a text, and how telling each word is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: whatever is neither letter nor digit separates words.
SEPARATOR = r"[^\p{L}\p{N}]+"


def words(text: str | Column) -> Column:
    """Lower-case words in order, repeats included; null text gives null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def explode_words(messages: DataFrame, *keep: str, distinct: bool = False) -> DataFrame:
    """One row per word (per distinct word) of each message: ``keep`` and ``term``."""
    found = words("text")
    if distinct:
        found = F.array_distinct(found)
    # stated here, the condition is the same in every branch and shuffles can be shared
    return messages.select(*keep, F.explode(found).alias("term")).where(F.col("term").isNotNull())


def discussion_count(messages: DataFrame) -> Column:
    """Number of discussions, as a scalar subquery."""
    return messages.select("conv_id").distinct().agg(F.count(F.lit(1))).scalar()


def rarity(discussions: Column, df: Column) -> Column:
    """ln(N / df)."""
    return F.ln(discussions / df)
