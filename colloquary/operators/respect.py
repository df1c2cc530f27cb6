"""Respect for the people who took part.

Order matters: removals first (afterwards nobody can be recognised), then
stand-ins, then masking.  Removal wins over preservation: apply it to the archive
before reading any past state from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquary.functions.masking import DEFAULT_RULES, Rule, masked, matches, stand_in
from colloquary.plans.skew import drop_listed


def pseudonymise(df: DataFrame, col: str, salt: str) -> DataFrame:
    """Replace a person's id by a stable stand-in.  Keep ``salt`` secret."""
    return df.withColumn(col, stand_in(col, salt))


def redact(df: DataFrame, col: str,
           rules: list[tuple[str, str]] = DEFAULT_RULES) -> DataFrame:
    """Replace what each (pattern, tag) rule finds, in order; by default e-mail and IPv4
    addresses, tokens and 16-digit numbers."""
    for rule in rules:
        df = df.withColumn(col, masked(col, Rule(*rule)))
    return df


def sensitive_report(df: DataFrame, col: str, by: str,
                     rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows per group that match each named rule."""
    return df.groupBy(by).agg(*[
        F.count_if(matches(col, Rule(*rule))).alias(name) for name, rule in rules.items()])


def honour_removals(df: DataFrame, removals: DataFrame, key: str) -> DataFrame:
    """Drop everything by or about those on the list; rows with a null key stay."""
    return drop_listed(df, removals, key)


def credit_report(messages: DataFrame) -> DataFrame:
    """Messages, characters and discussions per author.  Feed it stand-ins unless
    real names are meant to be shown."""
    return messages.groupBy("author").agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars"),
        F.countDistinct("conv_id").alias("discussions"))
