"""Two archives against each other when rows may repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquary.functions.masking import digest


def counted_difference(a: DataFrame, b: DataFrame, content: list[str]) -> DataFrame:
    """Each distinct ``content`` of two archives with ``in_a`` and ``in_b``, how often each
    holds it; null equals null.

    Copies are counted where they are, so what travels is a digest, one row and two numbers per
    distinct row and task, however many copies there are.
    """
    def side(df: DataFrame, one: int) -> DataFrame:
        return df.select(digest(*content).alias("__digest"), F.struct(*content).alias("__row"),
                         F.lit(one).cast("bigint").alias("__a"),
                         F.lit(1 - one).cast("bigint").alias("__b"))

    both = side(a, 1).unionByName(side(b, 0))
    return both.groupBy("__digest").agg(
        F.first("__row").alias("__row"), F.sum("__a").alias("in_a"), F.sum("__b").alias("in_b")
    ).select("__row.*", "in_a", "in_b")


def _times(counted: DataFrame, n: str, content: list[str]) -> DataFrame:
    each = F.sequence(F.lit(1).cast("bigint"), F.expr(n))
    return counted.where(F.expr(n) > 0).select(*content, F.explode(each).alias("__n")).drop("__n")


def except_all(a: DataFrame, b: DataFrame, content: list[str]) -> DataFrame:
    """Rows of ``a`` without as many of each as ``b`` has."""
    return _times(counted_difference(a, b, content), "in_a - in_b", content)


def intersect_all(a: DataFrame, b: DataFrame, content: list[str]) -> DataFrame:
    """Rows that both have, each as often as the one that has fewer."""
    return _times(counted_difference(a, b, content), "least(in_a, in_b)", content)
