"""Connected components by alternating stars, every step a join and a minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquary.llm.common import keep


def _state(edges: DataFrame) -> tuple:
    """Enough to tell whether a step changed anything."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                           F.sum("v")).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, of type bigint); ``root`` is the
    smallest node that can be reached.

    In turn, each node hands its larger neighbours to its smallest one, and its smaller
    neighbours likewise, until only stars are left; that takes few rounds, logarithmic in the
    longest way.  The minimum per node is combined before the shuffle.  Nodes of many
    neighbours are hot keys of plain joins, which adaptive execution splits; each round is
    written to the shared folder.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = keep(edges.where(F.col("a") != F.col("b"))
                 .select(high.alias("u"), low.alias("v")).distinct(), "edges")
    before = _state(edges)
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(
            edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = keep(both.groupBy("x").agg(F.min("y").alias("m"))
                     .select("x", F.least("x", "m").alias("m")), "least")
        handed = keep(both.where(F.col("y") > F.col("x")).join(least, "x")
                      .select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "handed")
        lower = keep(handed.groupBy("u").agg(F.min("v").alias("m")), "lower")
        moved = (handed.join(lower, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = keep(moved.unionAll(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
