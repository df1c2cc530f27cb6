"""Consumption: readable transcripts, nested records, search and counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquary.functions.tokens import words

PART_TURNS = 1000


def _parts(messages: DataFrame, part_turns: int, carry: list[str] = []
           ) -> tuple[DataFrame, Column, list[str]]:
    """Group by discussion and block of ``part_turns`` numbers of ``seq``.

    A discussion may hold a third of everything; its blocks do not, as ``seq`` is
    unique in it.  Turns without a number have no block: those of a discussion are dealt by
    hash to as many rows of null ``part`` as they would fill twice over.  Equal ones are
    counted first and numbered, so that they are dealt as others are.
    """
    part = F.floor(F.col("seq") / part_turns).alias("part")
    kept = ["conv_id", "author", "text", *carry]
    equal = messages.where(F.col("seq").isNull()).groupBy(*kept).agg(
        F.count(F.lit(1)).alias("__n"))
    # one row per discussion with such turns
    lost = equal.groupBy(F.col("conv_id").alias("__conv")).agg(F.sum("__n").alias("__lost"))
    equal = equal.join(lost, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    piece = F.floor((F.col("__n") - 1) / part_turns)
    equal = equal.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), piece)))
    least = F.least(F.lit(part_turns).cast("bigint"), F.col("__n") - F.col("__piece") * part_turns)
    equal = equal.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("bigint"), least)))
    no = F.lit(None).cast("bigint")
    messages = messages.where(F.col("seq").isNotNull()).select(
        *kept, "seq", no.alias("__piece"), no.alias("__turn"), no.alias("__lost")
    ).unionByName(equal.select(
            *kept, F.lit(None).cast(messages.schema["seq"].dataType).alias("seq"),
            "__piece", "__turn", "__lost"))
    deal = F.when(F.col("seq").isNull(), F.pmod(
        F.xxhash64("author", "text", "__piece", "__turn"),
        F.ceil(2 * F.col("__lost") / part_turns) + 1)).alias("__deal")
    said = F.sort_array(F.collect_list(F.struct("seq", "author", "text")))
    return messages.groupBy("conv_id", part, deal, *carry), said, ["conv_id", "part", *carry]


def transcript(messages: DataFrame, part_turns: int = PART_TURNS,
               carry: list[str] = []) -> DataFrame:
    """Readable text, ``author: text`` lines in order: ``conv_id, part, body``.

    Parts read one after the other are the whole discussion.  ``carry`` names columns that
    are the same throughout a discussion.
    """
    grouped, said, names = _parts(messages, part_turns, carry)
    lines = F.transform(said, lambda m: F.concat(
        F.coalesce(m["author"], F.lit("")), F.lit(": "), F.coalesce(m["text"], F.lit(""))))
    return grouped.agg(F.array_join(lines, "\n").alias("body")).select(*names, "body")


def nested_export(messages: DataFrame, as_json: bool = False,
                  part_turns: int = PART_TURNS) -> DataFrame:
    """Array of (seq, author, text) per discussion part, or the same as JSON text."""
    grouped, said, names = _parts(messages, part_turns)
    told = F.to_json(said).alias("json") if as_json else said.alias("messages")
    return grouped.agg(told).drop("__deal")


def keyword_search(messages: DataFrame, terms: list[str], all_terms: bool) -> DataFrame:
    """Discussions that use any (or all) of the terms: distinct terms and total uses.

    Terms are cut as texts are: "node.js" is found where "node" is followed by "js".  A term
    without a letter or digit is refused.
    """
    wanted = sorted({tuple(re.findall(r"[^\W_]+", t.lower())) for t in terms})
    if () in wanted:
        raise ValueError(f"a term without a word: {terms}")
    single = [t[0] for t in wanted if len(t) == 1]
    said = words("text")
    found = F.filter(said, lambda w: w.isin(single)) if single else F.array().cast("array<string>")
    for term in (t for t in wanted if len(t) > 1):
        first = F.sequence(F.lit(1), F.size(said) - len(term) + 1)
        uses = F.filter(first, lambda i: F.slice(said, i, len(term)) == F.array(
            *map(F.lit, term)))
        several = F.when(F.size(said) >= len(term), F.transform(
            uses, lambda _: F.lit(" ".join(term)))).otherwise(F.array().cast("array<string>"))
        found = F.concat(found, several)
    # only matching words leave the message
    hits = messages.select("conv_id", F.explode(found).alias("term"))
    found = hits.groupBy("conv_id").agg(
        F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("hits"))
    return found.where(F.col("terms") == len(wanted)) if all_terms else found


def hit_context(messages: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The k turns before and after each hit (``conv_id, hit``), the hit itself included.

    Both sides meet on bands of ``2k + 1`` turns, of which a hit's surroundings
    touch at most two, so a hit never meets more than twice the rows it returns,
    and a busy discussion is spread over its bands.
    """
    width = 2 * k + 1

    def band(turn: Column) -> Column:
        # first turn of the band
        return turn - F.pmod(turn, F.lit(width))

    around = (hits.select("conv_id", F.col("hit").cast("bigint")).distinct()
              .withColumn("__band", F.explode(F.sequence(
                  band(F.col("hit") - k), band(F.col("hit") + k), F.lit(width).cast("bigint")))))
    rows = messages.withColumn("__band", band(F.col("seq")))
    return (rows.join(around, ["conv_id", "__band"])
            .where(F.col("seq").between(F.col("hit") - k, F.col("hit") + k))
            .select("conv_id", "hit", *[c for c in messages.columns if c != "conv_id"]))


def activity_rollup(df: DataFrame, dims: list[str], ts: str) -> DataFrame:
    """Counts by dimensions and day with subtotals; ``gid`` says which level a row is.

    Rows are counted once at the finest level; subtotals add up those counts.
    """
    finest = df.groupBy(*dims, F.col(ts).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("__n"))
    return finest.rollup(*dims, "day").agg(
        F.sum("__n").alias("n"), F.grouping_id().cast("bigint").alias("gid"))


def register_views(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """Make frames available to SQL under the given names."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
