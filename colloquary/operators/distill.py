"""Distillation: cut logs into discussions and pick the telling words and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquary.functions.tokens import discussion_count, explode_words, rarity
from colloquary.plans.skew import (
    FREQUENT, HOT, PIECE, HotSplit, by_piece, cut_hot_keys, in_piece, lookup, null_safe_join,
    with_previous)


POSITION = "__position"


def _timed(df: DataFrame, ts: str, tie: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Rows with a time, and what orders rows of equal time: a hash of all they hold, if
    the caller names nothing, so that many rows of one moment can be cut into pieces."""
    timed = df.where(F.col(ts).isNotNull())
    if tie:
        return timed, tie
    plain = [f.name for f in df.schema if not f.dataType.simpleString().count("map<")]
    return timed.withColumn("__tie", F.xxhash64(*plain)), ["__tie"]


def _numbered(df: DataFrame, key: str, ts: str, gap: str, tie: list[str] | None,
              split: HotSplit) -> DataFrame:
    """Rows with a time with ``session_no`` and ``__position``, the row's place in its room."""
    timed, ties = _timed(df, ts, tie)
    keys, order = [key], [ts, *ties]
    cut = cut_hot_keys(timed, keys, order, split)
    within = in_piece(keys, order)

    def after_silence(before: Column) -> Column:
        return F.coalesce(F.col(ts) > before + F.expr(f"interval {gap}"), F.lit(False))

    # for each piece of a hot room: its last time, its rows, and the starts it has whatever
    # came before
    pieces = (cut.where(HOT)
              .withColumn("__starts", after_silence(F.lag(ts).over(within)).cast("bigint"))
              .groupBy(*keys, PIECE)
              .agg(F.min(ts).alias(ts), F.max(ts).alias("__last"),
                   F.sum("__starts").alias("__n"), F.count(F.lit(1)).alias("__rows")))
    # then the time before the piece, and the starts and rows in all pieces before
    carried = pieces.withColumn("__carry", F.lag("__last").over(by_piece(keys)))
    first = F.col("__carry").isNull() | after_silence(F.col("__carry"))
    before_it = by_piece(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("__n", F.col("__n") + first.cast("bigint")).select(
        *keys, PIECE, "__carry", F.sum("__n").over(before_it).alias("__offset"),
        F.sum("__rows").over(before_it).alias("__ahead"))
    # a few numbers per piece, and no more pieces than stated in plans.skew
    rows = null_safe_join(cut, F.broadcast(carried), keys + [PIECE], "left")
    before = F.coalesce(F.lag(ts).over(within), F.col("__carry"))
    starts = before.isNull() | after_silence(before)
    numbered = rows.withColumn("__starts", starts.cast("bigint")).withColumn(
        "__no", F.sum("__starts").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(within) + F.coalesce("__ahead", F.lit(0)) - 1
    return numbered.select(
        *df.columns, (F.col("__no") + F.coalesce("__offset", F.lit(0)) - 1).alias("session_no"),
        place.cast("bigint").alias(POSITION))


def sessionize(df: DataFrame, key: str, ts: str, gap: str, tie: list[str] | None = None,
               split: HotSplit = HotSplit()) -> DataFrame:
    """Number the discussions of each room: a new one starts after a silence longer than ``gap``.

    ``tie`` orders rows of equal time; it has no influence on the numbers.  Rows
    without a time get no number, and are not shuffled.
    """
    numbered = _numbered(df, key, ts, gap, tie, split).drop(POSITION)
    untimed = df.where(F.col(ts).isNull()).withColumn("session_no", F.lit(None).cast("bigint"))
    return numbered.unionByName(untimed)


def discussions_from_log(df: DataFrame, room: str, ts: str, gap: str, author: str, text: str,
                         tie: list[str] | None = None, split: HotSplit = HotSplit()) -> DataFrame:
    """Messages of the discussions in an unbroken room log.

    ``conv_id`` is a hash of room and session; ``seq`` is the row's place in its room, so it
    is unique and without gaps within a discussion.  Rows without a time belong to no
    discussion and are left out.
    """
    rows = _numbered(df, room, ts, gap, tie, split)
    return rows.select(
        F.col(room).cast("string").alias("space_id"),
        F.xxhash64(F.col(room).cast("string"), "session_no").alias("conv_id"),
        F.col(POSITION).alias("seq"), F.col(author).cast("string").alias("author"),
        F.col(ts).cast("timestamp_ntz").alias("ts"), F.col(text).cast("string").alias("text"))


def pair_replies(messages: DataFrame, asker: str, answerer: str,
                 split: HotSplit = HotSplit()) -> DataFrame:
    """Turns by ``asker`` directly followed by one of ``answerer``."""
    rows = messages.select("conv_id", "seq", "author")
    keys, order = ["conv_id"], ["seq"]
    rows = with_previous(cut_hot_keys(rows, keys, order, split), keys, order,
                         ["seq", "author"], "__prev")
    return (rows.where((F.col("__prev.author") == asker) & (F.col("author") == answerer))
            .select("conv_id", F.col("__prev.seq").alias("question_turn"),
                    F.col("seq").alias("answer_turn")))


def key_terms(messages: DataFrame, k: int, split: HotSplit = FREQUENT) -> DataFrame:
    """k words per discussion by tf * ln(N / df), rounded to 4; ties go to the smaller word."""
    tf = (explode_words(messages, "conv_id")
          .groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("tf")))
    # df is also the word's row count in tf.  Asking for tf > 0 keeps the column, so
    # that Spark sees one and the same shuffle here and below, and runs it once.
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    weighed = lookup(tf, df, "term", "df", split)
    score = F.round(F.col("tf") * rarity(discussion_count(messages), F.col("df")), 4)
    best = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), F.col("term"))
    return (weighed.select("conv_id", "term", score.alias("score"))
            .withColumn("rk", F.row_number().over(best))
            .where(F.col("rk") <= k).select("conv_id", "term", "rk"))


def extract_summary(messages: DataFrame, k: int, split: HotSplit = FREQUENT) -> DataFrame:
    """k turns per discussion with the rarest words on average, the writers' own text.

    Rarity of a turn is the mean ln(N / df) of its words, rounded to 4; ties go
    to the earlier turn.  Turns without a word are never picked.
    """
    tf = (explode_words(messages, "conv_id", "seq")
          .groupBy("conv_id", "seq", "term").agg(F.count(F.lit(1)).alias("tf")))
    # as in key_terms, one shuffle of counts serves here and in both branches of the lookup
    per_discussion = tf.groupBy("conv_id", "term").agg(F.count_if(F.col("tf") > 0).alias("turns"))
    df = per_discussion.groupBy("term").agg(F.count_if(F.col("turns") > 0).alias("df"),
                                            F.sum("turns").alias("turns"))
    weighed = lookup(tf, df, "term", "turns", split)
    n = discussion_count(messages)
    scored = weighed.groupBy("conv_id", "seq").agg(F.round(
        F.sum(F.col("tf") * rarity(n, F.col("df"))) / F.sum("tf"), 4).alias("score"))
    best = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), F.col("seq"))
    return (scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)
            .select("conv_id", F.col("seq").alias("turn"), "rk"))
