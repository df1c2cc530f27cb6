"""Preservation: captures of keyed items over time, read back as of any moment.

A capture has an item ``key``, a unique ``capture_id`` and a time
``captured_at``.  Tables with other names say so through ``Names``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquary.functions.masking import as_json, digest
from colloquary.plans.skew import (
    HOT, PIECE, HotSplit, by_piece, cut_hot_keys, in_piece, null_safe_join, with_previous)


@dataclass(frozen=True)
class Names:
    key: str = "key"
    capture_id: str = "capture_id"
    captured_at: str = "captured_at"


def _day(at: str) -> Column:
    return F.col(at).cast("date")


def append_captures(archive: DataFrame, new: DataFrame, identity: list[str], content: list[str],
                    within: str | None = None) -> DataFrame:
    """The archive and those new rows whose identity and content it does not hold yet.

    ``identity`` must single out the capture, not the item.  ``within`` may name
    the archive's partition column: a row is then looked for only among those that agree
    with it there.
    """
    return archive.unionByName(unseen_captures(archive, new, identity, content, within))


def unseen_captures(archive: DataFrame, new: DataFrame, identity: list[str], content: list[str],
                    within: str | None = None) -> DataFrame:
    """The part of ``new`` that ``append_captures`` adds.

    Of new rows that are equal in identity and content one is added, the smallest of them in
    all its columns.  With ``within`` only partitions of the archive between the first and the
    last that new rows fall into are read.
    """
    by = [within] if within else []
    mark = digest(*by, *identity, *content).alias("__digest")
    if within:
        # the span of the new rows is found when the plan runs, and partitions outside it are
        # not read; rows that share no digest with a new one are of no consequence
        low, high = (new.agg(f(within)).scalar() for f in (F.min, F.max))
        archive = archive.where(F.col(within).between(low, high) | F.col(within).isNull())
    # Both sides shrink their copies before the shuffle and come out partitioned the
    # way the join wants them.  An anti join would be moved below the aggregate,
    # where copies are still many.
    fresh = new.select(mark, F.struct(*new.columns).alias("__row")).groupBy("__digest").agg(
        F.min_by("__row", as_json(*[f"__row.`{c}`" for c in new.columns])).alias("__row"))
    seen = archive.select(mark).distinct().withColumn("__seen", F.lit(True))
    return (fresh.join(seen, "__digest", "left").where(F.col("__seen").isNull())
            .select("__row.*"))


def as_of(captures: DataFrame, at: str, names: Names = Names()) -> DataFrame:
    """Latest capture per key not after ``at``; ties go to the larger id.

    An aggregate rather than a ranking: each task sends one row per key.
    """
    return (captures.where(F.col(names.captured_at) <= F.lit(at).cast("timestamp_ntz"))
            .groupBy(F.col(names.key).alias("__key"))
            .agg(F.max_by(F.struct(*captures.columns),
                          F.struct(names.captured_at, names.capture_id)).alias("__row"))
            .select("__row.*"))


def states_at(captures: DataFrame, moments: DataFrame, moment: str = "moment",
              names: Names = Names(), split: HotSplit = HotSplit()) -> DataFrame:
    """``as_of`` for many moments at once: each row of ``moments`` (key and moment) with the
    other columns of its key's latest capture not after it; nulls where there is none.

    Captures and moments are put in one order per key, and the last capture is carried
    forward, so both sides are shuffled once, by key and piece, and a key with many of both
    costs their sum, not their product.  Of two captures of one time the larger id counts.
    A moment that is null, or asked of a key that is null, has no capture before it unless
    captures have that null key; repeated moments are answered each.
    """
    keys, order = [names.key], ["__at", "__asked", "__id"]
    state = [c for c in captures.columns if c != names.key]
    known = captures.where(F.col(names.captured_at).isNotNull()).select(
        names.key, F.col(names.captured_at).cast("timestamp_ntz").alias("__at"),
        F.lit(False).alias("__asked"), F.col(names.capture_id).cast("bigint").alias("__id"),
        F.struct(*state).alias("__state"))
    asked = moments.select(
        F.col(names.key), F.col(moment).cast("timestamp_ntz").alias("__at"),
        F.lit(True).alias("__asked"), F.lit(None).cast("bigint").alias("__id"),
        F.lit(None).cast(known.schema["__state"].dataType).alias("__state"))
    cut = cut_hot_keys(known.unionByName(asked), keys, order, split)
    # what a piece of a hot key starts from: the last capture in all pieces before it
    last = cut.where(HOT).groupBy(*keys, PIECE).agg(F.max_by("__state", F.when(
        ~F.col("__asked"), F.struct(*order))).alias("__last"))
    carried = last.select(*keys, PIECE, F.last("__last", ignorenulls=True).over(
        by_piece(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    # no more pieces than stated in plans.skew
    rows = null_safe_join(cut, F.broadcast(carried), [*keys, PIECE], "left")
    until = in_piece(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.coalesce(F.last("__state", ignorenulls=True).over(until), F.col("__carry"))
    return (rows.withColumn("__held", held).where("__asked")
            .select(names.key, F.col("__at").alias(moment), "__held.*"))


def nearest_capture(captures: DataFrame, at: str, names: Names = Names()) -> DataFrame:
    """Id of the capture per key closest to ``at``, before or after; ties go to the smaller id.

    A capture without a time is near nothing.
    """
    apart = F.abs(F.col(names.captured_at) - F.lit(at).cast("timestamp_ntz"))
    distance = F.struct(apart, F.col(names.capture_id))
    return captures.where(F.col(names.captured_at).isNotNull()).groupBy(names.key).agg(
        F.min_by(names.capture_id, distance).alias(names.capture_id))


def versions(captures: DataFrame, content: list[str], names: Names = Names(),
             split: HotSplit = HotSplit()) -> DataFrame:
    """Captures whose content differs from that key's previous one; the first always counts."""
    keys, order = [names.key], [names.captured_at, names.capture_id]
    rows = with_previous(cut_hot_keys(captures, keys, order, split), keys, order, content, "__prev")
    same = reduce(Column.__and__,
                  [F.col(c).eqNullSafe(F.col(f"__prev.`{c}`")) for c in content])
    return rows.where(F.col("__prev").isNull() | ~same).select(*captures.columns)


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Per key: added, removed, changed or same from ``a`` to ``b``; null equals null.

    Both are snapshots, that is one row per key.
    """
    left = a.select(F.col(key).alias("__ka"), F.struct(*content).alias("__a"))
    right = b.select(F.col(key).alias("__kb"), F.struct(*content).alias("__b"))
    status = (F.when(F.col("__a").isNull(), "added")
              .when(F.col("__b").isNull(), "removed")
              .when(F.col("__a").eqNullSafe(F.col("__b")), "same")
              .otherwise("changed"))
    return (left.join(right, F.col("__ka").eqNullSafe(F.col("__kb")), "full")
            .select(F.coalesce("__ka", "__kb").alias(key), status.alias("status")))


def capture_calendar(captures: DataFrame, names: Names = Names()) -> DataFrame:
    """Captures per key and day."""
    return (captures.groupBy(names.key, _day(names.captured_at).alias("day"))
            .agg(F.count(F.lit(1)).alias("n")))


def gap_report(captures: DataFrame, names: Names = Names()) -> DataFrame:
    """Days between a key's first and last capture on which it has none.

    Works on distinct days, of which a key has few, and writes out only the gaps.
    """
    days = (captures.where(F.col(names.captured_at).isNotNull())
            .select(names.key, _day(names.captured_at).alias("day")).distinct())
    before = F.lag("day").over(Window.partitionBy(names.key).orderBy("day"))
    return (days.withColumn("before", before)
            .where(F.datediff("day", "before") > 1)
            .select(names.key, F.explode(F.sequence(
                F.date_add("before", 1), F.date_sub("day", 1))).alias("day")))
