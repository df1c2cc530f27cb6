"""Versions as stretches of time, and which of them overlap which spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquary.operators.archive import Names, versions
from colloquary.plans.skew import HotSplit, cut_hot_keys, with_previous

HOUR = 3_600_000_000  # microseconds; the narrowest bins
FACTOR = 8  # each level's bins are so many times as wide as those of the level below
LEVELS = 10  # the widest are 15,000 years
_EVER = "timestamp_ntz'9999-12-31 00:00:00'"


def validity(captures: DataFrame, content: list[str], names: Names = Names(),
             split: HotSplit = HotSplit()) -> DataFrame:
    """``versions`` with ``valid_from`` and ``valid_to``, the time of the key's next version;
    null for the last, which still holds.

    Captures without a time are left out.  Of versions of one time all but the last hold for
    no time at all.
    """
    timed = captures.where(F.col(names.captured_at).isNotNull())
    kept = versions(timed, content, names, split).withColumns({
        "__at": -F.unix_micros(F.col(names.captured_at).cast("timestamp")),
        "__id": -F.col(names.capture_id)})
    keys, order = [names.key], ["__at", "__id"]  # backwards, so that before means after
    after = with_previous(cut_hot_keys(kept, keys, order, split), keys, order,
                          [names.captured_at], "__next")
    return after.select(*captures.columns, F.col(names.captured_at).alias("valid_from"),
                        F.col(f"__next.`{names.captured_at}`").alias("valid_to"))


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp_ntz").cast("timestamp"))


def _binned(df: DataFrame, start: str, end: str, side: str) -> DataFrame:
    """Rows by the bins they touch on their own level and all above, two at most on each.

    A row's own level is the first whose bins are as wide as the row is long.
    """
    begin, past = _micros(F.col(start)), _micros(F.coalesce(F.col(end), F.expr(_EVER)))
    named = df.select(F.struct(*df.columns).alias(f"__{side}"), begin.alias(f"__{side}_from"),
                      past.alias(f"__{side}_to")).where(F.col(f"__{side}_from")
                                                        < F.col(f"__{side}_to"))
    length = F.col(f"__{side}_to") - F.col(f"__{side}_from")
    own = sum([(length > HOUR * FACTOR ** level).cast("int") for level in range(LEVELS - 1)],
              F.lit(0))
    leveled = named.withColumn(f"__{side}_own", own).withColumn(
        "__level", F.explode(F.sequence(F.col(f"__{side}_own"), F.lit(LEVELS - 1))))
    width = F.element_at(F.array(*[F.lit(HOUR * FACTOR ** n) for n in range(LEVELS)]),
                         F.col("__level") + 1)

    def place(at: Column) -> Column:
        return F.floor(at / width)

    return leveled.withColumn("__bin", F.explode(F.sequence(
        place(F.col(f"__{side}_from")), place(F.col(f"__{side}_to") - 1))))


def overlapping(held: DataFrame, spans: DataFrame, on: list[str],
                held_from: str = "valid_from", held_to: str = "valid_to",
                span_from: str = "span_from", span_to: str = "span_to") -> DataFrame:
    """Rows of ``held`` with each of ``spans`` that shares a moment with them and agrees in the
    columns ``on`` (of both; may be none): all columns of ``held``, then those of ``spans``
    but ``on``.  Both are half-open; an end that is null never comes.

    Both sides meet in bins of time.  A long row isn't copied to every narrow bin: a pair meets
    on the level of the longer one, where the shorter one touches two bins at most.  So a row
    has at most two copies per level however long it is, and each pair is made once, in the
    bin in which the later of the two begins.
    """
    left = _binned(held, held_from, held_to, "a").withColumns(
        {f"__on{i}": F.col(f"__a.`{c}`") for i, c in enumerate(on)})
    right = _binned(spans, span_from, span_to, "b").withColumns(
        {f"__on{i}": F.col(f"__b.`{c}`") for i, c in enumerate(on)})
    met = left.join(right, ["__level", "__bin", *[f"__on{i}" for i in range(len(on))]])
    width = F.element_at(F.array(*[F.lit(HOUR * FACTOR ** n) for n in range(LEVELS)]),
                         F.col("__level") + 1)
    later = F.greatest("__a_from", "__b_from")
    once = met.where((F.col("__level") == F.greatest("__a_own", "__b_own"))
                     & (later < F.least("__a_to", "__b_to"))
                     & (F.floor(later / width) == F.col("__bin")))
    return once.select(*[F.col(f"__a.`{c}`").alias(c) for c in held.columns],
                       *[F.col(f"__b.`{c}`").alias(c) for c in spans.columns if c not in on])
