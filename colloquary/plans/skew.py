"""Plans that hold up when one key owns a large part of all rows.

Three situations come up in this package:

* a *window* over a key (previous row, running total) would put all rows of a
  busy key into one task.  ``cut_hot_keys`` cuts such a key into consecutive
  pieces along its order; the window then runs per piece, and what a piece needs
  from the pieces before is one row (see ``with_previous``);
* a *lookup* by a busy key (a very common word) would send all its rows to one
  task.  ``lookup`` answers the frequent keys from a broadcast, where their rows
  are, and shuffles only the rest;
* a *list* given by the caller may be ten names or ten billion.  ``keep_listed``
  and ``drop_listed`` are plain semi and anti joins: a list that turns out small is
  broadcast by adaptive execution, and the rows of a hot key are split by it.

A key is hot when it alone holds more than 1/share of all rows.  Fewer than
``share`` keys can be hot, and all their pieces together number less than about
twice ``share``, however large the data: that is the bound on what is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

PIECE = "__piece"
HOT = "__hot"
GHOST = "__ghost"
_CUTS = "__cuts"
_PLACE = "__place"
_STEP = "__step_"
_N = "__n"
_SAMPLES_PER_CUT = 8


@dataclass(frozen=True)
class HotSplit:
    """``share``: the largest part of all rows (1/share) one task should get.
    ``min_rows``: no key or piece needs to be smaller than this."""

    share: int = 10_000
    min_rows: int = 1_000_000


# Lookups broadcast more than hot keys need, since each answered row saves a shuffle.  A key
# in there takes at least 1/share of all rows, so a million keys of average length at most.
FREQUENT = HotSplit(share=1_000_000, min_rows=1_000)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which null equals null; the key columns come from ``left``."""
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def _counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_N))


def _fair_share(total: Column, split: HotSplit) -> Column:
    return F.greatest(total / split.share, F.lit(float(split.min_rows)))


def _hot(counts: DataFrame, total: Column, split: HotSplit) -> DataFrame:
    return counts.where(F.col(_N) > _fair_share(total, split))


def cut_hot_keys(df: DataFrame, keys: list[str], order: list[str],
                 split: HotSplit = HotSplit()) -> DataFrame:
    """Add ``__piece`` and ``__hot``.

    Ordinary keys are one piece, 0.  A hot key gets consecutive pieces along
    ``order`` of about a fair share of rows each.  Cut points are every eighth
    row of a sample taken by hash, hence a function of the rows alone: two
    branches of one plan, or a task run again, see the same pieces.
    """
    place = F.struct(*order)
    counts = _counts(df, keys)
    total = counts.agg(F.sum(_N)).scalar()
    hot = F.broadcast(_hot(counts, total, split).select(*keys))
    every = F.greatest(F.lit(1), F.floor(_fair_share(total, split) / _SAMPLES_PER_CUT))
    sample = (null_safe_join(df.select(*dict.fromkeys(keys + order)), hot, keys, "left_semi")
              .where(F.pmod(F.xxhash64(*keys, *order), every) == 0))
    cuts = (sample.groupBy(*keys).agg(F.sort_array(F.collect_set(place)).alias(_CUTS))
            .withColumn(_CUTS, F.filter(
                _CUTS, lambda _, i: i % _SAMPLES_PER_CUT == _SAMPLES_PER_CUT - 1)))
    cut = null_safe_join(df, F.broadcast(cuts), keys, "left")
    stepped = cut.select(
        *df.columns, F.col(_CUTS).isNotNull().alias(HOT),
        F.when(F.col(HOT), place).alias(_PLACE), *map(F.expr, _halving_steps(split)))
    # explode, so that rules tracing a join key to its origin stop here: written out as
    # one expression the steps would double in size with each of them
    return stepped.select(*df.columns, HOT, F.explode(F.array(f"{_STEP}0")).alias(PIECE))


def _halving_steps(split: HotSplit) -> list[str]:
    """Columns, each built on the one before; the last says how many of the sorted
    cuts are <= the row's place (0 without cuts).  As columns the steps are compiled
    with the rest of the stage; a higher-order function would be interpreted per row.
    """
    steps, found = [], "0"
    for bit in reversed(range((2 * split.share).bit_length())):
        name = f"{_STEP}{bit}"
        steps.append(f"{found} + IF(get({_CUTS}, {found} + {(1 << bit) - 1}) <= {_PLACE}, "
                     f"{1 << bit}, 0) AS {name}")
        found = name
    return steps


def by_piece(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(PIECE)


def in_piece(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, PIECE).orderBy(*order)


def with_previous(cut: DataFrame, keys: list[str], order: list[str],
                  values: list[str], name: str) -> DataFrame:
    """Add struct ``name`` with ``values`` of the row before, null for a key's first row.

    The first row of a piece needs the last row of the piece before.  That row is
    put in front of the piece as a ghost, so the lookup stays inside the piece.
    """
    carried = [c for c in dict.fromkeys(order + values) if c not in keys]
    last = (cut.where(HOT).groupBy(*keys, PIECE)
            .agg(F.max_by(F.struct(*carried), F.struct(*order)).alias("__last")))
    ghosts = (last.withColumn("__last", F.lag("__last").over(by_piece(keys)))
              .where(F.col("__last").isNotNull())
              .select(*keys, PIECE, "__last.*", F.lit(True).alias(HOT), F.lit(True).alias(GHOST)))
    rows = cut.withColumn(GHOST, F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    return (rows.withColumn(name, F.lag(F.struct(*values)).over(in_piece(keys, order)))
            .where(~F.col(GHOST)).drop(GHOST))


def lookup(left: DataFrame, table: DataFrame, key: str, weight: str,
           split: HotSplit = FREQUENT) -> DataFrame:
    """Inner join of ``left`` with ``table``, which has one row per ``key``.

    ``weight`` is the column of ``table`` that says how many rows of ``left`` have
    the key.  No key that is left for the shuffle has more than 1/share of them.
    """
    total = table.agg(F.sum(weight)).scalar()
    frequent = _hot(table.withColumn(_N, F.col(weight)), total, split).select(
        key, F.struct(*[c for c in table.columns if c != key]).alias("__known"))
    tried = left.join(F.broadcast(frequent), key, "left")
    answered = tried.where(F.col("__known").isNotNull()).select(*left.columns, "__known.*")
    # an anti join would be moved below an aggregate in ``left``, which would then run twice
    rest = tried.where(F.col("__known").isNull()).select(*left.columns).join(table, key)
    return answered.unionByName(rest)


def _listed(df: DataFrame, names: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join on ``key``, with the names in the type that ``df`` has.

    A name that cannot be of that type, or is null, is on no row.  Nothing runs while the
    plan is built, and it is the same plan for every length of the list.  Names that repeat
    are not made distinct first: neither join minds, and both sides come straight from their
    shuffle, which is what lets adaptive execution split a hot key.
    """
    kind = df.schema[key].dataType.simpleString()
    given, named = F.col(key), F.col(key).try_cast(kind)
    source = names.schema[key].dataType
    if source not in (df.schema[key].dataType, T.StringType()):
        # 1.5 is nobody's number, though it can be made 1
        named = F.when(named.try_cast(source.simpleString()) == given, named)
    named = names.select(named.alias(key)).where(F.col(key).isNotNull())
    return df.join(named, key, how).select(*df.columns)


def keep_listed(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in ``names``."""
    return _listed(df, names, key, "left_semi")


def drop_listed(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not in ``names``; a null key is on no list."""
    return _listed(df, names, key, "left_anti")
