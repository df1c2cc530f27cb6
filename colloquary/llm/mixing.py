"""Operator 6: mix sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; the ratio target / size is the number of
copies that each of its documents ought to have.  Whole copies are given at once; the
fractions are rounded by the pivotal method: two documents with fractions meet, and words
move from one to the other, in a random direction with such odds that nobody's expected
number of copies changes, until one of the two has no fraction any more.  What is moved are
words, not copies, so the words taken from a source stay what they were.

The documents of a source are dealt by hash to blocks of about ``BLOCK`` rows (sources of a
single block share a task, each for itself); a block ends with one document that still has
a fraction, and those meet in a tree, ``FAN`` blocks at a time, until each source has a
single one left.  Of that document the fraction is taken as
its first words, so that the source's words are the target to within one.

Whatever is random is a hash of document ids and the seed, and documents meet in the
order of such hashes; rows of one id are told apart by their number and size only.  So
reruns agree, on any cluster.  Texts are read once, to count their words, and are not
shuffled; a source that owns most of the rows is many blocks.

Null texts have no words, and rows without words take none.  A null source is a source of
its own, the last.  No source has words, or no rows at all: nothing is taken.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquary.llm.common import keep, ship, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2.0  # times a source's words
BLOCK, FAN = 4096, 64
SEED = 7

_STATE = ("doc_id bigint, n bigint, source string, size bigint, source_size bigint, "
          "target double, whole bigint, fraction double, block bigint, blocks bigint")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the place of each row in the order, from 0, without a task that sees all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = keep(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, starts = 0, {}
    for part_no, n in sorted(sizes):  # one row per partition
        starts[part_no], before = before, before + n
    start = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in starts.items()
                                        for x in kv]), part) if starts else F.lit(0)
    return ranged.withColumn(name, start + F.col("__at") - F.shiftleft(part, 33)).drop("__at")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights repeat along the sources in order of code points, null last.  All targets
    together are ``share`` of all words; a target stops at ``most`` times its source, and
    what it can't take goes to the others by weight.
    """
    # UTF-8 bytes sort as code points do; null last
    order = [F.col("source").isNull(), F.col("source")]
    placed = numbered(sizes, order, "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]),
                   F.pmod("place", F.lit(len(weights))).cast("int"))
    placed = keep(placed.select("source", "source_size", weight.alias("weight"),
                                (F.col("source_size") * most).alias("cap")), "weights")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:  # every turn finds at least one more source that is full, or ends
        is_full = F.col("cap") <= F.col("weight") * level
        taken, open_weight, now = placed.agg(
            F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(is_full, F.lit(0.0)).otherwise(F.col("weight"))),
            F.count_if(is_full)).first()
        if now == full or not open_weight:
            break
        full, level = now, (share * total - taken) / open_weight
    target = F.least(F.col("cap"), F.col("weight") * level)
    if full is not None and not open_weight:
        target = F.col("cap")
    return placed.select("source", "source_size", target.alias("target"))


def _chance(*parts) -> float:
    """A number in [0, 1) that depends on nothing but the arguments."""
    return xxhash.xxh64_intdigest("|".join(map(str, parts))) / 2**64


def pivot(sizes: list[int], fractions: list[float], names: list, seed: int
          ) -> tuple[list[float], int | None]:
    """Round fractions one against the next.  Returns them, and the place of the one that may
    be left with a fraction."""
    out, held = list(fractions), None
    for i, fraction in enumerate(out):
        if not 0.0 < fraction < 1.0:
            continue
        if held is None:
            held = i
            continue
        a, b = sizes[held], sizes[i]
        # words that can move from the held one to this one, and back
        there = min(out[held] * a, (1.0 - fraction) * b)
        back = min((1.0 - out[held]) * a, fraction * b)
        if _chance(seed, names[held], names[i]) * (there + back) < back:
            move, empty, filled = there, out[held] * a <= (1.0 - fraction) * b, False
        else:
            move, empty, filled = -back, False, (1.0 - out[held]) * a <= fraction * b
        left, right = out[held] - move / a, fraction + move / b
        if empty or filled:  # the held one is done, this one goes on
            out[held], out[i] = (0.0 if empty else 1.0), min(1.0, max(0.0, right))
            held = i if 0.0 < out[i] < 1.0 else None
        else:
            out[i], out[held] = (1.0 if move > 0 else 0.0), min(1.0, max(0.0, left))
            held = held if 0.0 < out[held] < 1.0 else None
    return out, held


def _rounding(seed: int, level: int):
    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        """Rows of one block of a large source, or all of many small ones."""
        rank = [_chance(seed, level, d, n) for d, n in zip(group.doc_id, group.n)]
        own = pd.factorize(group.source, use_na_sentinel=False)[0]
        group = group.assign(own=own, rank=rank).sort_values(["own", "rank", "doc_id", "n"],
                                                             kind="stable")
        names = list(zip(group.doc_id.tolist(), group.n.tolist()))
        sizes, fractions = group["size"].tolist(), group.fraction.tolist()
        ends = (group.own.diff() != 0).to_numpy().nonzero()[0].tolist() + [len(group)]
        out: list[float] = []
        for start, end in zip(ends, ends[1:]):
            out += pivot(sizes[start:end], fractions[start:end], names[start:end],
                         seed + level)[0]
        return group.assign(fraction=out).drop(columns=["own", "rank"])
    return rounded


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
        most: float = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, n, source, size, source_size, target, taken``, a row for each row of ``df``
    (``doc_id, source, text``); ``n`` numbers rows of one id and size.

    ``taken`` is the number of words the mix takes: ``taken // size`` whole copies, and the
    first words of one more for a single document of each source.
    """
    spark = df.sparkSession
    ship(spark)
    sized = df.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"),
                      word_count("text").alias("size"))
    # rows that repeat are one row with a number, so that they can be told apart
    sized = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    sized = keep(sized.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1))
                              .alias("n")).drop("rows"), "sizes")
    per_source = keep(sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "sources")
    targets = source_targets(per_source.drop("rows"), weights, share, most)
    # blocks of a source by its own rows
    counted = per_source.select(F.col("source").alias("__source"),
                                F.ceil(F.col("rows") / BLOCK).alias("blocks"))
    named = keep(targets.join(counted, targets.source.eqNullSafe(counted["__source"]))
                 .drop("source"), "targets")
    # no hint: the two sides are joined by what their sizes turn out to be
    wanted = sized.join(named, sized.source.eqNullSafe(named["__source"]), "left").drop("__source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio)
    rows, blocks = per_source.agg(F.coalesce(F.sum("rows"), F.lit(0)),
                                  F.ceil(F.coalesce(F.max("rows"), F.lit(0)) / BLOCK)).first()
    pools = max(1, -(-rows // BLOCK))
    state = wanted.select(
        "doc_id", "n", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, whole).otherwise(0).cast("bigint").alias("whole"),
        F.when(F.col("size") > 0, ratio - whole).otherwise(0.0).alias("fraction"),
        F.pmod(F.xxhash64("doc_id", "n", F.lit(seed)), F.col("blocks")).alias("block"), "blocks")
    state = keep(state, "fractions")
    is_open = (F.col("fraction") > 0) & (F.col("fraction") < 1)
    done, level, open_rows = [state.where(~is_open)], 0, state.where(is_open)
    while True:
        # a block of a large source is a group; small sources share groups of about as many rows
        small, last = F.col("blocks") <= 1, blocks <= 1
        grouped = open_rows.groupBy(
            F.when(~small, F.col("source")), F.when(~small, F.col("block")),
            F.when(small, F.pmod(F.xxhash64("source"), F.lit(pools))))
        rounded = keep(grouped.applyInPandas(_rounding(seed, level), _STATE), "rounded")
        if last:
            done.append(rounded)  # with the last open one of each source
            break
        done.append(rounded.where(~is_open | small))
        open_rows = rounded.where(is_open & ~small).withColumns({
            "block": F.floor(F.col("block") / FAN), "blocks": F.ceil(F.col("blocks") / FAN)})
        blocks, pools, level = -(-blocks // FAN), max(1, pools // FAN), level + 1
    copies = F.col("whole") + F.col("fraction")
    return reduce(DataFrame.unionByName, done).select(
        "doc_id", "n", "source", "size", "source_size", "target",
        F.round(copies * F.col("size")).cast("bigint").alias("taken"))


def take(df: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``df`` (``doc_id, source, text`` and others) that ``mixed``, made by ``mix``
    from it, takes: each as often as it has whole copies, and the first words, one blank
    apart, of those that are taken in part."""
    def keys(doc: Column, source: Column) -> list[Column]:
        # without nulls, so that window and join agree on one shuffle
        return [F.coalesce(doc, F.lit(0)).alias("__doc"), doc.isNull().alias("__no_doc"),
                F.coalesce(source, F.lit("")).alias("__source"),
                source.isNull().alias("__no_source")]

    by = ["__doc", "__no_doc", "__source", "__no_source", "__size"]
    wanted = mixed.where("taken > 0").select(
        *keys(F.col("doc_id"), F.col("source")), F.col("size").alias("__size"), "n", "taken")
    wanted = wanted.groupBy(*by).agg(F.map_from_entries(
        F.collect_list(F.struct("n", "taken"))).alias("__taken"))
    doc, source = F.col("doc_id").cast("bigint"), F.col("source").cast("string")
    have = df.select("*", *keys(doc, source), word_count("text").alias("__size"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("text"))) - 1
    have = have.withColumn("__n", number.cast("bigint"))
    met = have.join(wanted, by).withColumn("__take", F.try_element_at("__taken", F.col("__n")))
    met = met.where(F.col("__take").isNotNull())
    whole, rest = F.floor(F.col("__take") / F.col("__size")), F.col("__take") % F.col("__size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("bigint"), whole.cast("int")),
                      F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    met = met.withColumn("__words", F.explode(copies))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    part = F.array_join(F.slice(words, 1, F.col("__words").cast("int")), " ")
    return met.withColumn("text", F.when(F.col("__words") > 0, part).otherwise(F.col("text"))
                          ).select(*df.columns)
