"""Operator 9: near-duplicates by SimHash, found with an index of byte positions.

Fingerprint: words of the lower-cased text (A-Z only), shingles of ``SHINGLE`` words with
repeats, XXH64 of each; a bit of the fingerprint is 1 if it is 1 in more than half of them.
Two fingerprints are linked if they differ in at most ``BITS`` = 4 bits.

Index: 4 differing bits touch at most 4 of the 8 bytes, so linked fingerprints agree in 4
byte positions or more (the guaranteed minimum).  Lists of single bytes would meet almost
everything with everything; the index therefore has lists of three bytes at three positions
each.  ``TRIPLES`` are 20 of the 56 choices of positions, picked so that any four positions
contain one of them: whoever shares four bytes meets in a list.  In a list the shared bytes
of a pair are tallied, pairs below the minimum are dropped, the others are verified.

Scale: equal fingerprints are one entry, so copies never meet.  A list's entries are sorted
next to each other and worked through block by block; of a large list only links that
connect it (a spanning forest) are put out, found by a search that compares each entry with
those not yet reached, which is fast just where entries are much alike.  Cells of lists that
hold far more than others are cut into blocks, and each pair of blocks is a list of its own,
so every pair still meets.  Components then come from ``components``.

Null and empty texts have fingerprint zero and are linked like any other.  A row without a
doc_id gets a fingerprint but takes no part, and its component is null.  Rows of one
doc_id are one document as far as components go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquary.llm.common import (
    arrow_schema, bit_place, bit_table, in_batches, keep, make_room, rows, ship)
from colloquary.llm.components import components

SHINGLE, SEED, BITS, SHARED = 4, 42, 4, 4
SMALL = 8  # lists up to here are compared pair by pair
CELLS = 1 << 16  # in which list sizes are counted
CROWD, TIMES = 4096, 8  # a cell is crowded above both: entries, times the mean
STRIPE = 1 << 22  # comparisons at a time

_PRINTS = "doc_id bigint, fp bigint"
_LINKS = "a bigint, b bigint"


def _triples() -> list[tuple[int, int, int]]:
    """Positions in three groups; three of one group, or two of one and one of the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    group = {p: i for i, g in enumerate(groups) for p in g}
    out = []
    for chosen in combinations(range(8), 3):
        of = [group[p] for p in chosen]
        pair = next((g for g in of if of.count(g) == 2), None)
        if len(set(of)) == 1 or pair is not None and any(g == (pair + 1) % 3 for g in of):
            out.append(chosen)
    return out


TRIPLES = _triples()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[:len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in
                           zip(starts, ends[shingle - 1:].tolist())], dtype=np.uint64)
    set_bits = np.zeros(64, dtype=np.int64)
    for some in np.array_split(hashes, len(hashes) // 100_000 + 1):
        set_bits += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _printed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    make_room()
    for docs, texts in rows(batches):
        prints = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(prints.view(np.int64))],
            schema=arrow_schema(_PRINTS))


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a bigint) of each row."""
    return in_batches(df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")),
                      partial(_printed, shingle=shingle), _PRINTS)


def shared_bytes(apart: np.ndarray) -> np.ndarray:
    """In how many of 8 positions the bytes agree, given what is apart (exclusive or)."""
    x = apart | apart >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return 8 - np.bitwise_count(x & np.uint64(0x0101010101010101))


def forest(prints: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends of links that connect whatever is connected."""
    left, right = [], []
    waiting = np.arange(len(prints))  # not reached yet
    while len(waiting):
        reached, waiting = waiting[:1], waiting[1:]
        while len(reached) and len(waiting):
            found = []
            step = max(1, STRIPE // max(1, len(waiting)))
            for start in range(0, len(reached), step):
                some = reached[start:start + step]
                near = np.bitwise_count(prints[waiting][None, :] ^ prints[some][:, None]) <= bits
                hit = near.any(axis=0)
                if hit.any():
                    left.append(some[near[:, hit].argmax(axis=0)])
                    right.append(waiting[hit])
                    found.append(waiting[hit])
                    waiting = waiting[~hit]
                    if not len(waiting):
                        break
            reached = np.concatenate(found) if found else waiting[:0]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _met(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links from rows ``list, fp, low`` sorted by list."""

    def links(lists, prints, lows):
        a, b = [], []
        starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        sizes = np.diff(np.r_[starts, len(lists)])
        size_of = np.repeat(sizes, sizes)
        few = (size_of > 1) & (size_of <= SMALL)
        for step in range(1, min(SMALL, len(lists))):
            at = np.flatnonzero(few[:-step] & (lists[:-step] == lists[step:]))
            apart = prints[at] ^ prints[at + step]
            enough = shared_bytes(apart) >= SHARED
            at = at[enough][np.bitwise_count(apart[enough]) <= bits]
            a.append(lows[at])
            b.append(lows[at + step])
        for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            # here verifying is cheaper than tallying, and passes no pair below the minimum
            i, j = forest(prints[start:start + size], bits)
            a.append(lows[start + i])
            b.append(lows[start + j])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)],
            schema=arrow_schema(_LINKS))

    held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new[1] = new[1].view(np.uint64)
        held = [np.concatenate(x) for x in zip(held, new)]
        # the last list may go on in the next batch
        end = int(np.searchsorted(held[0], held[0][-1]))
        if end:
            yield links(*[x[:end] for x in held])
            held = [x[end:] for x in held]
    if len(held[0]):
        yield links(*held)


def _keys() -> Column:
    def key(number: int, positions: tuple[int, int, int]) -> Column:
        out = F.lit(number).cast("bigint")
        for p in positions:
            byte = F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
            out = F.shiftleft(out, 8).bitwiseOR(byte)
        return out

    return F.explode(F.array(*[key(i, t) for i, t in enumerate(TRIPLES)])).alias("list")


def near_links(entries: DataFrame, bits: int = BITS) -> DataFrame:
    """Links ``a, b`` between rows of ``fp, low`` (both unique): enough of those at most
    ``bits`` <= 4 bits apart to connect all that are connected."""
    if bits > BITS:
        raise ValueError(f"the index finds no more than {BITS} differing bits")
    listed = entries.select(_keys(), "fp", "low")
    cell = F.pmod(F.xxhash64("list"), F.lit(CELLS)).cast("int")
    sizes = keep(listed.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(CROWD, TIMES * total // CELLS)
    # no more rows than there are cells
    crowded = F.broadcast(sizes.where(F.col("n") > limit).select(
        "cell", F.ceil(F.col("n") / (limit // 2)).alias("blocks")))
    placed = listed.withColumn("cell", cell).join(crowded, "cell", "left")
    plain = placed.where(F.col("blocks").isNull()).select("list", "fp", "low")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    paired = placed.where(F.col("blocks").isNotNull()).select(
        "list", "fp", "low", own.alias("own"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    paired = paired.select(F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other"))
                           .alias("list"), "fp", "low")
    met = plain.unionByName(paired).repartition("list").sortWithinPartitions("list")
    return in_batches(met, partial(_met, bits=bits), _LINKS)


def near_duplicates(df: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` (the smallest doc_id that can be reached) of each row."""
    prints = keep(fingerprints(df, shingle), "prints")
    entries = keep(prints.where(F.col("doc_id").isNotNull()).groupBy("fp")
                   .agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "entries")
    linked = near_links(entries.select("fp", "low"), bits)
    # a document of several fingerprints links them
    found = components(keep(linked.unionByName(_same_id(prints, entries)), "links"))
    named = keep(entries.join(found, entries.low == found.node, "left").select(
        "fp", F.coalesce("root", "low").alias("component_id")), "named")
    joined = prints.join(named, "fp", "left")
    known = F.col("doc_id").isNotNull()
    return joined.select("doc_id", "fp", F.when(known, F.col("component_id")).alias("component_id"))


def _same_id(prints: DataFrame, entries: DataFrame) -> DataFrame:
    """Links between the fingerprints of rows that share a doc_id, where they differ."""
    several = (prints.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
               .agg(F.min("fp").alias("least"), F.max("fp").alias("most")))
    several = keep(several.where(F.col("least") != F.col("most")).select("doc_id"), "several")
    return (prints.join(several, "doc_id").join(entries, "fp")
            .select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct())


def keep_first(df: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with one document of each component, the one of the smallest ``doc_id``; of
    rows that share this id one stays.  Rows without an id all stay.

    Only documents that may have to go are shuffled; a bit table tells them from the others.
    """
    ship(df.sparkSession)
    found = keep(near_duplicates(df, bits, shingle).where(F.col("doc_id").isNotNull())
                 .groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("rows")), "found")
    stays = F.col("doc_id") == F.col("component_id")
    told = keep(found.where(~stays | (F.col("rows") > 1)).select(
        F.col("doc_id").alias("__doc"), stays.alias("__stays"),
        F.lit(0).cast("bigint").alias("__zero")), "told")
    table = bit_table(told, "__doc", "__zero")

    @F.pandas_udf("boolean")
    def perhaps(doc: pd.Series) -> pd.Series:
        place = bit_place(doc.to_numpy(dtype=np.int64), np.zeros(1, dtype=np.int64))
        return pd.Series(table[place >> 3] >> (place & 7) & 1 == 1)

    doc = F.col("doc_id").cast("bigint")
    flagged = df.withColumn("__told", doc.isNotNull() & perhaps(F.coalesce(doc, F.lit(0))))
    some = flagged.where("__told").join(told, doc == F.col("__doc"), "left")
    one = some.where("__stays").dropDuplicates(["__doc"])
    return reduce(DataFrame.unionAll, [x.select(*df.columns) for x in (
        flagged.where("NOT __told"), some.where(F.col("__stays").isNull()), one)])


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
