"""Operator 13: the trie of prefixes that conversations share, summed up by an Euler tour.

A node is a distinct sequence of first turns; it is known by its smallest conversation and its
depth.  Sequences are told apart by 128 bits: two xors of the hashes of (depth, role, text).

Tour.  Every node has an arc that enters it and one that leaves it.  Entering leads to the
node's first child, or out again if it has none; leaving leads into the next sibling, or out of
the parent.  So all arcs are one list, along which a subtree lies between its two arcs: sums
over subtrees are differences of prefix sums along the list.

List ranking.  Arcs are dealt to parts of about ``PART``, and each part shortens the stretches
of the list that lie in it to one arc each, writing down what was ahead of every arc in its
stretch.  Rounds go on with what is left: by turns dealt in the order of ids, where tours mostly
stay together, and by coin, where every arc of tails joins the following one of heads, so that
a quarter or more goes in any case.  What is left of at most ``FEW`` arcs is ranked by the
driver, and the rounds are undone in reverse with one join each.

No group is ever held whole: long conversations are numbered and hashed in pieces, the children
of a busy node are linked in pieces, members are only counted, and the ids of those that end at a
node are joined where a sort has put them, so that a busy node's digest goes over few long
strings in their order.

Rows without a conv_id belong to no conversation.  Turns of equal number are ordered by role and
text, equal rows are turns each.  A null role or text is ''.  An empty table has no nodes.  Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquary.llm.common import arrow_schema, in_batches, keep
from colloquary.plans.skew import (
    HOT, PIECE, HotSplit, by_piece, cut_hot_keys, in_piece, null_safe_join, with_previous)

BORROWED = 6  # a conversation takes fewer turns than this from another
STRETCH = 10_000  # turns of a conversation hashed together
PART = 20_000
FEW = 2_000
IDS = 10_000  # joined to one string
SPLIT = HotSplit(min_rows=250)

KEY = ["depth", "k1", "k2"]


def borrowed(conv_id: Column) -> Column:
    """How many turns are taken from the first conversation of the hundred."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(BORROWED)).cast("bigint")


def _placed(turns: DataFrame, split: HotSplit) -> DataFrame:
    """``conv_id, place, role, text``: places from 1 in each conversation."""
    keys, order = ["conv_id"], ["turn", "role", "text"]
    cut = cut_hot_keys(turns, keys, order, split)
    sizes = cut.where(HOT).groupBy(*keys, PIECE).agg(F.count(F.lit(1)).alias("__n"))
    ahead = sizes.select(*keys, PIECE, F.sum("__n").over(
        by_piece(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("__ahead"))
    # no more pieces than stated in plans.skew
    rows = null_safe_join(cut, F.broadcast(ahead), [*keys, PIECE], "left")
    place = F.row_number().over(in_piece(keys, order)) + F.coalesce("__ahead", F.lit(0))
    return rows.select("conv_id", place.cast("bigint").alias("place"), "role", "text")


def rebuilt(conversations: DataFrame, split: HotSplit = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(``conv_id`` of every conversation, ``conv_id, depth, role, text`` of its turns): the
    first turns of the hundred's first conversation, as many as ``borrowed`` says, then its
    own after as many."""
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).where(F.col("conv_id").isNotNull())
    placed = keep(_placed(turns, split), "placed")
    own = F.col("conv_id")
    names = placed.select("conv_id").distinct()
    first = placed.where(F.col("place") < BORROWED).withColumnRenamed("conv_id", "from")
    wanting = names.select("conv_id", borrowed(own).alias("h"), (own - own % 100).alias("from"))
    taken = wanting.join(first, "from").where(F.col("place") <= F.col("h"))
    got = wanting.join(first.groupBy("from").agg(F.max("place").alias("there")), "from", "left")
    shift = got.select("conv_id", (F.least("h", F.coalesce("there", F.lit(0).cast("bigint")))
                                   - F.col("h")).alias("shift"))
    kept = placed.where(F.col("place") > borrowed(own)).join(shift, "conv_id")
    return names, taken.select("conv_id", F.col("place").alias("depth"), "role", "text").unionAll(
        kept.select("conv_id", (F.col("place") + F.col("shift")).alias("depth"), "role", "text"))


def _prefixes(turns: DataFrame, stretch: int) -> DataFrame:
    """Digest of every prefix: ``conv_id, depth, k1, k2, p1, p2, chars``; p is the parent's."""
    told = turns.select(
        "conv_id", "depth", F.xxhash64("depth", "role", "text").alias("h1"),
        F.xxhash64(F.lit("again"), "text", "depth", "role").alias("h2"),
        F.length("text").cast("bigint").alias("chars"),
        F.floor(F.col("depth") / stretch).alias("stretch"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = told.groupBy("conv_id", "stretch").agg(
        F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    carried = whole.select("conv_id", "stretch", *[
        F.bit_xor(f"b{i}").over(before).alias(f"c{i}") for i in (1, 2)])
    # both sides are dealt by conversation and stretch as the window is
    rows = told.withColumns({f"k{i}": F.bit_xor(f"h{i}").over(inside) for i in (1, 2)}).join(
        carried, ["conv_id", "stretch"])
    keys = [F.col(f"k{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("bigint"))).alias(f"k{i}")
            for i in (1, 2)]
    return rows.select("conv_id", "depth", "h1", "h2", "chars", *keys).select(
        "conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "chars")


_ENDS = "depth bigint, k1 bigint, k2 bigint, first bigint, ids string"
_DIGESTS = "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Ids of each node, sorted by node and id, joined by commas, at most so many."""
    kind = arrow_schema(_ENDS)
    node, ids = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([v]) for v in (*node, ids[0], ",".join(map(str, ids)))], schema=kind)

    for batch in batches:
        for *at, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if ids and (at != node or len(ids) >= most):
                yield out()
                ids = []
            node = at
            ids.append(conv)
    if ids:
        yield out()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's strings, which come one after the other."""
    kind = arrow_schema(_DIGESTS)
    node, sha = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([v]) for v in (*node, sha.hexdigest())], schema=kind)

    for batch in batches:
        for i in range(batch.num_rows):
            *at, _, ids = (c[i].as_py() for c in batch.columns)
            if at != node:
                if sha:
                    yield out()
                node, sha = at, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if sha:
        yield out()


def _ends(prefixes: DataFrame, ids: int) -> DataFrame:
    """Digest of the conversations that end at each node at which some do."""
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), F.col("depth")).alias("at"))
    last = last.select("at.*", "conv_id")
    joined = in_batches(last.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(
        *KEY, "conv_id"), partial(_joined, most=ids), _ENDS)
    return in_batches(joined.repartition(*KEY).sortWithinPartitions(*KEY, "first"),
                      _digested, _DIGESTS)


# an arc (or a stretch of them, by its first): conversation and 2 * depth, or that + 1 for
# leaving; the arc that follows; what the stretch adds to the two sums
_ARCS = "c bigint, e bigint, nc bigint, ne bigint, leaves bigint, saved bigint"
_AHEAD = "c bigint, e bigint, hc bigint, he bigint, leaves bigint, saved bigint, head boolean, " \
         "nc bigint, ne bigint, all_leaves bigint, all_saved bigint"


def _stretches(arcs: list[tuple]) -> Iterator[tuple]:
    """The list's stretches among these arcs: per arc, its stretch's first and the sums ahead
    of it; with the first, what follows the stretch and its sums."""
    at = {(c, e): i for i, (c, e, *_) in enumerate(arcs)}
    follows = [at.get((nc, ne), -1) for _, _, nc, ne, _, _ in arcs]
    inner = set(follows)
    for start in range(len(arcs)):
        if start in inner:
            continue
        head, members, leaves, saved, i = arcs[start][:2], [], 0, 0, start
        while True:
            members.append((*arcs[i][:2], *head, leaves, saved))
            leaves, saved = leaves + arcs[i][4], saved + arcs[i][5]
            if follows[i] < 0:
                break
            i = follows[i]
        for k, member in enumerate(members):
            first = k == 0
            yield (*member, first, *(arcs[i][2:4] if first else (None, None)),
                   leaves if first else None, saved if first else None)


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = arrow_schema(_AHEAD)
    arcs = [arc for batch in batches for arc in zip(*[c.to_pylist() for c in batch.columns])]
    rows = list(_stretches(arcs))
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def _heads(c: str, e: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), c, e), F.lit(2)) == 1


def rank(arcs: DataFrame, part: int = PART, few: int = FEW) -> DataFrame:
    """``c, e, leaves, saved``: the sums ahead of every arc on the list."""
    spark = arcs.sparkSession
    rounds: list[DataFrame] = []
    left = arcs
    n = left.count()
    while n > few:
        parts = -(-n // part)
        turn = len(rounds)
        if turn % 2 == 0:
            dealt = left.repartitionByRange(parts, "c", "e")
        else:
            joins = ~_heads("c", "e", turn) & F.coalesce(_heads("nc", "ne", turn), F.lit(False))
            dealt = left.withColumns({
                "__c": F.when(joins, F.col("nc")).otherwise(F.col("c")),
                "__e": F.when(joins, F.col("ne")).otherwise(F.col("e"))}).repartition(
                parts, "__c", "__e").select(*left.columns)
        done = keep(in_batches(dealt, _shortened, _AHEAD), "stretches")
        rounds.append(done.select("c", "e", "hc", "he", "leaves", "saved"))
        left = done.where("head").select(
            "c", "e", "nc", "ne", F.col("all_leaves").alias("leaves"),
            F.col("all_saved").alias("saved"))
        n = left.count()
    rest = [tuple(r) for r in left.collect()]  # at most few
    ranked = [(c, e, leaves, saved) for c, e, _, _, leaves, saved, *_ in _stretches(rest)]
    found = spark.createDataFrame(ranked, "c bigint, e bigint, leaves bigint, saved bigint")
    for members in reversed(rounds):
        ahead = found.select(F.col("c").alias("hc"), F.col("e").alias("he"),
                             F.col("leaves").alias("__leaves"), F.col("saved").alias("__saved"))
        found = keep(members.join(ahead, ["hc", "he"]).select(
            "c", "e", (F.col("leaves") + F.col("__leaves")).alias("leaves"),
            (F.col("saved") + F.col("__saved")).alias("saved")), "ranked")
    return found


def prefix_trie(conversations: DataFrame, split: HotSplit = SPLIT, stretch: int = STRETCH,
                part: int = PART, few: int = FEW, ids: int = IDS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` of every node."""
    zero = F.lit(0).cast("bigint")
    names, turns = rebuilt(conversations, split)
    roots = names.select("conv_id", *[zero.alias(c) for c in (*KEY, "p1", "p2", "chars")])
    prefixes = keep(_prefixes(turns, stretch).unionByName(roots), "prefixes")
    nodes = keep(prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2")), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"),
                           F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # parents are distinct; adaptive execution splits the children of a busy one
    nodes = keep(nodes.join(parents, ["depth", "p1", "p2"], "left"), "with-parents")
    inner = nodes.where(F.col("depth") > 0).select(
        "conv_id", "depth", "parent_conv_id", (-F.col("conv_id")).alias("back"))
    under = ["parent_conv_id", "depth"]
    linked = with_previous(cut_hot_keys(inner, under, ["back"], split), under, ["back"],
                           ["conv_id"], "__after").select(
        "conv_id", "depth", F.col("__after.conv_id").alias("sibling"))
    below = inner.groupBy(*under).agg(
        F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("child")).select(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"),
        "n_children", "child")
    nodes = keep(nodes.join(linked, ["conv_id", "depth"], "left")
                 .join(below, ["conv_id", "depth"], "left")
                 .withColumn("n_children", F.coalesce("n_children", zero)), "linked")
    d = F.col("depth")
    leaf, saved = (F.col("n_children") == 0), (F.col("n_convs") - 1) * F.col("chars")
    entering = nodes.select(
        F.col("conv_id").alias("c"), (2 * d).alias("e"), F.coalesce("child", "conv_id").alias("nc"),
        F.when(leaf, 2 * d + 1).otherwise(2 * d + 2).alias("ne"),
        leaf.cast("bigint").alias("leaves"), saved.alias("saved"))
    leaving = nodes.select(
        F.col("conv_id").alias("c"), (2 * d + 1).alias("e"),
        F.coalesce("sibling", "parent_conv_id").alias("nc"),
        F.when(F.col("sibling").isNotNull(), 2 * d).when(d > 0, 2 * d - 1).alias("ne"),
        zero.alias("leaves"), zero.alias("saved"))
    ranked = rank(entering.unionAll(leaving), part, few)
    leaves = F.col("e") % 2 == 1
    # what is ahead of the arc that leaves, less what is ahead of the one that enters
    sums = ranked.groupBy(F.col("c").alias("conv_id"), F.floor(F.col("e") / 2).alias("depth")).agg(*[
        F.sum(F.when(leaves, F.col(a)).otherwise(-F.col(a))).alias(b)
        for a, b in (("leaves", "n_leaves"), ("saved", "saved_tokens"))])
    nothing = hashlib.sha256(b"").hexdigest()
    return (nodes.join(sums, ["conv_id", "depth"]).join(_ends(prefixes, ids), KEY, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))
