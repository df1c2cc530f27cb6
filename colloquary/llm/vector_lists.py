"""Operator 10: approximate nearest neighbours with balanced posting lists.

Fitting, on about ``SAMPLE`` vectors at most (those with the smallest hashes):
the sample is halved again and again, each time across the line between two means and at
the median, so lists come out balanced; a list's centroid is its mean.  There is a list for
every ``LIST`` vectors of the table, up to ``LISTS``.  Centroids are linked to their nearest
ones, and a best-first walk over these links finds the centroids around a vector without
looking at all of them; the links also run through all centroids in a ring, so none is
out of reach.

Indexing covers every row: a vector goes to the list of its nearest centroid and, near a
boundary, to those of up to ``COPIES`` - 1 more whose distance is within ``EDGE`` times that.

Searching: a query looks into the lists whose centroids are within a learnt reach times the
distance of its nearest one, ``FEWEST`` at least.  The reach is ``REACH`` or more: for
``TRIED`` of the queries the true neighbours are found in one pass over the index, and it is
made so wide that a share of ``TARGET`` of them lie in lists that are looked into.  Lists are cut by hash into blocks of about ``BLOCK`` rows, so a
list that draws much of the table (copies of one vector, say) is many tasks, and so are the
queries that come to a list, into blocks of about ``ASKING``; each block of rows meets each
of queries and ranks its rows for them, and only the best k of each travel on.

Distances are computed on the original vectors in double precision; ties go to the smaller
vec_id.  Vectors that are null, zero, or hold a null or a number that is not finite take no
part, nor do rows without an id, nor vectors of another length than most have (of two
lengths equally frequent the smaller counts).  Rows that share a vec_id are one
neighbour, the nearest of them; rows equal in both are one from the start, and blocks and
the sample are dealt by id and vector, so an id may hold much of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquary.llm.common import arrow_schema, in_batches, keep, ship

SAMPLE = 20_000
LIST, LISTS = 500, 4096
BLOCK, ASKING = 4096, 4096
COPIES, EDGE = 3, 1.02
REACH, FEWEST = 1.15, 10
TRIED, TARGET = 256, 0.96
LINKS = 16
LEAST = 24  # centroids a walk looks at before it may stop

_PLACED = "list int, vec_id bigint, embedding array<double>"
_TRUE = "query int, vec_id bigint, score double, list int"
_FOUND = "query_id bigint, vec_id bigint, score double"


def balanced_centroids(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` or up to twice as many equal parts."""
    size = max(1, len(vectors) // max(1, lists))
    todo, out = [np.arange(len(vectors))], []
    while todo:
        part = todo.pop()
        points = vectors[part]
        if len(part) <= size or len(part) < 2:
            out.append(points.mean(axis=0))
            continue
        # far apart to begin with: the point farthest from the mean, and that one's farthest
        a = points[((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        b = points[((points - a) ** 2).sum(axis=1).argmax()]
        for _ in range(6):
            side = points @ (b - a)
            order = np.argsort(side, kind="stable")
            half = len(order) // 2
            a, b = points[order[:half]].mean(axis=0), points[order[half:]].mean(axis=0)
        todo += [part[order[:half]], part[order[half:]]]
    return np.array(out)


class CentroidGraph:
    """Centroids with links to their neighbours, walked best first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        squares = (centroids ** 2).sum(axis=1)
        links: list[set[int]] = [{(i + 1) % n, (i - 1) % n} for i in range(n)]
        for start in range(0, n, 512):
            some = centroids[start:start + 512]
            far = squares[None, :] - 2 * some @ centroids.T
            near = np.argsort(far, axis=1)[:, :LINKS + 1]
            for i, row in enumerate(near.tolist(), start):
                for j in row:
                    if i != j:
                        links[i].add(j)
                        links[j].add(i)
        self.links = [np.array(sorted(x - {i}), dtype=np.int64) for i, x in enumerate(links)]
        self.entries = np.unique(np.linspace(0, n - 1, max(1, int(n ** 0.5)), dtype=np.int64))

    def _distances(self, vector: np.ndarray, some: np.ndarray) -> np.ndarray:
        apart = self.centroids[some] - vector
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))

    def around(self, vector: np.ndarray, ratio: float, fewest: int = 1
               ) -> list[tuple[float, int]]:
        """(distance, centroid) of those within ``ratio`` times the nearest, nearest first, and
        ``fewest`` of those that were looked at in any case."""
        seen = np.zeros(len(self.centroids), dtype=bool)
        seen[self.entries] = True
        found = list(zip(self._distances(vector, self.entries).tolist(), self.entries.tolist()))
        heap: list[tuple[float, int]] = []
        for item in found:
            heappush(heap, item)
        best, walked = min(found)[0], 0
        while heap:
            distance, at = heappop(heap)
            if distance > best * ratio and walked >= LEAST:
                break
            walked += 1
            new = self.links[at][~seen[self.links[at]]]
            if len(new):
                seen[new] = True
                for item in zip(self._distances(vector, new).tolist(), new.tolist()):
                    found.append(item)
                    heappush(heap, item)
                    best = min(best, item[0])
        found.sort()
        return [x for i, x in enumerate(found) if i < fewest or x[0] <= best * ratio]


def _placed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, ratio: float,
            fewest: int, most: int | None) -> Iterator[pa.RecordBatch]:
    graph, kind = CentroidGraph(centroids), arrow_schema(_PLACED)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist()
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(len(ids), -1)
        lists, owner = [], []
        for i, vector in enumerate(vectors):
            near = graph.around(vector, ratio, fewest)[:most]
            lists += [c for _, c in near]
            owner += [i] * len(near)
        dim = vectors.shape[1]
        again = pa.ListArray.from_arrays(
            pa.array(np.arange(0, len(owner) * dim + 1, dim, dtype=np.int32)),
            pa.array(vectors[owner].reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(lists, pa.int32()), pa.array(np.array(ids, dtype=np.int64)[owner]), again],
            schema=kind)


def _ranked(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k ids of a block for each query."""
    if not len(rows) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    rows = rows.sort_values("vec_id", kind="stable")
    ids, points = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy())
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])  # of the rows of each id
    asking = np.stack(queries.embedding.to_numpy())
    squares, out = (points ** 2).sum(axis=1), []
    for query, vector in zip(queries.vec_id.to_numpy(), asking):
        rough = squares - 2 * points @ vector + vector @ vector
        rough[ids == query] = np.inf
        # whatever may be among the best once rounding is taken out
        nearest, most = np.minimum.reduceat(rough, starts), min(k, len(starts))
        limit = np.partition(nearest, most - 1)[most - 1]
        slack = 1e-9 * (1 + squares.max() + vector @ vector)
        some = np.flatnonzero((rough <= limit + slack) & np.isfinite(rough))
        exact = np.sqrt(((points[some] - vector) ** 2).sum(axis=1))
        best = np.lexsort((ids[some], exact))
        best = best[np.sort(np.unique(ids[some][best], return_index=True)[1])[:k]]
        out.append(pd.DataFrame({"query_id": query, "vec_id": ids[some][best],
                                 "score": exact[best]}))
    return pd.concat(out)


def _true(batches: Iterator[pa.RecordBatch], ids: np.ndarray, asking: np.ndarray, k: int
          ) -> Iterator[pa.RecordBatch]:
    """The k nearest ids of each query among these placed rows, with all lists they are in."""
    squares, limit = (asking ** 2).sum(axis=1), np.full(len(asking), np.inf)
    none = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))
    held = [none] * len(asking)
    for batch in batches:
        if not batch.num_rows:
            continue
        lists, own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
        points = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
        sizes = (points ** 2).sum(axis=1)
        rough = squares[:, None] - 2 * asking @ points.T + sizes[None, :]
        slack = 1e-9 * (1 + sizes.max() + squares)
        near = (rough <= (limit ** 2 + slack)[:, None]) & (own[None, :] != ids[:, None])
        for q in np.flatnonzero(near.any(axis=1)).tolist():
            some = np.flatnonzero(near[q])
            exact = np.sqrt(((points[some] - asking[q]) ** 2).sum(axis=1))
            score, vec, at = map(np.concatenate, zip(held[q], (exact, own[some], lists[some])))
            order = np.lexsort((vec, score))
            firsts = np.sort(np.unique(vec[order], return_index=True)[1])
            if len(firsts) >= k:
                limit[q] = score[order[firsts[k - 1]]]
                order = order[score[order] <= limit[q] + 1e-9]
            held[q] = score[order], vec[order], at[order]
    columns = [np.repeat(np.arange(len(held)), [len(x[0]) for x in held])]
    columns += [np.concatenate([none[i]] + [x[i] for x in held]) for i in (1, 0, 2)]
    kind = arrow_schema(_TRUE)
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)


def learnt_reach(placed: DataFrame, asking: pd.DataFrame, centroids: np.ndarray, k: int,
                 least: float) -> float:
    """``least``, or as much more as these queries need to find their neighbours."""
    if not len(asking) or len(centroids) <= FEWEST:
        return least
    vectors = np.stack(asking.embedding.to_numpy())
    found = in_batches(placed, partial(_true, ids=asking.vec_id.to_numpy(), asking=vectors, k=k),
                       _TRUE)
    found = found.groupBy("query", "vec_id", F.round("score", 9).alias("score")).agg(
        F.collect_set("list").alias("lists"))
    found = found.groupBy("query", "vec_id").agg(
        F.min("score").alias("score"), F.min_by("lists", "score").alias("lists"))
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    # k rows a query at most
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ratios = []
    for vector in vectors:
        far = np.sqrt(((centroids - vector) ** 2).sum(axis=1))
        ratio = far / max(far.min(), 1e-300)
        ratio[np.argsort(far, kind="stable")[:FEWEST]] = 0.0  # looked into in any case
        ratios.append(ratio)
    needed = sorted(float(ratios[r["query"]][r["lists"]].min())
                    for r in found.select("query", "lists").collect())
    if not needed:
        return least
    return max(least, needed[int(np.ceil(TARGET * len(needed))) - 1] * (1 + 1e-9))


def usable(df: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    limit = F.lit(float("inf"))
    good = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
            & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
            & F.exists(vector, lambda x: x != 0))
    rows = df.where(F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("bigint"), vector.alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.col("n").desc(), "size").first()
    return rows.where(F.size("embedding") == (top["size"] if top else 0))


def search(df: DataFrame, query: Column, k: int = 10, reach: float = REACH,
           sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row that ``query``
    selects, among all other rows of ``df`` (``vec_id, embedding``).  ``reach`` is the least
    that is looked into."""
    ship(df.sparkSession)
    rows = keep(usable(df).distinct(), "vectors")
    n = rows.count()
    part = int(min(1.0, sample / max(1, n)) * (1 << 32))
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 32)) < part)
    fit = chosen.orderBy("vec_id", "embedding").toPandas()  # about ``sample`` rows at most
    if not len(fit):  # no rows, or too few to be chosen from
        fit = rows.limit(1).toPandas()
    vectors = np.stack(fit.embedding.to_numpy()) if len(fit) else np.zeros((1, 1))
    centroids = balanced_centroids(vectors, min(LISTS, max(1, n // LIST)))
    placed = keep(in_batches(rows, partial(_placed, centroids=centroids, ratio=EDGE, fewest=1,
                                           most=COPIES), _PLACED), "lists")
    tried = rows.where(query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    tried = tried.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIED).toPandas()
    reach = learnt_reach(placed, tried, centroids, k, reach)
    asked = in_batches(rows.where(query), partial(_placed, centroids=centroids, ratio=reach,
                                                  fewest=FEWEST, most=None), _PLACED)
    asked = keep(asked, "asked")

    def blocks(of: DataFrame, size: int, name: str) -> DataFrame:
        return of.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).alias(name))

    # as many rows as there are lists that queries look into
    both = F.broadcast(keep(blocks(placed, BLOCK, "blocks").join(
        blocks(asked, ASKING, "parts"), "list"), "blocks"))

    def dealt(of: DataFrame, own: str, other: str, count: str, others: str) -> DataFrame:
        return of.join(both, "list").select(
            "list", F.pmod(F.xxhash64("vec_id", "embedding"), F.col(count)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(others) - 1)).alias(other),
            "vec_id", "embedding")

    held = dealt(placed, "block", "part", "blocks", "parts")
    asked = dealt(asked, "part", "block", "parts", "blocks")

    def ranked(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return _ranked(rows, queries, k)

    found = held.groupBy("list", "block", "part").cogroup(
        asked.groupBy("list", "block", "part")).applyInPandas(ranked, _FOUND)
    # a vector may have been found in several lists
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
