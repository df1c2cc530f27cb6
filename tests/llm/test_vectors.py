"""Posting lists against a full search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquary.llm import vector_lists


def table(spark, rows):
    return spark.createDataFrame(
        rows, "vec_id bigint, embedding array<float>, label int").withColumn("list", F.lit("x"))


def full_search(rows, asked, k=10):
    usable = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows
              if i is not None and v is not None}
    out = {}
    for q in asked:
        near = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), i)
                      for i, v in usable.items() if i != q)
        out[q] = near[:k]
    return out


def vectors(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[i % 12] + rng.normal(size=dim) * 0.6).astype(np.float32).tolist())
            for i in range(n)]


def test_recall_and_scores(spark):
    rows = vectors(4000)
    got = vector_lists.search(table(spark, [(i, v, 0) for i, v in rows]),
                              F.col("vec_id") % 100 == 0).collect()
    want = full_search(rows, range(0, 4000, 100))
    hits = 0
    for q, near in want.items():
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        exact = dict((i, d) for d, i in full_search(rows, [q], 4000)[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in mine)
        assert [m[1:][::-1] for m in mine] == sorted(m[1:][::-1] for m in mine)
        hits += len({i for _, i in near} & {m[1] for m in mine})
    assert hits >= 0.95 * 10 * len(want)


def test_small_and_awkward_tables(spark):
    odd = [(None, [1.0, 2.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0),
           (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [1.0, 2.0, 3.0], 0),
           (0, [1.0, 1.0], 0), (7, [2.0, 2.0], 0), (8, [2.0, 2.0], 0), (8, [9.0, 9.0], 0),
           (9, [], 0)]
    got = vector_lists.search(table(spark, odd), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == [
        (0, 1, 7, round(2 ** 0.5, 9)), (0, 2, 8, round(2 ** 0.5, 9))]
    for rows in ([], [(1, None, 0)], [(0, [1.0], 0)]):
        assert vector_lists.search(table(spark, rows), F.col("vec_id") % 100 == 0).count() == 0


def test_ties_and_a_vector_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(vector_lists, "BLOCK", 100)
    rows = vectors(900) + [(i, [0.5] * 16) for i in range(900, 1500)]
    got = vector_lists.search(table(spark, [(i, v, 0) for i, v in rows]),
                              F.col("vec_id").isin(900, 1400)).collect()
    for q, first in ((900, 901), (1400, 900)):
        assert [(r.vec_id, r.score) for r in sorted(
            (r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [
                (first + k, 0.0) for k in range(10)]


def test_lists_are_balanced_and_the_graph_finds_them():
    points = np.array([v for _, v in vectors(3000)])
    centroids = vector_lists.balanced_centroids(points, 50)
    assert 50 <= len(centroids) <= 128
    graph = vector_lists.CentroidGraph(centroids)
    for p in points[:200]:
        far = np.sqrt(((centroids - p) ** 2).sum(axis=1))
        near = [c for _, c in graph.around(p, 1.2)]
        assert near[0] == far.argmin()
        want = set(np.flatnonzero(far <= far.min() * 1.2 - 1e-12).tolist())
        assert len(want & set(near)) >= 0.9 * len(want)


def test_recall_where_lists_are_really_pruned(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(8000, 8)).astype(np.float32))]
    want = full_search(rows, range(0, 8000, 100))
    for size in (80, 20, 8):  # from ten times FEWEST lists on
        monkeypatch.setattr(vector_lists, "LIST", size)
        got = vector_lists.search(table(spark, [(i, v, 0) for i, v in rows]),
                                  F.col("vec_id") % 100 == 0, sample=1000).collect()
        hits = sum(len({i for _, i in near} & {r.vec_id for r in got if r.query_id == q})
                   for q, near in want.items())
        assert hits >= 0.9 * 10 * len(want)


def test_an_id_that_many_rows_share(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)).astype(np.float32))]
    near = rows[0][1]
    many = [(1000, [x + 1e-3 * j for x in near]) for j in range(1, 40)] + [(1001, near)] * 40
    got = vector_lists.search(table(spark, [(i, v, 0) for i, v in rows + many]),
                              F.col("vec_id") == 0).collect()
    nearest = {}
    for i, v in rows[1:] + many:
        d = float(np.sqrt(((np.array(v, np.float32).astype(float) - np.array(near)) ** 2).sum()))
        nearest[i] = min(d, nearest.get(i, d))
    want = sorted((d, i) for i, d in nearest.items())[:10]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [
        (i, pytest.approx(d, abs=1e-12)) for d, i in want]


def test_queries_of_a_list_are_cut_as_well(spark, monkeypatch):
    ranked = vector_lists._ranked

    def told(rows, queries, k):
        assert len(queries) <= 60, len(queries)
        return ranked(rows, queries, k)

    rows = vectors(300) + [(i, [0.5] * 16) for i in range(300, 600)]
    monkeypatch.setattr(vector_lists, "_ranked", told)
    monkeypatch.setattr(vector_lists, "ASKING", 30, raising=False)
    monkeypatch.setattr(vector_lists, "BLOCK", 100)
    got = vector_lists.search(table(spark, [(i, v, 0) for i, v in rows]),
                              F.col("vec_id") % 2 == 0).collect()
    want = full_search(rows, range(0, 600, 2))
    assert len(got) == 10 * len(want)
    for q, near in want.items():
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q),
                                         key=lambda r: r["rank"])] == [i for _, i in near]
