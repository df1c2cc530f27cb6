"""Operator 12: whitening directions of embeddings.

Every entry becomes a whole number, ``floor(256 * entry)``; each distinct vector counts once.
Rows of these, less their means, are factored block by block (QR), each part keeping one
triangle, and triangles are factored together in a tree until one is left.  That triangle has
the singular values and right vectors of the whole table: it is brought to bidiagonal form by
reflections, dqds finds its singular values, twisted factorisations its vectors
(``bidiagonal``).  No product of the rows with themselves is formed, so small directions are
found as accurately as large ones.

Sums are exact: of numbers cut into 26 low bits and the rest, added up as decimals.  What is
sent or broadcast depends on the number of dimensions only.

Rows whose vector is null or has a null, infinite or undefined entry are dropped.  Vectors
shorter than the longest are continued with zeros.  Entries beyond a long are taken as the
largest long.  Rows that repeat are returned each, and fit once.  There are no more components
than directions in which the vectors differ (none for one vector or for equal ones, hence no
rows).  A deviation that doesn't fit a long is null.  An empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquary.llm.bidiagonal import principal
from colloquary.llm.common import arrow_schema, in_batches, keep

COMPONENTS = 4
SCALE = 256
ROWS = 4096  # factored at a time
FAN = 16  # triangles factored together
_LOW = 26

SCHEMA = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
          "explained double, identity_error double")


def whole_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: vectors without null or non-finite entries, in whole numbers."""
    vector = F.col("embedding").cast("array<double>")
    return df.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("x")).where(
        F.col("x").isNotNull() & F.forall(
            "x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    ).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, low, high = 0, None, None
    for batch in batches:
        x = _matrix(batch.column(0))
        if len(x):
            n += len(x)
            sums = (x & ((1 << _LOW) - 1)).sum(axis=0), (x >> _LOW).sum(axis=0)
            low, high = sums if low is None else (low + sums[0], high + sums[1])
    if n:
        d = len(low)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(low),
             pa.array(high)], names=["at", "n", "low", "high"])


def _triangle(rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(rows), mode="r")


_PART = "part bigint, r binary"


def _told(r: np.ndarray, d: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([crc32(r.tobytes())]), pa.array([r.reshape(-1, d).tobytes()], pa.binary())],
        schema=arrow_schema(_PART))


def _factored(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The triangle of a part's rows less the means."""
    d, held, waiting = len(mean), [], 0
    for batch in batches:
        x = _matrix(batch.column(0))
        for start in range(0, len(x), ROWS):
            held.append(x[start:start + ROWS].astype(float) - mean)
            waiting += len(held[-1])
            if waiting >= max(ROWS, 4 * d):
                held, waiting = [_triangle(held)], 0
    if held:
        yield _told(_triangle(held), d)


def _together(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    r = None
    for batch in batches:
        for raw in batch.column("r").to_pylist():
            other = np.frombuffer(raw).reshape(-1, d)
            r = other if r is None else _triangle([r, other])
    if r is not None:
        yield _told(r, d)


def _squared(batches: Iterator[pa.RecordBatch], mean: np.ndarray, onto: np.ndarray
             ) -> Iterator[pa.RecordBatch]:
    """Sums of whitened rows and of their products."""
    k = onto.shape[1]
    sums, products = np.zeros(k), np.zeros((k, k))
    for batch in batches:
        x = _matrix(batch.column(0))
        if len(x):
            y = (x.astype(float) - mean) @ onto
            sums += y.sum(axis=0)
            products += y.T @ y
    flat = np.concatenate([sums, products.ravel()])
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["at", "value"])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2, exactly."""
    most = float(np.abs(x.astype(float)).max(initial=0.0)) * n + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 2.0**62:
        apart = n * x - np.array(sums, dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def _whitened(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], mean: np.ndarray,
              onto: np.ndarray, explained: list[float], error: float
              ) -> Iterator[pa.RecordBatch]:
    kind, k = arrow_schema(SCHEMA), onto.shape[1]
    for batch in batches:
        x = _matrix(batch.column("x"))
        m = len(x)
        if not m:
            continue
        y = (x.astype(float) - mean) @ onto
        each = np.repeat(np.arange(m), k)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(each)),
             pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
             pa.array(np.full(m * k, n)),
             pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)),
             pa.array(y.ravel()), pa.array(np.tile(explained, m)),
             pa.array(np.full(m * k, error))], schema=kind)


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row of
    ``vec_id, embedding`` that takes part and each of the first components."""
    spark = df.sparkSession
    nothing = spark.createDataFrame([], SCHEMA)
    vectors = whole_vectors(df, scale)
    d = vectors.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return nothing
    vectors = vectors.select("vec_id", F.concat(
        "x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(d) - F.size("x"))).alias("x"))
    fit = keep(vectors.select("x").distinct(), "distinct-vectors")
    exact = {c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")}
    counted = in_batches(fit, _summed, "at int, n bigint, low bigint, high bigint").groupBy(
        "at").agg(F.sum("n").alias("n"), *exact.values()).orderBy("at").collect()  # d rows
    n = counted[0]["n"]
    sums = [(int(r["high"]) << _LOW) + int(r["low"]) for r in counted]
    mean = np.array([s / n for s in sums])
    triangles = keep(in_batches(fit, partial(_factored, mean=mean), _PART), "triangles")
    left = triangles.count()
    while left > FAN:
        left = -(-left // FAN)
        triangles = keep(in_batches(triangles.repartition(left, "part"),
                                    partial(_together, d=d), _PART), "triangles")
    parts = sorted(bytes(r["r"]) for r in triangles.select("r").collect())  # at most FAN
    r = _triangle([np.frombuffer(p).reshape(-1, d) for p in parts])
    r = np.concatenate([r, np.zeros((max(0, d - len(r)), d))])
    values, basis = principal(r, components)
    values = values / n
    k = basis.shape[1]
    if not k:
        return nothing
    onto = basis / np.sqrt(values[:k])
    found = in_batches(fit, partial(_squared, mean=mean, onto=onto), "at int, value double"
                       ).groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    flat = np.array([row["value"] for row in found]) / n
    spread = flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k])
    error = float(np.abs(spread - np.eye(k)).max())
    return in_batches(vectors, partial(
        _whitened, n=n, sums=sums, mean=mean, onto=onto,
        explained=(values[:k] / values.sum()).tolist(), error=error), SCHEMA)
