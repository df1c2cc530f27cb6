"""Operator 7: toxicity by maximum-scoring segments.

Learning, from about ``ROWS`` labelled texts at most (those with the smallest hashes of
their ids):

* For each word, and for the first ``STEM`` letters of each, it is counted in how many toxic
  and clean texts it stands.  Log-odds have Dirichlet priors in two stages: a stem's toxic
  share is drawn towards the share of all, a word's towards its stem's.  So a word that was
  never seen speaks as its stem does.
* Words and stems fall into ``CELLS`` cells by hash, which bounds the model for any corpus.

Scoring: each word gives its log-odds less ``DRIFT``, so that ordinary text falls.  A scan
of linear time finds every maximal segment, that is, one that no shorter or longer segment
around beats.  In random text the best segment follows an extreme-value law: in a text of n
words a score of S or more is expected K n exp(-lambda S) times.  ``lambda`` solves
sum(p exp(lambda s)) = 1 over the words of clean labelled texts, K is fitted to their best
segments.  Segments expected less than ``SIGNIFICANT`` times count as toxic passages; a
text is described by the surprise of its best segment and by the sum over its passages, and
a logistic curve, fitted to the labelled texts, turns this into a probability.

Null and empty texts have no passages and get the score of that.  With labels of one class
or without any, every score is that class, or 0.  Only texts are looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquary.llm.common import arrow_schema, in_batches, keep, rows

CELLS = 1 << 18
STEM = 4
PRIOR = 5.0  # texts that each prior weighs
DRIFT = 1.0
SIGNIFICANT = 0.05
ROWS = 40_000
LIMIT = 500_000  # words remembered per worker

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def cell(word: str) -> int:
    return crc32(word.encode()) % CELLS


def stem_cell(word: str) -> int:
    return crc32(b"\x00" + word[:STEM].encode()) % CELLS


class Cells(dict):
    """word -> (cell, stem's cell), worked out once"""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > LIMIT:
            self.clear()
        self[word] = found = (cell(word), stem_cell(word))
        return found


@dataclass
class Model:
    toxic: np.ndarray  # texts, by cell of a word
    seen: np.ndarray
    stem_share: np.ndarray  # toxic share, by cell of a stem
    share: float
    decay: float = 1.0  # lambda
    rate: float = 1.0  # K
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0)
    constant: float | None = None

    def __post_init__(self):
        self.known: dict[str, float] = {}

    @staticmethod
    def of(counts: np.ndarray) -> Model:
        """From ``counts[kind, label, cell]``; kind 0 are stems, 1 are words."""
        stems, words = counts[0].astype(np.float64), counts[1].astype(np.float32)
        share = (stems[1].sum() + 1) / (stems.sum() + 2)
        stem_share = (stems[1] + PRIOR * share) / (stems.sum(axis=0) + PRIOR)
        return Model(words[1], words[0] + words[1], stem_share.astype(np.float32), float(share))

    def value(self, word: str) -> float:
        at = cell(word)
        p = ((self.toxic[at] + PRIOR * self.stem_share[stem_cell(word)])
             / (self.seen[at] + PRIOR))
        return float(np.log(p / (1 - p)) - np.log(self.share / (1 - self.share))) - DRIFT

    def values(self, words: list[str]) -> list[float]:
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.value(w)
        out = [known[w] for w in words]
        if len(known) > LIMIT:
            known.clear()
        return out


def maximal_segments(values: list[float]) -> list[tuple[int, int, float]]:
    """(start, end, score) of every maximal scoring segment, in one scan of linear time.

    Candidates are kept with the totals before and behind them.  A new one is joined with
    the last that begins lower, if it ends higher than that one does.  Each knows which
    candidate that is, so that none is passed twice; one that begins lower than all before
    makes those final.
    """
    final: list[tuple[int, int, float]] = []
    held: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, v in enumerate(values):
        low, total = total, total + v
        if v <= 0:
            continue
        start, at = i, len(held) - 1
        while True:
            while at >= 0 and held[at][2] >= low:
                at = held[at][4]
            if at < 0:
                final += [(s, e, high - lo) for s, e, lo, high, _ in held]
                held = [(start, i + 1, low, total, -1)]
                break
            if held[at][3] >= total:
                held.append((start, i + 1, low, total, at))
                break
            start, _, low, _, before = held[at]
            del held[at:]
            at = before
    return final + [(s, e, high - lo) for s, e, lo, high, _ in held]


def decay_of(values: np.ndarray, share: np.ndarray) -> float:
    """The positive solution of sum(share exp(x values)) = 1."""
    if not (values > 0).any() or (values * share).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (share * np.exp(np.minimum(high * values, 700.0))).sum() < 1 and high < 1e3:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        if (share * np.exp(np.minimum(middle * values, 700.0))).sum() < 1:
            low = middle
        else:
            high = middle
    return high


def describe(model: Model, text: str | None) -> tuple[float, float, int]:
    """Surprise of the best segment, of all significant ones, and how many those are.

    Surprise is -log of the number of such segments that clean text would have."""
    words = words_of(text)
    if not words:
        return 0.0, 0.0, 0
    edge = np.log(model.rate * len(words))
    each = sorted((model.decay * s - edge for _, _, s in maximal_segments(model.values(words))),
                  reverse=True)
    told = [x for x in each if x > -np.log(SIGNIFICANT)]
    return max(0.0, each[0]) if each else 0.0, sum(told), len(told)


def passages(model: Model, text: str | None) -> list[tuple[int, int, float]]:
    """Significant segments as (start, end) in characters with their surprise."""
    found = list(_WORD.finditer(text.lower())) if text else []
    if not found:
        return []
    edge = np.log(model.rate * len(found))
    segments = maximal_segments(model.values([m.group() for m in found]))
    return [(found[a].start(), found[b - 1].end(), model.decay * s - edge)
            for a, b, s in segments if model.decay * s - edge > -np.log(SIGNIFICANT)]


STEPS = (0.01, 0.02)  # of the features while the curve is fitted: 601 by 692 at most


def features(best: float, total: float) -> list[float]:
    return [1.0, min(best, 60.0) / 10.0, np.log1p(min(total, 1e6))]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells, counts = Cells(), np.zeros((2, 2, CELLS), dtype=np.int64)
    for texts, labels in rows(batches):
        for text, label in zip(texts, labels):
            # once per text: a word that is said again tells nothing new
            found = [cells[w] for w in set(words_of(text))]
            if found:
                own, stem = np.array(found).T
                np.add.at(counts[1, label], own, 1)
                np.add.at(counts[0, label], np.unique(stem), 1)
    kind, label, place = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(kind * 2 + label, pa.int32()), pa.array(place, pa.int32()),
         pa.array(counts[kind, label, place])], names=["part", "cell", "n"])


FINE = 1 << 20  # parts of one; sums of whole numbers don't depend on the order


def _best(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Texts with words, and the sum of n exp(-lambda S) of their best segments."""
    count = total = 0
    for (texts,) in rows(batches):
        for words in filter(None, map(words_of, texts)):
            best = max([0.0, *(s for *_, s in maximal_segments(model.values(words)))])
            count += 1
            total += round(len(words) * float(np.exp(-model.decay * best)) * FINE)
    yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()),
                                      pa.array([total / FINE], pa.float64())],
                                     names=["texts", "total"])


def _described(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How many texts have which label and features, these in steps of ``STEPS``."""
    counts: Counter = Counter()
    for texts, labels in rows(batches):
        for text, label in zip(texts, labels):
            _, best, total = features(*describe(model, text)[:2])
            counts[label, round(best / STEPS[0]), round(total / STEPS[1])] += 1
    kinds = list(zip(*counts)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays(
        [*(pa.array(k, pa.int32()) for k in kinds), pa.array(list(counts.values()), pa.int64())],
        names=["label", "best", "total", "n"])


def _values(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How often words have which value, in hundredths."""
    counts: dict[int, int] = {}
    for (texts,) in rows(batches):
        values = [v for t in texts for v in model.values(words_of(t))]
        for v, n in zip(*np.unique(np.round(np.array(values) * 100), return_counts=True)):
            counts[int(v)] = counts.get(int(v), 0) + int(n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())],
        names=["value", "n"])


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge; ``n`` is how often each row occurs."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + ridge * np.r_[0.0, w[1:]]
        curvature = (x.T * (n * (p * (1 - p) + 1e-9))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def train(documents: DataFrame, labels: DataFrame, n_rows: int = ROWS) -> Model:
    """Learn from the ``text`` of documents whose ``doc_id`` has a ``label`` of 0 or 1.

    Of more than ``n_rows`` labels about so many are used; they are broadcast, so that no
    text is shuffled.
    """
    labels = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint"), F.col("label").cast("int"))
    part = n_rows / max(n_rows, labels.count())
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(part * (1 << 32))
    chosen = labels.where(chosen).groupBy("doc_id").agg(F.max("label").alias("label"))
    fit = keep(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
               .join(F.broadcast(chosen), "doc_id").select("text", "label"), "labelled")
    counts = np.zeros((4, CELLS), dtype=np.int64)
    cells = in_batches(fit, _counted, "part int, cell int, n bigint")
    # no more rows than the model has cells
    for part, at, n in cells.groupBy("part", "cell").agg(F.sum("n")).collect():
        counts[part, at] = n
    model = Model.of(counts.reshape(2, 2, CELLS))
    n_toxic, n = fit.agg(F.count_if(F.col("label") == 1), F.count(F.lit(1))).first()
    if n_toxic in (0, n):
        model.constant = n_toxic / n if n else 0.0
        return model
    seen = in_batches(fit.where("label = 0").select("text"), partial(_values, model=model),
                      "value int, n bigint")
    seen = seen.groupBy("value").agg(F.sum("n")).collect()  # as many as there are values
    values, share = np.array(seen, dtype=float).reshape(-1, 2).T
    model.decay = decay_of(values / 100, share / max(1.0, share.sum()))
    best = in_batches(fit.where("label = 0").select("text"), partial(_best, model=model),
                      "texts bigint, total double")
    # the mean of n exp(-lambda S) is 1 / K for best segments of random texts
    whole = F.sum((F.col("total") * FINE).cast("decimal(38,0)"))
    texts, total = best.agg(F.sum("texts"), whole).first()
    if texts:
        model.rate = texts / (float(total) / FINE)
    told = in_batches(fit, partial(_described, model=model),
                      "label int, best int, total int, n bigint")
    told = told.groupBy("label", "best", "total").agg(F.sum("n"))
    # as many as there are steps, in one order
    told = np.array(sorted(map(tuple, told.collect())), dtype=float)
    x = np.column_stack([np.ones(len(told)), told[:, 1] * STEPS[0], told[:, 2] * STEPS[1]])
    model.curve = tuple(_logistic(x, told[:, 0], told[:, 3]))
    return model


_SCORES = "doc_id bigint, score double, passages int, best double"


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for docs, texts in rows(batches):
        told = [describe(model, t) for t in texts]
        if model.constant is None:
            x = np.array([features(b, t) for b, t, _ in told])
            score = 1 / (1 + np.exp(-np.clip(x @ np.array(model.curve), -30, 30)))
        else:
            score = np.full(len(docs), model.constant)
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(score),
             pa.array([n for *_, n in told], pa.int32()), pa.array([b for b, *_ in told],
                                                                   pa.float64())],
            schema=arrow_schema(_SCORES))


def score_toxicity(df: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, passages`` (how many are significant) and ``best`` (surprise of the
    best one) of each row."""
    return in_batches(df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")),
                      partial(_scored, model=model), _SCORES)
