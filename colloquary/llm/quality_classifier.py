"""Operator 2: a quality classifier from weak labels.

Labellers: ``LABELLERS`` are overlapping rules of thumb.  Each says good, bad or nothing
about a text.  How right they are is estimated by expectation-maximisation without bounds
(``fit_labellers``), under a prior of a few texts.  Texts are good or of one of several kinds
of bad, since poor texts have one fault or another; a labeller that speaks is right with a
probability of its own for each kind, whatever the others say.  There are as many kinds as
the votes bear out (Bayesian information criterion): one for each labeller to begin with,
taken away while that costs less likelihood than its parameters are worth.  So a fault that
several labellers see in the same texts is a kind of bad text, and the single votes of a
labeller that nothing goes along with are its errors on good ones.  (Where fewer than three
labellers see a fault, votes alone don't tell how right each is; the prior then decides.)
Texts with equal votes are equal to it, so it works on the counts of vote patterns over the
whole corpus, of which there are 3**9 at most.

Scorer: the posterior of its votes is a text's soft label, and about ``ROWS`` texts at most
(those with the smallest hashes of id and text, repeated rows once) train a logistic scorer
over words hashed to ``CELLS`` cells, along with the words' shapes and signs of repetition.
Its score decides, not the rules: ``kept`` from ``THRESHOLD`` on.

Null and empty texts get no vote and the scorer's bias; they are rejected, having nothing
to learn from.  With fewer texts that any labeller speaks about than 2, or posteriors that
all agree, every text with a word is kept.  Only texts and ids are looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquary.llm.common import arrow_schema, in_batches, make_room, rows, ship

CELLS = 1 << 18
ROWS = 10_000
THRESHOLD = 0.5
EPOCHS, RATE = 6, 2.0
LIMIT = 100_000  # words remembered per task

_DECORATION = "#*$%&|<>=~^_{}[]\\@+"
_ENDS = (b".", b"!", b"?", b".\"", b",", b";", b":")
# the same and those of other scripts, where a text has more than ASCII
_PAUSES = re.compile(
    "(?:[.!?,;:\u2026\u037e\u00b7\u0387\u0589\u055d\u060c\u061b\u061f\u06d4\u0964\u0965\u1362-\u1367"
    "\u104a\u104b\u17d4\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f]"
    "|\\.\"|[.!?][\u201d\u2019\u00bb\u201c])(?=[ \t\n\x0b\x0c\r]|\\Z)")
# Thai to Burmese, Khmer, kana and Han: scripts that do not part words by blanks
_UNPARTED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff"
                       "\uf900-\ufaff\U00020000-\U0003ffff]+")


def _between(value: float, good: tuple[float, float], bad_below: float, bad_above: float) -> int:
    if value < bad_below or value > bad_above:
        return -1
    return 1 if good[0] <= value <= good[1] else 0


_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + _UPPER.lower()
# letters and digits; whatever isn't ASCII is taken for letters
_WRITTEN = _LETTERS + b"0123456789" + bytes(range(128, 256))


def _letters(text: str, raw: bytes) -> tuple[int, int]:
    """Letters and capitals of the whole text."""
    if text.isascii():
        return (len(raw) - len(raw.translate(None, _LETTERS)),
                len(raw) - len(raw.translate(None, _UPPER)))
    return sum(map(str.isalpha, text)), sum(map(str.isupper, text))


def facts(text: str) -> dict[str, float]:
    raw = text.encode()
    words = raw.split()
    letters, upper = _letters(text, raw)
    n, letters = max(1, len(words)), max(1, letters)
    counts = Counter(words)
    unparted = 0 if text.isascii() else sum(map(len, _UNPARTED.findall(text)))
    return {
        "words": len(words),
        "upper": upper / letters,
        "shout": (text.count("!") + text.count("\uff01")) / n,
        "decoration": sum(map(text.count, _DECORATION)) / n,
        "top": max(counts.values(), default=0) / n,
        "distinct": len(counts) / n,
        "again": sum(map(bytes.__eq__, words, words[1:])) / n,
        "long": (sum(map(len, words)) - len(raw) + len(text)) / n,
        "unparted": unparted / letters,
        "written": 1 - sum(map(len, raw.translate(None, _WRITTEN).split()))
        / max(1, sum(map(len, words))),
        "pauses": (sum(w.endswith(_ENDS) for w in words) if text.isascii()
                   else len(_PAUSES.findall(text))) / n,
    }


def _of_words(f: dict[str, float], fewest: int) -> bool:
    return f["words"] >= fewest and f["unparted"] < 0.2


# What plain prose looks like; where it isn't written in words, some say nothing.
LABELLERS = {
    "upper case": lambda f: _between(f["upper"], (0.0, 0.15), 0.0, 0.35),
    "shouting": lambda f: _between(f["shout"], (0.0, 0.03), 0.0, 0.15) if _of_words(f, 0)
    else 0,
    "decoration": lambda f: _between(f["decoration"], (0.0, 0.05), 0.0, 0.25)
    if _of_words(f, 0) else 0,
    "letters": lambda f: _between(f["written"], (0.85, 1.0), 0.75, 1.0) if f["words"] >= 20 else 0,
    "repetition": lambda f: _between(f["top"], (0.0, 0.12), 0.0, 0.25) if _of_words(f, 20) else 0,
    "variety": lambda f: 0 if not _of_words(f, 20) else 1 if f["distinct"] * f["words"] ** 0.3 > 1.2
    else -1 if f["distinct"] * f["words"] ** 0.3 < 0.5 else 0,
    "stutter": lambda f: _between(f["again"], (0.0, 0.05), 0.0, 0.2) if _of_words(f, 5) else 0,
    "word length": lambda f: _between(f["long"], (3.0, 9.0), 2.0, 14.0) if _of_words(f, 5) else 0,
    "pauses": lambda f: _between(f["pauses"], (0.04, 0.25), 0.01, 0.6) if _of_words(f, 30) else 0,
}


def votes(text: str | None) -> list[int]:
    if not text or not text.split():
        return [0] * len(LABELLERS)
    told = facts(text)
    return [rule(told) for rule in LABELLERS.values()]


def pattern_of(each: list[int]) -> int:
    out = 0
    for v in each:
        out = 3 * out + v + 1
    return out


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, v = divmod(pattern, 3)
        out.append(v - 1)
    return out[::-1]


PRIOR = 2.0  # texts per labeller and kind that stand for what is thought of it beforehand


def _climb(table: np.ndarray, weight: np.ndarray, belongs: np.ndarray, rounds: int
           ) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood with the prior, P(kind | votes), P(good vote | kind, it speaks), shares)
    by expectation-maximisation from ``belongs``, a row per pattern and a column per kind."""
    yes, no = (table > 0).astype(float), (table < 0).astype(float)
    # rules of thumb are thought right on nine in ten good texts; of bad ones nothing is known
    thought = np.full((belongs.shape[1], 1), 0.5)
    thought[0] = 0.9
    before = -np.inf
    for _ in range(rounds):
        mass = belongs * weight[:, None]
        share = (mass.sum(axis=0) + 1) / (weight.sum() + belongs.shape[1])
        said = mass.T @ yes
        good_vote = (said + PRIOR * thought) / (said + mass.T @ no + PRIOR)
        joint = np.log(share) + yes @ np.log(good_vote).T + no @ np.log1p(-good_vote).T
        top = joint.max(axis=1, keepdims=True)
        whole = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
        belongs = np.exp(joint - whole)
        now = float(weight @ whole[:, 0] + np.log(share).sum()
                    + PRIOR * (thought * np.log(good_vote)
                               + (1 - thought) * np.log1p(-good_vote)).sum())
        if now - before < 1e-7 * abs(now) / len(weight):
            break
        before = now
    return now, belongs, good_vote, share


def fit_labellers(patterns: dict[int, int], rounds: int = 500
                  ) -> tuple[dict[int, float], np.ndarray, float]:
    """(how likely each pattern is good, P(right) of each labeller for bad and good texts,
    share of good texts) by expectation-maximisation."""
    keys = sorted(p for p in patterns if any(votes_of(p)))
    if not keys:
        return {}, np.full((2, len(LABELLERS)), 0.75), 0.5
    table = np.array([votes_of(p) for p in keys])
    weight = np.array([patterns[p] for p in keys], dtype=float)
    price = 0.5 * (table.shape[1] + 1) * np.log(weight.sum() + 1)

    def climb(belongs: np.ndarray, rounds: int = rounds // 5):
        fitted = _climb(table, weight, belongs, rounds)
        return fitted[0] - price * belongs.shape[1], fitted

    def start(bad: np.ndarray) -> np.ndarray:
        """A kind per column of ``bad``, which parts a text among those it is true of."""
        odds = np.c_[np.where(bad.any(axis=1), 0.25, 9.0), bad + 1e-3]
        return odds / odds.sum(axis=1, keepdims=True)

    # restarts: every labeller has its kind; one kind for any bad vote; one for most votes
    bad_votes, voted = table < 0, [j for j in range(table.shape[1]) if (table[:, j] < 0).any()]
    best = climb(start(bad_votes[:, voted]))
    while best[1][1].shape[1] > 1:
        belongs, fewer = best[1][1], []
        for k in range(1, belongs.shape[1]):
            others = np.delete(belongs, k, axis=1)
            others[:, 0] += belongs[:, k]
            fewer.append(climb(others))
        found = max(fewer, key=lambda f: f[0])
        if found[0] < best[0]:
            break
        best = found
    for bad in (bad_votes.any(axis=1), table.sum(axis=1) < 0):
        best = max(best, climb(start(bad[:, None])), key=lambda f: f[0])
    _, belongs, good_vote, share = climb(best[1][1], rounds)[1]
    right = np.full((2, table.shape[1]), 0.5)
    right[1] = good_vote[0]
    if len(share) > 1:
        right[0] = 1 - share[1:] @ good_vote[1:] / share[1:].sum()
    return dict(zip(keys, belongs[:, 0].tolist())), right, float(share[0])


_RUNS = [(re.compile(b"[A-Z]+"), b"A"), (re.compile(b"[a-z\x80-\xff]+"), b"a"),
         (re.compile(b"[0-9]+"), b"0")]


def cells_of(word: bytes) -> tuple[int, int]:
    """Cell of the word and cell of its shape."""
    shape = word
    for pattern, letter in _RUNS:
        shape = pattern.sub(letter, shape)
    return crc32(word.lower()) % CELLS, crc32(b"\x00" + shape) % CELLS


_AGAIN = crc32(b"\x01again") % CELLS


def features(text: str, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(cells, share of the words) of a text."""
    words = text.encode().split()
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        if word not in known:
            if len(known) > LIMIT:
                known.clear()
            known[word] = cells_of(word)
        for cell in known[word]:
            counts[cell] += n
    counts[_AGAIN] += sum(a == b for a, b in zip(words, words[1:]))
    n = max(1, len(words))
    return (np.fromiter(counts.keys(), dtype=np.int64, count=len(counts)),
            np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) * (10.0 / n))


def fit_scorer(texts: list[str], soft: list[float]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer, by adaptive gradient steps in a fixed order."""
    known: dict = {}
    seen = [features(t, known) for t in texts]
    # both classes weigh the same
    y = np.array(soft)
    weigh = 0.5 / np.array([max(1e-9, 1 - y.mean()), max(1e-9, y.mean())])
    w, g, bias, gb = np.zeros(CELLS), np.full(CELLS, 1.0), 0.0, 1.0
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(seen)):
            cells, x = seen[i]
            p = 1 / (1 + np.exp(-np.clip(w[cells] @ x + bias, -30, 30)))
            d = (1 - y[i]) * p * weigh[0] - y[i] * (1 - p) * weigh[1]
            step = d * x
            g[cells] += step * step
            w[cells] -= RATE * 0.1 * step / np.sqrt(g[cells])
            gb += d * d
            bias -= RATE * 0.1 * d / np.sqrt(gb)
    return w, float(bias)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room()
    counts: Counter = Counter()
    for (texts,) in rows(batches):
        counts.update(pattern_of(votes(t)) for t in texts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())],
        names=["pattern", "n"])


def _trained(batches: Iterator[pa.RecordBatch], good: dict[int, float]
             ) -> Iterator[pa.RecordBatch]:
    docs = []
    for ids, texts in rows(batches):
        for doc, text in zip(ids, texts):
            p = good.get(pattern_of(votes(text)))
            if p is not None:
                docs.append((doc, text, p))
    docs.sort(key=lambda d: (d[0], crc32(d[1].encode())))  # the order of arrival may change
    soft = [p for *_, p in docs]
    if docs and min(soft) < 0.5 < max(soft):
        weights, bias = fit_scorer([t for _, t, _ in docs], soft)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias])],
            names=["weights", "bias"])


def train(df: DataFrame, n_rows: int = ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias, learnt from ``doc_id, text``."""
    texts = df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    voted = in_batches(texts.select("text"), _voted, "pattern int, n bigint")
    # no more rows than there are patterns
    patterns = dict(voted.groupBy("pattern").agg(F.sum("n")).collect())
    good, _, _ = fit_labellers(patterns)
    part = int(min(1.0, n_rows / max(1, sum(patterns.values()))) * (1 << 32))
    # by id and text, and repeats once: rows that share an id or are copies don't swell it
    sample = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()
                         & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) < part)).distinct()
    # one task trains, on as many texts as the parameter says
    fitted = in_batches(sample.repartition(1), partial(_trained, good=good),
                        "weights binary, bias double").collect()
    if not fitted:
        return np.zeros(CELLS), 1.0
    return np.frombuffer(fitted[0][0], dtype="<f4").astype(float), fitted[0][1]


class Values(dict):
    """word -> what it adds to the score"""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > LIMIT:
            self.clear()
        a, b = cells_of(word)
        self[word] = value = float(self.weights[a] + self.weights[b])
        return value


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        make_room()
        self.value, self.again, self.bias = Values(weights), float(weights[_AGAIN]), bias

    def __call__(self, text: str | None) -> float:
        words = text.encode().split() if text else []
        if not words:
            return 0.0
        total = sum(map(self.value.__getitem__, words))
        total += self.again * sum(map(bytes.__eq__, words, words[1:]))
        return float(1 / (1 + np.exp(-np.clip(self.bias + 10.0 * total / len(words), -30, 30))))


def _scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float, schema: str
            ) -> Iterator[pa.RecordBatch]:
    score = Scorer(weights, bias)
    for ids, texts in rows(batches):
        out = list(map(score, texts))
        kind = arrow_schema(schema)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, kind.field(0).type), pa.array(out)], schema=kind)


def score_quality(df: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher is better) of each row."""
    schema = "doc_id bigint, score double"
    return in_batches(df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")),
                      partial(_scored, weights=model[0], bias=model[1], schema=schema), schema)


def keep_good(df: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD
              ) -> DataFrame:
    """Rows of ``df`` whose ``text`` scores at least ``threshold``, all columns as they were."""
    ship(df.sparkSession)
    weights, bias = model

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(weights, bias)
        for texts in parts:
            yield texts.map(scorer).astype(float)

    return df.where(score(F.col("text").cast("string")) >= threshold)
