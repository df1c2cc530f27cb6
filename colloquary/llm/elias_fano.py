"""Monotone sequences in Elias-Fano form, and the two-level n-gram trie built from them.

A sequence of n numbers below u takes about ``2 + log2(u / n)`` bits each: the low bits are
stored as they are, the high ones in unary.  Levels are plain bytes, mapped where they lie
with ``numpy.frombuffer``; all look-ups are over arrays.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _packed(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, one after the other, and 8 bytes of slack."""
    if not width or not len(values):
        return bytes(16)
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(len(values), 8)
    used = -(-width // 8)
    bits = np.unpackbits(raw[:, :used], axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes() + bytes(16)


def _fields(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Values number ``at`` of ``width`` bits from 64-bit words."""
    if not width:
        return np.zeros(len(at), dtype=_U)
    bit = at.astype(_U) * _U(width)
    word, shift = (bit >> _U(6)).astype(np.int64), bit & _U(63)
    low = data[word] >> shift
    high = np.where(shift > 0, data[word + 1] << (_U(64) - np.maximum(shift, _U(1))), _U(0))
    return (low | high) & _U((1 << width) - 1)


def _words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u8", count=len(raw) // 8)


class Monotone:
    """A non-decreasing sequence of unsigned numbers."""

    def __init__(self, raw: bytes):
        head = np.frombuffer(raw, dtype="<u8", count=4)
        self.n, self.width = int(head[0]), int(head[1])
        low, high = int(head[2]), int(head[3])
        view = memoryview(raw)
        self._low = _words(view[32:32 + low])
        unary = np.unpackbits(np.frombuffer(view[32 + low:32 + low + high], dtype=np.uint8),
                              bitorder="little")
        # where the n-th number's bit is, and how many numbers precede each bucket
        self._ones = np.flatnonzero(unary).astype(np.int64)[:self.n]
        self._buckets = np.concatenate([
            [0], np.flatnonzero(unary == 0) - np.arange(len(unary) - len(self._ones))])

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = values.astype(_U)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1) if n else 0
        low = _packed(values, width)
        low += bytes(-len(low) % 8)
        high = (values >> _U(width)).astype(np.int64)
        unary = np.zeros(n + (int(high[-1]) + 1 if n else 0), dtype=np.uint8)
        unary[high + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").tobytes()
        high += bytes(-len(high) % 8)
        return np.array([n, width, len(low), len(high)], dtype="<u8").tobytes() + low + high

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        high = (self._ones[at] - at).astype(_U)
        return high << _U(self.width) | _fields(self._low, at, self.width)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None,
                  past: np.ndarray | None = None) -> np.ndarray:
        """Place of the first number that is ``x`` or more, among those from ``first`` to
        before ``past``; ``past`` if there is none."""
        x = x.astype(_U)
        bucket = np.minimum(x >> _U(self.width), _U(len(self._buckets) - 1)).astype(np.int64)
        lo = self._buckets[bucket]
        hi = self._buckets[np.minimum(bucket + 1, len(self._buckets) - 1)]
        hi = np.where(bucket + 1 >= len(self._buckets), self.n, hi)
        hi = np.minimum(hi, self.n)
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(np.maximum(hi, first), past)
            lo = np.minimum(lo, hi)
        lo, hi = lo.copy(), hi.copy()
        while True:  # numbers of one bucket are few, so few halvings do
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            middle = (lo[open_] + hi[open_]) >> 1
            less = self[middle] < x[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)

    def index(self, x: np.ndarray) -> np.ndarray:
        """Place of ``x`` in a rising sequence, -1 where it isn't."""
        if not self.n:
            return np.full(len(x), -1, dtype=np.int64)
        at = self.successor(x)
        there = at < self.n
        there[there] = self[at[there]] == x[there].astype(_U)
        return np.where(there, at, -1)


STEP = 2000  # quantised logarithms are multiples of 1/STEP
ABSENT = np.iinfo(np.uint16).max


def quantise(p: np.ndarray) -> np.ndarray:
    """-log10 of probabilities in 16 bits: down to 10**-32, to within 0.06 %."""
    return np.minimum(np.rint(-np.log10(p) * STEP), ABSENT - 1).astype("<u2")


def restore(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-code.astype(np.float64) / STEP)


class Trie:
    """Successors of contexts with their probabilities.

    Level 1 has the hashes of the contexts, their counts and weights, and pointers, which
    never fall, to where the successors of each begin on level 2.  There a successor is
    stored relative to its context: as the place of its hash among the trie's successors,
    raised by the context's place times their number, which makes the level one monotone
    sequence.  Beside it stand the quantised probabilities.
    """

    NAMES = ("contexts", "counts", "weights", "words", "pointers", "successors", "shares")

    def __init__(self, levels: dict[str, bytes]):
        self.contexts, self.words = Monotone(levels["contexts"]), Monotone(levels["words"])
        self.pointers, self.successors = (Monotone(levels["pointers"]),
                                          Monotone(levels["successors"]))
        self.counts = np.frombuffer(levels["counts"], dtype="<i8")
        self.weights = np.frombuffer(levels["weights"], dtype="<u2")
        self.shares = np.frombuffer(levels["shares"], dtype="<u2")

    @staticmethod
    def build(contexts: np.ndarray, words: np.ndarray, n: np.ndarray,
              given: dict[int, int]) -> dict[str, bytes]:
        """Levels from distinct (context, word) with counts, sorted by both.

        A context's count is that of its pairs, and its weight is count / (count + distinct
        successors), after Witten and Bell.  ``given`` has the counts of contexts of which
        only a part is here; the weight of these is for the caller to find, and 1 here.
        """
        starts = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])
                                ) if len(contexts) else np.zeros(0, dtype=np.int64)
        keys = contexts[starts]
        counts = np.add.reduceat(n, starts) if len(starts) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([starts[1:], [len(contexts)]]).astype(np.int64)
        kinds = ends[:len(starts)] - starts
        weights = counts / (counts + kinds)
        if given:
            known = np.array(sorted(given), dtype=_U)
            place = np.searchsorted(known, keys)
            part = known[np.minimum(place, len(known) - 1)] == keys
            total = np.array([given[int(k)] for k in known], dtype=np.int64)
            counts = np.where(part, total[np.minimum(place, len(known) - 1)], counts)
            weights = np.where(part, 1.0, weights)
        vocabulary, place = np.unique(words, return_inverse=True)
        owner = np.repeat(np.arange(len(starts)), kinds)
        relative = owner.astype(_U) * _U(max(1, len(vocabulary))) + place.astype(_U)
        return {"contexts": Monotone.encode(keys), "counts": counts.astype("<i8").tobytes(),
                "weights": quantise(weights).tobytes(), "words": Monotone.encode(vocabulary),
                "pointers": Monotone.encode(np.concatenate([starts, [len(contexts)]])),
                "successors": Monotone.encode(relative),
                "shares": quantise(n / counts[owner]).tobytes()}

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place on level 2 of words among the successors of contexts, -1 where they are not.

        Both are given by their places (``contexts.index``, ``words.index``), -1 for none.
        """
        place = np.full(len(context), -1, dtype=np.int64)
        both = np.flatnonzero((context >= 0) & (word >= 0))
        if len(both):
            at = context[both]
            first = self.pointers[at].astype(np.int64)
            past = self.pointers[at + 1].astype(np.int64)
            x = at.astype(_U) * _U(self.words.n) + word[both].astype(_U)
            found = self.successors.successor(x, first, past)
            there = found < past
            there[there] = self.successors[found[there]] == x[there]
            place[both] = np.where(there, found, -1)
        return place
