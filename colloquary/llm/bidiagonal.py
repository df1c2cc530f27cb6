"""Singular values and right singular vectors of a triangle by way of its bidiagonal form.

All of this works on one matrix whose size is the square of the number of columns: it does
not depend on how many rows there are.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
_FLOOR = 1e-200  # where nothing is left of a pivot
_CLOSE = 1e-3  # relative distance under which vectors are told apart by more than their value


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, diagonal above it, reflectors from the right) by Householder's reflections
    from both sides by turns."""
    a, d = np.array(r, dtype=float), r.shape[1]
    right: list[np.ndarray] = []

    def reflector(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        return v / size if size > 0 else v

    for k in range(d):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def back(right: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """Vectors (columns) of the bidiagonal form as vectors of what it was made from."""
    z = z.copy()
    for k in reversed(range(len(right))):
        v = right[k]
        z[k + 1:] -= 2 * np.outer(v, v @ z[k + 1:])
    return z


def _values(q: list[float], e: list[float]) -> list[float]:
    """Squares of the singular values of one block without gaps, by dqds.

    The shift is a lower bound for the least value, 1 over the trace of the inverse, which a
    step without a shift gives along the way; so nothing ever turns negative.
    """
    out, shifted = [], 0.0
    while len(q) > 1:
        low, high = q[-1], max(q)
        if e[-1] <= EPS * EPS * (shifted + low) or high <= _FLOOR:
            out.append(shifted + low)
            q.pop()
            e.pop()
            continue
        # one step without a shift, of which only the bound is wanted
        d, inverse = q[0], 1 / max(q[0], _FLOOR)
        for i in range(len(e)):
            d = d * (q[i + 1] / max(d + e[i], _FLOOR))
            inverse += 1 / max(d, _FLOOR)
        shift = (1 - 8 * EPS * len(q)) / inverse
        if shift <= EPS * shifted * 0.25:
            shift = 0.0
        d = q[0] - shift
        for i in range(len(e)):
            q[i] = max(d + e[i], _FLOOR)
            ratio = q[i + 1] / q[i]
            e[i] *= ratio
            d = max(d * ratio - shift, 0.0)
        q[-1] = d
        shifted += shift
        # parts that have come apart go on alone
        for i in range(len(e) - 1):
            if e[i] <= EPS * EPS * (shifted + min(q[i], q[i + 1])):
                for a, b in ((q[:i + 1], e[:i]), (q[i + 1:], e[i + 1:])):
                    out += [shifted + v for v in _values(a, b)]
                return out
    return out + [shifted + v for v in q]


def squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of all singular values of an upper bidiagonal matrix, falling."""
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if size == 0:
        return np.zeros(len(diagonal))
    q, e = (diagonal / size) ** 2, (above / size) ** 2
    out: list[float] = []
    start = 0
    for i in range(len(q)):
        if i == len(e) or e[i] <= EPS * EPS * min(q[i], q[i + 1]):
            out += _values(q[start:i + 1].tolist(), e[start:i].tolist())
            start = i + 1
    return np.sort(np.array(out))[::-1] * size * size


class Twisted:
    """``T - value I`` taken apart from both ends at once, T being the square of a bidiagonal
    matrix; the ends meet where the pivot is least."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        n = len(diagonal)
        d = np.maximum(diagonal * diagonal, _FLOOR)
        factor = diagonal[:-1] * above / d[:-1]
        tiny = max(EPS * EPS * value, _FLOOR)

        def firm(x: float) -> float:
            return x if abs(x) > tiny else tiny

        s, p = np.empty(n), np.empty(n)
        self.down, self.up = np.empty(n - 1), np.empty(n - 1)
        self.plus, self.minus = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n - 1):
            self.plus[i] = firm(s[i] + d[i])
            self.down[i] = d[i] * factor[i] / self.plus[i]
            s[i + 1] = self.down[i] * factor[i] * s[i] - value
        p[-1] = d[-1] - value
        for i in reversed(range(n - 1)):
            self.minus[i + 1] = firm(d[i] * factor[i] * factor[i] + p[i + 1])
            ratio = d[i] / self.minus[i + 1]
            self.up[i] = factor[i] * ratio
            p[i] = p[i + 1] * ratio - value
        pivots = s + p + value
        self.at = int(np.argmin(np.abs(pivots)))
        self.pivot = firm(pivots[self.at])

    def _spread(self, z: np.ndarray, start: np.ndarray) -> np.ndarray:
        for i in reversed(range(self.at)):
            z[i] = start[i] - self.down[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] = start[i + 1] - self.up[i] * z[i]
        return z

    def vector(self) -> tuple[np.ndarray, float]:
        """The vector, and how much the value was wrong."""
        z = np.zeros(len(self.plus))
        z[self.at] = 1.0
        z = self._spread(z, np.zeros(len(z)))
        size = z @ z
        return z / np.sqrt(size), self.pivot / size

    def solve(self, b: np.ndarray) -> np.ndarray:
        y, k, n = b.copy(), self.at, len(b)
        for i in range(1, k + 1):
            y[i] -= self.down[i - 1] * y[i - 1]
        for i in reversed(range(k + 1, n)):
            y[i - 1] -= self.up[i - 1] * y[i]
        y[:k] /= self.plus[:k]
        y[k + 1:] /= self.minus[k + 1:]
        y[k] /= self.pivot
        return self._spread(y.copy(), y)


def vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Right singular vectors (columns) of the ``k`` largest of ``values``, the squares of all
    singular values in falling order.

    Where values are close together, each vector is found from a start of its own, kept at
    right angles to those before.
    """
    n = len(diagonal)
    if n == 1:
        return np.ones((1, 1))[:, :k]
    out = np.zeros((n, k))
    first = 0  # of the run of close values
    starts = np.random.default_rng(0)
    for i in range(k):
        if i and values[i - 1] - values[i] > _CLOSE * values[i - 1]:
            first = i
        alone = first == i and (i + 1 == n or values[i] - values[i + 1] > _CLOSE * values[i])
        if alone:
            value = values[i]
            for _ in range(2):
                z, wrong = Twisted(diagonal, above, value).vector()
                if abs(wrong) <= 4 * EPS * value:
                    break
                value += wrong
        else:
            solver, z = Twisted(diagonal, above, values[i]), starts.standard_normal(n)
            near = out[:, first:i]
            for _ in range(4):
                for _ in range(2):
                    z -= near @ (near.T @ z)
                z = solver.solve(z / np.linalg.norm(z))
            for _ in range(2):
                z -= near @ (near.T @ z)
            z /= np.linalg.norm(z)
        out[:, i] = z
    return out


def principal(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(all squared singular values of a triangle, falling; right singular vectors of the k
    largest as columns, the largest entry of each positive)."""
    # to a scale at which squares neither vanish nor overflow
    size = np.abs(r).max(initial=0.0)
    if size == 0:
        return np.zeros(r.shape[1]), np.zeros((r.shape[1], 0))
    diagonal, above, right = bidiagonalise(r / size)
    values = squares(diagonal, above)
    # what is left of a value that is nothing but rounding is no component
    k = min(k, int((values > (EPS * len(values)) ** 2 * values[0] * 1e4).sum()))
    z = back(right, vectors(diagonal, above, values, k))
    z *= np.sign(z[np.abs(z).argmax(axis=0), np.arange(k)])
    return values * size * size, z
