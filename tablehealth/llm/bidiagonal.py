"""Singular values and right singular vectors of a small square matrix, by qd algorithms.

Householder reflections make the matrix bidiagonal, dqds finds its singular values to
high relative accuracy, and twisted factorisations of B'B - s*s give the vectors, one
solve each.  Vectors of values that lie close together are made orthogonal to each other
by inverse iteration with the same factorisations.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: Squares below this, for a largest singular value near 1, count as zero.
_TINY = 1e-60
#: Values whose squares differ by less than this share may need to be made orthogonal.
_CLOSE = 1e-3
_SWEEPS_PER_VALUE = 60


def bidiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and the orthogonal W with ``a = U B W'``."""
    a, d = a.astype(np.float64).copy(), a.shape[0]
    w = np.eye(d)
    for k in range(d):
        v, beta = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        if k + 2 < d:
            v, beta = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, beta * v)
            w[:, k + 1 :] -= np.outer(w[:, k + 1 :] @ v, beta * v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), w


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta with (I - beta v v')x a multiple of the first unit vector."""
    scale = float(np.abs(x).max(initial=0.0))
    if not scale or not np.abs(x[1:]).max(initial=0.0):
        return np.zeros(len(x)), 0.0
    v = x / scale
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v, 2.0 / float(v @ v)


def squared_values(q: list[float], e: list[float]) -> list[float]:
    """Squares of the singular values of the bidiagonal matrix with squared entries ``q``, ``e``; in no order."""
    found: list[float] = []
    parts = [(list(q), list(e), 0.0)]
    while parts:
        q, e, sigma = parts.pop()
        sweeps = _SWEEPS_PER_VALUE * len(q)
        while len(q) > 2 and sweeps:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (sigma + q[i]) or e[i] <= EPS * EPS * q[i + 1]), None)
            if cut == len(e) - 1:
                found.append(sigma + q.pop())
                e.pop()
                continue
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:  # the small end belongs at the bottom
                q.reverse()
                e.reverse()
            shift = _shift(q, e)
            while (swept := _dqds(q, e, shift)) is None:
                shift = shift / 4 if shift > 1e-3 * q[-1] else 0.0
            q, e = swept
            sigma, sweeps = sigma + shift, sweeps - 1
        if len(q) > 2:
            raise ArithmeticError("dqds did not converge")
        if len(q) == 2:
            found += [sigma + x for x in _two(q[0], e[0], q[1])]
        elif q:
            found.append(sigma + q[0])
    return found


def _shift(q: list[float], e: list[float]) -> float:
    """A little less than the lower value of the last two rows."""
    return 0.98 * max(0.0, min(_two(q[-2], e[-1], q[-1])) - e[-2])


def _two(q0: float, e0: float, q1: float) -> tuple[float, float]:
    """Both squared values of a 2 by 2 upper bidiagonal matrix, without cancellation."""
    if not q0 or not q1:
        return q0 + e0 + q1, 0.0
    total = q0 + e0 + q1
    large = 0.5 * (total + np.sqrt(max((q0 - q1 + e0) ** 2 + 4 * q1 * e0, 0.0)))
    return float(large), float(q1 * (q0 / large))


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One sweep with a shift; none if the shift is above the smallest value."""
    d, new_q, new_e = q[0] - shift, [], []
    for i in range(len(e)):
        if d < 0 and shift:
            return None
        x = max(d, 0.0) + e[i]
        x = x if x > _TINY * _TINY else _TINY * _TINY
        t = q[i + 1] / x
        new_q.append(x)
        new_e.append(e[i] * t)
        d = d * t - shift
    if d < 0 and shift:
        return None
    new_q.append(max(d, 0.0))
    return new_q, new_e


class _Twisted:
    """B'B - value as N D N', twisted at the index where its pivot is smallest."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        d, n = (a * a).tolist(), len(a)
        low = [x / y for x, y in zip(b.tolist(), a[:-1].tolist(), strict=True)]
        floor = EPS * EPS * max(value, _TINY)
        pivot = lambda x: x if abs(x) > floor else -floor
        s, self.down, above = [-value], [], []
        for i in range(n - 1):
            above.append(pivot(s[i] + d[i]))
            self.down.append(d[i] * low[i] / above[i])
            s.append(self.down[i] * low[i] * s[i] - value)
        p, self.up, below = [d[-1] - value], [], []
        for i in range(n - 2, -1, -1):
            below.append(pivot(d[i] * low[i] * low[i] + p[-1]))
            t = d[i] / below[-1]
            self.up.append(low[i] * t)
            p.append(p[-1] * t - value)
        for x in (p, self.up, below):
            x.reverse()
        gamma = [x + y + value for x, y in zip(s, p, strict=True)]
        self.k = int(np.argmin(np.abs(gamma)))
        self.pivots = [*above[: self.k], pivot(gamma[self.k]), *below[self.k :]]

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.pivots))
        z[self.k] = 1.0
        return _unit(self._back(z))

    def _back(self, y: np.ndarray) -> np.ndarray:
        """N'x = y."""
        for i in range(self.k - 1, -1, -1):
            y[i] -= self.down[i] * y[i + 1]
        for i in range(self.k, len(y) - 1):
            y[i + 1] -= self.up[i] * y[i]
        return y

    def solve(self, b: np.ndarray) -> np.ndarray:
        y, k = b.copy(), self.k
        for i in range(k):
            y[i + 1] -= self.down[i] * y[i]
        for i in range(len(y) - 2, k - 1, -1):
            y[i] -= self.up[i] * y[i + 1]
        y /= np.array(self.pivots)
        return _unit(self._back(y / max(np.abs(y).max(), _TINY)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def _away(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            x = x - (o @ x) * o
    return x


def singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``most`` singular values of the square ``r``, falling, and their right vectors as rows."""
    scale = float(np.abs(r).max(initial=0.0))
    if not scale:
        return np.zeros(min(most, len(r))), np.eye(len(r))[:most]
    a, b, w = bidiagonalise(r / scale)
    top = float(max(np.abs(a).max(), np.abs(b).max(initial=0.0)))
    a, b = a / top, b / top
    b[np.abs(b) <= EPS * 0.1] = 0.0
    a[np.abs(a) <= 1e-30] = 1e-30
    pairs: list[tuple[float, np.ndarray]] = []
    rng = np.random.Generator(np.random.PCG64(11))
    begin = 0
    for end in [*(np.flatnonzero(b == 0.0) + 1).tolist(), len(a)]:  # parts between zeros of the upper diagonal
        own_a, own_b = a[begin:end], b[begin : end - 1]
        values = sorted(squared_values((own_a * own_a).tolist(), (own_b * own_b).tolist()), reverse=True)[:most]
        found: list[tuple[float, np.ndarray]] = []
        for value in values:
            twisted = _Twisted(own_a, own_b, value)
            z = twisted.vector()
            near = [v for x, v in found if abs(x - value) <= _CLOSE * x or x <= (len(a) * EPS) ** 2]
            if near:
                left = _away(z, near)
                z = left if np.linalg.norm(left) > 0.5 else _away(rng.standard_normal(len(z)), near)
                for _ in range(3):
                    z = _unit(_away(twisted.solve(_unit(z)), near))
            found.append((value, z))
        for value, z in found:
            whole = np.zeros(len(a))
            whole[begin:end] = z
            pairs.append((value, whole))
        begin = end
    pairs.sort(key=lambda p: -p[0])
    pairs = pairs[:most]
    return scale * top * np.sqrt([max(p[0], 0.0) for p in pairs]), np.array([w @ p[1] for p in pairs])
