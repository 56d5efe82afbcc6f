"""How many tables the customers of a dish have in a Pitman-Yor restaurant, drawn from the exact conditional.

For c customers, discount d, strength a (with the discounts of the other dishes'
tables) and a parent that gives the dish probability p, t tables have weight
S(c, t) * product over k < t of (a + d * k) * p, where S are the generalized
Stirling numbers: S(1, 1) = 1, S(c + 1, t) = S(c, t - 1) + (c - d * t) * S(c, t).
They are tabulated up to EXACT customers. For more, log S comes from the
coefficient of z**c in (1 - (1 - z)**d)**t: an alternating series while t is
small against c**d, else the saddle point; the
weights, log-concave in t, are then evaluated where they are not negligible, on
at most GRID points. Either way it is one law; only its evaluation differs,
by less than half a percent of a weight.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

EXACT = 1024
GRID = 512
LOST = 10.0
#: Weights below exp(-FAR) of the largest are negligible.
FAR = 45.0
#: Numbers that one step works on, tables that are tried before all are, and customers whose weights need no logarithms.
CELLS, FEW, SMALL = 1 << 18, 48, 16


@lru_cache(maxsize=4)
def table(d: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t) for c, t <= most; -inf where t > c."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c, 1:] + np.log(np.maximum(c - d * t, 1e-300))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(t <= c, stay, -np.inf))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0."""
    x = np.asarray(x, float)
    low, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        low[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    tail = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - low


def _reach(d: float) -> float:
    """The t / c**d up to which the series keeps half of its digits: S falls as exp(-LOST) there, while terms grow as exp(LOST)."""
    return (LOST / ((1 - d) * d ** (d / (1 - d)))) ** (1 - d)


def _series(c: float, t: np.ndarray, d: float) -> np.ndarray:
    peak = (1 - d) * d ** (d / (1 - d)) * (t.max() / c**d) ** (1 / (1 - d)) / (1 - d)
    k = np.arange(1, min(int(t.max()), 40 + int(4 * peak)) + 1, dtype=float)
    of_k = log_gamma(c - k * d) - log_gamma(np.array([c - d])) + log_gamma(1 + k * d)
    with np.errstate(divide="ignore"):
        choose = np.cumsum(np.log(np.maximum(t[:, None] - k + 1.0, 0.0) / k), axis=1)
    sign = np.where(k % 2 == 1, 1.0, -1.0) * np.sin(math.pi * k * d) / math.pi  # 1 / gamma(-x) = -sin(pi x) gamma(1 + x) / pi
    total = (np.exp(choose + of_k) * sign).sum(axis=1)
    return np.log(np.maximum(total, 1e-300)) + log_gamma(np.array([c - d])) - t * math.log(d) - log_gamma(t + 1.0)


def _saddle(c: float, t: np.ndarray, d: float) -> np.ndarray:
    ratio = c / t.astype(float)
    low, high = np.full(len(t), -60.0), np.full(len(t), -1e-14)  # log(1 - z)
    for _ in range(70):
        y = (low + high) / 2
        big = d * -np.expm1(y) * np.exp((d - 1) * y) / -np.expm1(d * y) > ratio
        low, high = np.where(big, y, low), np.where(big, high, y)
    y = (low + high) / 2
    rest, f = np.exp(y), -np.expm1(d * y)
    z = -np.expm1(y)
    k = d * z * rest ** (d - 1) / f
    spread = k * (1 + (1 - d) * z / rest - k)
    n = c - t  # near t = c the error is that of Stirling's formula for n!
    excess = log_gamma(n + 1.0) - (n + 0.5) * np.log(n) + n - 0.5 * math.log(2 * math.pi)
    return log_gamma(np.array([c + 1.0])) - log_gamma(t + 1.0) - t * math.log(d) + t * np.log(f) - c * np.log(z) - 0.5 * np.log(2 * math.pi * t * spread) - excess


def log_stirling(c: int, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) for c > EXACT."""
    out = np.empty(len(t))
    few = t <= _reach(d) * c**d
    if few.any():
        out[few] = _series(c, t[few], d)
    if not few.all():
        most = t == c
        rest = ~few & ~most
        out[most] = 0.0
        out[rest] = _saddle(c, t[rest], d)
    return out


def _many(c: int, strength: float, p: float, d: float, u: float) -> int:
    """A draw for more than EXACT customers."""
    a = strength / d

    def weight(t: np.ndarray) -> np.ndarray:
        return log_stirling(c, t, d) + t * math.log(d * p) + log_gamma(a + t)

    low, high = 1, c
    while high - low >= GRID:
        t = np.unique(np.rint(np.geomspace(low, high, 24)).astype(np.int64)) if low * 4 < high else np.unique(np.linspace(low, high, 24).astype(np.int64))
        w = weight(t)
        near = np.flatnonzero(w > w.max() - FAR)
        new = int(t[max(near[0] - 1, 0)]), int(t[min(near[-1] + 1, len(t) - 1)])
        if new[1] - new[0] > 0.7 * (high - low):
            break
        low, high = new
    step = -(-(high - low + 1) // GRID)
    t = np.arange(low, high + 1, step)
    w = weight(np.minimum(t + (step - 1) // 2, c))  # the middle stands for a step
    upto = np.cumsum(np.exp(w - w.max()))
    x = u * upto[-1]
    k = int(np.searchsorted(upto, x, "right"))
    k = min(k, len(t) - 1)
    within = 1 - (upto[k] - x) / (upto[k] - (upto[k - 1] if k else 0.0))
    return min(int(t[k]) + int(within * step), c)


def _few(numbers: np.ndarray, strength: np.ndarray, p: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Draws for so few customers that weights need no logarithms; ``numbers`` are their Stirling numbers."""
    upto = np.empty((len(numbers), len(p)))
    product = np.ones(len(p))
    upto[0] = numbers[0]
    for t in range(1, len(numbers)):
        product *= (strength + d * t) * p
        np.add(upto[t - 1], numbers[t] * product, out=upto[t])
    return 1 + (upto[:-1] <= u * upto[-1]).sum(axis=0)


def draw(c: np.ndarray, strength: np.ndarray, p: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables for ``c`` customers of each dish; ``u`` is uniform in (0, 1)."""
    c = np.asarray(c, np.int64)
    strength = np.broadcast_to(np.asarray(strength, float), c.shape)
    out = np.minimum(c, 1)
    order = np.argsort(np.minimum(c, EXACT + 1).astype(np.uint16), kind="stable")
    sorted_c = np.minimum(c[order], EXACT + 1)
    lo = int(np.searchsorted(sorted_c, 2))
    logs = table(d)
    while lo < len(order):
        n = int(c[order[lo]])
        hi = int(np.searchsorted(sorted_c, n, "right")) if n <= EXACT else len(order)
        if n <= SMALL:
            numbers = np.exp(logs[n, 1 : n + 1])
            for at in range(lo, hi, CELLS // n):
                i = order[at : min(at + CELLS // n, hi)]
                out[i] = _few(numbers, strength[i], p[i], d, u[i])
        elif n > EXACT:
            for i in order[lo:hi].tolist():
                out[i] = _many(int(c[i]), float(strength[i]), float(p[i]), d, float(u[i]))
        else:
            rest, m = order[lo:hi], n if n <= FEW else FEW
            while len(rest):
                again = []
                step = max(1, CELLS // m)
                for at in range(0, len(rest), step):
                    i = rest[at : at + step]
                    w = np.log((strength[i, None] + d * np.arange(m)) * p[i, None])
                    w[:, 0] = 0.0
                    w = np.cumsum(w, axis=1) + logs[n, 1 : m + 1]
                    top = w.max(axis=1)
                    if m < n:  # weights are log-concave: what is negligible and falls stays so
                        done = w[:, -1] < top - FAR
                        again.append(i[~done])
                        i, w, top = i[done], w[done], top[done]
                    upto = np.cumsum(np.exp(w - top[:, None]), axis=1)
                    out[i] = 1 + (upto[:, :-1] <= u[i, None] * upto[:, -1:]).sum(axis=1)
                rest, m = np.concatenate(again) if again else rest[:0], n
        lo = hi
    return out
