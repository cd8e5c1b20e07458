"""SetSketch registers over 64-bit element hashes (Ertl, 2021), vectorised over many sets.

Every element sends arrivals of a Poisson process of rate ``m`` to random registers, so
each register sees independent exponential arrivals; a register keeps the earliest one
of all elements on an exponentially spaced, truncated scale.  Merging two sketches is
the maximum of their registers.  Only arrivals before a bound near ``log(m)/n`` can be
minima; sets with a register still empty at the bound are gone over again with a later
bound, so results never depend on it.
"""

from __future__ import annotations

import numpy as np

from medlake.llm.words import U, mix

M, BANDS, ROWS = 160, 32, 5
#: Scale of the registers: base, rate, and largest value.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def minima(elements: np.ndarray, first: np.ndarray, m: int = M) -> np.ndarray:
    """Earliest arrival in each register; ``first`` bounds each set. Empty sets give infinity."""
    n = np.diff(first)
    out = np.full(len(n) * m, np.inf)
    todo, slack = np.flatnonzero(n > 0), 8.0
    while len(todo):
        size = n[todo]
        owner = np.repeat(todo, size)
        e = elements[np.repeat(first[todo] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        bound = np.repeat((np.log(m) + slack) / size, size)
        t, step = np.zeros(len(e)), 0
        while len(e):
            t = t - np.log(_unit(mix(e, 2 * step + 10))) / m
            live = t <= bound
            e, owner, t, bound = e[live], owner[live], t[live], bound[live]
            np.minimum.at(out, owner * m + (mix(e, 2 * step + 11) % U(m)).astype(np.int64), t)
            step += 1
        todo, slack = todo[np.isinf(out.reshape(-1, m)[todo]).any(1)], slack * 3
        out.reshape(-1, m)[todo] = np.inf
    return out.reshape(-1, m)


def registers(elements: np.ndarray, first: np.ndarray, m: int = M) -> np.ndarray:
    """Register values, 0 for empty sets; one row for each set."""
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(minima(elements, first, m) * 1.0 / RATE) / np.log(BASE))
    return np.clip(np.where(np.isfinite(k), k, 0), 0, TOP).astype(np.uint16)


def joint_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of each pair of rows, given the set sizes.

    The counts of registers that are larger, smaller and equal are multinomial with
    probabilities that depend on the similarity alone; the likelihood is concave enough
    for a golden-section search.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return more * np.log(x + tiny) + less * np.log(y + tiny) + same * np.log(np.maximum(1 - x - y, 0) + tiny)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(rounds):
        c, d = high - g * (high - low), low + g * (high - low)
        left = likelihood(c) > likelihood(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return (low + high) / 2
