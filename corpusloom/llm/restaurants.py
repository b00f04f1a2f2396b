"""Chinese restaurants of a Pitman-Yor process: how many tables the customers of each dish take.

A dish with ``c`` customers in a restaurant stands at ``t`` tables. The next
customer of the dish opens a table with weight ``a``, the restaurant's weight
for new tables times the parent's probability of the dish, and joins one of the
tables there with weight ``c - d t``. Only (c, t) is kept: how the customers
spread over the tables is integrated out by generalised Stirling numbers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Customers up to which the chance to sit alone is tabulated; beyond, it is an integral.
TABULATED = 512
# Nodes of the integral, pairs of (c, t) taken at once, and the exponent below the largest that no longer counts.
NODES, PAIRS, NEGLIGIBLE = 64, 4096, 42.0


@lru_cache(maxsize=4)
def alone_table(discount: float) -> np.ndarray:
    """``[c, t]``: the chance that a customer, of ``c`` at ``t`` tables, has a table alone: S(c - 1, t - 1) / S(c, t)."""
    log_s = np.full(TABULATED + 1, -np.inf)
    log_s[1] = 0.0
    out = np.zeros((TABULATED + 1, TABULATED + 1))
    out[1, 1] = 1.0
    for c in range(2, TABULATED + 1):
        t = np.arange(1, c + 1)
        stay = np.log(np.maximum(c - 1 - discount * t, 1e-300)) + log_s[1 : c + 1]
        new = np.logaddexp(log_s[:c], stay)
        out[c, 1 : c + 1] = np.exp(log_s[:c] - new)
        log_s[1 : c + 1] = new
    return out


def alone_integral(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """:func:`alone_table` for any ``1 < t < c``, without the numbers below ``c``; for hundreds of customers and more.

    The generating function of the tables' sizes, 1 - (1 - z)^d, gives S(c, t) as the integral of
    exp(f(p)), f(p) = c p + t log(1 - (1 - exp(-p))^d), around its branch point p = 0. The wanted ratio is
    (t d / c) times the mean of exp(-p) / (1 - (1 - exp(-p))^d) under that integrand. The path crosses the real axis
    at the saddle point and is a parabola around the cut, or the line of one period where the saddle is far from it.
    """
    c, t = c.astype(float)[:, None], t.astype(float)[:, None]

    def log_q(p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(p.real < 1.0, np.log(-np.expm1(-p)), np.log1p(-np.exp(-p)))

    def logs(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = np.log(-np.expm1(discount * log_q(p)))
        return c * p + t * kept, -p - kept

    # The saddle, by bisection of log p: f' falls from +inf to t - c as p grows on its logarithm's scale.
    low, high = np.full(c.shape, -60.0), np.full(c.shape, 6.0)
    for _ in range(60):
        middle = (low + high) / 2
        p = np.exp(middle)
        q = log_q(p)
        above = c * -np.expm1(discount * q) < t * discount * np.exp((discount - 1) * q - p)
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    saddle = np.exp(low)
    near = saddle < 0.5
    # A path too close to the branch point would see its corner.
    cross = np.where(near, np.maximum(saddle, 8.0 / c), saddle)

    def path(u: np.ndarray) -> np.ndarray:
        return np.where(near, cross * (1 + 1j * u) ** 2, cross + 1j * u)

    top = logs(cross.astype(complex))[0].real
    # How far the path counts, by bisection.
    low, high = np.zeros(c.shape), np.where(near, np.minimum(12.0, np.pi / (2 * cross)), np.pi)
    for _ in range(30):
        middle = (low + high) / 2
        counts = logs(path(middle))[0].real > top - NEGLIGIBLE
        low, high = np.where(counts, middle, low), np.where(counts, high, middle)
    u = high * (np.arange(NODES) + 0.5) / NODES
    p = path(u)
    exponent, ratio = logs(p)
    weight = np.exp(exponent - top) * np.where(near, 2 * cross * (1 + 1j * u), 1.0)
    mean = (weight * np.exp(ratio)).real.sum(axis=1) / weight.real.sum(axis=1)
    return np.clip(t[:, 0] * discount / c[:, 0] * mean, 0.0, 1.0)


def alone(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The chance that a customer leaving ``c`` customers at ``t`` tables empties a table."""
    known = c <= TABULATED
    # One customer at every table is alone for sure, and so is none of several at one table.
    out = (t == c).astype(float)
    out[known] = alone_table(discount)[c[known], t[known]]
    rest = np.flatnonzero(~known & (t > 1) & (t < c))
    if len(rest):
        pairs, place = np.unique(np.stack([c[rest], t[rest]]), axis=1, return_inverse=True)
        found = [alone_integral(*pairs[:, i : i + PAIRS], discount) for i in range(0, pairs.shape[1], PAIRS)]
        out[rest] = np.concatenate(found)[place.reshape(-1)]
    return out


def seat(c: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after ``c`` customers came in one by one.

    The customers between two new tables are drawn at once: as a Polya urn, their
    number is geometric with a Beta-distributed chance.
    """
    tables = np.ones(len(c), np.int64)
    seated = np.ones(len(c))
    rest = np.flatnonzero(c > 1)
    while len(rest):
        chance = rng.beta(np.maximum(a[rest], 1e-300), seated[rest] - discount * tables[rest])
        with np.errstate(divide="ignore", over="ignore"):
            wait = np.floor(np.log(rng.random(len(rest))) / np.log1p(-np.minimum(chance, 1 - 1e-16)))
        seated[rest] += np.where(np.isfinite(wait), wait, np.inf) + 1
        rest = rest[seated[rest] <= c[rest]]
        tables[rest] += 1
    return tables


def reseat(c: np.ndarray, t: np.ndarray, a: np.ndarray, discount: float, moves: int, rng: np.random.Generator) -> np.ndarray:
    """Tables after ``moves`` Gibbs steps: a random customer of each dish leaves and comes in again.

    Dishes with one customer always have one table.
    """
    out = t.copy()
    rest = np.flatnonzero(c > 1)
    own_c, own_t, own_a = c[rest], out[rest], a[rest]
    for _ in range(moves):
        own_t -= rng.random(len(rest)) < alone(own_c, own_t, discount)
        own_t += rng.random(len(rest)) * (own_a + own_c - 1 - discount * own_t) < own_a
    out[rest] = own_t
    return out
