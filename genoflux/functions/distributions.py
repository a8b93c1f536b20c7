"""Densities, quantiles and draws.

Draws hash (seed, key) for each row, so a row's value depends neither on partitioning nor on the order of rows.  What has a
closed inverse is a built-in expression; the rest takes a generator in a pandas UDF, seeded by the row's hash; a batch's seeds are worked out together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .math import NAN, _c, _d


def uniform(seed: int, *key, stream: int = 0) -> Column:
    """A float in (0, 1) of 53 bits for each key."""
    h = F.xxhash64(F.lit(seed).cast("bigint"), F.lit(stream).cast("bigint"), *map(_c, key))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, *key, stream: int = 0) -> Column:
    """Standard normal (Box-Muller)."""
    u, v = uniform(seed, *key, stream=2 * stream + 1001), uniform(seed, *key, stream=2 * stream + 1002)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def runif(seed, *key, low=0.0, high=1.0) -> Column:
    return _d(low) + (_d(high) - _d(low)) * uniform(seed, *key)


def rdunif(seed, *key, low=0, high=1) -> Column:
    """Integers from low to high, both included."""
    return (F.floor(uniform(seed, *key) * (_d(high) - _d(low) + 1)) + _c(low)).cast("bigint")


def rdunif64(seed, *key) -> Column:
    return F.xxhash64(F.lit(seed).cast("bigint"), F.lit(64), *map(_c, key))


def rnorm(seed, *key, mean=0.0, sd=1.0) -> Column:
    return _d(mean) + _d(sd) * normal(seed, *key)


def rlnorm(seed, *key, meanlog=0.0, sdlog=1.0) -> Column:
    return F.exp(rnorm(seed, *key, mean=meanlog, sd=sdlog))


def rexp(seed, *key, mu=1.0) -> Column:
    return -_d(mu) * F.ln(uniform(seed, *key))


def rcauchy(seed, *key, location=0.0, scale=1.0) -> Column:
    return _d(location) + _d(scale) * F.tan(math.pi * (uniform(seed, *key) - 0.5))


def rlaplace(seed, *key, b=1.0) -> Column:
    u = uniform(seed, *key) - 0.5
    return -_d(b) * F.signum(u) * F.ln(1 - 2 * F.abs(u))


def rweibull(seed, *key, scale=1.0, shape=1.0) -> Column:
    return _d(scale) * F.pow(-F.ln(uniform(seed, *key)), 1 / _d(shape))


def rgeom(seed, *key, p=0.5) -> Column:
    """Failures before the first success."""
    q = _d(p)
    return F.when(q >= 1, F.lit(0)).otherwise(F.floor(F.ln(uniform(seed, *key)) / F.ln(1 - F.least(q, F.lit(1 - 1e-16))))).cast("bigint")


def _times(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 128 bits, in halves, times PCG64's multiplier."""
    m_hi, m_lo, half, low = *map(np.uint64, (0x2360ED051FC65DA4, 0x4385DF649FCCF645)), np.uint64(32), np.uint64(0xFFFFFFFF)
    a, b, c, d = lo >> half, lo & low, m_lo >> half, m_lo & low
    ad, bc, bd = a * d, b * c, b * d
    carry = (bd >> half) + (ad & low) + (bc & low)
    return hi * m_lo + lo * m_hi + a * c + (ad >> half) + (bc >> half) + (carry >> half), lo * m_lo


def _plus(hi: np.ndarray, lo: np.ndarray, more_hi: np.ndarray, more_lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = lo + more_lo
    return hi + more_hi + (total < lo), total


def _seeded(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The states and increments of PCG64(seed), in halves, for each seed below 2 ** 63: numpy's seeding, of all seeds at once.

    A test compares them with numpy's own, which takes longer for one seed than most draws do."""
    word = lambda x: np.uint32(x & 0xFFFFFFFF)

    def hashed(v: np.ndarray, const: int, factor: int) -> tuple[np.ndarray, int]:
        v = (v ^ word(const)) * word(const * factor)
        return v ^ (v >> np.uint32(16)), const * factor & 0xFFFFFFFF

    const, pool = 0x43B0D7E5, []
    zero = np.zeros(len(seeds), np.uint32)
    for v in (seeds.astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32), zero, zero):
        v, const = hashed(v, const, 0x931E8875)
        pool.append(v)
    for i in range(4):
        for j in range(4):
            if i != j:
                v, const = hashed(pool[i], const, 0x931E8875)
                v = word(0xCA01F9DD) * pool[j] - word(0x4973F715) * v
                pool[j] = v ^ (v >> np.uint32(16))
    const, out = 0x8B51F9DD, []
    for i in range(8):
        v, const = hashed(pool[i % 4], const, 0x58F38DED)
        out.append(v.astype(np.uint64))
    a, b, c, d = (out[i] | out[i + 1] << np.uint64(32) for i in range(0, 8, 2))
    one = np.uint64(1)
    inc = c << one | d >> np.uint64(63), d << one | one
    return *_plus(*_times(*_plus(*inc, a, b)), *inc), *inc


def _states(seeds: np.ndarray) -> Iterator[dict]:
    """The states of PCG64(seed) for each seed below 2 ** 63, as a generator takes them."""
    for hi, lo, inc_hi, inc_lo in zip(*(x.tolist() for x in _seeded(seeds))):
        yield {"bit_generator": "PCG64", "state": {"state": hi << 64 | lo, "inc": inc_hi << 64 | inc_lo}, "has_uint32": 0, "uinteger": 0}


def _poisson(seeds: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """What Generator(PCG64(seed)).poisson(lam) draws, for means from 0 to less than 10, of all rows at once.

    numpy counts how many uniforms can be multiplied until their product is no more than exp(-lam)."""
    n, rows = np.zeros(len(seeds), np.int64), np.flatnonzero(lam > 0)
    means, which = np.unique(lam[rows], return_inverse=True)
    least = np.array([math.exp(-x) for x in means])[which]
    hi, lo, *inc = (x[rows] for x in _seeded(seeds))
    product = np.ones(len(rows))
    while len(rows):
        hi, lo = _plus(*_times(hi, lo), *inc)
        turn, bits = hi >> np.uint64(58), hi ^ lo
        bits = bits >> turn | bits << (np.uint64(64) - turn & np.uint64(63))
        product *= (bits >> np.uint64(11)) * (1 / (1 << 53))
        on = product > least
        rows, least, hi, lo, product, *inc = (x[on] for x in (rows, least, hi, lo, product, *inc))
        n[rows] += 1
    return n


def _drawn(returns: T.DataType, draw, at_once=None):
    """draw(generator, *parameters), with the generator in the state that each row's hash seeds.

    at_once(seeds, *parameters) draws the same for a whole batch, or gives None for a batch that it isn't for."""

    @F.pandas_udf(returns)
    def udf(h: pd.Series, *args: pd.Series) -> pd.Series:
        g, out = np.random.Generator(np.random.PCG64(0)), []
        bits, seeds = g.bit_generator, h.to_numpy(np.int64).view(np.uint64) & np.uint64((1 << 63) - 1)
        if at_once and (made := at_once(seeds, *args)) is not None:
            return pd.Series(made)
        for state, *a in zip(_states(seeds), *args):
            bits.state = state
            out.append(draw(g, *a))
        return pd.Series(out)

    def f(seed: int, *key, **parameters) -> Column:
        return udf(F.xxhash64(F.lit(seed).cast("bigint"), F.lit(7), *map(_c, key)), *(_c(v) for v in parameters.values()))

    return f


def _multinormal(g: np.random.Generator, mu: np.ndarray, sigma: np.ndarray) -> list[float]:
    """As Generator.multivariate_normal by Cholesky's method, whose factor is kept for the rows of the same sigma."""
    n = len(mu)
    return (np.asarray(mu, float) + g.standard_normal((1, n)) @ _factor(np.asarray(sigma, float).tobytes(), n).T)[0].tolist()


@lru_cache(256)
def _factor(sigma: bytes, n: int) -> np.ndarray:
    return np.linalg.cholesky(np.frombuffer(sigma).reshape(n, n))


def _multinomial(g: np.random.Generator, size: int, prob: np.ndarray) -> list[int]:
    p = np.asarray(prob)
    return g.multinomial(size, p / p.sum()).tolist()


rgamma = _drawn(T.DoubleType(), lambda g, mean, shape: math.copysign(1, mean) * g.gamma(shape, abs(mean) / shape))
rbeta = _drawn(T.DoubleType(), lambda g, alpha, beta: g.beta(alpha, beta))
rf = _drawn(T.DoubleType(), lambda g, d1, d2: g.f(d1, d2))
rbinom = _drawn(T.LongType(), lambda g, size, prob: int(g.binomial(size, prob)))
rpois = _drawn(T.LongType(), lambda g, lam: int(g.poisson(lam)), lambda seeds, lam: _poisson(seeds, lam.to_numpy(float)) if lam.between(0, 10, inclusive="left").all() else None)
rnbinom = _drawn(T.LongType(), lambda g, size, prob: int(g.negative_binomial(size, prob)))
rdirichlet = _drawn(T.ArrayType(T.DoubleType()), lambda g, alpha: g.dirichlet(alpha).tolist())
rmultinom = _drawn(T.ArrayType(T.LongType()), _multinomial)
rmvnorm = _drawn(T.ArrayType(T.DoubleType()), _multinormal)


def _truncated_poisson(g: np.random.Generator, lam: float) -> int:
    """A Poisson variable that isn't zero: the time of the first event is drawn within the interval, the rest is free."""
    first = -math.log1p(-g.random() * -math.expm1(-lam))
    return 1 + int(g.poisson(max(0.0, lam - first)))


rztpois = _drawn(T.LongType(), _truncated_poisson)


def dnorm(x, mean=0.0, sd=1.0) -> Column:
    z = (_d(x) - _d(mean)) / _d(sd)
    return F.exp(-z * z / 2) / (_d(sd) * math.sqrt(2 * math.pi))


def dexp(x, mu=1.0) -> Column:
    return F.when(_d(x) < 0, 0.0).otherwise(F.exp(-_d(x) / _d(mu)) / _d(mu))


@F.pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.lgamma(v) if v > 0 else NAN)


def dgamma(x, mean, shape) -> Column:
    """Of the mean and the shape; a negative mean mirrors it."""
    v, k, scale = _d(x) * F.signum(_d(mean)), _d(shape), F.abs(_d(mean)) / _d(shape)
    return F.when(v < 0, 0.0).otherwise(F.exp((k - 1) * F.ln(F.when(v > 0, v)) - v / scale - lgamma(k) - k * F.ln(scale)))


def dbeta(x, alpha, beta) -> Column:
    v, a, b = _d(x), _d(alpha), _d(beta)
    inside = (v > 0) & (v < 1)
    return F.when(inside, F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * F.ln(F.when(inside, v)) + (b - 1) * F.ln(F.when(inside, 1 - v)))).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


def pnorm(q, mean=0.0, sd=1.0) -> Column:
    return _erfc(-(_d(q) - _d(mean)) / (_d(sd) * math.sqrt(2))) / 2


@F.pandas_udf(T.DoubleType())
def _inverse_normal(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return p.map(lambda v: inverse(v) if 0 < v < 1 else -math.inf if v == 0 else math.inf if v == 1 else NAN)


def qnorm(p, mean=0.0, sd=1.0) -> Column:
    return _d(mean) + _d(sd) * _inverse_normal(_d(p))


def dmvnorm(x, mu: list[float], sigma: list[list[float]]) -> Column:
    """Density of array values."""
    lower = np.linalg.cholesky(np.asarray(sigma, float))

    @F.pandas_udf(T.DoubleType())
    def density(v: pd.Series) -> pd.Series:
        z = np.linalg.solve(lower, (np.stack(v.to_list()) - np.asarray(mu, float)).T) if len(v) else np.zeros((len(mu), 0))
        return pd.Series(np.exp(-(z * z).sum(axis=0) / 2) / (np.prod(np.diag(lower)) * (2 * math.pi) ** (len(mu) / 2)))

    return density(_c(x))


def find_interval(x, breaks: list[float], rightmost_closed: bool = False, all_inside: bool = False) -> Column:
    """0-based interval of x in ascending breaks: -1 below the first, their number less 1 from the last on."""
    v, n = _d(x), len(breaks)
    found = F.size(F.filter(F.array(*[F.lit(float(b)) for b in breaks]), lambda b: b <= v)) - 1
    if rightmost_closed:
        found = F.when(v == breaks[-1], n - 2).otherwise(found)
    if all_inside:
        found = F.greatest(F.lit(0), F.least(F.lit(n - 2), found))
    return found.cast("bigint")
