"""Probability tails, digamma and key-hash randomness as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EULER_GAMMA = 0.5772156649015329


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, relative error below 1e-12.

    Below 2 the series of positive terms 2x/sqrt(pi) exp(-x^2) (1 + y/3 (1 + y/5 (1 + ...))) with y = 2x^2, above it the
    continued fraction exp(-x^2)/sqrt(pi) / (x + 1/2 / (x + 2/2 / (x + 3/2 / ...))).
    """
    y, series, fraction = F.lit(2.0) * x * x, F.lit(1.0), x
    for n in range(45, 0, -1):
        series = F.lit(1.0) + y / F.lit(2.0 * n + 1.0) * series
    for n in range(50, 0, -1):
        fraction = x + F.lit(n / 2.0) / fraction
    bell = F.exp(-x * x) / F.lit(math.sqrt(math.pi))
    return F.when(x < 2, F.lit(1.0) - F.lit(2.0) * x * bell * series).otherwise(bell / fraction)


def normal_two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / F.lit(math.sqrt(2.0))))


def kolmogorov_tail(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided tail of the two-sample gap d; below lambda = 0.2 the tail is 1 to 12 digits."""
    lam = d * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


# digamma(1) .. digamma(9) = H(n-1) - gamma.
_SMALL_DIGAMMA = [sum(1.0 / j for j in range(1, n)) - EULER_GAMMA for n in range(1, 10)]


def digamma(n: Column) -> Column:
    """Digamma of a positive integer column: table below 10, asymptotic series above (error < 1e-11)."""
    x = n.cast("double")
    inv2 = F.lit(1.0) / (x * x)
    series = F.ln(x) - 0.5 / x - inv2 * (F.lit(1 / 12) - inv2 * (F.lit(1 / 120) - inv2 * F.lit(1 / 252)))
    table = F.array(*[F.lit(v) for v in _SMALL_DIGAMMA])
    return F.when(n < 10, F.get(table, n.cast("int") - 1)).otherwise(series)


def hash32(key: Column, seed) -> Column:
    """32-bit unsigned hash of (key, seed): the same on every cluster, partitioning and SQL engine."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat(key.cast("string"), F.lit(":"), seed.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(key: Column, seed) -> Column:
    """Uniform in [0, 1) from `hash32`."""
    return hash32(key, seed) / F.lit(4294967296.0)


def uniform52(key: Column, seed) -> Column:
    """Uniform in [0, 1) with 52 bits, so that it can index any number of rows."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat(key.cast("string"), F.lit(":"), seed.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral (modified Lentz), for whole arrays."""
    def away(v):
        return np.where(np.abs(v) > 1e-300, v, 1e-300)

    c, d = np.ones_like(x), 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / away(1.0 + num * d), away(1.0 + num / c)
            h = h * d * c
        if (np.abs(d * c - 1.0) < 1e-15).all():
            break
    return h


def student_tail(t, dof) -> np.ndarray:
    """Two-sided tail of Student's t, for whole arrays; NaN where an argument is missing or dof is not positive."""
    t, dof = np.broadcast_arrays(np.asarray(t, float), np.asarray(dof, float))
    out = np.full(t.shape, np.nan)
    ok = ~np.isnan(t) & (dof > 0)
    n = dof[ok]
    x, a, b = n / (n + t[ok] ** 2), n / 2.0, np.full(n.shape, 0.5)
    out[ok] = np.clip(x, 0.0, 1.0)  # right at both ends
    inner = (x > 0.0) & (x < 1.0)
    x, a, b = x[inner], a[inner], b[inner]
    sizes, back = np.unique(a, return_inverse=True)
    constant = np.array([math.lgamma(v + 0.5) - math.lgamma(v) - math.lgamma(0.5) for v in sizes])[back]
    front = np.exp(constant + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1.0) / (a + b + 2.0)
    tail = np.empty(x.shape)
    tail[low] = front[low] * _beta_fraction(a[low], b[low], x[low]) / a[low]
    tail[~low] = 1.0 - front[~low] * _beta_fraction(b[~low], a[~low], 1.0 - x[~low]) / b[~low]
    where = np.flatnonzero(ok)[inner]
    out.flat[where] = tail
    return out


@F.pandas_udf(DoubleType())
def student_two_sided(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for t, dof in parts:
        yield pd.Series(student_tail(t, dof), index=t.index).where(t.notna())


# ---- exact tails of small samples ---------------------------------------------------------------

#: Sizes n1 x n2 up to which the exact distributions are counted.
EXACT_U, EXACT_GAP = 20_000, 4_000_000


def exact_u_tail(n1: int, n2: int, u: float) -> float:
    """Two-sided tail of the rank-sum statistic without ties: all orders of n1 + n2 values are equally likely.

    The last value belongs to the first sample with chance n1 / (n1 + n2) and then adds n2 to U; so the distribution of each
    pair of sizes follows from those of the pairs one smaller, by sums of positive terms."""
    top = int(max(u, n1 * n2 - u))
    before = [np.ones(1) for _ in range(n2 + 1)]  # sizes (0, j): U is 0
    for i in range(1, n1 + 1):
        row = [np.ones(1)]
        for j in range(1, n2 + 1):
            p = np.zeros(i * j + 1)
            p[j: j + len(before[j])] += i / (i + j) * before[j]
            p[: len(row[-1])] += j / (i + j) * row[-1]
            row.append(p)
        before = row
    return float(min(1.0, 2.0 * before[n2][top:].sum()))


def exact_gap_tail(n: int, m: int, d: float) -> float:
    """Chance that two samples of one continuous distribution differ by a gap of at least d: of all lattice paths from (0, 0)
    to (n, m), the share that touches |i / n - j / m| >= d, added up where paths touch first."""
    bound = round(d * n * m - 1e-7 * min(1.0, d * n * m))  # gaps are whole multiples of 1 / (n m)
    if bound <= 0:
        return 1.0
    i = np.arange(n + 1)
    inside, out = np.zeros(n + 1), 0.0  # by i, on the diagonal i + j = t
    inside[0] = 1.0
    for t in range(n + m):
        j = t - i
        right = np.where((j >= 0) & (j <= m), (n - i) / (n + m - t), 0.0)
        step = inside * (1.0 - right)
        step[1:] += (inside * right)[:-1]
        j = t + 1 - i
        touched = (np.abs(i * m - j * n) >= bound) & (j >= 0) & (j <= m)
        out += float(step[touched].sum())
        step[touched] = 0.0
        inside = step
    return float(min(1.0, out))


@F.pandas_udf(DoubleType())
def exact_u(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for n1, n2, u in parts:
        yield pd.Series([exact_u_tail(int(min(a, b)), int(max(a, b)), c) if a * b <= EXACT_U else None
                         for a, b, c in zip(n1, n2, u)], dtype="float64")


@F.pandas_udf(DoubleType())
def exact_gap(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for n, m, d in parts:
        yield pd.Series([exact_gap_tail(int(min(a, b)), int(max(a, b)), c) if a * b <= EXACT_GAP else None
                         for a, b, c in zip(n, m, d)], dtype="float64")
