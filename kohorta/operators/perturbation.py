"""Cycle-to-cycle perturbation: jitter of period series, shimmer of amplitude series.

A neighbour pair counts when its larger-to-smaller ratio stays within `factor`; multi-point measures need every pair
of their span to count. Periods must also lie within [floor, ceiling].
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import over_series

PERIOD_FLOOR, PERIOD_CEILING, PERIOD_FACTOR, AMPLITUDE_FACTOR = 1e-4, 0.02, 1.3, 1.6
_KEYS = ("Record", "series")


def _neighbourhood(frames: DataFrame, span: int, usable, factor: float, keys, chunk_rows) -> DataFrame:
    """Adds v<k> for k = -span..span and ok<k> = "the pair (k-1, k) counts"."""
    def columns(w):
        out = {}
        for k in range(-span, span + 1):
            v = F.col("value") if k == 0 else (F.lag("value", -k).over(w) if k < 0 else F.lead("value", k).over(w))
            out[f"v{k}"] = v
        return out

    def at(k: int) -> Column:
        return F.col(f"`v{k}`")

    base = over_series(frames, span, columns, keys=keys, chunk_rows=chunk_rows)
    pairs = {}
    for k in range(-span + 1, span + 1):
        a, b = at(k - 1), at(k)
        ratio = F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0.0))
        good = (ratio <= F.lit(factor)) & usable(a) & usable(b)
        pairs[f"ok{k}"] = F.coalesce(good, F.lit(False))
    return base.withColumns(pairs)


def _ok(first: int, last: int) -> Column:
    """All pairs between offsets first and last count."""
    out = F.lit(True)
    for k in range(first + 1, last + 1):
        out = out & F.col(f"`ok{k}`")
    return out


def _mean_gap(half: int) -> Column:
    """|v - mean of the 2*half+1 points around it|, only where the whole span counts."""
    points = [F.col(f"`v{k}`") for k in range(-half, half + 1)]
    total = points[0]
    for p in points[1:]:
        total = total + p
    return F.avg(F.when(_ok(-half, half), F.abs(F.col("v0") - total / F.lit(2.0 * half + 1.0))))


def jitter(frames: DataFrame, floor: float = PERIOD_FLOOR, ceiling: float = PERIOD_CEILING,
           factor: float = PERIOD_FACTOR, keys: Sequence[str] = _KEYS, chunk_rows: int | None = None) -> DataFrame:
    """Local, absolute, RAP, PPQ5 and DDP per series; divided by the mean of the periods within [floor, ceiling]."""
    rule = lambda v: (v >= F.lit(floor)) & (v <= F.lit(ceiling))
    n = _neighbourhood(frames, 2, rule, factor, keys, chunk_rows)
    v0 = F.col("v0")
    stats = n.groupBy(*keys).agg(
        F.avg(F.when(_ok(-1, 0), F.abs(v0 - F.col("`v-1`")))).alias("abs1"),
        _mean_gap(1).alias("rap"), _mean_gap(2).alias("ppq5"),
        F.avg(F.when(_ok(-1, 1), F.abs(F.col("v1") - v0 - (v0 - F.col("`v-1`"))))).alias("ddp"),
        F.avg(F.when(rule(v0), v0)).alias("level"))
    level = F.nullif(F.col("level"), F.lit(0.0))
    return stats.select(
        *keys, (F.col("abs1") / level).alias("Local_jitter"), F.col("abs1").alias("Local_absolute_jitter"),
        (F.col("rap") / level).alias("RAP_jitter"), (F.col("ppq5") / level).alias("PPQ5_jitter"),
        (F.col("ddp") / level).alias("DDP_jitter"))


def shimmer(frames: DataFrame, factor: float = AMPLITUDE_FACTOR, keys: Sequence[str] = _KEYS,
            chunk_rows: int | None = None) -> DataFrame:
    """Local, dB, APQ3, APQ5, APQ11 and DDA per series; divided by the mean amplitude."""
    n = _neighbourhood(frames, 5, lambda v: v > F.lit(0.0), factor, keys, chunk_rows)
    v0, prev, after = F.col("v0"), F.col("`v-1`"), F.col("v1")
    stats = n.groupBy(*keys).agg(
        F.avg(F.when(_ok(-1, 0), F.abs(v0 - prev))).alias("abs1"),
        F.avg(F.when(_ok(-1, 0), F.abs(F.lit(20.0) * F.log10(v0 / prev)))).alias("db"),
        _mean_gap(1).alias("apq3"), _mean_gap(2).alias("apq5"), _mean_gap(5).alias("apq11"),
        F.avg(F.when(_ok(-1, 1), F.abs(after - v0 - (v0 - prev)))).alias("dda"),
        F.avg(v0).alias("level"))
    level = F.nullif(F.col("level"), F.lit(0.0))
    return stats.select(
        *keys, (F.col("abs1") / level).alias("Local_shimmer"), F.col("db").alias("Local_dB_shimmer"),
        (F.col("apq3") / level).alias("APQ3_shimmer"), (F.col("apq5") / level).alias("APQ5_shimmer"),
        (F.col("apq11") / level).alias("APQ11_shimmer"), (F.col("dda") / level).alias("DDA_shimmer"))
