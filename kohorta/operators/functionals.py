"""Functionals and deltas of per-record measurement series.

Input is the long table `frames(Record, series, t, value)` with t = 0, 1, 2, ... or 1, 2, 3, ... inside each series.
Aggregates combine map-side, so a record that holds a large share of all frames is not gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import over_series, row_index

KEYS = ("Record", "series")

# Savitzky-Golay weights of width 9 (first derivative of a line, second derivative of a parabola).
SLOPE_WEIGHTS = [k / 60.0 for k in range(-4, 5)]
CURVE_WEIGHTS = [k / 462.0 for k in (28, 7, -8, -17, -20, -17, -8, 7, 28)]


def reindex(frames: DataFrame, order: Sequence[str] = ("t",), rows_per_bucket: int | None = None) -> DataFrame:
    """Number frames densely again, for example after a filter."""
    order = list(order)
    numbered = row_index(frames, KEYS, order, "_t", rows_per_bucket)
    return numbered.drop("t").withColumnRenamed("_t", "t")


def _moments(value: Column, prefix: str, ddof: int, single_zero: bool) -> list[Column]:
    std = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    if single_zero:
        std = F.when(F.count(value) == 1, F.lit(0.0)).otherwise(std)
    return [F.avg(value).alias(f"{prefix}mean"), std.alias(f"{prefix}stdev"),
            F.skewness(value).alias(f"{prefix}skew"), F.kurtosis(value).alias(f"{prefix}kurtosis")]


def functionals(frames: DataFrame, ddof: int = 1, voiced_only_level: bool = False,
                keys: Sequence[str] = KEYS) -> DataFrame:
    """mean, stdev, skew, excess kurtosis per series.

    `voiced_only_level` is the pitch rule: mean and stdev skip frames coded 0, skew and kurtosis keep them.
    """
    v = F.col("value")
    mean, std, skew, kurt = _moments(v, "", ddof, False)
    if voiced_only_level:
        voiced = F.when(v > 0, v)
        mean, std, _, _ = _moments(voiced, "", ddof, False)
    return frames.groupBy(*keys).agg(mean, std, skew, kurt)


def deltas(frames: DataFrame, keys: Sequence[str] = KEYS, chunk_rows: int | None = None) -> DataFrame:
    """delta1 = v[i] - v[i-1]; delta2 = v[i] - v[i-2] (a two-step difference)."""
    def columns(w):
        return {"delta1": F.col("value") - F.lag("value", 1).over(w),
                "delta2": F.col("value") - F.lag("value", 2).over(w)}
    return over_series(frames, 2, columns, keys=keys, chunk_rows=chunk_rows)


def delta_stats(frames: DataFrame, keys: Sequence[str] = KEYS, chunk_rows: int | None = None) -> DataFrame:
    """Four statistics of each delta; stdev is 0 when there is a single delta."""
    d = deltas(frames, keys, chunk_rows)
    return d.groupBy(*keys).agg(*_moments(F.col("delta1"), "Delta1_", 1, True),
                                *_moments(F.col("delta2"), "Delta2_", 1, True))


def savitzky_golay(frames: DataFrame, keys: Sequence[str] = KEYS, chunk_rows: int | None = None) -> DataFrame:
    """`slope` and `curve` over nine frames. Within four frames of an end, the value at the nearest full centre;
    a series of fewer than nine frames has NULL."""
    def columns(w):
        near = w.rowsBetween(-8, 8)
        return {"_near": F.collect_list("value").over(near),
                "_left": F.count("value").over(w.rowsBetween(-8, -1)).cast("int")}

    def weighted(weights: list[float]) -> Column:
        size = F.size("_near")
        start = F.least(F.greatest(F.col("_left"), F.lit(4)), size - 5) - 4
        total = F.lit(0.0)
        for i, w in enumerate(weights):
            total = total + F.lit(w) * F.get("_near", start + i)
        return F.when(size >= 9, total)

    near = over_series(frames, 8, columns, keys=keys, chunk_rows=chunk_rows)
    return near.withColumns({"slope": weighted(SLOPE_WEIGHTS), "curve": weighted(CURVE_WEIGHTS)}).drop("_near", "_left")


def cepstral_functionals(frames: DataFrame, keys: Sequence[str] = KEYS, chunk_rows: int | None = None) -> DataFrame:
    """Statistics (stdev with ddof 0) of each coefficient series and of its slope and curve, in one grouped pass."""
    sg = savitzky_golay(frames, keys, chunk_rows)
    aggs = []
    for column, prefix in (("value", ""), ("slope", "Delta_"), ("curve", "Delta2_")):
        aggs += _moments(F.col(column), prefix, 0, False)
    return sg.groupBy(*keys).agg(*aggs)


def to_wide(stats: DataFrame, series: Sequence[str]) -> DataFrame:
    """One row per Record, columns `<series>_<statistic>`: a single grouped pass with conditional picks."""
    names = [c for c in stats.columns if c not in KEYS]
    picks = [F.max(F.when(F.col("series") == s, F.col(c))).alias(f"{s}_{c}") for s in series for c in names]
    return stats.groupBy("Record").agg(*picks)


def join_record_tables(*tables: DataFrame) -> DataFrame:
    """Column-wise concatenation of per-record tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "Record", "inner")
    return out
