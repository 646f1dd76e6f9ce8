"""Variance and correlation filters.

Correlations come from one pass of co-moments. A few columns use built-in covariances (their generated code grows with
the square of the width); wider tables reduce per-batch
numpy co-moments (values shifted by the column means first, so nothing cancels) with a `groupBy(i, j)`. Both are
pairwise-complete, and a constant column has a NULL correlation, which never exceeds a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import feature_columns, unpivot

VARIANCE_THRESHOLD = 0.1
CORRELATION_THRESHOLD = 0.9
NARROW = 4


def _q(name: str):
    return F.col(f"`{name}`").cast("double")


def feature_moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(Feature, n, mean, variance): all in one aggregate over the wide table, no unpivot of rows."""
    aggs = []
    for i, c in enumerate(features):
        aggs += [F.count(_q(c)).alias(f"n{i}"), F.avg(_q(c)).alias(f"m{i}"), F.var_samp(_q(c)).alias(f"v{i}")]
    stats = F.explode(F.array(*[
        F.struct(F.lit(c).alias("Feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
                 F.col(f"v{i}").alias("variance")) for i, c in enumerate(features)]))
    return df.agg(*aggs).select(stats.alias("s")).select("s.*")


def low_variance(df: DataFrame, threshold: float = VARIANCE_THRESHOLD,
                 features: Sequence[str] | None = None) -> DataFrame:
    """(Feature, variance) of the features to remove: sample variance below the threshold."""
    return (feature_moments(df, features or feature_columns(df))
            .filter(F.col("variance") < threshold).select("Feature", "variance"))


def cross_moments(df: DataFrame, features: Sequence[str], key: str | None = None,
                  centre: dict[str, float] | None = None) -> DataFrame:
    """(key, i, j, n, sx, sy, sxx, syy, sxy) for i <= j over rows where both are present, in one pass.

    Each task adds up its Arrow batches with matrix products and emits one row per (key, pair), so what is shuffled
    grows with tasks x pairs, not with rows. `centre` shifts the values first.
    """
    d = len(features)
    keys = [key] if key else []  # an integer column with few values, such as a fold
    shift = np.array([float((centre or {}).get(c) or 0.0) for c in features])
    upper = np.triu_indices(d)
    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    schema = f"{key + ' int, ' if keys else ''}i int, j int, " + ", ".join(f"{s} double" for s in sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            x = np.column_stack([
                batch.column(len(keys) + c).to_numpy(zero_copy_only=False).astype("float64") for c in range(d)]) - shift
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            seen = seen.astype("float64")
            if keys:
                code = batch.column(0).to_numpy(zero_copy_only=False)
                groups = {(int(k),): np.flatnonzero(code == k) for k in np.unique(code)}
            else:
                groups = {(): np.arange(x.shape[0])}
            for key, at in groups.items():
                xs, ms = x[at], seen[at]
                parts = [ms.T @ ms, xs.T @ ms, ms.T @ xs, (xs * xs).T @ ms, ms.T @ (xs * xs), xs.T @ xs]
                old = state.get(key)
                state[key] = parts if old is None else [a + b for a, b in zip(old, parts)]
        for key, parts in state.items():
            columns = [pa.array(np.full(len(upper[0]), v, dtype="int32")) for v in key]
            columns += [pa.array(upper[0].astype("int32")), pa.array(upper[1].astype("int32"))]
            columns += [pa.array(p[upper]) for p in parts]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "i", "j", *sums])

    narrow = df.select(*[F.col(k).cast("int").alias(k) for k in keys], *[_q(c).alias(f"c{i}") for i, c in enumerate(features)])
    return (narrow.mapInArrow(partial, schema).groupBy(*keys, "i", "j")
            .agg(*[F.sum(s).alias(s) for s in sums]))


def corr_matrix(df: DataFrame, features: Sequence[str] | None = None, narrow: int = NARROW,
                centre: dict[str, float] | None = None) -> DataFrame:
    """Upper triangle (i, j, fi, fj, r), i < j, pairwise-complete Pearson. Known means (`centre`) save a pass."""
    features = list(features or feature_columns(df))
    d = len(features)
    if d < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, fi string, fj string, r double")
    if d <= narrow:
        aggs, rows = [], []
        for i in range(d):
            for j in range(i + 1, d):
                x, y = _q(features[i]), _q(features[j])
                both = x.isNotNull() & y.isNotNull()
                spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
                aggs.append((F.covar_samp(x, y) / F.nullif(spread, F.lit(0.0))).alias(f"r{i}_{j}"))
                rows.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(features[i]).alias("fi"),
                                     F.lit(features[j]).alias("fj"), F.col(f"r{i}_{j}").alias("r")))
        return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    if centre is None:
        centre = {r["Feature"]: r["mean"] for r in feature_moments(df, features).collect()}
    m = cross_moments(df, features, centre=centre).filter("i < j")
    n = F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.nullif(n, F.lit(0.0))
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.nullif(n, F.lit(0.0))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.nullif(n, F.lit(0.0))
    # a constant column leaves only rounding in vx: compare with the size of the terms that cancelled
    def spread(v, s):
        return F.when(v > F.lit(1e-14) * F.col(s), v)
    names = F.array(*[F.lit(c) for c in features])
    return m.select("i", "j", names[F.col("i")].alias("fi"), names[F.col("j")].alias("fj"),
                    (cov / F.sqrt(spread(vx, "sxx") * spread(vy, "syy"))).alias("r"))


def correlated_features(df: DataFrame, threshold: float = CORRELATION_THRESHOLD,
                        features: Sequence[str] | None = None, centre: dict[str, float] | None = None) -> DataFrame:
    """(Feature, max_abs_r): a feature goes when any earlier one, kept or not, correlates above the threshold."""
    return (corr_matrix(df, features, centre=centre).groupBy("j", F.col("fj").alias("Feature"))
            .agg(F.max(F.abs("r")).alias("max_abs_r"))
            .filter(F.col("max_abs_r") > threshold).select("Feature", "max_abs_r"))


def remove_low_variance(df: DataFrame, threshold: float = VARIANCE_THRESHOLD) -> tuple[DataFrame, list[str]]:
    gone = {r["Feature"] for r in low_variance(df, threshold).collect()}
    removed = [c for c in df.columns if c in gone]
    return df.drop(*removed), removed


def remove_correlated(df: DataFrame, threshold: float = CORRELATION_THRESHOLD) -> tuple[DataFrame, list[str]]:
    gone = {r["Feature"] for r in correlated_features(df, threshold).collect()}
    removed = [c for c in df.columns if c in gone]
    return df.drop(*removed), removed


def clean(df: DataFrame, variance_threshold: float = VARIANCE_THRESHOLD,
          correlation_threshold: float = CORRELATION_THRESHOLD) -> tuple[DataFrame, dict[str, list[str]]]:
    """Both filters in turn. The actions read statistics only (at most one row per feature or pair)."""
    moments = {r["Feature"]: r for r in feature_moments(df, feature_columns(df)).collect()}
    low = [c for c, r in moments.items() if r["variance"] is not None and r["variance"] < variance_threshold]
    step = df.drop(*low)
    gone = {r["Feature"] for r in correlated_features(
        step, correlation_threshold, centre={c: r["mean"] for c, r in moments.items()}).collect()}
    corr = [c for c in step.columns if c in gone]
    return step.drop(*corr), {"low_variance": low, "correlated": corr}


def removal_log(spark, removed: dict[str, list[str]]) -> DataFrame:
    rows = [(reason, i, f) for reason, names in removed.items() for i, f in enumerate(names)]
    return spark.createDataFrame(rows, "reason string, position int, Feature string")


def removal_report(log: DataFrame, first: int = 10) -> DataFrame:
    """Per reason: how many features went, the first ten by position, and how many more."""
    named = F.array_sort(F.collect_list(F.struct("position", "Feature")))
    return log.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), named.alias("_all")).select(
        "reason", "n", F.concat_ws(",", F.slice("_all", 1, first)["Feature"]).alias("shown"),
        F.greatest(F.lit(0), F.col("n") - first).cast("bigint").alias("more"))


def marker_report(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Per marker: name and category from the dimension, mean, std, min, max and missing count."""
    from ..functions.columns import marker_dimension

    long = unpivot(df, markers, [])
    value = F.when(~F.isnan("value"), F.col("value"))
    stats = long.groupBy(F.col("Feature").alias("Marker")).agg(
        F.avg(value).alias("Mean"), F.stddev_samp(value).alias("Std"), F.min(value).alias("Min"),
        F.max(value).alias("Max"), F.count_if(value.isNull()).alias("Missing"))
    dim = marker_dimension(df.sparkSession).select(
        F.col("code").alias("Marker"), F.col("name").alias("Name"), F.col("category").alias("Category"))
    # the dimension has 22 rows
    return stats.join(F.broadcast(dim), "Marker", "left").select(
        "Marker", F.coalesce("Name", F.lit("Unknown")).alias("Name"),
        F.coalesce("Category", F.lit("Unknown")).alias("Category"), "Mean", "Std", "Min", "Max", "Missing")
