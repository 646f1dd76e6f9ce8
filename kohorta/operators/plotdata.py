"""The tables behind the figures."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import feature_columns, inf_to_null, nan_to_null
from ..functions.formulas import hash32
from .clean import corr_matrix, feature_moments
from .metrics import class_counts
from .neighbours import _matrix
from .ordered import quantiles, spread_small

GRID = 200
KERNELS = ("rbf", "sigmoid", "poly")


def class_distribution(before: DataFrame, after: DataFrame) -> DataFrame:
    """(Stage, Diagnosed, n)."""
    def side(df, tag):
        return class_counts(df).select(F.lit(tag).alias("Stage"), "Diagnosed", "n")
    return side(before, "Before").unionByName(side(after, "After"))


def correlation_heatmap(df: DataFrame, max_features: int = 50) -> DataFrame:
    return corr_matrix(df, feature_columns(df)[:max_features])


def top_importance(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("Importance"), "Feature").limit(n)


def feature_density(before: DataFrame, after: DataFrame, max_features: int = 30, grid: int = GRID) -> DataFrame:
    """(Stage, Feature, g, x, density): Gaussian kernel density on `grid` points from min - 3h to max + 3h,
    h = n^(-1/5) * std. Every row contributes; tasks add up their batches and pass on grid sums only."""
    features = feature_columns(before)[:max_features]
    parts = []
    for tag, df in (("Before", before), ("After", after)):
        clean = inf_to_null(nan_to_null(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features])))
        aggs = [a for i, c in enumerate(features) for a in (
            F.count(f"`{c}`").alias(f"n{i}"), F.stddev_samp(f"`{c}`").alias(f"s{i}"), F.min(f"`{c}`").alias(f"a{i}"),
            F.max(f"`{c}`").alias(f"b{i}"))]
        one = clean.agg(*aggs).first()
        shape = []
        for i, c in enumerate(features):
            if one[f"n{i}"] > 1 and one[f"s{i}"]:
                h = one[f"n{i}"] ** -0.2 * one[f"s{i}"]
                lo, hi = one[f"a{i}"] - 3 * h, one[f"b{i}"] + 3 * h
                shape.append((i, c, h, one[f"n{i}"], lo + (hi - lo) * np.arange(grid) / (grid - 1)))

        def sums(batches: Iterator[pa.RecordBatch], shape=shape) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(shape), grid))
            for batch in batches:
                for row, (i, _, h, _, xs) in enumerate(shape):
                    v = batch.column(i).to_numpy(zero_copy_only=False).astype("float64")
                    v = v[~np.isnan(v)]
                    for at in range(0, len(v), 8192):
                        z = (xs[:, None] - v[None, at:at + 8192]) / h
                        total[row] += np.exp(-0.5 * z * z).sum(axis=1)
            f, g = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(f.ravel().astype("int32")), pa.array(g.ravel().astype("int32")), pa.array(total.ravel())],
                names=["f", "g", "s"])

        if not shape:
            continue
        summed = spread_small(clean).mapInArrow(sums, "f int, g int, s double").groupBy("f", "g").agg(F.sum("s").alias("s"))
        meta = df.sparkSession.createDataFrame(
            [(r, c, 1.0 / (n * h * math.sqrt(2 * math.pi)), float(xs[0]), float(xs[-1]))
             for r, (_, c, h, n, xs) in enumerate(shape)],
            "f int, Feature string, unit double, lo double, hi double")
        parts.append(summed.join(F.broadcast(meta), "f").select(  # at most max_features rows
            F.lit(tag).alias("Stage"), "Feature", "g",
            (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / F.lit(float(grid - 1))).alias("x"),
            (F.col("s") * F.col("unit")).alias("density")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


BROADCAST_GROUPS = 1000


def boxplot_stats(df: DataFrame, feature: str, group: str = "Diagnosed") -> tuple[DataFrame, DataFrame]:
    """(per group: quartiles, whiskers at the last value within 1.5 IQR, outlier count; the outlier rows)."""
    rows = inf_to_null(nan_to_null(df.select(group, F.col(f"`{feature}`").cast("double").alias("value")))).filter(
        F.col("value").isNotNull())
    q = quantiles(rows, [group], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    fences = q.withColumn("_lo", F.col("q1") - 1.5 * iqr).withColumn("_hi", F.col("q3") + 1.5 * iqr)
    # few groups (as always with a class) travel to the rows
    few = df.select(group).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    placed = rows.join(F.broadcast(fences) if few else fences, group)
    inside = (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    stats = placed.groupBy(group).agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))
    return stats, placed.filter(~inside).select(group, "value")


def _project(df: DataFrame, column: str, n_components: int, keep: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """Principal components of an already centred vector column."""
    model = PCA(k=n_components, inputCol=column, outputCol="_pc").fit(df)
    out = model.transform(df).withColumn("_pc", vector_to_array("_pc"))
    cols = [F.col("_pc")[i].alias(f"PC{i + 1}") for i in range(n_components)]
    return out.select(*keep, *cols), [float(x) for x in model.explainedVariance.toArray()]


def pca(df: DataFrame, features: Sequence[str] | None = None, n_components: int = 2,
        keep: Sequence[str] = ("Record", "Diagnosed")) -> tuple[DataFrame, DataFrame]:
    """(coordinates, explained variance %): centred, not scaled."""
    features = list(features or feature_columns(df))
    rows = df.dropna(subset=features)
    mean = {r["Feature"]: r["mean"] for r in feature_moments(rows, features).collect()}
    centred = rows.select(*keep, array_to_vector(F.array(
        *[F.col(f"`{c}`").cast("double") - F.lit(mean[c]) for c in features])).alias("_c"))
    coords, share = _project(centred, "_c", n_components, keep)
    table = df.sparkSession.createDataFrame(
        [(i + 1, 100.0 * s) for i, s in enumerate(share)], "component int, explained double")
    return coords, table


def kernel_pca(df: DataFrame, kernel: str = "rbf", features: Sequence[str] | None = None, n_components: int = 2,
               landmarks: int = 128, gamma: float | None = None, id: str = "Record",
               keep: Sequence[str] = ("Record", "Diagnosed")) -> tuple[DataFrame, DataFrame]:
    """(coordinates, variance share %) of kernel PCA through a Nystrom map: each row becomes its kernel values with a
    fixed number of landmark rows, so nothing of size rows x rows is formed."""
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel}; one of {KERNELS}")
    features = list(features or feature_columns(df))
    rows = df.dropna(subset=features).withColumn(
        "_v", F.array(*[F.col(f"`{c}`").cast("double") for c in features]))
    marks = np.array([list(r["_v"]) for r in rows.select(
        "_v", hash32(F.col(id), "landmark").alias("h"), id).orderBy("h", id).limit(landmarks).collect()])
    g = gamma if gamma is not None else 1.0 / len(features)

    def kernel_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if kernel == "rbf":
            sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
            return np.exp(-g * np.maximum(sq, 0.0))
        dot = g * (a @ b.T) + 1.0
        return np.tanh(dot) if kernel == "sigmoid" else dot ** 3

    values, vectors = np.linalg.eigh(kernel_of(marks, marks))
    good = values > 1e-10 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    width = int(good.sum())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = kernel_of(_matrix(batch.column("_v")), marks) @ root
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(0, z.size + 1, width, dtype="int32")), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], flat], names=[*keep, "_z"])

    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    z = rows.select(*keep, "_v").mapInArrow(mapped, f"{ddl}, _z array<double>")
    means = z.agg(*[F.avg(F.col("_z")[i]).alias(f"m{i}") for i in range(width)]).first()
    centre = F.array(*[F.lit(float(m)) for m in means])
    centred = z.select(*keep, array_to_vector(F.zip_with("_z", centre, lambda a, b: a - b)).alias("_c"))
    coords, _ = _project(centred, "_c", n_components, keep)
    spread = coords.agg(*[F.var_pop(f"PC{i + 1}").alias(f"v{i}") for i in range(n_components)]).first()
    total = sum(spread) or 1.0
    share = df.sparkSession.createDataFrame(
        [(i + 1, 100.0 * v / total) for i, v in enumerate(spread)], "component int, explained double")
    return coords, share
