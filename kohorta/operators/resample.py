"""Synthetic minority oversampling and the two cleaning rules that may follow it.

Draw i of a run picks its minority row, its neighbour and its position between them from hashes of (i, seed), so the
synthetic rows do not depend on partitioning. Draws meet their rows by equi-joins on evenly spread keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import PATHOLOGICAL, feature_columns
from ..functions.formulas import uniform, uniform52
from ..session import materialise
from .assemble import with_row_id
from .metrics import class_balance, class_counts
from .neighbours import knn_join, vector
from .ordered import row_index
from .stats import ks_test

METHODS = ("smote", "borderline_smote", "smote_tomek", "smote_enn")
DANGER_NEIGHBOURS = 10


def _with_vectors(df: DataFrame, features: Sequence[str], id: str) -> DataFrame:
    return df.select(F.col(id).cast("string").alias("rid"), "Diagnosed", vector(features).alias("v"))


def _unusable_rows(features: Sequence[str]):
    fine = [F.col(f"`{c}`").cast("double") for c in features]
    bad = [x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) for x in fine]
    return F.count_if(reduce(or_, bad, F.lit(False)))


def danger_rows(df: DataFrame, minority: str, features: Sequence[str], id: str = "Record",
                m: int = DANGER_NEIGHBOURS, **knn) -> DataFrame:
    """Minority rows (rid, other) with m/2 <= number of other-class rows among the m nearest < m."""
    rows = _with_vectors(df, features, id).withColumn("y", (F.col("Diagnosed") != minority).cast("int"))
    near = knn_join(rows.filter(F.col("y") == 0), rows, m, id="rid", exclude="rid", carry=["y"], **knn)
    return near.groupBy("rid").agg(F.sum("y").alias("other")).filter(
        (F.col("other") >= m / 2) & (F.col("other") < m))


def _synthetic(df: DataFrame, features: Sequence[str], minority: str, n_new: int, n_minority: int, k: int, seed: int,
               id: str, seeds: DataFrame | None, n_seeds: int, knn: dict) -> DataFrame:
    """(draw, v): n_new interpolated vectors."""
    spark = df.sparkSession
    rows = materialise(_with_vectors(df.filter(F.col("Diagnosed") == minority), features, id).select("rid", "v"), "minority")
    base = rows if seeds is None else rows.join(seeds.select("rid"), "rid", "left_semi")
    near = knn_join(base, rows, k, id="rid", exclude="rid", **knn)
    placed = row_index(base, [], ["rid"], "pos").select((F.col("pos") - 1).alias("pos"), "rid", "v")
    d = F.col("id")
    draws = spark.range(n_new).select(
        d.alias("draw"),
        F.floor(uniform52(d, f"{seed}:row") * n_seeds).alias("pos"),
        (F.floor(uniform(d, f"{seed}:neighbour") * k) + 1).cast("int").alias("neighbour_rank"),
        uniform(d, f"{seed}:step").alias("step"))
    started = draws.join(placed, "pos")
    paired = started.join(near.select("rid", "neighbour_rank", "neighbour"), ["rid", "neighbour_rank"])
    ends = rows.select(F.col("rid").alias("neighbour"), F.col("v").alias("w"))
    step = F.col("step")
    return paired.join(ends, "neighbour").select(
        "draw", F.zip_with("v", "w", lambda a, b: a + step * (b - a)).alias("v"))


def smote(df: DataFrame, k: int = 7, seed: int = 42, features: Sequence[str] | None = None, id: str = "Record",
          borderline: bool = False, keep_row_id: bool = False, **knn) -> DataFrame:
    """Originals plus synthetic minority rows up to the majority's size.

    Output: Record (string; 'SMOTE' on synthetic rows), Diagnosed, Is_SMOTE, features; `row_id` is unique. Rows that
    repeat `id` are rows of their own. A missing or infinite feature value raises a ValueError.
    """
    features = list(features or feature_columns(df))
    df = materialise(df, "rows")  # checked, counted, searched and drawn from: derived once
    bad = df.agg(_unusable_rows(features)).first()[0]
    if bad:
        raise ValueError(f"{bad} rows have a missing or infinite value: drop or fill them first")
    df = with_row_id(df, id)
    id = "_rid"
    counts = sorted((r["n"], r["Diagnosed"]) for r in class_counts(df).collect())  # one row per class
    if len(counts) != 2:
        raise ValueError(f"expected two classes, found {[c for _, c in counts]}")
    (n_min, minority), (n_maj, _) = counts
    # originals travel with their own id
    originals = df.select(
        F.concat(F.lit("o:"), F.col(id).cast("string")).alias("row_id"), F.col("Record").cast("string").alias("Record"),
        "Diagnosed", F.lit(False).alias("Is_SMOTE"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    out = originals
    if n_maj > n_min:
        if k >= n_min:
            raise ValueError(f"k = {k} needs more than {k} minority rows, found {n_min}")
        start, n_start = None, n_min
        if borderline:
            start = materialise(danger_rows(df, minority, features, id, **knn), "danger")
            n_start = start.count()
        if n_start:
            made = _synthetic(df, features, minority, n_maj - n_min, n_min, k, seed, id, start, n_start, knn)
            out = originals.unionByName(made.select(
                F.concat(F.lit("s:"), F.col("draw").cast("string")).alias("row_id"), F.lit("SMOTE").alias("Record"),
                F.lit(minority).alias("Diagnosed"), F.lit(True).alias("Is_SMOTE"),
                *[F.col("v")[i].alias(c) for i, c in enumerate(features)]))
    return out if keep_row_id else out.drop("row_id")


def tomek_links(df: DataFrame, features: Sequence[str], id: str = "row_id", **knn) -> DataFrame:
    """(id) of both ends of every Tomek link: two rows of different class, each the other's nearest."""
    rows = df.select(id, F.col("Diagnosed").alias("label"), vector(features).alias("v"))
    near = knn_join(rows, rows, 1, id=id, exclude=id, carry=["label"], **knn)
    own = rows.select(id, F.col("label").alias("own"))
    cross = near.join(own, id).filter(F.col("own") != F.col("label")).select(id, "neighbour")
    back = cross.select(F.col("neighbour").alias(id), F.col(id).alias("neighbour"))
    return cross.join(back, [id, "neighbour"], "left_semi").select(id)


def enn_violations(df: DataFrame, features: Sequence[str], id: str = "row_id", k: int = 3, **knn) -> DataFrame:
    """(id) of the rows whose k nearest are not all of their own class."""
    rows = df.select(id, F.col("Diagnosed").alias("label"), vector(features).alias("v"))
    near = knn_join(rows, rows, k, id=id, exclude=id, carry=["label"], **knn)
    own = rows.select(id, F.col("label").alias("own"))
    return near.join(own, id).filter(F.col("own") != F.col("label")).select(id).distinct()


def resample(df: DataFrame, method: str = "smote", k: int = 7, seed: int = 42, enabled: bool = True,
             features: Sequence[str] | None = None, id: str = "Record", keep_row_id: bool = False,
             **knn) -> DataFrame:
    if not enabled:
        return df
    if method not in METHODS:
        raise ValueError(f"unknown resampling method {method}; one of {METHODS}")
    features = list(features or feature_columns(df))
    out = smote(df, k, seed, features, id, borderline=method == "borderline_smote", keep_row_id=True, **knn)
    if method in ("smote_tomek", "smote_enn"):
        out = materialise(out, "resampled")  # searched and then filtered: drawn once
    if method == "smote_tomek":
        out = out.join(tomek_links(out, features, **knn), "row_id", "left_anti")
    elif method == "smote_enn":
        out = out.join(enn_violations(out, features, **knn), "row_id", "left_anti")
    return out if keep_row_id else out.drop("row_id")


def resampling_analysis(before: DataFrame, after: DataFrame, features: Sequence[str] | None = None,
                        label: str = PATHOLOGICAL) -> dict[str, DataFrame]:
    """Class counts and balance before and after, and the gap test of the resampled class."""
    return {"before": class_counts(before), "after": class_counts(after), "balance": class_balance(before, after),
            "ks_tests": ks_test(before, after, features, label=label)}
