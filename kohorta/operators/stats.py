"""Rank-sum, two-sample gap and t tests for all features or models in one job; bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import CONTROL, PATHOLOGICAL, feature_columns, unpivot
from ..functions.formulas import (EXACT_GAP, EXACT_U, exact_gap, exact_u, kolmogorov_tail, normal_two_sided, student_two_sided,
                                  uniform)
from .metrics import METRICS, confusion_aggs, metric_columns
from .ordered import mid_rank, running

ALPHA = 0.05


#: Rank sums are counted exactly when a sample has so few values, none of them tied.
FEW = 8


def mann_whitney(df: DataFrame, features: Sequence[str] | None = None, rows_per_bucket: int | None = None,
                 method: str = "auto") -> DataFrame:
    """(Feature, n1, n2, U, z, P-Value): control against pathological.

    `method` asymptotic: normal tail with tie and continuity correction; exact: counted where there are no ties and n1 x n2
    is within `EXACT_U`; auto: exact if also one sample has at most `FEW` values.

    Rows are reduced to (Feature, value) counts before ranking, so ties cost nothing and a feature of any length is
    ranked range by range. A feature with an empty class is left out.
    """
    features = list(features or feature_columns(df))
    long = unpivot(df.filter(F.col("Diagnosed").isin(CONTROL, PATHOLOGICAL)), features, ["Diagnosed"]).filter(
        F.col("value").isNotNull())
    control = F.when(F.col("Diagnosed") == CONTROL, 1).otherwise(0)
    ranked = mid_rank(long, ["Feature"], "value", {"c": control}, rows_per_bucket)
    n = F.col("n").cast("double")
    sums = ranked.groupBy("Feature").agg(
        F.sum("c").cast("double").alias("n1"), F.sum(n - F.col("c")).alias("n2"),
        F.sum(F.col("mid_rank") * F.col("c")).alias("r1"), F.sum(n * n * n - n).alias("ties")
    ).filter((F.col("n1") > 0) & (F.col("n2") > 0))
    n1, n2 = F.col("n1"), F.col("n2")
    total = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * (total + 1 - F.col("ties") / (total * F.nullif(total - 1, F.lit(0.0))))
    spread = F.sqrt(F.greatest(F.lit(0.0), variance))
    # two-sided: continuity correction on the larger U; no gap (as in a constant feature) means p = 1
    gap = F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5
    z = gap / F.nullif(spread, F.lit(0.0))
    tail = F.when(F.col("gap") <= 0, 1.0).otherwise(normal_two_sided(F.col("z")))
    small = {"asymptotic": F.lit(False), "exact": F.lit(True), "auto": F.least(n1, n2) <= FEW}[method]
    counted = small & (F.col("ties") == 0) & (n1 * n2 <= EXACT_U)
    out = sums.select("Feature", n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), u.alias("U"),
                      z.alias("z"), gap.alias("gap"), counted.alias("counted")).withColumn("P-Value", tail)
    if method != "asymptotic":  # sizes of samples that aren't counted are passed as nothing
        sizes = [F.when(F.col("counted"), F.col(c)).otherwise(0) for c in ("n1", "n2")]
        out = out.withColumn("P-Value", F.when(F.col("counted"), exact_u(*sizes, F.col("U"))).otherwise(F.col("P-Value")))
    return out.drop("gap", "counted")


def bonferroni(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds the adjusted p (p x m, at most 1) and the decision p <= alpha / m."""
    p = F.col("P-Value")
    counted = tests.crossJoin(F.broadcast(tests.agg(F.count("P-Value").alias("_m"))))  # one row
    return (counted.withColumn("Adjusted P-Value", F.least(F.lit(1.0), p * F.col("_m")))
            .withColumn("Reject Null Hypothesis", p <= F.lit(alpha) / F.col("_m")).drop("_m"))


def statistical_selection(df: DataFrame, features: Sequence[str] | None = None, alpha: float = ALPHA) -> DataFrame:
    """Rank-sum tests with the multiple-testing correction, ascending."""
    return (bonferroni(mann_whitney(df, features), alpha)
            .select("Feature", "P-Value", "Adjusted P-Value", "Reject Null Hypothesis")
            .orderBy("Adjusted P-Value", "Feature"))


def ks_test(before: DataFrame, after: DataFrame, features: Sequence[str] | None = None, alpha: float = ALPHA,
            label: str | None = PATHOLOGICAL, rows_per_bucket: int | None = None, method: str = "auto") -> DataFrame:
    """(Feature, Statistic, P-Value, Significant): largest gap of the two empirical distributions per feature.

    `label` restricts both sides to one class; None compares whole tables. `method` auto: the exact tail where n1 x n2 is within
    `EXACT_GAP`, else the asymptotic one, which `asymptotic` takes always.
    """
    if features is None:
        features = [c for c in feature_columns(before) if c in after.columns]

    def side(df: DataFrame, flag: int) -> DataFrame:
        if label is not None:
            df = df.filter(F.col("Diagnosed") == label)
        return unpivot(df, features, []).withColumn("a", F.lit(flag))

    both = side(before, 1).unionByName(side(after, 0)).filter(F.col("value").isNotNull())
    counts = both.groupBy("Feature", "value").agg(F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb"))
    run = running(counts, ["Feature"], ["value"], {"ca": F.col("na"), "cb": F.col("nb")}, sizing=both,
                  rows_per_bucket=rows_per_bucket, totals=True)
    ta, tb = F.col("ca_total").cast("double"), F.col("cb_total").cast("double")
    gaps = run.filter((ta > 0) & (tb > 0)).groupBy("Feature").agg(
        F.max(F.abs(F.col("ca") / ta - F.col("cb") / tb)).alias("Statistic"), F.max(ta).alias("ta"),
        F.max(tb).alias("tb"))
    p = kolmogorov_tail(F.col("Statistic"), F.col("ta"), F.col("tb"))
    if method == "auto":
        small = F.col("ta") * F.col("tb") <= EXACT_GAP
        sizes = [F.when(small, F.col(c)).otherwise(0.0) for c in ("ta", "tb")]
        p = F.when(small, exact_gap(*sizes, F.col("Statistic"))).otherwise(p)
    elif method != "asymptotic":
        raise ValueError(f"unknown method {method}")
    return gaps.withColumn("P-Value", p).select(
        "Feature", "Statistic", "P-Value", (F.col("P-Value") < alpha).alias("Significant"))


def model_pairs(metrics: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """One row per (Metric, Method, Model 1 < Model 2) with both sides' n, mean, variance: scores are reduced to
    sufficient statistics first, then paired."""
    long = metrics.unpivot(["Model", "Method"], [F.col(f"`{c}`") for c in names], "Metric", "score")
    per = long.groupBy("Metric", "Method", "Model").agg(
        F.count("score").alias("n"), F.avg("score").alias("m"), F.var_samp("score").alias("v"))
    a = per.select("Metric", "Method", F.col("Model").alias("Model 1"),
                   *[F.col(c).alias(c + "1") for c in "nmv"])
    b = per.select("Metric", "Method", F.col("Model").alias("Model 2"),
                   *[F.col(c).alias(c + "2") for c in "nmv"])
    # a handful of models per (Metric, Method), so the pairs are few
    return a.join(b, ["Metric", "Method"]).filter(F.col("Model 1") < F.col("Model 2"))


def t_test_pairs(metrics: DataFrame, alpha: float = ALPHA, names: Sequence[str] = METRICS) -> DataFrame:
    """Student's t with pooled variance for every pair with at least two scores each."""
    pairs = model_pairs(metrics, names).filter((F.col("n1") > 1) & (F.col("n2") > 1))
    dof = (F.col("n1") + F.col("n2") - 2).cast("double")
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    spread = F.sqrt(pooled * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    t = (F.col("m1") - F.col("m2")) / F.nullif(spread, F.lit(0.0))
    tested = pairs.select("Metric", "Method", "Model 1", "Model 2", t.alias("T-statistic"), dof.alias("dof"))
    tested = tested.withColumn("P-value", student_two_sided("T-statistic", "dof"))
    significant = F.coalesce(F.col("P-value") < alpha, F.lit(False))
    winner = F.when(F.col("T-statistic") > 0, F.col("Model 1")).when(
        F.col("T-statistic").isNotNull(), F.col("Model 2"))
    return tested.withColumn("Significant", significant).withColumn(
        "Better Model", F.concat(winner, F.when(F.col("Significant"), "*").otherwise("")))


# ---- bootstrap ----------------------------------------------------------------------------------

_POISSON_STEPS = 12


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw from a uniform, by the cumulative table (the tail beyond 12 is below 1e-9)."""
    cumulative, term, out = 0.0, float(np.exp(-1.0)), F.lit(0)
    for k in range(_POISSON_STEPS):
        cumulative += term
        out = out + F.when(u >= F.lit(cumulative), 1).otherwise(0)
        term /= k + 1
    return out


def bootstrap_replicates(pairs: DataFrame, n: int = 100, seed: int = 42, key: str = "Record",
                         metrics: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """(b, metrics...) of n Poisson replicates of (key, y, p): each row's weight is a function of (key, b, seed), so
    every replicate is summed map-side and only b x cells is shuffled. `metrics` maps a name to an aggregate over
    y, p and the weight w."""
    b = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b")
    weighted = pairs.select(F.col(key).alias("_k"), "y", "p", b).withColumn(
        "w", poisson_weight(uniform(F.col("_k"), F.concat(F.lit(f"{seed}:"), F.col("b").cast("string")))))
    if metrics is not None:
        return weighted.groupBy("b").agg(*[f().alias(k) for k, f in metrics.items()])
    return metric_columns(weighted.groupBy("b").agg(*confusion_aggs(F.col("w"))), ["b"])


def cell_replicates(pairs: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """(b, metrics...): resampling N rows with replacement is a multinomial draw over the four confusion cells, so
    the table is reduced to four counts once and each replicate costs the same at any size."""
    cells = pairs.agg(*confusion_aggs(F.lit(1)))
    draws = cells.select("tn", "fp", "fn", "tp", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))

    def resample(parts):
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                counts = np.array([row.tn, row.fp, row.fn, row.tp], dtype="int64")
                rng = np.random.default_rng([seed, int(row.b)])
                out.append((row.b, *rng.multinomial(counts.sum(), counts / counts.sum())))
            yield pd.DataFrame(out, columns=["b", "tn", "fp", "fn", "tp"])

    drawn = draws.mapInPandas(resample, "b int, tn bigint, fp bigint, fn bigint, tp bigint")
    return metric_columns(drawn, ["b"])


def intervals(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """(Metric, mean, std with ddof 0, ci_lower, ci_upper) over the replicates; NULL replicates are skipped."""
    names = [c for c in replicates.columns if c != "b"]
    long = replicates.unpivot(["b"], [F.col(f"`{c}`") for c in names], "Metric", "score").filter(
        F.col("score").isNotNull())
    tail = (1.0 - level) / 2.0
    # n replicates per metric, so the built-in exact percentile holds few values
    return long.groupBy("Metric").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
        F.percentile("score", tail).alias("ci_lower"), F.percentile("score", 1.0 - tail).alias("ci_upper"))


def bootstrap_ci(pairs: DataFrame, n: int = 100, level: float = 0.95, seed: int = 42, method: str = "multinomial",
                 key: str = "Record", metrics: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    if method == "multinomial" and metrics is None:
        return intervals(cell_replicates(pairs, n, seed), level)
    if method not in ("multinomial", "poisson"):
        raise ValueError(f"unknown bootstrap method {method}")
    return intervals(bootstrap_replicates(pairs, n, seed, key, metrics), level)

