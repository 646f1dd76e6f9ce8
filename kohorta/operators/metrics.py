"""Confusion cells, the metrics over them, AUC, and summaries over executions, records and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import mid_rank, running

METRICS = ("Accuracy", "Weighted Balanced Accuracy", "Sensitivity", "Specificity", "F1")


def confusion_aggs(weight: Column, y: str = "y", p: str = "p") -> list[Column]:
    """tn, fp, fn, tp as sums of `weight`."""
    def cell(a: int, b: int) -> Column:
        hit = (F.col(y) == a) & (F.col(p) == b)
        return F.sum(F.when(hit, weight).otherwise(0)).cast("bigint")
    return [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]


def confusion(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(*keys).agg(*confusion_aggs(F.lit(1), y, p))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def metric_columns(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The five metrics from tn, fp, fn, tp; 0.0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    sens, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return cells.select(
        *keys, _ratio(tp + tn, tp + tn + fp + fn).alias("Accuracy"),
        ((sens + spec) / 2).alias("Weighted Balanced Accuracy"), sens.alias("Sensitivity"),
        spec.alias("Specificity"), _ratio(2 * tp, 2 * tp + fp + fn).alias("F1"))


# name -> aggregate over (y, p): the user-facing metric table
def _agg_metric(name: str):
    def build(weight: Column | None = None) -> Column:
        w = F.lit(1) if weight is None else weight

        def s(cond: Column) -> Column:
            return F.sum(F.when(cond, w).otherwise(0)).cast("double")

        y, p = F.col("y") == 1, F.col("p") == 1
        tp, tn, fp, fn = s(y & p), s(~y & ~p), s(~y & p), s(y & ~p)
        sens, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
        return {"Accuracy": _ratio(tp + tn, tp + tn + fp + fn), "Sensitivity": sens, "Specificity": spec,
                "Weighted Balanced Accuracy": (sens + spec) / 2, "F1": _ratio(2 * tp, 2 * tp + fp + fn)}[name]
    return build


METRIC_FUNCTIONS = {name: _agg_metric(name) for name in METRICS}


def compute_all_metrics(predictions: DataFrame, keys: Sequence[str] = ("Model", "Method", "Execution"),
                        score: str | None = None) -> DataFrame:
    """Metrics table: every model, method and execution in one conditional aggregation; AUC joins on the same keys."""
    out = metric_columns(confusion(predictions, keys), keys)
    if score is not None:
        out = out.join(auc_roc(predictions, keys, score=score), list(keys), "left")
    if "Execution" in keys:
        out = out.withColumnRenamed("Execution", "Number of execution")
    return out


def auc_roc(df: DataFrame, keys: Sequence[str] = (), score: str = "score", y: str = "y",
            rows_per_bucket: int | None = None) -> DataFrame:
    """Area under ROC from average ranks; NULL when a class is empty."""
    scored = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
    ranked = mid_rank(scored, list(keys), score, {"pos": F.col(y)}, rows_per_bucket)
    sums = ranked.groupBy(*keys).agg(
        F.sum("pos").cast("double").alias("n1"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("n0"),
        F.sum(F.col("mid_rank") * F.col("pos")).alias("r1"))
    n1, n0 = F.col("n1"), F.col("n0")
    return sums.select(*keys, ((F.col("r1") - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))).alias("AUC"))


# ---- ROC curves ---------------------------------------------------------------------------------

def roc_points(df: DataFrame, keys: Sequence[str] = (), score: str = "score", y: str = "y",
               rows_per_bucket: int | None = None) -> DataFrame:
    """(keys..., score, fpr0, tpr0, fpr, tpr) per distinct score, falling; fpr0/tpr0 is the point before it, so later
    steps need no second window."""
    keys = list(keys)
    scored = df.filter(F.col(score).isNotNull()).withColumn("_d", -F.col(score).cast("double"))
    counts = scored.groupBy(*keys, "_d").agg(F.sum(F.col(y)).cast("bigint").alias("pos"),
                                             F.sum(1 - F.col(y)).cast("bigint").alias("neg"))
    both = running(counts, keys, ["_d"], {"tp": F.col("pos"), "fp": F.col("neg")}, sizing=scored,
                   rows_per_bucket=rows_per_bucket, totals=True)
    n1, n0 = (F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("tp_total", "fp_total"))
    return both.select(
        *keys, (-F.col("_d")).alias("score"),
        ((F.col("fp") - F.col("neg")) / n0).alias("fpr0"), ((F.col("tp") - F.col("pos")) / n1).alias("tpr0"),
        (F.col("fp") / n0).alias("fpr"), (F.col("tp") / n1).alias("tpr"))


def trapezoid_auc(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    step = (F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2
    return points.groupBy(*keys).agg(F.sum(step).alias("AUC"))


def roc_on_grid(points: DataFrame, keys: Sequence[str] = (), n: int = 100) -> DataFrame:
    """(keys..., g, x, tpr): linear interpolation at x = g / (n-1). Each curve segment yields just the grid points it
    covers, so there is no join with the grid."""
    last = n - 1
    seg = points.filter(F.col("fpr") > F.col("fpr0"))
    g = F.explode(F.sequence(F.floor(F.col("fpr0") * last), F.ceil(F.col("fpr") * last)))
    inside = seg.withColumn("g", g).withColumn("g", F.col("g").cast("int")).withColumn("x", F.col("g") / F.lit(float(last))).filter(
        (F.col("x") >= F.col("fpr0")) & (F.col("x") < F.col("fpr")))
    slope = (F.col("tpr") - F.col("tpr0")) / (F.col("fpr") - F.col("fpr0"))
    value = F.when(F.col("g") == 0, 0.0).otherwise(F.col("tpr0") + (F.col("x") - F.col("fpr0")) * slope)
    curve = inside.select(*keys, "g", "x", value.alias("tpr"))
    end = points.groupBy(*keys).agg(F.lit(last).alias("g"), F.lit(1.0).alias("x"), F.lit(1.0).alias("tpr"))
    return curve.unionByName(end)


def mean_roc(predictions: DataFrame, fold: str = "fold", keys: Sequence[str] = ("Model",), n: int = 100,
             score: str = "score") -> tuple[DataFrame, DataFrame]:
    """(curve, summary): mean TPR with a +-1 std band per grid point; mean and std of the AUC over folds."""
    keys = list(keys)
    points = roc_points(predictions, [*keys, fold], score)
    grid = roc_on_grid(points, [*keys, fold], n)
    curve = grid.groupBy(*keys, "g", "x").agg(F.avg("tpr").alias("tpr"), F.stddev_pop("tpr").alias("std_tpr"))
    curve = curve.withColumn("lower", F.greatest(F.lit(0.0), F.col("tpr") - F.col("std_tpr"))).withColumn(
        "upper", F.least(F.lit(1.0), F.col("tpr") + F.col("std_tpr")))
    fold_auc = trapezoid_auc(points, [*keys, fold])
    std = fold_auc.groupBy(*keys).agg(F.stddev_pop("AUC").alias("std_auc"))
    # area under the mean curve: equal steps, so it is a weighted sum
    edge = F.when((F.col("g") == 0) | (F.col("g") == n - 1), 0.5).otherwise(1.0)
    area = curve.groupBy(*keys).agg((F.sum(F.col("tpr") * edge) / F.lit(float(n - 1))).alias("mean_auc"))
    return curve, area.join(std, keys)


# ---- summaries ----------------------------------------------------------------------------------

def _numeric(df: DataFrame, skip: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def mean_by(metrics: DataFrame, keys: Sequence[str] = ("Model", "Method")) -> DataFrame:
    """Mean of every numeric column, the execution number included."""
    return metrics.groupBy(*keys).agg(*[F.avg(f"`{c}`").alias(c) for c in _numeric(metrics, keys)])


def std_by(metrics: DataFrame, keys: Sequence[str] = ("Model", "Method")) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.stddev_samp(f"`{c}`").alias(c) for c in _numeric(metrics, keys)])


def loo_metrics(loo: DataFrame) -> DataFrame:
    """Per model: mean, std, median and IQR of the 0/1 accuracies; synthetic rows are left out when flagged."""
    if "Is_SMOTE" in loo.columns:
        loo = loo.filter(~F.col("Is_SMOTE"))
    a = F.col("Accuracy").cast("double")
    # two distinct values per model, so the exact percentile keeps two counters
    return loo.groupBy("Model").agg(
        F.avg(a).alias("LOO_Mean"), F.stddev_samp(a).alias("LOO_Std"), F.percentile(a, 0.5).alias("LOO_Median"),
        (F.percentile(a, 0.75) - F.percentile(a, 0.25)).alias("LOO_IQR"))


def aggregate_metrics(metrics: DataFrame, loo: DataFrame | None = None) -> DataFrame:
    """Per model: <column>_mean and <column>_std of every numeric column, with the leave-one-out statistics."""
    cols = _numeric(metrics, ["Model"])
    aggs = [a for c in cols for a in (F.avg(f"`{c}`").alias(f"{c}_mean"), F.stddev_samp(f"`{c}`").alias(f"{c}_std"))]
    out = metrics.groupBy("Model").agg(*aggs)
    return out if loo is None else out.join(loo_metrics(loo), "Model", "left")


def loo_summary(loo: DataFrame) -> DataFrame:
    """Mean per (Model, Execution), then its distribution over executions; best model first."""
    per = loo.groupBy("Model", "Execution").agg(F.avg(F.col("Accuracy").cast("double")).alias("a"))
    # one value per execution
    q1, q3 = F.percentile("a", 0.25), F.percentile("a", 0.75)
    return per.groupBy("Model").agg(
        F.avg("a").alias("Mean"), F.stddev_samp("a").alias("Std"), F.percentile("a", 0.5).alias("Median"),
        (q3 - q1).alias("IQR"), F.min("a").alias("Min"), F.max("a").alias("Max"), q1.alias("Q1"), q3.alias("Q3"),
        F.count_distinct("Execution").alias("N_Executions")).orderBy(F.desc("Mean"), "Model")


def patient_accuracy(predictions: DataFrame, by_model: bool = True, record: str = "Record", true: str = "True_Label",
                     predicted: str = "Predicted") -> DataFrame:
    """Accuracy per record, then mean, std, median and IQR over records (per model or overall).

    The quantiles read (keys, accuracy) counts: records with equal accuracy collapse before the final step.
    """
    keys = ["Model"] if by_model else []
    hit = (F.col(true) == F.col(predicted)).cast("double")
    per = predictions.groupBy(*keys, record).agg(F.avg(hit).alias("a"))
    counts = per.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("n"))
    a, n = F.col("a"), F.col("n")
    total, s1 = F.sum(n).cast("double"), F.sum(a * n)
    pct = [F.percentile("a", q, n) for q in (0.25, 0.5, 0.75)]  # distinct fractions only
    mean = s1 / total
    spread = F.sum(n * a * a) - s1 * s1 / total
    return counts.groupBy(*keys).agg(
        mean.alias("Patient_Accuracy_Mean"),
        F.when(total > 1, F.sqrt(F.greatest(F.lit(0.0), spread) / (total - 1))).alias("Patient_Accuracy_Std"),
        pct[1].alias("Patient_Accuracy_Median"), (pct[2] - pct[0]).alias("Patient_Accuracy_IQR"))


def misclassification(predictions: DataFrame, label: str = "Pathological") -> tuple[DataFrame, DataFrame]:
    """(per record and model, per model): share not predicted as `label`, then the mean of the records' shares."""
    miss = (F.col("Predicted") != label).cast("double")
    per = predictions.groupBy("Record", "Model").agg(F.avg(miss).alias("Misclassified"))
    return per, per.groupBy("Model").agg(F.avg("Misclassified").alias("Misclassified"))


def best_model(metrics: DataFrame, by: str = "Accuracy") -> DataFrame:
    ties = [c for c in ("Model", "Method", "Number of execution") if c in metrics.columns]
    return metrics.orderBy(F.desc_nulls_last(by), *ties).limit(1)


def class_counts(df: DataFrame, label: str = "Diagnosed") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_balance(before: DataFrame, after: DataFrame, label: str = "Diagnosed") -> DataFrame:
    """One row: smallest/largest class ratio before and after, rows before, after and added."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return class_counts(df, label).select(F.lit(tag).alias("side"), "n")
    both = side(before, "before").unionByName(side(after, "after"))

    def of(tag: str, f) -> Column:
        return f(F.when(F.col("side") == tag, F.col("n")))
    return both.agg(
        (of("before", F.min) / of("before", F.max)).alias("ratio_before"),
        (of("after", F.min) / of("after", F.max)).alias("ratio_after"),
        of("before", F.sum).alias("rows_before"), of("after", F.sum).alias("rows_after"),
        (of("after", F.sum) - of("before", F.sum)).alias("rows_added"))
