"""Dataset validation as result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import LABELS, feature_columns, is_inf, missing_columns

RESULT_SCHEMA = "check string, severity string, detail string, n bigint"


def _missing(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.count_if(c.isNull() | F.isnan(c))
    return F.count_if(c.isNull())


def invalid_labels(df: DataFrame, allowed: Sequence[str] = LABELS) -> DataFrame:
    """Observed label values outside the allowed set (NULL is invalid too), with their row counts."""
    label = F.col("Diagnosed")
    return (df.filter(label.isNull() | ~label.isin(*allowed))
            .groupBy("Diagnosed").agg(F.count(F.lit(1)).alias("n")))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each `Record`; NULL counts as one value. Aggregated per Record first (map-side)."""
    per_record = df.groupBy("Record").agg(F.count(F.lit(1)).alias("c"))
    return per_record.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))


def validate_dataset(df: DataFrame, required: Sequence[str] = ("Record", "Diagnosed"),
                     allowed: Sequence[str] = LABELS) -> DataFrame:
    """(check, severity, detail, n): one scan for NULL, infinity and row counts, one grouped pass each for labels
    and duplicates. Errors: missing columns, invalid labels. Warnings: missing values, duplicates, infinities."""
    spark = df.sparkSession
    absent = missing_columns(df, required)
    rows = [("required_columns", "error", c, 1) for c in absent] or [("required_columns", "success", "all", 0)]
    out = spark.createDataFrame(rows, RESULT_SCHEMA)

    floats = [c for c in df.columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    probes = {f"missing_values:{c}": _missing(df, c) for c in df.columns}
    probes |= {f"infinite_values:{c}": F.count_if(is_inf(F.col(f"`{c}`"))) for c in floats}
    one = df.agg(*[v.alias(f"p{i}") for i, v in enumerate(probes.values())])
    tall = one.unpivot([], [F.col(f"p{i}") for i in range(len(probes))], "p", "n")
    names = F.create_map(*[F.lit(x) for i, k in enumerate(probes) for x in (f"p{i}", k)])
    key = F.split(F.element_at(names, F.col("p")), ":", 2)
    scans = tall.select(
        key[0].alias("check"),
        F.when(F.col("n") > 0, "warning").otherwise("success").alias("severity"),
        key[1].alias("detail"),
        F.col("n").cast("bigint").alias("n"),
    )
    out = out.unionByName(scans)
    if "Diagnosed" in df.columns:
        # one row for each invalid value, however many there are
        bad = invalid_labels(df, allowed).select(F.coalesce("Diagnosed", F.lit("NULL")).alias("detail"), "n")
        label = F.col("Diagnosed")
        none = df.agg(F.count_if(label.isNull() | ~label.isin(*allowed)).alias("n")).filter("n = 0") \
            .select(F.lit("").alias("detail"), "n")
        out = out.unionByName(bad.unionByName(none).select(
            F.lit("labels").alias("check"), F.when(F.col("n") > 0, "error").otherwise("success").alias("severity"),
            "detail", F.col("n").cast("bigint").alias("n")))
    if "Record" in df.columns:
        out = out.unionByName(duplicate_count(df).select(
            F.lit("duplicates").alias("check"),
            F.when(F.col("n") > 0, "warning").otherwise("success").alias("severity"),
            F.lit("Record").alias("detail"), F.col("n").cast("bigint").alias("n")))
    return out


def validation_summary(result: DataFrame) -> DataFrame:
    """is_valid, has_warnings and the counts per severity; merging two results is `unionByName`."""
    def n(severity: str):
        return F.count_if(F.col("severity") == severity)
    return result.agg(
        (n("error") == 0).alias("is_valid"), (n("warning") > 0).alias("has_warnings"),
        n("error").alias("errors"), n("warning").alias("warnings"), n("success").alias("successes"))


def is_valid(result: DataFrame) -> bool:
    return result.filter(F.col("severity") == "error").isEmpty()


def validation_text(result: DataFrame) -> DataFrame:
    """One line per check, errors first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    line = F.concat_ws(" ", F.upper("severity"), "check", "detail", F.col("n").cast("string"))
    return result.select(rank.alias("rank"), line.alias("line")).orderBy("rank", "line")


def pca_conditions(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """One row: nothing missing, no row with all values equal, at least two distinct rows; and their conjunction."""
    features = list(features or feature_columns(df))
    cols = [F.col(f"`{c}`").cast("double") for c in features]
    any_missing = F.lit(False)
    for c in cols:
        any_missing = any_missing | c.isNull() | F.isnan(c)
    flat = F.least(*cols) == F.greatest(*cols) if len(cols) > 1 else F.lit(True)
    # two distinct rows exist iff some column has min < max (or is missing in some rows only)
    varied = F.lit(False)
    for c in cols:
        partly = (F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))
        varied = varied | F.coalesce(F.min(c) < F.max(c), F.lit(False)) | partly
    return df.agg(
        F.count_if(any_missing).alias("rows_missing"),
        F.count_if(~any_missing & F.coalesce(flat, F.lit(False))).alias("rows_flat"),
        varied.alias("two_distinct"),
    ).withColumn("ok", (F.col("rows_missing") == 0) & (F.col("rows_flat") == 0) & F.col("two_distinct"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
