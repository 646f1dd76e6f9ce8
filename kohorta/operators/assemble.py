"""Joins and unions that build the record x feature table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import reorder_columns
from ..session import materialise


def merge_on_record(left: DataFrame, right: DataFrame, how: str = "inner",
                    suffixes: tuple[str, str] | None = None) -> DataFrame:
    """Equi-join on `Record`. Shared column names need a suffix pair."""
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join type {how}")
    shared = [c for c in left.columns if c in right.columns and c != "Record"]
    if shared and suffixes is None:
        raise ValueError(f"columns on both sides: {shared}; pass suffixes")
    if shared:
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, "Record", how)


def merge_features(signal: DataFrame, markers: DataFrame, label: str | None = None) -> DataFrame:
    """Signal features and markers of the same record; `label` sets the class."""
    merged = merge_on_record(signal, markers, "inner")
    return merged if label is None else merged.withColumn("Diagnosed", F.lit(label))


def concatenate_groups(*groups: DataFrame) -> DataFrame:
    """UNION ALL by name, absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)


concat_results = concatenate_groups


def build_cohort(parts: Sequence[tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """(signal, markers, label) per group -> joined, labelled, stacked, ordered columns, complete rows only."""
    stacked = concatenate_groups(*[merge_features(s, m, label) for s, m, label in parts])
    return reorder_columns(stacked).dropna()


def leave_group_out(df: DataFrame, held: DataFrame, key: str = "Record") -> DataFrame:
    return df.join(held.select(key).distinct(), key, "left_anti")


def distinct_patients(df: DataFrame, label: str = "Pathological") -> DataFrame:
    real = df.filter(F.col("Diagnosed") == label)
    if "Is_SMOTE" in df.columns:
        real = real.filter(~F.col("Is_SMOTE"))
    return real.select("Record").distinct()


def with_row_id(df: DataFrame, id: str = "Record", name: str = "_rid") -> DataFrame:
    """Adds a unique string `name`: `id` itself where it is unique and never NULL, else `id#position`.

    Positions follow (id, hash of all columns) and are stored, so they stay the same however often the rows are read.
    """
    repeated = df.groupBy(id).count().where((F.col("count") > 1) | F.col(id).isNull()).limit(1).count()
    if not repeated:
        return df.withColumn(name, F.col(id).cast("string"))
    order = [F.col(id).asc_nulls_first(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    numbered = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order)
                           .withColumn(name, F.monotonically_increasing_id()), "numbered")
    return numbered.withColumn(name, F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit("#"), F.col(name)))
