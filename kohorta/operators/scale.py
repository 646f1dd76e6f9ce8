"""Feature scaling: statistics are learned once (one row per feature) and applied as a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import feature_columns, unpivot
from .ordered import quantiles

METHODS = ("standard", "minmax", "robust")


@dataclass
class Scaler:
    """x -> (x - centre) / scale; a scale of zero counts as one."""

    method: str = "standard"
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature -> (centre, divisor)
    table: DataFrame | None = None

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown scaler {self.method}; one of {METHODS}")

    def fit(self, df: DataFrame, features: Sequence[str] | None = None) -> "Scaler":
        features = feature_columns(df) if features is None else list(features)
        self.table = feature_stats(df, self.method, features)
        self.stats = {}
        for r in self.table.collect():  # one row per feature
            if self.method == "minmax":
                self.stats[r["Feature"]] = (r["Min"], 1.0 / r["Scale"] if r["Scale"] is not None else 1.0)
            else:
                self.stats[r["Feature"]] = (r["Mean" if self.method == "standard" else "Center"], r["Scale"])
        return self

    def _known(self) -> dict[str, tuple[float, float]]:
        if self.table is None:
            raise ValueError("scaler is not fitted")
        return {c: s for c, s in self.stats.items() if None not in s}

    def transform(self, df: DataFrame) -> DataFrame:
        cols = {c: (F.col(f"`{c}`") - F.lit(a)) / F.lit(b) for c, (a, b) in self._known().items() if c in df.columns}
        return df.withColumns(cols) if cols else df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        cols = {c: F.col(f"`{c}`") * F.lit(b) + F.lit(a) for c, (a, b) in self._known().items() if c in df.columns}
        return df.withColumns(cols) if cols else df

    def fit_transform(self, df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
        return self.fit(df, features).transform(df)


def feature_stats(df: DataFrame, method: str, features: Sequence[str]) -> DataFrame:
    """standard: (Feature, Mean, Scale); minmax: (Feature, Min, Max, Scale = 1 / range); robust: (Feature, Center, Scale).

    Zero spread gives Scale 1."""
    if not features:
        return df.sparkSession.createDataFrame([], "Feature string, Mean double, Scale double")
    q = {c: F.col(f"`{c}`").cast("double") for c in features}

    def one_or(c):
        return F.when(c == 0, 1.0).otherwise(c)

    if method == "standard":
        aggs = [a for i, c in enumerate(features) for a in (
            F.avg(q[c]).alias(f"a{i}"), F.stddev_pop(q[c]).alias(f"b{i}"))]
        rows = [F.struct(F.lit(c).alias("Feature"), F.col(f"a{i}").alias("Mean"),
                         one_or(F.col(f"b{i}")).alias("Scale")) for i, c in enumerate(features)]
    elif method == "minmax":
        aggs = [a for i, c in enumerate(features) for a in (F.min(q[c]).alias(f"a{i}"), F.max(q[c]).alias(f"b{i}"))]
        rows = [F.struct(F.lit(c).alias("Feature"), F.col(f"a{i}").alias("Min"), F.col(f"b{i}").alias("Max"),
                         (F.lit(1.0) / one_or(F.col(f"b{i}") - F.col(f"a{i}"))).alias("Scale"))
                for i, c in enumerate(features)]
    elif method == "robust":
        long = unpivot(df, features, [])
        qs = quantiles(long, ["Feature"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
        return qs.select("Feature", F.col("q2").alias("Center"), one_or(F.col("q3") - F.col("q1")).alias("Scale"))
    else:
        raise ValueError(f"unknown scaler {method}; one of {METHODS}")
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def standardize_split(train: DataFrame, test: DataFrame, method: str = "standard",
                      features: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, Scaler]:
    """Learn on `train` only, apply to both."""
    scaler = Scaler(method).fit(train, features)
    return scaler.transform(train), scaler.transform(test), scaler
