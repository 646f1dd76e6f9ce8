"""Seeded splits and folds. Every choice is a function of (key, seed), never of partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import hash32
from .ordered import row_index

SEEDS = (42, 123, 1234, 12345, 0, 1)  # fixed values


def seeds(n: int, first: tuple[int, ...] = SEEDS) -> list[int]:
    """The first n seeds; beyond the list, the last one plus one each time."""
    out = list(first[:n])
    while len(out) < n:
        out.append(out[-1] + 1)
    return out


def shuffled(df: DataFrame, seed: int, key: str = "Record") -> DataFrame:
    """Seeded permutation."""
    return df.orderBy(hash32(F.col(key), seed), key)


_SMALL_BIN = 50_000


def smallest_by_hash(df: DataFrame, take: Callable[[int], int], seed: int, key: str = "Record",
                     within: str | None = None) -> Column:
    """Predicate that holds for exactly `take(n)` of the n rows (of each value of `within`): those with the smallest
    (hash, key).

    A histogram over the top 16 bits of the hash finds the bin of the cut; only that bin (1/65,536 of the rows) is
    looked at again, through a second histogram if it is still large. No row is shuffled and the result is a filter.
    """
    h = hash32(F.col(key), seed)
    group = F.lit(None).cast("string") if within is None else F.col(within)
    counts: dict = {}
    # at most 65,536 rows per class
    for r in df.groupBy(group.alias("g"), F.shiftright(h, 16).alias("b")).count().collect():
        counts.setdefault(r["g"], {})[r["b"]] = r["count"]

    def locate(bins: dict[int, int], left: int) -> tuple[int | None, int]:
        for b in sorted(bins):
            if left <= bins[b]:
                return b, left
            left -= bins[b]
        return None, left

    def cut(g, bins: dict[int, int]) -> Column:
        left = take(sum(bins.values()))
        if left <= 0:
            return F.lit(False)
        high, left = locate(bins, left)
        if high is None:
            return F.lit(True)
        rows = df.filter(F.shiftright(h, 16) == high)
        rows = rows if within is None else rows.filter(group.eqNullSafe(F.lit(g)))
        if bins[high] > _SMALL_BIN:
            low = {r["b"]: r["count"] for r in rows.groupBy(h.bitwiseAND(F.lit(65535)).alias("b")).count().collect()}
            b, left = locate(low, left)
            rows = rows.filter(h == high * 65536 + b)
        last = rows.select(h.alias("h"), key).orderBy("h", key).limit(left).agg(
            F.max(F.struct("h", F.col(key).alias("k"))).alias("m")).first()["m"]
        return (h < last["h"]) | ((h == last["h"]) & (F.col(key) <= F.lit(last["k"])))

    if within is None:
        return cut(None, counts[None]) if counts else F.lit(False)
    out = F.lit(False)
    for g, bins in counts.items():
        out = out | (group.eqNullSafe(F.lit(g)) & cut(g, bins))
    return out


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = "Record",
                     stratify: str | None = None) -> DataFrame:
    """Adds `is_test`; the test side has ceil(test_size x n) rows (per class when stratified)."""
    return df.withColumn("is_test", smallest_by_hash(df, lambda n: math.ceil(test_size * n), seed, key, stratify))


def hash_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = "Record") -> DataFrame:
    """Adds `is_test` by a hash threshold: one projection, sizes right on average."""
    return df.withColumn("is_test", hash32(F.col(key), seed) % 10000 < int(round(test_size * 10000)))


def stratified_kfold(df: DataFrame, k: int = 5, seed: int = 42, key: str = "Record", label: str = "label",
                     rows_per_bucket: int | None = None) -> DataFrame:
    """Adds `fold` in 0..k-1: position by hash inside each class, modulo k."""
    hashed = df.withColumn("_h", hash32(F.col(key), seed))
    placed = row_index(hashed, [label], ["_h", key], "_pos", rows_per_bucket)
    return placed.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_h", "_pos")


def group_kfold(df: DataFrame, k: int = 5, seed: int = 42, key: str = "Record") -> DataFrame:
    """Adds `fold`: rows with the same key share a fold. A projection."""
    return df.withColumn("fold", (hash32(F.col(key), seed) % k).cast("int"))
