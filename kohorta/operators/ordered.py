"""Running sums, ranks and exact quantiles over ordered groups of any size.

A plain window puts a whole group in one task. Here a group above `rows_per_bucket` rows is cut into value ranges
(approximate split points, so they only steer balance, never the result); sums run inside each range and a small table
of range totals supplies what came before. The split points are collected once, so every branch of the plan sees the
same ranges. The number of split points is at most rows / rows_per_bucket plus one per hot group, and at most `_FAN` squared
for one group: every row looks its range up among them, so more would cost more for every row; ranges grow instead.

Groups are measured by counting their rows; keys may be NULL, which is a group like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 2_000_000
_FAN = 64
_SAMPLES = 64


def spread_small(df: DataFrame) -> DataFrame:
    """A small table often arrives in few partitions; before work that is heavy per row, use every slot. Tables with
    partitions enough are left alone."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """`right` with renamed keys, and the null-safe condition that joins it to `left`."""
    renamed = right.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(keys)})
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}"))
    return renamed, same


def _split_points(sizing: DataFrame, keys: Sequence[str], by: str, rows_per_bucket: int | None) -> DataFrame | None:
    """(keys..., _fine array, _coarse array) of the groups with more rows than fit a bucket; None when there is none.

    Split points of numbers are approximate percentiles, those of texts evenly chosen values of a sample by hash (about
    `_SAMPLES` values for each bucket).
    """
    limit = rows_per_bucket or ROWS_PER_BUCKET
    spark = sizing.sparkSession
    counts = sizing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0]
    if largest is None or largest <= limit:
        return None
    limit = max(limit, -(-largest // (_FAN * _FAN)))
    grid = -(-largest // limit)
    if _numeric(sizing, by):
        points = [i / grid for i in range(1, grid)]
        stats = sizing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                          F.percentile_approx(by, points, max(10_000, 4 * grid)).alias("_p"))
    else:
        every = max(1, limit // _SAMPLES)
        drawn = F.when(F.pmod(F.xxhash64(by), F.lit(every)) == 0, F.col(by))
        stats = sizing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_set(drawn)).alias("_s"))
        stats = stats.withColumn("_p", F.when(F.size("_s") < grid, F.col("_s")).otherwise(F.transform(
            F.sequence(F.lit(1), F.lit(max(1, grid - 1))),
            lambda i: F.element_at("_s", (i * F.size("_s") / grid).cast("int"))))).drop("_s")
    # keep only as many points as a group needs
    stats = (stats.filter(F.col("_n") > limit)
             .withColumn("_step", F.greatest(F.lit(1), F.floor(F.lit(grid) * F.lit(float(limit)) / F.col("_n")).cast("int")))
             .withColumn("_fine", F.array_distinct(F.filter("_p", lambda x, i: i % F.col("_step") == 0)))
             .select(*keys, "_fine"))
    rows = stats.collect()  # bounded: see module docstring
    fixed = spark.createDataFrame(rows, stats.schema)
    coarse = F.filter("_fine", lambda x, i: i % _FAN == 0)
    return fixed.withColumn("_coarse", coarse)


def _bucket(key: Column) -> Column:
    """How many split points lie below the key: its place among at most _FAN coarse, then _FAN fine points."""
    def below(points: Column) -> Column:
        return (F.array_position(F.sort_array(F.array_append(points, key)), key) - 1).cast("int")
    above = below(F.col("_coarse"))
    start = (above - 1) * _FAN
    inside = below(F.slice(F.col("_fine"), F.greatest(start, F.lit(0)) + 1, _FAN))
    return F.when(F.col("_fine").isNull() | (above == 0), 0).otherwise(start + inside)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, Column],
    sizing: DataFrame | None = None,
    rows_per_bucket: int | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums of `measures`, ordered by `order` inside each group of `keys`; with `totals` also the
    group's sum of each, as `<measure>_total`.

    `order` must be a total order without NULLs; its first column also cuts hot groups. `sizing` is a cheaper table
    with the same keys and first order column (for example the rows before a shuffle) to measure group sizes on.
    """
    keys, order = list(keys), list(order)
    base = df.withColumns({f"_m_{k}": v for k, v in measures.items()})
    splits = _split_points(df if sizing is None else sizing, keys, order[0], rows_per_bucket)
    if splits is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = {k: F.sum(f"_m_{k}").over(w) for k in measures}
        if totals:  # same partitioning and sort, so no further shuffle
            sums |= {f"{k}_total": F.sum(f"_m_{k}").over(Window.partitionBy(*keys)) for k in measures}
        return base.withColumns(sums).drop(*[f"_m_{k}" for k in measures])
    if keys:
        renamed, same = _same_keys(base, splits, keys)
        joined = base.join(F.broadcast(renamed), same, "left").drop(*[f"_k{i}" for i in range(len(keys))])  # bounded
    else:
        joined = base.withColumns({c: F.lit(v) for c, v in splits.first().asDict().items()})
    cut = joined.withColumn("_b", _bucket(F.col(order[0]))).drop("_fine", "_coarse")
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = cut.withColumns({k: F.sum(f"_m_{k}").over(w) for k in measures})
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = (
        cut.groupBy(*keys, "_b")
        .agg(*[F.sum(f"_m_{k}").alias(f"_m_{k}") for k in measures])
        .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_b").alias("_ob"),
                *[F.sum(f"_m_{k}").over(before).alias(f"_o_{k}") for k in measures],
                *[F.sum(f"_m_{k}").over(whole).alias(f"{k}_total") for k in measures if totals])
    )
    if not totals:
        # the first range of a group has no offset; what is left is at most one row per split point
        offsets = F.broadcast(offsets.filter(F.col("_ob") > 0))
    same = F.col("_b") == F.col("_ob")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = inner.join(offsets, same, "left")
    out = out.withColumns({k: F.col(k) + F.coalesce(F.col(f"_o_{k}"), F.lit(0)) for k in measures})
    return out.select(*df.columns, *measures, *[f"{k}_total" for k in measures if totals])


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "t",
              rows_per_bucket: int | None = None) -> DataFrame:
    """1-based position inside each group."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, rows_per_bucket=rows_per_bucket)


def mid_rank(df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column] | None = None,
             rows_per_bucket: int | None = None, totals: bool = False) -> DataFrame:
    """One row per (keys, value): n rows, average rank over ties, running count `cum`, summed `measures`; with
    `totals` also the group's row count `cum_total`."""
    counts = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in (measures or {}).items()])
    ranked = running(counts, keys, [value], {"cum": F.col("n")}, sizing=df, rows_per_bucket=rows_per_bucket, totals=totals)
    return ranked.withColumn("mid_rank", F.col("cum") - (F.col("n") - 1) / F.lit(2.0))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
              rows_per_bucket: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, by position in the running counts; NULLs are ignored."""
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())
    counts = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, keys, [value], {"_cum": F.col("_n")}, sizing=present, rows_per_bucket=rows_per_bucket,
                     totals=True)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_n") <= index) & (index < F.col("_cum")), F.col(value)))

    parts, finish = [], {}
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_cum_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        parts += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(pos - lo).alias(f"_f_{name}")]
        finish[name] = F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_f_{name}")
    return placed.groupBy(*keys).agg(*parts).select(*keys, *[c.alias(n) for n, c in finish.items()])


def sorted_neighbours(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], halo: int,
                      columns: Callable[[Window], dict[str, Column]], rows_per_bucket: int | None = None,
                      chunk_rows: int | None = None) -> DataFrame:
    """Adds the position `t` in sorted order and window columns over at most `halo` rows to either side.

    `order` has no NULLs; with ties it should end in a row key, so that a repeated task numbers rows alike."""
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    if chunk_rows is None and _split_points(df, keys, order[0], rows_per_bucket) is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({"t": F.row_number().over(w).cast("bigint"), **columns(w)})
    placed = row_index(df, keys, order, "t", rows_per_bucket)
    return over_series(placed, halo, columns, keys=keys, chunk_rows=chunk_rows)


def over_series(
    frames: DataFrame,
    halo: int,
    columns: Callable[[Window], dict[str, Column]],
    keys: Sequence[str] = ("Record", "series"),
    t: str = "t",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Window columns that look at most `halo` frames to either side, on frames numbered densely by `t`.

    Long series are cut into chunks of consecutive frames; the `halo` frames at a cut are sent to both chunks and the
    copies dropped afterwards, so no series, however long, has to fit in one task.
    """
    size = chunk_rows or ROWS_PER_BUCKET
    if halo >= size:
        raise ValueError("chunk_rows must exceed the halo")
    frame = F.col(t).cast("bigint")

    def chunk(shift: int) -> Column:
        return F.floor((frame + shift) / size)

    own = chunk(0)
    # a row away from a cut has one target; only rows next to a cut are copied
    targets = F.array_distinct(F.array(own, chunk(-halo), chunk(halo)))
    tagged = frames.withColumn("_chunk", F.explode(targets))
    w = Window.partitionBy(*keys, "_chunk").orderBy(t)
    return tagged.withColumns(columns(w)).filter(F.col("_chunk") == own).drop("_chunk")
