"""Exact k nearest neighbours.

A training side whose size is checked against `broadcast_bytes` is shipped to the query tasks, which compare all pairs, if
there are at most `BROADCAST_PAIRS`. Beyond that training rows are cut into cells around pivot rows, and neighbouring cells are put together in blocks (crowded cells are cut into several).
A query is searched in its own cell first; the k-th distance found there and bounds from the triangle inequality (Lu et al.,
"Efficient Processing of k Nearest Neighbor Joins using MapReduce", VLDB 2012) decide which other cells it has to visit.
A query travels once to each block it needs, a block meets its queries in portions, and both are bounded by `BLOCK_BYTES`.
Once a query has k rows, pairs are compared by coarse measures of known error, and only those that may be nearer exactly.
Equal vectors are collapsed first: copies beyond the first few ids cannot be among the k nearest, and equal query vectors
are searched once. Results are ordered by (distance rounded to 9 decimals, id).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import hash32
from ..session import materialise

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_PAIRS = 1 << 32
BLOCK_ROWS = 8192
BLOCK_BYTES = 32 * 1024 * 1024
CELL_ROWS = 512
MAX_PIVOTS = 512
QUERY_STEP, TRAIN_STEP = 512, 2048
SPREAD_ROWS = 256
DIGITS = 9
METRICS = {"euclidean": 2.0, "manhattan": 1.0}


def vector(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def _unusable(vec: str) -> Column:
    """Number of rows whose vector is missing or holds a missing or infinite value."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.count_if(~F.coalesce(fine, F.lit(False))).alias("bad")


def _order_of(metric: str, p: float) -> float:
    if metric == "minkowski":
        return float(p)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return METRICS[metric]


# ---- numpy helpers used inside tasks ------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _exact(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Row-by-row distances of two equally long matrices."""
    gap = np.abs(a - b)
    if p == 2.0:
        return np.sqrt((gap * gap).sum(axis=1))
    return gap.sum(axis=1) if p == 1.0 else (gap ** p).sum(axis=1) ** (1.0 / p)


def _table(a: np.ndarray, b: np.ndarray, p: float) -> tuple[np.ndarray, float]:
    """All distances of a block and a bound on their rounding error."""
    if p == 2.0:
        qa, qb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        squares = qa[:, None] + qb[None, :] - 2.0 * (a @ b.T)
        top = max(qa.max(initial=0.0), qb.max(initial=0.0))
        # error e in the square shifts the root by at most sqrt(e)
        return np.sqrt(np.maximum(squares, 0.0)), float(np.sqrt(1e-14 * a.shape[1] * (top + 1e-300)))
    out = np.zeros((a.shape[0], b.shape[0]))
    for c in range(a.shape[1]):
        gap = np.abs(a[:, c][:, None] - b[:, c][None, :])
        out += gap if p == 1.0 else gap ** p
    return (out if p == 1.0 else out ** (1.0 / p)), 1e-12 * (1.0 + float(out.max(initial=0.0)))


def _gaps(a: np.ndarray, b: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(measure of every pair, offset of every row, error): a pair is within r if measure <= _level(r) - offset, and may
    be if it is within the error of that."""
    d = a.shape[1]
    centre = b.mean(axis=0)
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    a, b = a - centre, b - centre
    if p == 2.0:
        qa, qb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        table = a @ (-2.0 * b.T)
        table += qb
        return table, qa, 1e-13 * (d + 1) * float(max(qa.max(initial=0.0), qb.max(initial=0.0)))
    kind = np.float32 if p == 1.0 and scale < 1e30 else np.float64
    a, b = np.ascontiguousarray(a.T, dtype=kind), np.ascontiguousarray(b.T, dtype=kind)
    table, gap = np.zeros((a.shape[1], b.shape[1]), dtype=kind), np.empty((a.shape[1], b.shape[1]), dtype=kind)
    for x, y in zip(a, b):
        np.subtract(x[:, None], y, out=gap)
        np.abs(gap, out=gap)
        if p != 1.0:
            np.power(gap, p, out=gap)
        table += gap
    top = 2.0 * scale * d * (d + 1) if kind == np.float32 else float(table.max(initial=0.0))
    return table, np.zeros(a.shape[1]), (2.5e-7 if kind == np.float32 else 1e-12 * (d + 1) * p) * top


class _Coarse:
    """Which pairs may lie within a radius, by measures that cost little: products in single precision (euclidean), sums of
    whole numbers in 16 bits (manhattan). Both err by a known amount; the pairs named are measured exactly afterwards."""

    def __init__(self, q: np.ndarray, t: np.ndarray, p: float):
        d = t.shape[1]
        low, high = np.minimum(q.min(axis=0), t.min(axis=0)), np.maximum(q.max(axis=0), t.max(axis=0))
        self.p, self.scale, self.error = p, max(np.abs(low).max(), np.abs(high).max()), np.inf
        if p == 2.0 and self.scale < 1e15:
            self.centre = t.mean(axis=0)
            far = np.maximum(high - self.centre, self.centre - low)
            self.error = 1.2e-7 * (d + 4) * 4.0 * float((far * far).sum())  # of a square
            self.t = np.empty((len(t), d + 1), dtype=np.float32)
            for at in range(0, len(t), TRAIN_STEP):
                x = t[at:at + TRAIN_STEP] - self.centre
                self.t[at:at + TRAIN_STEP, :d], self.t[at:at + TRAIN_STEP, d] = x, np.einsum("ij,ij->i", x, x)
        elif p == 1.0 and self.scale < 1e15 and d <= 4096:
            self.low, self.step = low, max(float((high - low).max()) / (65000 // d), 1e-300)
            self.error = d * self.step  # each value is off by half a step at most
            self.t = np.empty((d, len(t)), dtype=np.uint16)
            for at in range(0, len(t), TRAIN_STEP):
                self.t[:, at:at + TRAIN_STEP] = self._whole(t[at:at + TRAIN_STEP]).T
            self.half = (-(self.t.sum(axis=0, dtype=np.int64) // 2)).astype(np.uint16)  # sums wrap round

    def _whole(self, x: np.ndarray) -> np.ndarray:
        return np.rint((x - self.low) / self.step).astype(np.uint16)

    def queries(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """A block of queries as `pairs` takes it."""
        if self.error == np.inf:
            return None
        if self.p == 1.0:
            whole = self._whole(q)
            return whole, whole.sum(axis=1, dtype=np.int64)
        x = q - self.centre
        return np.concatenate([-2.0 * x, np.ones((len(x), 1))], axis=1).astype(np.float32), np.einsum("ij,ij->i", x, x)

    def sharp(self, radius: np.ndarray) -> bool:
        """Whether the error is small beside the radii."""
        return self.error <= 0.1 * float(np.median(radius ** self.p))

    def pairs(self, q: np.ndarray, offset: np.ndarray, radius: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.p == 2.0:
            level = np.nextafter((radius * radius - offset + self.error).astype(np.float32), np.float32(np.inf))
            table = q @ self.t[start:end].T
        else:
            # the sum of |a - b| is twice that of max(a, b), less the sums of a and of b
            level = np.minimum(np.floor((radius / self.step + self.t.shape[0] + offset) / 2) + 2, 65535).astype(np.uint16)
            table = np.repeat(self.half[None, start:end], len(q), axis=0)
            larger = np.empty_like(table)
            for x, y in zip(np.ascontiguousarray(q.T), self.t[:, start:end]):
                np.maximum(x[:, None], y, out=larger)
                table += larger
        return np.divmod(np.flatnonzero(table <= level[:, None]), end - start)


def _margin(d: int, scale: float) -> float:
    """What rounding may add to a distance."""
    return 4 * 10.0 ** -DIGITS + 4e-15 * d * scale


def _measured(a, b, r, c, p, a_ex, b_ex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if a_ex is not None:
        apart = a_ex[r] != b_ex[c]
        r, c = r[apart], c[apart]
    return r, c, np.round(_exact(a[r], b[c], p), DIGITS)


def _within(a, b, k, p, bound, a_ex, b_ex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the pairs at a distance of at most `bound`; where that is infinite, of a block's k nearest
    and what ties with them."""
    table, offset, error = _gaps(a, b, p)
    margin = _margin(a.shape[1], max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)))
    level = (bound + margin) ** p - offset + error
    open_rows = np.nonzero(np.isinf(bound))[0]
    if len(open_rows):
        part = table[open_rows]
        if a_ex is not None:
            part[a_ex[open_rows][:, None] == b_ex] = np.inf
        if b.shape[0] > k:
            kth = np.partition(part, k - 1, axis=1)[:, k - 1] + offset[open_rows]  # their distance to the power of p
            reach = np.maximum(kth + error, 0.0) ** (1.0 / p) + margin
            level[open_rows] = reach ** p - offset[open_rows] + error
    r, c = np.divmod(np.flatnonzero(table <= level[:, None]), b.shape[0])
    return _measured(a, b, r, c, p, a_ex, b_ex)


def _together(cells: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, end) of neighbouring cells that fit into a step, or of one larger cell."""
    out: list[tuple[int, int]] = []
    for j, (_, end) in enumerate(cells):
        if out and end - cells[out[-1][0]][0] <= TRAIN_STEP:
            out[-1] = out[-1][0], j + 1
        else:
            out.append((j, j + 1))
    return out


def _first(r, c, d, k: int):
    """The k least (distance, position) of every row."""
    order = np.lexsort((c, d, r))
    r, c, d = r[order], c[order], d[order]
    top = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
    return r[top], c[top], d[top]


def _nearest(q: np.ndarray, t: np.ndarray, k: int, p: float, q_ex: np.ndarray | None, t_ex: np.ndarray | None,
             limit: np.ndarray | None = None, place: np.ndarray | None = None, cells: Sequence[tuple[int, int]] | None = None,
             lower=None):
    """(query row, training position, distance) of the k nearest, none beyond `limit`. `t` comes sorted by id, so position
    breaks ties, or cell by cell with the position of each row in `place`; `lower` gives the least distance that queries
    can have to each of the `cells` (start, end), infinite for those not to be visited."""
    place = np.arange(t.shape[0]) if place is None else place
    cells = [(0, t.shape[0])] if cells is None else cells
    runs, sizes = _together(cells), np.array([end - start for start, end in cells])
    coarse = _Coarse(q, t, p) if len(q) and len(t) else None
    out = []
    for at in range(0, q.shape[0], QUERY_STEP):
        block = q[at:at + QUERY_STEP]
        m = block.shape[0]
        bound = np.full(m, np.inf) if limit is None else limit[at:at + m].copy()
        least = None if lower is None else lower(at, block)
        told = None if coarse is None else coarse.queries(block)
        best = np.array([], dtype=int), np.array([], dtype=int), np.array([])

        def wanted(first: int, last: int) -> np.ndarray:
            """Which queries have to visit which of the cells."""
            if least is None:
                return np.ones((m, last - first), dtype=bool)
            return (least[:, first:last] <= bound[:, None]) & (least[:, first:last] < np.inf)

        def visit(first: int, last: int) -> None:
            nonlocal best
            for start in range(cells[first][0], cells[last - 1][1], TRAIN_STEP):
                rows = np.nonzero(wanted(first, last).any(axis=1))[0]
                if not len(rows):
                    return
                end = min(start + TRAIN_STEP, cells[last - 1][1])
                exs = (None, None) if q_ex is None else (q_ex[at:at + m][rows], t_ex[start:end])
                radius = bound[rows] + _margin(t.shape[1], 0.0 if coarse is None else coarse.scale)
                if told is not None and np.isfinite(radius).all() and coarse.sharp(radius):
                    r, c = coarse.pairs(told[0][rows], told[1][rows], radius, start, end)
                    r, c, d = _measured(block[rows], t[start:end], r, c, p, *exs)
                else:
                    r, c, d = _within(block[rows], t[start:end], k, p, bound[rows], *exs)
                if not len(r):
                    continue
                best = _first(*[np.concatenate(x) for x in zip(best, (rows[r], place[start + c], d))], k)
                count = np.bincount(best[0], minlength=m)
                full = np.nonzero(count >= k)[0]
                bound[full] = np.minimum(bound[full], best[2][np.cumsum(count)[full] - 1])

        for first, last in runs:
            need = wanted(first, last)
            rows = np.count_nonzero(need.any(axis=1))
            if not rows:
                continue
            # cells that most of the queries visit anyway are compared in one go
            if last - first == 1 or 2 * (need.sum(axis=0) @ sizes[first:last]) >= rows * sizes[first:last].sum():
                visit(first, last)
            else:
                for j in range(first, last):
                    visit(j, j + 1)
        out.append((best[0] + at, best[1], best[2]))
    if not out:
        return np.array([], dtype=int), np.array([], dtype=int), np.array([])
    return tuple(np.concatenate(x) for x in zip(*out))


def _codes(a, b):
    """Comparable integer codes of two exclusion columns."""
    pool = pa.chunked_array([*_chunks(a), *_chunks(b)]).dictionary_encode().combine_chunks()
    if isinstance(pool, pa.ChunkedArray):
        pool = pool.chunk(0)
    idx = pool.indices.to_numpy(zero_copy_only=False)
    return idx[:len(a)], idx[len(a):]


def _chunks(a):
    return a.chunks if isinstance(a, pa.ChunkedArray) else [a]


def _flat(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else (
        column if isinstance(column, pa.Array) else pa.array([], type=column.type))


# ---- the join -----------------------------------------------------------------------------------

def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    id: str = "Record",
    vec: str = "v",
    metric: str = "euclidean",
    p: float = 2.0,
    exclude: str | None = None,
    carry: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """(id, neighbour_rank, neighbour, distance, carry...) with the k nearest training rows of every query row.

    `vec` is an array<double> column and `id` is unique per row; a missing or infinite value on either side raises a
    ValueError, whichever way the join takes. A training row is not a neighbour of a
    query with the same value of `exclude` (the id for self-joins, a group column to leave a group out). `carry`
    names training columns to bring along.
    """
    order = _order_of(metric, p)
    d_row = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d"), _unusable(vec)).first()
    asked = queries.agg(F.count(F.lit(1)).alias("n"), _unusable(vec)).first()
    if d_row["bad"] or asked["bad"]:
        raise ValueError(f"{d_row['bad'] + asked['bad']} rows have a missing or infinite value: drop or fill them first")
    n, d = d_row["n"], d_row["d"] or 0
    keep_train = train.select(F.col(id).alias("t_id"), F.col(vec).alias("t_v"),
                              *([F.col(exclude).alias("t_ex")] if exclude else []), *carry)
    keep_query = queries.select(F.col(id).alias("q_id"), F.col(vec).alias("q_v"),
                                *([F.col(exclude).alias("q_ex")] if exclude else []))
    id_type = queries.schema[id].dataType.simpleString()
    t_type = train.schema[id].dataType.simpleString()
    carry_types = "".join(f", `{c}` {train.schema[c].dataType.simpleString()}" for c in carry)
    pairs_schema = f"q_id {id_type}, t_id {t_type}, distance double{carry_types}"
    if n * (8 * d + 64) <= broadcast_bytes and n * asked["n"] <= BROADCAST_PAIRS:
        ranked = _broadcast_join(keep_query, keep_train, k, order, bool(exclude), carry, pairs_schema)
    else:
        found = _cell_join(keep_query, keep_train, d, k, order, exclude, exclude == id, carry, pairs_schema,
                           block_rows, max_pivots)
        w = Window.partitionBy("q_id").orderBy("distance", "t_id")
        ranked = found.withColumn("neighbour_rank", F.row_number().over(w)).filter(F.col("neighbour_rank") <= k)
    return (ranked
            .select(F.col("q_id").alias(id), "neighbour_rank", F.col("t_id").alias("neighbour"), "distance", *carry))


def _emit(q_id, t_id, carried, r, c, dist) -> pa.RecordBatch:
    names = ["q_id", "t_id", "distance", *carried, "neighbour_rank"]
    cols = [q_id.take(pa.array(r)), t_id.take(pa.array(c)), pa.array(dist)]
    cols += [v.take(pa.array(c)) for v in carried.values()]
    rank = np.arange(len(r)) - np.searchsorted(r, r, side="left") + 1  # rows come sorted by query
    cols.append(pa.array(rank.astype("int32")))
    return pa.RecordBatch.from_arrays(cols, names=names)


def _broadcast_join(queries, train, k, order, excluding, carry, schema) -> DataFrame:
    """The training side has passed the size check, so it goes to every task as one broadcast value. A query meets all of
    it in one place, so the result is final and needs no shuffle."""
    local = train.orderBy("t_id").toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(local)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        if table.num_rows == 0:
            return
        t, t_id = _matrix(table.column("t_v")), _flat(table.column("t_id"))
        carried = {c: _flat(table.column(c)) for c in carry}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            q_ex = t_ex = None
            if excluding:
                q_ex, t_ex = _codes(batch.column("q_ex"), table.column("t_ex"))
            found = _nearest(_matrix(batch.column("q_v")), t, k, order, q_ex, t_ex)
            yield _emit(batch.column("q_id"), t_id, carried, *found)

    # each query costs one pass over the training side, so spread the queries over all slots
    if local.num_rows >= SPREAD_ROWS:
        queries = queries.repartition(queries.sparkSession.sparkContext.defaultParallelism)
    return queries.mapInArrow(search, schema + ", neighbour_rank int")


def _distinct_copies(train: DataFrame, k: int, excluding: bool, by_id: bool) -> DataFrame:
    """Of equal vectors, only the first ids can be among the k nearest: k, k + 1 when a query skips itself, and with
    groups the first 2k after at most k per group (so k remain whichever group is skipped)."""
    base = train.withColumn("_h", F.xxhash64("t_v"))  # vectors are told apart by their hash first: sorting arrays is slow
    limit = k
    if excluding and by_id:
        limit = k + 1
    elif excluding:
        limit = 2 * k
        g = Window.partitionBy("_h", "t_v", "t_ex").orderBy("t_id")
        base = base.withColumn("_g", F.row_number().over(g)).filter(F.col("_g") <= k).drop("_g")
    w = Window.partitionBy("_h", "t_v").orderBy("t_id")
    return base.withColumn("_c", F.row_number().over(w)).filter(F.col("_c") <= limit).drop("_c", "_h")


def _chain(between: np.ndarray) -> list[int]:
    """An order of the pivots in which each is followed by the nearest one left."""
    left = np.ones(len(between), dtype=bool)
    order = [0]
    left[0] = False
    while left.any():
        order.append(int(np.where(left, between[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return order


def _cell_join(queries, train, d, k, order, exclude, by_id, carry, schema, block_rows, max_pivots) -> DataFrame:
    spark = queries.sparkSession
    excluding = exclude is not None
    # both sides are read several times below: written once, they are neither recomputed nor lost with an executor
    train = materialise(_distinct_copies(train, k, excluding, by_id), "knn-train")
    # search every distinct query vector once; a skipped id is dropped afterwards from one extra neighbour
    group_key = ["q_ex"] if excluding and not by_id else []
    reps = materialise(queries.select("q_v", *group_key).distinct().withColumn("q_no", F.monotonically_increasing_id()),
                       "knn-queries")
    reach = k + 1 if excluding and by_id else k
    in_kernel = bool(group_key)
    n, n_q = train.count(), reps.count()
    if not n or not n_q:
        return spark.createDataFrame([], schema)

    n_pivots = max(1, min(max_pivots, max(-(-n // block_rows), n // CELL_ROWS)))
    chosen = train.select("t_v", hash32(F.col("t_id"), "pivot").alias("h"), "t_id").orderBy("h", "t_id").limit(n_pivots)
    pivots = np.unique(np.array([list(r["t_v"]) for r in chosen.collect()]), axis=0)  # at most max_pivots rows
    between = np.array([_exact(np.broadcast_to(x, pivots.shape), pivots, order) for x in pivots])

    def ddl(df: DataFrame, names: Sequence[str]) -> str:
        return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def assign(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
        def run(batches):
            for batch in batches:
                v = _matrix(batch.column(column))
                for at in range(0, batch.num_rows, QUERY_STEP):
                    part = v[at:at + QUERY_STEP]
                    cell = _table(part, pivots, order)[0].argmin(axis=1)
                    near = _exact(part, pivots[cell], order)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).slice(at, len(part)) for c in names], pa.array(cell.astype("int32")), pa.array(near)],
                        names=[*names, "cell", "near"])
        return df.select(*names).mapInArrow(run, ddl(df, names) + ", cell int, near double")

    t_names = ["t_id", "t_v", *(["t_ex"] if in_kernel else []), *carry]
    q_names = ["q_no", "q_v", *group_key]
    t_cells, q_cells = assign(train, "t_v", t_names), assign(reps, "q_v", q_names)
    size, lo, hi = np.zeros(len(pivots), dtype=int), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in t_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("lo"),
                                         F.max("near").alias("hi")).collect():  # at most max_pivots rows
        size[r["cell"]], lo[r["cell"]], hi[r["cell"]] = r["n"], r["lo"], r["hi"]

    # a grid of blocks: enough for every slot, none larger than a task may hold
    hold, grid = max(1, BLOCK_BYTES // (8 * d + 64)), max(1, int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism))))
    t_rows, q_rows = (min(hold, max(block_rows, -(-x // grid))) for x in (n, n_q))
    start, parts, block, fill = np.zeros(len(pivots), dtype=int), np.ones(len(pivots), dtype=int), 0, 0
    for c in _chain(between):
        if fill and fill + size[c] > t_rows:
            block, fill = block + 1, 0
        start[c], parts[c], fill = block, max(1, -(-size[c] // t_rows)), fill + size[c]
        if parts[c] > 1:
            block, fill = block + parts[c], 0
    n_blocks = block + 1
    lies_in = np.zeros((len(pivots), n_blocks), dtype=np.float32)
    for c in np.nonzero(size)[0]:
        lies_in[c, start[c]:start[c] + parts[c]] = 1

    def least(v: np.ndarray, cell: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The least distance that queries of cell `cell` can have to a row of each cell in `seen`."""
        to, slack = _table(v, pivots[seen], order)
        own = _exact(v, pivots[cell], order)
        out = np.maximum(to - hi[seen], lo[seen] - to)
        if order == 2.0:
            gap = between[cell][:, seen]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (to * to - (own * own)[:, None]) / (2.0 * gap)
                off = 2.0 * slack * (to + own[:, None] + slack) / (2.0 * gap) + 1e-6 * (1.0 + to)
            out = np.maximum(out, np.where(gap > 0, plane - off, 0.0))
        return np.where(size[seen] > 0, out - 4 * slack - 8 * 10.0 ** -DIGITS, np.inf)

    # every row's block is a function of its key alone, so a retried task sends it to the same place
    home = spark.createDataFrame([(c, int(start[c]), int(parts[c])) for c in range(len(pivots))], "cell int, start int, parts int")
    t_blocks = t_cells.join(F.broadcast(home), "cell").select(
        *t_names, "cell", (F.col("start") + F.pmod(hash32(F.col("t_id"), "block"), F.col("parts"))).cast("int").alias("block"))

    def meet(asked: DataFrame, counts: dict[int, int], work, out_schema: str) -> DataFrame:
        """`work` on every block and each portion of the queries sent to it."""
        split = F.broadcast(spark.createDataFrame([(b, -(-c // q_rows)) for b, c in counts.items()], "block int, n int"))
        left = asked.join(split, "block").withColumn("part", F.pmod(F.xxhash64("q_no"), F.col("n")).cast("int")).drop("n")
        right = t_blocks.join(split, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(work, out_schema)

    def opened(left: pa.Table, right: pa.Table):
        """Queries and training rows of a block, both cell by cell, with what `_nearest` asks for."""
        left, right = left.sort_by("cell"), right.sort_by("t_id")
        cell = right.column("cell").to_numpy()
        place = np.argsort(cell, kind="stable")
        seen, first = np.unique(cell[place], return_index=True)
        ends = [*first[1:], len(place)]
        q_ex = t_ex = None
        if in_kernel:
            q_ex, t_ex = _codes(left.column("q_ex"), right.column("t_ex"))
            t_ex = t_ex[place]
        t = _matrix(right.column("t_v"))[place] if len(place) else np.zeros((0, d))
        args = (_matrix(left.column("q_v")), t, reach, order, q_ex, t_ex)
        return left, right, args, {"place": place, "cells": list(zip(first, ends))}, left.column("cell").to_numpy(), seen

    def bounds(left: pa.Table, right: pa.Table) -> pa.Table:
        """The reach-th distance within a query's own cell (else its block), and the blocks that may hold nearer rows."""
        left, right, args, options, cell, seen = opened(left, right)
        q = args[0]
        bound = np.full(len(q), np.inf)

        def note(rows: np.ndarray, found) -> None:
            count = np.bincount(found[0], minlength=len(rows))
            full = np.nonzero(count >= reach)[0]
            bound[rows[full]] = found[2][np.cumsum(count)[full] - 1]

        if right.num_rows and len(q):
            own = lambda at, v: np.where(cell[at:at + len(v)][:, None] == seen, 0.0, np.inf)
            note(np.arange(len(q)), _nearest(*args, **options, lower=own))
            short = np.nonzero(np.isinf(bound))[0]
            note(short, _nearest(q[short], *args[1:4], None if args[4] is None else args[4][short], args[5], **options))
        everything, values, sizes = np.arange(len(pivots)), [np.array([], dtype="int32")], [np.array([], dtype=int)]
        for at in range(0, len(q), QUERY_STEP):
            rows = slice(at, at + QUERY_STEP)
            low = least(q[rows], cell[rows], everything)
            wanted = ((low <= bound[rows][:, None]) & (low < np.inf)).astype(np.float32) @ lies_in > 0
            values.append(np.nonzero(wanted)[1].astype("int32"))
            sizes.append(wanted.sum(axis=1))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("int32")
        blocks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
        return pa.table([*[left.column(c) for c in q_names], left.column("cell"), pa.array(bound), blocks],
                        names=[*q_names, "cell", "bound", "blocks"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right, args, options, cell, seen = opened(left, right)
        r, c, dist = _nearest(*args, **options, limit=left.column("bound").to_numpy(),
                              lower=lambda at, v: least(v, cell[at:at + len(v)], seen))
        return pa.table([left.column("q_no").take(pa.array(r)), right.column("t_id").take(pa.array(c)), pa.array(dist),
                         *[right.column(x).take(pa.array(c)) for x in carry]], names=["q_no", "t_id", "distance", *carry])

    at_home = q_cells.drop("near").join(F.broadcast(home), "cell").withColumnRenamed("start", "block").drop("parts")
    counts = {r["block"]: r["n"] for r in at_home.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    routed = materialise(meet(at_home, counts, bounds, ddl(reps, q_names) + ", cell int, bound double, blocks array<int>"),
                         "knn-routes")
    sent = routed.select(*q_names, "cell", "bound", F.explode("blocks").alias("block"))
    counts = {r["block"]: r["n"] for r in sent.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = meet(sent, counts, search, "q_no bigint, " + schema.split(", ", 1)[1])
    # k rows per block and vector; the row_number limit is also applied before the shuffle
    w = Window.partitionBy("q_no").orderBy("distance", "t_id")
    best = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= reach).drop("_r")
    # equal query vectors meet their shared result again; a crowded vector is split by AQE's skew join
    same = reps.select(*[F.col(c).alias(f"_{c}") for c in q_names], F.xxhash64("q_v").alias("_h"))
    numbered = queries.join(same, [F.xxhash64(queries["q_v"]) == same["_h"],
                                   *[queries[c].eqNullSafe(same[f"_{c}"]) for c in q_names[1:]]]).drop("_h")
    out = numbered.join(best, F.col("_q_no") == F.col("q_no"))
    if excluding and by_id:
        out = out.filter(F.col("q_ex") != F.col("t_id"))
    return out.select("q_id", "t_id", "distance", *carry)


def knn_predict(queries: DataFrame, train: DataFrame, k: int = 5, id: str = "Record", vec: str = "v",
                label: str = "label", weights: str = "uniform", exclude: str | None = None, **options) -> DataFrame:
    """(id, score, Predicted): share of votes for class 1; `distance` weighs by 1/d, an exact match decides alone."""
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights}")
    near = knn_join(queries, train.withColumn(label, F.col(label).cast("int")), k, id, vec, exclude=exclude,
                    carry=[label], **options)
    y = F.col(label).cast("double")
    if weights == "uniform":
        votes = near.groupBy(id).agg(F.avg(y).alias("score"))
    else:
        exact = F.col("distance") == 0
        w = F.when(~exact, F.lit(1.0) / F.nullif(F.col("distance"), F.lit(0.0)))
        votes = near.groupBy(id).agg(F.coalesce(
            F.avg(F.when(exact, y)), F.sum(w * y) / F.nullif(F.sum(w), F.lit(0.0))).alias("score"))
    # a tied vote goes to the smaller code
    return votes.withColumn("Predicted", F.when(F.col("score") > 0.5, 1).otherwise(0))
