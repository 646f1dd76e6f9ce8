"""Approximate nearest neighbours by an inverted multi-index.

Vectors are halved and each half is quantised with its own codebook, so a cell is a pair of centroids. A query visits
cells in the order of their summed distance, which for inner products is the summed inner product with the two centroids:
a heap walks the pairs best first. It stops when the visited cells hold enough rows; all rows in visited cells are reranked
by their exact inner products. How many rows are enough is measured: the exact neighbours of a sample of queries are found
by brute force, and the walk goes on until it would have covered `recall` of them.

Codebooks are fitted on a bounded sample (`sample` rows of the least id hashes), every row is indexed. Rows are stored in
blocks of neighbouring cells, large cells in several blocks; each block meets each chunk of queries in a task of its own
and returns a short list per query.

Defined cases: see `vectors.usable` for the vectors that take no part, those with a null id neither; a query is never its own
neighbour; equal scores are ordered by vec_id; rows that repeat an id are queries with a list each (a row with the query's id
is left out), rows that repeat id and vector have one list; fewer candidates than `k` give all of them; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drawn, stored
from .vectors import dots, matrix, rows_of, usable


def centroids(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    """Lloyd's iterations from randomly chosen rows."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class Index:
    """Codebooks and the number of rows in each cell; the size is set by the codebooks."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray  # (left, right)

    def cell(self, x: np.ndarray) -> np.ndarray:
        half, out = self.left.shape[1], np.zeros(len(x), np.int64)
        for c, part in ((self.left, x[:, :half]), (self.right, x[:, half:])):
            out = out * len(c) + np.argmin((c * c).sum(1) - 2 * part @ c.T, axis=1)
        return out

    def walk(self, q: np.ndarray, enough: int) -> np.ndarray:
        """Cells with rows, best first, until they hold `enough` rows."""
        half = self.left.shape[1]
        a, b = self.left @ q[:half], self.right @ q[half:]
        i, j = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b, held = a[i].tolist(), b[j].tolist(), self.counts[i][:, j].tolist()
        heap, depth = [(-a[0] - b[0], 0, 0)], [0] * len(a)  # depth: pairs of a left centroid that were pushed
        depth[0] = 1
        out, rows, n = [], 0, len(j)
        while heap and rows < enough:
            _, x, y = heapq.heappop(heap)
            if held[x][y]:
                out.append(int(i[x]) * n + int(j[y]))
                rows += held[x][y]
            if y + 1 < n and depth[x] == y + 1 and (x == 0 or depth[x - 1] > y + 1):
                heapq.heappush(heap, (-a[x] - b[y + 1], x, y + 1))
                depth[x] += 1
            if x + 1 < len(a) and depth[x + 1] == y:
                heapq.heappush(heap, (-a[x + 1] - b[y], x + 1, y))
                depth[x + 1] += 1
        return np.array(out, np.int64)


def fit(rows: DataFrame, *, codes: int = 64, sample: int = 20_000, seed: int = 3) -> Index | None:
    """Codebooks from a bounded sample, counts from all rows."""
    some = drawn(rows, ["id"], sample).select("v").toArrow().column(0).combine_chunks()
    if not len(some):
        return None
    x, rng = matrix(some), np.random.default_rng(seed)
    half = (x.shape[1] + 1) // 2
    index = Index(centroids(x[:, :half], codes, rng),
                  centroids(x[:, half:], codes, rng) if half < x.shape[1] else np.zeros((1, 0)), np.zeros((1, 1)))

    def count(batches):
        for batch in batches:
            cell, n = np.unique(index.cell(matrix(batch.column(0))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    got = rows.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()
    counts = np.zeros(len(index.left) * len(index.right), np.int64)
    for cell, n in got:
        counts[cell] = n
    index.counts = counts.reshape(len(index.left), len(index.right))
    return index


def _best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, allowed=None):
    """(query, id, score) of the k best rows of each query by exact score, then id; `allowed` masks (query, row)."""
    rough = q @ x.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    if allowed is not None:
        rough[~allowed] = -np.inf
    if rough.shape[1] > k:
        edge = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
        at, col = np.nonzero((rough >= (edge - slack)[:, None]) & np.isfinite(rough))
    else:
        at, col = np.nonzero(np.isfinite(rough))
    score = dots(q[at], x[col])
    order = np.lexsort((ids[col], -score, at))
    at, col, score = at[order], col[order], score[order]
    first = np.searchsorted(at, at, side="left")
    keep = np.arange(len(at)) - first < k
    return at[keep], ids[col[keep]], score[keep]


def _top(found: DataFrame, k: int, query: tuple[str, ...] = ("query_id",)) -> DataFrame:
    by = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _needed(rows: DataFrame, queries: DataFrame, index: Index, k: int, recall: float, audit: int) -> int:
    """Rows that cells must hold so that a sample of queries finds `recall` of its exact neighbours."""
    some = drawn(queries, ["id"], audit).toArrow()
    own, q = some.column("id").to_numpy(), matrix(some.column("v").combine_chunks())

    def brute(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                at, ids, score = _best(q, batch.column(0).to_numpy(), x, own, k)
                cell = dict(zip(batch.column(0).to_pylist(), index.cell(x).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids), pa.array(score),
                                                  pa.array([cell[i] for i in ids.tolist()], pa.int64())],
                                                 names=["query_id", "vec_id", "score", "cell"])

    exact = _top(rows.select("id", "v").mapInArrow(brute, "query_id long, vec_id long, score double, cell long"), k) \
        .select("query_id", "cell").collect()  # audit * k rows at most
    total = int(index.counts.sum())
    flat, cost = index.counts.ravel(), []
    walks = {}
    for i, cell in exact:
        if i not in walks:
            order = index.walk(q[i], total)
            walks[i] = dict(zip(order.tolist(), np.cumsum(flat[order]).tolist()))
        cost.append(walks[i][cell])
    return max(8 * (k + 1), int(np.quantile(cost, recall, method="higher"))) if cost else total


def search(df: DataFrame, is_query, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           recall: float = 0.96, audit: int = 200, block: int = 4096, chunk: int = 512, codes: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of greatest inner product found for every query row.

    `is_query` is a condition on `id`.
    """
    spark = df.sparkSession
    rows = stored(usable(df, id_col, vector_col).where("id is not null").withColumn("key", F.xxhash64("id", "v")), "vectors")
    index = fit(rows, codes=codes)
    if index is None or not (n_queries := rows.where(is_query).count()):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    enough = _needed(rows, rows.where(is_query), index, k, recall, audit)
    # cells in order, cut into blocks of about `block` rows; a larger cell gets several blocks
    flat = index.counts.ravel()
    home = (np.cumsum(flat) - flat) // block
    copies = np.maximum(1, -(-flat // block))
    chunks = -(-n_queries // chunk)

    def visited(q) -> bytes:
        """One bit per query and cell: whether the query's walk visits the cell."""
        flags = np.zeros((len(q), flat.size), bool)
        for i in range(len(q)):
            flags[i, index.walk(q[i], enough)] = True
        return np.packbits(flags, axis=1).tobytes()

    def pack(kind):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x, names = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy()
                cell = index.cell(x)
                salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                key = home[cell] + salt % copies[cell] if kind == "block" else salt % chunks
                order = np.argsort(key, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(key[part[0]])]), pa.array([len(part)]),
                         pa.array([ids[part].tobytes() if kind == "block" else np.stack([ids[part], names[part]], axis=1).tobytes()]),
                         pa.array([cell[part].tobytes() if kind == "block" else visited(x[part])]),
                         pa.array([np.ascontiguousarray(x[part]).tobytes()])], names=[kind, "n", "ids", "cells", "x"])
        return run

    shape = " long, n long, ids binary, cells binary, x binary"
    blocks = stored(rows.select("id", "v", "key").mapInArrow(pack("block"), "block" + shape), "blocks")
    queries = rows.where(is_query).select("id", "v", "key").dropDuplicates(["id", "key"]).repartition(chunks)
    asked = stored(queries.mapInArrow(pack("chunk"), "chunk" + shape), "queries")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    n_blocks = int((home + copies).max())
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    a = blocks.select("*", numbers.alias("chunk")).withColumn("side", F.lit(0))
    b = asked.select("*", every.alias("block")).withColumn("side", F.lit(1))
    cols = ["block", "chunk", "side", "n", "ids", "cells", "x"]

    def meet(batches):
        """Rows of a (block, chunk) come one after the other, the block's first."""
        now, have = None, [[], []]

        def done():
            if have[0] and have[1]:
                (ids, cell, x), (own, bits, q) = ([np.concatenate(v) for v in zip(*h)] for h in have)
                cell, (own, name) = cell.view(np.int64), own.reshape(-1, 2).T
                allowed = np.unpackbits(bits.reshape(len(own), -1), axis=1)[:, cell].astype(bool)
                at, found, score = _best(q, ids, x, own, k, allowed)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(name[at]), pa.array(found), pa.array(score)],
                                                 names=["query_id", "key", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if (key := (r["block"], r["chunk"])) != now:
                    yield from done()
                    now, have = key, [[], []]
                have[r["side"]].append((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["cells"], np.uint8),
                                        rows_of(r["x"], r["n"])))
        yield from done()

    found = a.select(cols).union(b.select(cols)).repartition("block", "chunk") \
        .sortWithinPartitions("block", "chunk", "side").mapInArrow(meet, "query_id long, key long, vec_id long, score double")
    return _top(found, k, ("query_id", "key")).select("query_id", "rank", "vec_id", "score")
