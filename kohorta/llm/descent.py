"""Near-duplicate vectors by NN-descent and a threshold graph.

Equal vectors are collapsed first and counted. A neighbour graph starts from blocks of vectors that are neighbours in the
order of random hyperplane codes, and is refined: at every node, its neighbours and the nodes that have it as neighbour
are compared with each other, and better pairs enter the lists. Lists whose last entry still passes the threshold are
saturated; their capacity is doubled in the next round, up to `8 * keep` (entries that pass are kept up to there). Edges of
cosine >= the threshold make components. An audit compares sampled vectors with all rows; while it finds links that the
components miss, refinement goes on, for `rounds` rounds at most. Then the vectors of saturated lists, or all vectors if the
audit still finds links, are compared with every vector of other components, in blocks, and components that have a link
are joined.

The links inside a component are then counted exactly: its vectors are compared in blocks of bounded size, and tasks
return sums, never pairs.

Defined cases: see `vectors.usable` for vectors that take no part: they link with nothing and are their own component;
equal vectors link with each other; ids that repeat are different vectors; the component of a null id is the smallest id
it reaches, or null; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import discard, drawn, stored
from .vectors import matrix, usable

PAIRS = "node long, nbr long, sim double"
BLOCK = 128


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stack(column: pa.Array, kind) -> np.ndarray:
    """Unit vectors from a column of raw bytes."""
    raw = column.to_pylist()
    if not raw:
        return np.zeros((0, 1))
    return _unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64))


def _batch(node, nbr, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(nbr, pa.int64()), pa.array(sim, pa.float64())],
                                      names=["node", "nbr", "sim"])


def _groups(batches, key: str):
    """Lists of batches' rows (as one table) that share a key; rows come sorted by it."""
    parts, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if parts and k[a] != now:
                yield pa.Table.from_batches(parts).combine_chunks()
                parts = []
            now = k[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _start(v: DataFrame, n: int, dim: int, kind, keep: int, tables: int, seed: int) -> DataFrame:
    """First lists: the best `keep` of the blocks of `BLOCK` vectors in the order of each table's hyperplane codes."""
    bits = int(np.clip(np.ceil(np.log2(max(2, n / 64))), 1, 40))
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, dim, bits + 1))

    def code(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _stack(batch.column(1), kind)
            for t in range(tables):
                y = x @ planes[t]
                c = ((y[:, :bits] > 0).astype(np.int64) << np.arange(bits)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(c), pa.array(y[:, bits]),
                                                  batch.column(0), batch.column(1)], names=["t", "c", "y", "node", "x"])

    def compare(batches):
        for batch in batches:
            node = batch.column("node").to_numpy()
            for a in range(0, len(node), BLOCK):
                x = _stack(batch.column("x").slice(a, BLOCK), kind)
                own, s = node[a: a + BLOCK], x @ x.T
                np.fill_diagonal(s, -2)
                k = min(keep, len(own) - 1)
                if k < 1:
                    continue
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield _batch(np.repeat(own, k), own[best].ravel(), np.take_along_axis(s, best, 1).ravel())

    coded = stored(v.select("node", "x").mapInArrow(code, "t long, c long, y double, node long, x binary"), "codes")
    return coded.repartitionByRange("t", "c", "y").sortWithinPartitions("t", "c", "y").mapInArrow(compare, PAIRS)


def _lists(pairs: DataFrame, caps: DataFrame | None, keep: int) -> DataFrame:
    """The best neighbours of every node: `keep`, or the node's own capacity where `caps` has one."""
    once = pairs.where("node <> nbr").groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")))
    if caps is None:
        return ranked.where(F.col("r") <= keep)
    return ranked.join(caps, "node", "left").where(F.col("r") <= F.coalesce("cap", F.lit(keep))).drop("cap")


def _capacities(graph: DataFrame, threshold: float, keep: int) -> DataFrame:
    """(node, low, cap) of nodes of at least `keep` entries that pass: twice as many if the last one passes, else these."""
    passes = F.count_if(F.col("sim") >= threshold)
    return graph.groupBy("node").agg(F.min("sim").alias("low"), passes.alias("n")).where(F.col("n") >= keep) \
        .select("node", "low", F.least(F.when(F.col("low") >= threshold, 2 * F.col("n")).otherwise(F.col("n")),
                                       F.lit(8 * keep)).alias("cap"))


def _refined(graph: DataFrame, v: DataFrame, kind, keep: int) -> DataFrame:
    """Better pairs among the neighbours and reverse neighbours of every node."""
    back = graph.withColumn("q", F.row_number().over(Window.partitionBy("nbr").orderBy(F.desc("sim"), "node"))) \
        .where(F.col("q") <= keep)
    members = graph.select(F.col("node").alias("u"), F.col("nbr").alias("w")) \
        .union(back.select("nbr", "node")).union(v.select("node", F.col("node"))).distinct()
    low = graph.groupBy("node").agg(F.min("sim").alias("low"))
    side = v.select("node", "x").join(low, "node", "left").select(F.col("node").alias("w"), "x", F.coalesce("low", F.lit(-2.0))
                                                                  .alias("low"))

    def join(batches):
        for g in _groups(batches, "u"):
            w, low_ = g.column("w").to_numpy(), g.column("low").to_numpy()
            if len(w) < 2:
                continue
            x = _stack(g.column("x"), kind)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            k = min(6, len(w) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            sim = np.take_along_axis(s, best, 1)
            r, c = np.nonzero(sim > low_[:, None])
            if len(r):
                yield _batch(w[r], w[best[r, c]], sim[r, c])

    return members.join(side, "w").select("u", "w", "low", "x").repartition("u").sortWithinPartitions("u") \
        .mapInArrow(join, PAIRS)


def _missed(v: DataFrame, parts: DataFrame, kind, threshold: float, sample: int) -> tuple[int, int]:
    """(links of sampled vectors that join different components, all their links): compared with every row."""
    label = v.join(parts.withColumnRenamed("component", "part"), "node", "left") \
        .select("node", "x", F.coalesce("part", "node").alias("part"), F.col("part").isNotNull().alias("linked"))
    some = drawn(label.where("linked"), ["node"], sample).union(drawn(label, ["node"], sample)).toArrow()
    own, part, q = some.column("node").to_numpy(), some.column("part").to_numpy(), _stack(some.column("x"), kind)

    def count(batches):
        bad = total = 0
        for batch in batches:
            if batch.num_rows:
                hit = (q @ _stack(batch.column(1), kind).T >= threshold) & (own[:, None] != batch.column(0).to_numpy())
                total += int(hit.sum())
                bad += int((hit & (part[:, None] != batch.column(2).to_numpy())).sum())
        yield pa.RecordBatch.from_arrays([pa.array([bad]), pa.array([total])], names=["bad", "total"])

    r = label.select("node", "x", "part").mapInArrow(count, "bad long, total long").agg(F.sum("bad"), F.sum("total")).first()
    return r[0] or 0, r[1] or 0


def _joined(v: DataFrame, parts: DataFrame, some: DataFrame | None, kind, threshold: float, block: int) -> DataFrame:
    """(node, nbr): pairs of components between which there is a link of a vector in `some` (default: any), by all pairs."""
    label = v.join(parts.withColumnRenamed("component", "part"), "node", "left") \
        .select("node", "x", F.coalesce("part", "node").alias("part"))
    label = stored(label, "labels")
    own = label if some is None else label.join(some.select("node"), "node", "left_semi")
    nx, ny = (max(1, -(-df.count() // block)) for df in (own, label))

    def dealt(df, n, others, mine):
        b = F.pmod(F.xxhash64("node", F.lit(9)), F.lit(n))
        o = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select("x", "part", b.alias("b"), o.alias("o")) \
            .select(((F.col("b") * ny + F.col("o")) if mine else (F.col("o") * ny + F.col("b"))).cast("long").alias("g"),
                    F.lit(mine).alias("mine"), "x", "part")

    def find(batches):
        for g in _groups(batches, "g"):
            mine, part, x = g.column("mine").to_numpy(zero_copy_only=False), g.column("part").to_numpy(), _stack(g.column("x"), kind)
            p, y, q = part[mine], x[~mine], part[~mine]
            pairs = set()
            for a in range(0, len(p), 256):
                i, j = np.nonzero((x[mine][a: a + 256] @ y.T >= threshold) & (p[a: a + 256, None] != q))
                pairs |= set(zip(p[a: a + 256][i].tolist(), q[j].tolist()))
            both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            yield _batch(both[:, 0], both[:, 1], np.ones(len(both)))

    return dealt(own, nx, ny, True).union(dealt(label, ny, nx, False)).repartition("g").sortWithinPartitions("g") \
        .mapInArrow(find, PAIRS).select("node", "nbr").distinct()


def _counted(v: DataFrame, parts: DataFrame, kind, threshold: float, block: int) -> DataFrame:
    """(node, links): exact numbers of linked rows within each component, from blocks of at most about `block` vectors."""
    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = v.join(parts, "node").join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("node", F.lit(9)), "blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    rows = placed.select("component", "node", "x", "m", "b", other) \
        .withColumn("g", F.xxhash64("component", F.least("b", "o"), F.greatest("b", "o"))) \
        .withColumn("first", F.col("b") <= F.col("o"))

    def count(batches):
        for g in _groups(batches, "g"):
            node, m, b, o = (g.column(c).to_numpy() for c in ("node", "m", "b", "o"))
            x = _stack(g.column("x"), kind)
            if (b == o).all():
                hit = x @ x.T >= threshold
                np.fill_diagonal(hit, False)
                links = hit @ m
            else:
                one = b < o
                hit = x[one] @ x[~one].T >= threshold
                links = np.zeros(len(node), np.int64)
                links[one], links[~one] = hit @ m[~one], hit.T @ m[one]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64))], names=["node", "links"])

    return rows.select("g", "node", "x", "m", "b", F.col("o").cast("long").alias("o")).repartition("g") \
        .sortWithinPartitions("g").mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                    keep: int = 10, tables: int = 8, rounds: int = 8, audit: int = 200, block: int = 512,
                    seed: int = 1) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id = component_id)."""
    single = df.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64  # the values as they are stored

    def pack(batches):
        for batch in batches:
            x = matrix(batch.column(1)).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["id", "x"])

    rows = stored(usable(df, id_col, vector_col).mapInArrow(pack, "id long, x binary")
                  .withColumn("node", F.xxhash64("x")), "vectors")
    v = stored(rows.groupBy("node").agg(F.first("x").alias("x"), F.count("*").alias("m"), F.min("id").alias("least")), "nodes")
    n = v.count()
    size = np.dtype(kind).itemsize
    dim = (v.select(F.length("x")).first() or [size])[0] // size
    graph, caps = stored(_lists(_start(v, n, dim, kind, keep, tables, seed), None, keep), "graph"), None
    parts = None
    for done in range(rounds):
        caps = _capacities(graph, threshold, keep)
        old = graph
        graph = stored(_lists(graph.select("node", "nbr", "sim").union(_refined(graph, v, kind, keep)), caps, keep), "graph")
        discard(old)
        if parts is not None:
            discard(parts)
        parts = stored(components(graph.where(F.col("sim") >= threshold).select("node", "nbr"), "node", "nbr"), "parts")
        bad, total = _missed(v, parts, kind, threshold, audit)
        if done >= 1 and not bad:
            break
    full = stored(_capacities(graph, threshold, keep).where(F.col("low") >= threshold).select("node"), "full")
    if bad or full.limit(1).count():
        across = stored(_joined(v, parts, None if bad else full, kind, threshold, 8 * block), "across")
        tree = parts.select("node", F.col("component").alias("nbr"))
        parts = stored(components(tree.union(across), "node", "nbr"), "parts")
    inner = _counted(v, parts, kind, threshold, block)
    named = v.join(parts, "node", "left").select("node", "m", "least", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = stored(named.join(smallest, "component").join(inner, "node", "left")
                   .select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "facts")
    linked = rows.join(facts, "node").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    # rows that take no part; ids of those that do are needed to tell them apart, so the test is made on the vector itself
    rest = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    d = F.col("v")
    fine = d.isNotNull() & (F.size(d) == dim) & F.exists(d, lambda x: x != 0) & F.forall(
        d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    alone = rest.where(~F.coalesce(fine, F.lit(False))) if n else rest
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
