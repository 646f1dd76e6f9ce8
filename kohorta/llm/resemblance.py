"""Groups of documents by the Jaccard similarity of their word shingles.

Documents of equal shingle sets are one node. `HASHES` min-hashes of a set enter as `BANDS` tables, each keyed by `ROWS` of
them: of pairs at similarity 0.8 all but 3 in 100,000 share a bucket, of closer ones all but fewer. See
`graph.bucket_groups` for the pairs compared in a bucket; each link is verified by the similarity of the two sets (of
64-bit hashes of shingles).

Defined cases: with fewer words than a shingle has, all words are the one shingle; texts without words are one group; null
ids aren't supported; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import bucket_groups
from .shared import _mixed, stored
from .simhash import _shingles

BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS


def _tables(sets: list[bytes], salt: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), BANDS), np.int64)
    for i, raw in enumerate(sets):
        h = np.frombuffer(raw, np.uint64)
        least = np.array([_mixed(h ^ s).min() for s in salt]).reshape(BANDS, ROWS)
        out[i] = [xxhash.xxh64_intdigest(least[b].tobytes(), b) - (1 << 63) for b in range(BANDS)]
    return out


def groups(docs: DataFrame, *, id_col: str, text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id (the long `id_col`), component_id (smallest doc_id that links reach)."""
    salt = np.random.default_rng(5).integers(0, 1 << 63, HASHES, dtype=np.uint64)

    def read(batches):
        for batch in batches:
            sets = []
            for text in batch.column(1).to_pylist():
                joined, begin, end = _shingles(text, width)
                h = np.array([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(begin, end)], np.uint64)
                sets.append(np.unique(h).tobytes())
            node = [int.from_bytes(hashlib.sha1(x).digest()[:8], "little", signed=True) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(sets, pa.binary())],
                                             names=["doc_id", "node", "x"])

    def place(batches):
        for batch in batches:
            sets = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(_tables(sets, salt).ravel(), pa.int64()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS), pa.int64()),
                 pa.array(np.repeat([len(x) // 8 for x in sets], BANDS), pa.int64()),
                 pa.array(np.repeat(batch.column(2).to_numpy(), BANDS), pa.int64())], names=["key", "node", "size", "n"])

    def verify(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in (2, 3))
            ok = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
                  .mapInArrow(read, "doc_id long, node long, x binary"), "shingles")
    nodes = stored(rows.groupBy("node").agg(F.first("x").alias("x"), F.count("*").alias("n")), "sets")
    buckets = nodes.where("length(x) > 0").select("node", "x", "n").mapInArrow(place, "key long, node long, size long, n long")

    def alike(pairs: DataFrame) -> DataFrame:
        sets = nodes.select("node", "x")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a") \
            .join(sets.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")
        return both.select("a", "b", "xa", "xb").mapInArrow(verify, "a long, b long")

    found = bucket_groups(buckets, lambda x, y: f"least({x}, {y}) >= {similarity} * greatest({x}, {y}) - 1e-9", alike)
    named = stored(rows.select("doc_id", "node").join(found, "node", "left")
                   .select("doc_id", F.coalesce("component", "node").alias("component")), "named")
    return named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component") \
        .select("doc_id", "component_id")
