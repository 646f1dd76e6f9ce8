"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 values (seed 42) of a document's word shingles. It is cut in two
segments of 32 bits, each with its own table. A table holds every different fingerprint under each member of the Hamming
ball of radius 1 around its segment, next to the bits of the other segment; two fingerprints that differ in 2 bits or
fewer meet in at least one table: one flips a bit of one segment, or each flips one. Matches are verified on all 64 bits.

Keys take in the other segment because a segment alone may be shared by a large part of all fingerprints. A bucket holds
65 different fingerprints at most, so links are emitted as a star within each bucket and never as all pairs of a group.

Defined cases: null and empty texts have no words and fingerprint zero; with fewer words than a shingle has, all words are
the one shingle; equal fingerprints are one class; null ids are kept and are never the smallest id; repeated rows give
repeated results; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import runs, stored


def _shingles(text: bytes, width: int) -> tuple[bytes, list[int], list[int]]:
    """Words joined by one blank, and where each shingle begins and ends there."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) < width:
        return joined, [0] * bool(words), [len(joined)] * bool(words)
    size = np.array([len(w) for w in words]) + 1
    end = np.cumsum(size) - 1
    return joined, (end - size + 1)[: len(words) - width + 1].tolist(), end[width - 1:].tolist()


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of `counts` hashes, the bits set in more than half of them (no hashes: 0)."""
    parts = -(-counts // 255)  # bytes count up to 255
    owner = np.repeat(np.arange(len(counts)), parts)
    out = np.zeros(len(counts), np.uint64)
    if not len(owner):
        return out
    first = np.cumsum(counts) - counts
    begin = runs(np.zeros(len(counts), np.int64), parts) * 255 + first[owner]
    split = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), begin)
        total = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), split)
        over = total * 2 > counts[owner[split]][:, None]
        for byte in range(8):
            out[owner[split]] |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            hashes, counts = [], []
            for text in batch.column(1).to_pylist():
                joined, begin, end = _shingles(text, width)
                hashes += [xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(begin, end)]
                counts.append(len(begin))
            fp = majority(np.array(hashes, np.uint64), np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")) \
        .mapInArrow(run, f"doc_id {kind}, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) with a > b: links that connect exactly the fingerprints within 2 bits of each other.

    `fps` has different fingerprints in column fp. Each pair within 2 bits shares a table key, and in each bucket all are
    linked to the smallest: a path of links joins every such pair, no link joins others.
    """
    low = [1 << i for i in range(32)]
    high = [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(32, 64)]
    balls = F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in low + high])
    table = fps.select("fp", F.explode(F.transform(balls, lambda flip: F.col("fp").bitwiseXOR(flip))).alias("key"))
    met = table.select("fp", F.expr("min(fp) over (partition by key)").alias("b"))
    return met.where("fp > b and bit_count(fp ^ b) <= 2").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach)."""
    fps = stored(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(links(distinct.select("fp")))
    labelled = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = stored(labelled.join(smallest, "component").select("fp", "component_id"), "classes")
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                        "component_id")
