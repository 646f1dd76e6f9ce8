"""Remove every byte that a string of `min_bytes` bytes covers which also starts earlier in the corpus.

Sampled suffixes, as in the difference-cover construction, but the cover is content-defined: a position is sampled if the
hash of its next `width` bytes is the least in some window of `min_bytes` bytes (the rightmost on ties). Any two equal
strings of `min_bytes` bytes thus have a sampled position at the same distance from their starts, which is what a fixed
difference cover is for; about one position in 25 is sampled instead of two in three. Steps:

1. Sampled positions are named by the hash of their `width` bytes, and sorted by (name, name of the whole stretch whose
   windows they serve, place). Adjacent rows with the same stretch repeat an earlier one: all of its windows go.
2. A name that occurs once, or whose stretches are all the same, needs nothing more: one name spans `width` bytes and a
   stretch at least `min_bytes`, so names need no deeper recursion.
3. The remaining suffixes, the single windows of different stretches under one name, are merged the same way: sorted by
   the 128 bits of their window and compared with their neighbour.

Equal strings are recognised by two independent 64-bit hashes. A name that many places share doesn't meet in one task:
each batch keeps the first row of equal strings (the others are repeats for sure), and sends rows of names that have
several stretches in the batch to the task of their stretch, with one beacon to the task of their name.

Defined cases: null and empty texts have no bytes; a text shorter than `min_bytes` is kept whole; texts of any length are
used whole; documents with repeated or null ids are ordered by (id, null first; text), each row is a document; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Hashes, _mixed, keyed, portions, runs, stored, sub_batches

PLAIN, SURE_FIRST, BEACON, SURE_REPEAT = 0, 1, 2, 3
SUB = 1 << 19  # bytes that are hashed at once
_ROWS = "pk long, ctx long, row long, s long, n long, kind int"


def _slide(h: np.ndarray, w: int, best) -> np.ndarray:
    """best (minimum or maximum) of every w neighbouring values, from block-wise running values."""
    n = len(h)
    x = np.full(-(-n // w) * w, h[-1] if n else 0, np.uint64)
    x[:n] = h
    x = x.reshape(-1, w)
    ahead = best.accumulate(x, axis=1).ravel()
    back = best.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - w + 1], ahead[w - 1: n])


def stretches(data: np.ndarray, sizes: np.ndarray, min_bytes: int, width: int, hashes: Hashes):
    """(name, first window, number of windows, hash of the stretch) of every sampled position of concatenated texts."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n, w = len(data), min_bytes - width + 1
    if n < min_bytes:
        return none
    windows = n - min_bytes + 1
    valid = np.arange(min_bytes, n + 1) <= np.repeat(np.cumsum(sizes), sizes)[:windows]
    if not valid.any():
        return none
    prefix = hashes.prefixes(data)
    h = hashes.rolling(prefix, width)
    least = _slide(h, w, np.minimum)
    start = valid.copy()
    start[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    used = np.concatenate([np.zeros(w - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(w - 1, np.uint64)])
    sampled = np.flatnonzero(h == _slide(used, w, np.maximum))
    tie = np.flatnonzero((h[sampled[1:]] == h[sampled[:-1]]) & (np.diff(sampled) < w))
    cut = sampled[tie + 1] - (w - 1)
    cut = cut[(cut >= 0) & (cut < windows)]
    start[cut[valid[cut]]] = True
    s = np.flatnonzero(start)
    count = np.add.reduceat(valid.astype(np.int64), s)
    return least[s], s, count, hashes.of(prefix, s, s + count - 1 + min_bytes)


def _combined(name, ctx, row, s, n) -> pa.RecordBatch:
    """The rows a batch sends on; see the module's text for the kinds."""
    order = np.argsort(name, kind="stable")
    name, ctx, row, s, n = name[order], ctx[order], row[order], s[order], n[order]
    same = name[1:] == name[:-1] if len(name) else np.zeros(0, bool)
    many = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(name) else np.zeros(0, np.int64)
    kind, pk = np.zeros(len(name), np.int32), name.copy()
    beacons = np.zeros(0, np.uint64)
    if len(many):
        many = many[np.lexsort((s[many], row[many], ctx[many], name[many]))]
        a, b = name[many], ctx[many]
        new_name = np.append(True, a[1:] != a[:-1])
        new = new_name | np.append(True, b[1:] != b[:-1])
        group = np.cumsum(new_name) - 1
        varied = np.bincount(group, new) > 1
        first = many[new & varied[group]]
        kind[first], pk[first] = SURE_FIRST, _mixed(name[first] ^ _mixed(ctx[first]))
        again = many[~new]
        kind[again], pk[again] = SURE_REPEAT, _mixed((row[again] * 1_000_003 + s[again]).astype(np.uint64))
        beacons = a[new_name][varied]
    z = np.zeros(len(beacons), np.int64)
    cols = [np.concatenate([pk, beacons]).view(np.int64), np.concatenate([ctx.view(np.int64), z]),
            np.concatenate([row, z]), np.concatenate([s, z]), np.concatenate([n, z]),
            np.concatenate([kind, z + BEACON]).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["pk", "ctx", "row", "s", "n", "kind"])


def _compared(rows: DataFrame) -> DataFrame:
    """(row, s, n, repeat): repeat is true where an equal string starts earlier; else it has to be looked into."""
    by = Window.partitionBy("pk")
    before = F.lag("ctx").over(by.orderBy("ctx", "row", "s"))
    found = rows.select("*", before.alias("before"), (F.min("ctx").over(by) != F.max("ctx").over(by)).alias("varied"))
    repeat = (F.col("kind") == SURE_REPEAT) | F.coalesce(F.col("before") == F.col("ctx"), F.lit(False))
    return found.where(F.col("kind") != BEACON).select("row", "s", "n", repeat.alias("repeat"), "varied", "kind") \
        .where(F.col("repeat") | F.col("varied") | (F.col("kind") == SURE_FIRST)).select("row", "s", "n", "repeat")


def _packed(spans: DataFrame) -> DataFrame:
    return spans.groupBy("row").agg(F.collect_list(F.shiftleft("s", 24) + F.col("n")).alias("spans"))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the list, s, n) of every packed span."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), flat >> 24, flat & 0xFFFFFF


def repeats(docs: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(row, s, n): from byte s on, n successive windows of `min_bytes` bytes that start earlier too.

    `docs` has a unique long `row`, in the order of the corpus, and binary `t`.
    """
    width = min_bytes // 2 + 1

    def sample(batches):
        hashes = Hashes(11)
        for batch in (p for b in batches for p in portions(b, 1)):
            row, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            parts = []
            for lo, hi in sub_batches(raw, SUB):
                size = np.array([len(t) for t in raw[lo:hi]], np.int64)
                name, s, n, ctx = stretches(np.frombuffer(b"".join(raw[lo:hi]), np.uint8), size, min_bytes, width, hashes)
                end = np.cumsum(size)
                doc = np.searchsorted(end, s, side="right")
                parts.append((name, ctx, row[lo:hi][doc], s - (end - size)[doc], n))
            if parts:
                yield _combined(*(np.concatenate(x) for x in zip(*parts)))

    sampled = stored(_compared(docs.select("row", "t").mapInArrow(sample, _ROWS)), "stretches")

    def expand(batches):
        one, two = Hashes(12), Hashes(13)
        for batch in (p for b in batches for p in portions(b, 1)):
            row, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            doc, first, count = _lists(batch.column(2))
            parts = []
            for lo, hi in sub_batches(raw, SUB):
                a, b = np.searchsorted(doc, [lo, hi])
                size = np.array([len(t) for t in raw[lo:hi]], np.int64)
                data, base = np.frombuffer(b"".join(raw[lo:hi]), np.uint8), np.cumsum(size) - size
                owner = np.repeat(doc[a:b] - lo, count[a:b])
                s = runs(first[a:b], count[a:b])
                at = s + base[owner]
                x, y = (h.of(h.prefixes(data), at, at + min_bytes) for h in (one, two))
                parts.append((x, y, row[lo:hi][owner], s, np.ones(len(s), np.int64)))
            if parts:
                yield _combined(*(np.concatenate(x) for x in zip(*parts)))

    open_ = _packed(sampled.where("not repeat"))
    windows = stored(_compared(docs.join(open_, "row").select("row", "t", "spans").mapInArrow(expand, _ROWS))
                     .where("repeat"), "windows")
    return sampled.where("repeat").select("row", "s", "n").union(windows.select("row", "s", "n"))


def dedup(docs: DataFrame, *, min_bytes: int = 100, id_col: str = "doc_id", text_col: str = "text",
          keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    `keep_text`, kept_text, the kept bytes as text (a character that a cut splits is left out). The columns in `carry`
    follow as _0, _1 and so on."""
    base = keyed(docs, id_col, text_col).select(F.col("_row").alias("row"), F.col(id_col).alias("doc_id"),
                                                F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"),
                                                *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)])
    extra = [f"_{i}" for i in range(len(carry))]
    spans = _packed(repeats(base, min_bytes))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep_text + extra

    def cut(batches):
        for batch in (p for b in batches for p in portions(b, 1)):
            raw = batch.column(1).to_pylist()
            doc, s, n = _lists(batch.column(2))
            removed, pieces, digest, text = [], [], [], []
            for lo, hi in sub_batches(raw):
                a, b = np.searchsorted(doc, [lo, hi])
                size = np.array([len(t) for t in raw[lo:hi]], np.int64)
                base = np.cumsum(size) - size
                data, total = np.frombuffer(b"".join(raw[lo:hi]), np.uint8), int(size.sum())
                begin = s[a:b] + base[doc[a:b] - lo]
                depth = np.bincount(begin, minlength=total + 1) - np.bincount(begin + n[a:b] - 1 + min_bytes,
                                                                              minlength=total + 1)
                gone = np.cumsum(depth)[:total] > 0
                rise = gone.copy()
                rise[1:] &= ~gone[:-1]
                heads = base[(size > 0)]
                rise[heads] = gone[heads]
                for g in (gone, rise):
                    (removed if g is gone else pieces).append(
                        np.diff(np.concatenate([[0], np.cumsum(g)])[np.append(base, total)]))
                for i in range(hi - lo):
                    at = slice(base[i], base[i] + size[i])
                    left = data[at][~gone[at]].tobytes()
                    digest.append(hashlib.sha256(left).hexdigest())
                    if keep_text:
                        text.append(left.decode("utf-8", "ignore"))
            out = [batch.column(0), pa.array([len(t) for t in raw], pa.int64()),
                   *(pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (removed, pieces)),
                   pa.array(digest, pa.string())] + [pa.array(text, pa.string())] * keep_text \
                + batch.columns[3:]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    kinds = "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return base.join(spans, "row", "left").select("doc_id", "t", "spans", *extra).mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
             + ", kept_text string" * keep_text + kinds)
