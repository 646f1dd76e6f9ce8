"""Pack tokenised documents into windows by non-negative least squares over length combinations.

Each document's ids are cut into full windows and one rest. The histogram of rest lengths is all the planner sees: it
enumerates shallow combinations of lengths that fill a window (one, two or three rests), solves for the repeat count of
each combination by non-negative least squares against the histogram, rounds down, and packs what is left greedily
(largest rest first, then the largest that still fits). A rest gets its place from its rank among the rests of its
length, so no sequence's pieces have to meet in a task, and the driver handles at most `window` counts.

Defined cases: null and empty texts are the closing id alone; texts of any length are cut whole; repeated rows are
packed once each; ties in length are ordered by (doc_id, start); other columns are not read; an empty table gives an
empty table; null ids are packed like others.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Dictionary
from .shared import stored, sub_batches


@functools.cache
def _encoders(path: str, *version):
    """(tokenizer of whole texts, its special tokens, dictionary of pieces), kept by a worker from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model, whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
    for m in (model, whole):
        m.no_truncation()
        m.no_padding()
    model.encode_special_tokens = True
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return whole, special, Dictionary(lambda new: [x.ids for x in model.encode_batch_fast([p.decode() for p in new],
                                                                                           add_special_tokens=False)])


def tokenised(docs: DataFrame, path: str, *, window: int = 1024, end_id: int = 0, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Pieces of at most `window` ids: doc_id, start, length, ids_crc32, doc_tokens.

    Ids come from the `tokenizers` file at `path`; each different match of its split pattern is encoded once per worker. Texts
    that hold the string of a special token are encoded as a whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        stat = os.stat(path)
        whole, special, seen = _encoders(path, stat.st_mtime_ns, stat.st_size)
        for batch in batches:
            keys, raw = batch.column(0), batch.column(1).to_pylist()
            row, start, length, crc, total = [], [], [], [], []
            for lo, hi in sub_batches(raw):
                ids, counts = seen.ids(raw[lo:hi])
                at = np.concatenate([[0], np.cumsum(counts)]).tolist()
                for i in range(hi - lo):
                    own = ids[at[i]: at[i + 1]]
                    if any(t in raw[lo + i] for t in special):  # a token's own string is that token
                        own = np.array(whole.encode(raw[lo + i], add_special_tokens=False).ids, np.uint32)
                    mine = np.append(own, np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(mine), window):
                        piece = mine[s: s + window]
                        row.append(lo + i)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(mine))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row, pa.int64()))] + [pa.array(c, pa.int64()) for c in (start, length, crc, total)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")) \
        .mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


# ---- the plan: from counts of lengths to patterns with repeat counts -------------------------------------------------
def combinations(lengths: list[int], window: int, per_length: int = 6) -> list[tuple[int, ...]]:
    """Combinations of one, two or three of the given lengths that fill the window.

    Triples are enumerated for every first length with `per_length` second lengths spread over the possible ones.
    """
    have, out = set(lengths), set()
    for a in lengths:
        if a == window:
            out.add((a,))
        elif window - a in have and window - a <= a:
            out.add((a, window - a))
        rest = window - a
        seconds = [b for b in lengths if b <= a and 0 < rest - b <= b and rest - b in have]
        for b in seconds[:: max(1, -(-len(seconds) // per_length))]:
            out.add((a, b, rest - b))
    return sorted(out, reverse=True)


def solve(patterns: list[tuple[int, ...]], counts: dict[int, int], rounds: int = 60) -> np.ndarray:
    """Non-negative repeat counts x minimising |A x - counts|: coordinate descent, each step exact for one pattern."""
    columns = []
    for p in patterns:
        used = {}
        for length in p:
            used[length] = used.get(length, 0) + 1
        columns.append((list(used.items()), sum(v * v for v in used.values())))
    rest, x = {k: float(v) for k, v in counts.items()}, np.zeros(len(patterns))
    scale = max(1.0, float(sum(counts.values())))
    for _ in range(rounds):
        moved = 0.0
        for j, (used, norm) in enumerate(columns):
            step = sum(v * rest[k] for k, v in used) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                for k, v in used:
                    rest[k] -= v * step
                moved += abs(step)
        if moved < 1e-4 * scale:
            break
    return x


def plan(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): every rest of the histogram is in exactly one pattern, each pattern fits in the window."""
    left = {k: int(v) for k, v in counts.items() if v > 0}
    patterns = combinations(sorted(left, reverse=True), window)
    x, out = solve(patterns, left), []

    def take(pattern, times):
        if times > 0:
            out.append((pattern, int(times)))
            for k in pattern:
                left[k] -= int(times)

    for j in np.argsort(-x, kind="stable"):
        p = patterns[j]
        take(p, min([int(x[j] + 1e-9)] + [left[k] // p.count(k) for k in p]))
    while open_ := [k for k in sorted(left, reverse=True) if left[k] > 0]:
        pattern, gap, free = [], window, dict(left)
        for k in open_:  # largest first, each as often as it fits
            while k <= gap and free[k] > 0:
                pattern.append(k)
                free[k] -= 1
                gap -= k
        take(tuple(pattern), min(left[k] // pattern.count(k) for k in set(pattern)))
    return out


def placed(pieces: DataFrame, window: int) -> DataFrame:
    """`pieces` (stored) with sequence_id and offset."""
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    spans: dict[int, list[tuple[int, int, int]]] = {}  # by length: first rank, first sequence, offset
    used, sequence = dict.fromkeys(counts, 0), 0
    for pattern, times in plan(counts, window):
        at = 0
        for k in pattern:
            spans.setdefault(k, []).append((used[k], sequence, at))
            used[k] += times
            at += k
        sequence += times
    order = ["length", "doc_id", "start", "ids_crc32"]
    ranged = stored(pieces.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    # partitions are ordered by length: one row for each partition and length, partitions + window rows at most
    part = F.shiftrightunsigned("_at", 33)
    heads = sorted(tuple(r) for r in ranged.groupBy("length", part.alias("p")).agg(F.min("_at"), F.count("*")).collect())
    base, before = {}, {}
    for length, p, first, n in heads:
        base.setdefault(length, ([], [], []))
        b = base[length]
        b[0].append(p)
        b[1].append(first)
        b[2].append(before.get(length, 0))
        before[length] = before.get(length, 0) + n

    def run(batches):
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("_at").to_numpy()
            seq, off = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for k in np.unique(length):
                mine = np.flatnonzero(length == k)
                p, first, ahead = (np.array(v, np.int64) for v in base[int(k)])
                i = np.searchsorted(p, at[mine] >> 33)
                rank = at[mine] - first[i] + ahead[i]
                begin, sequence_, offset = (np.array(v, np.int64) for v in zip(*spans[int(k)]))
                j = np.searchsorted(begin, rank, side="right") - 1
                seq[mine] = sequence_[j] + rank - begin[j]
                off[mine] = offset[j]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(seq), pa.array(off)],
                                             names=batch.schema.names[:-1] + ["sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranged.select(*pieces.columns, "_at").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, *, window: int = 1024, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces of a sequence follow each other without gaps; the sum of their lengths is at most `window`.
    """
    pieces = stored(tokenised(docs, path, window=window, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    return placed(pieces, window)
