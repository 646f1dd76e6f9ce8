"""Periodic runs of words: stretches that repeat a period of q words at least four times.

A run of smallest period q and length L >= max(6, 4q) means that words q apart are equal over L - q >= 3q places, a piece
of a diagonal. Periods are taken in classes [k, 2k), k = 1, 2, 4, ...: 2k words fit into the guaranteed overlap of every
period of the class, so the 2k-grams of a document are the seeds. As 2k exceeds the period, the next occurrence of a seed
inside a run is exactly one period away; so each occurrence is paired with the next one only, never with all others. The
2k-grams are named by pairs of names of k-grams, and only k-grams that occur again in their document are carried on.
Seeds are extended along their diagonal in both directions; a table of the furthest covered place of each lag skips seeds
that an extension has passed. A document of n words costs n log n comparisons and sorts at most log n times, whatever it
repeats. Documents never leave their task; nothing is shuffled.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; texts of any length are used
whole; repeated rows and null or repeated ids give a row each; other columns are dropped unless named in `carry`; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import portions, runs
from .words import bytes_of, numbered, spans, strings

#: Blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (32, 9, 10, 11, 12, 13)
RUN = "struct<start:long,length:long,period:long>"


def _seeds(ids: np.ndarray, owner: np.ndarray):
    """(positions, lags) of the seeds of each class of periods; positions ascend for each lag."""
    n = len(ids)
    if n < 2:
        return
    key, at, k = owner * (int(ids.max()) + 1) + ids, np.arange(n), 1
    name = np.full(n, -1, np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order[1:]] != key[order[:-1]])
        number, pos = np.cumsum(new) - 1, at[order]
        again = ~new[1:]
        if k > 1:  # these are k-grams: periods from k / 2 on, less than k
            lag = pos[1:] - pos[:-1]
            ok = again & (lag >= k // 2) & (lag < k)
            yield pos[:-1][ok], lag[ok]
        repeated = np.append(again, False) | np.append(False, again)
        if not repeated.any():
            return
        name[:] = -1
        name[pos[repeated]] = number[repeated]
        at = np.flatnonzero(name[: n - k] >= 0) if n > k else at[:0]
        at = at[(name[at + k] >= 0) & (owner[at] == owner[at + k])]
        if len(at) < 2:
            return
        key, k = name[at] * (int(name.max()) + 1) + name[at + k], 2 * k


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal leading elements of two arrays of one length."""
    done, step = 0, 32
    while done < len(a):
        unlike = a[done: done + step] != b[done: done + step]
        if unlike.any():
            return done + int(unlike.argmax())
        done += len(unlike)
        step *= 2
    return done


def repetitions(ids: np.ndarray, owner: np.ndarray, *, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, length, period) of all runs of the word numbers `ids`, ordered by start and period; `owner` is the
    ascending document number of each word."""
    head = np.searchsorted(owner, owner, side="left")
    tail = np.searchsorted(owner, owner, side="right")
    found = []
    for pos, lag in _seeds(ids, owner):
        order = np.lexsort((pos, lag))
        pos, lag = pos[order], lag[order]
        covered: dict[int, int] = {}
        lead = np.append(True, (lag[1:] != lag[:-1]) | (pos[1:] != pos[:-1] + 1)) if len(pos) else np.zeros(0, bool)
        for i, q in zip(pos[lead].tolist(), lag[lead].tolist()):
            if i < covered.get(q, -1):
                continue
            lo, hi = int(head[i]), int(tail[i])
            right = i + _agree(ids[i: hi - q], ids[i + q: hi])
            left = i - _agree(ids[lo: i][::-1], ids[lo + q: i + q][::-1])
            covered[q] = right
            if right - left + q >= max(least, times * q):
                found.append((left, right - left + q, q))
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapse(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4,
             carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period in words, by start, then period),
    collapsed (the words left when every run keeps its first period only, joined by blanks); then the `carry` columns as
    `_0`, `_1`, ..."""
    if times < 4:
        raise ValueError("seeds are guaranteed for four repetitions or more")

    def run(batches):
        blank = np.zeros(256, bool)
        blank[list(BLANKS)] = True
        for batch in batches:
            for part in portions(batch, 1):
                data, offsets = bytes_of(part.column(1))
                first, end, owner = spans(~blank[data], offsets)
                n = part.num_rows
                ids, _, _ = numbered(data, first, end)
                found = repetitions(ids, owner, least=least, times=times)
                words = np.bincount(owner, minlength=n)
                before = np.cumsum(words) - words
                of = owner[found[:, 0]] if len(found) else np.zeros(0, np.int64)
                cuts = np.zeros(n + 1, np.int32)
                np.cumsum(np.bincount(of, minlength=n), out=cuts[1:])
                rows = pa.StructArray.from_arrays(
                    [pa.array(found[:, 0] - before[of]), pa.array(found[:, 1]), pa.array(found[:, 2])],
                    names=["start", "length", "period"])
                gone = np.zeros(len(ids) + 1, np.int64)
                np.add.at(gone, found[:, 0] + found[:, 2], 1)
                np.add.at(gone, found[:, 0] + found[:, 1], -1)
                kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                more = np.append(owner[kept[1:]] == owner[kept[:-1]], False)[: len(kept)]
                size = end[kept] - first[kept] + more
                text = data[runs(first[kept], size)]
                text[(np.cumsum(size) - 1)[more]] = 32
                length = np.bincount(owner[kept], size, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words), pa.ListArray.from_arrays(pa.array(cuts), rows),
                     strings(text, length), *part.columns[2:]],
                    names=["doc_id", "n_words", "runs", "collapsed", *[f"_{i}" for i in range(len(carry))]])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"doc_id {kinds[id_col]}, n_words long, runs array<{RUN}>, collapsed string" + "".join(
        f", _{i} {kinds[c]}" for i, c in enumerate(carry))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                       *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]).mapInArrow(run, schema)


def strongest(found: Column) -> Column:
    """Of an array of runs the one of greatest length / period (then the first), null for none."""
    return F.aggregate(found, F.lit(None).cast(RUN), lambda a, r: F.when(
        a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
