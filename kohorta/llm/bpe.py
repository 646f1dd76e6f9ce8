"""Byte-level BPE encoding and decoding in padded numpy matrices.

Pieces of the split pattern are dealt into matrices by length. In every round each row merges its leftmost pair of
minimum rank; pairs are looked up in an open-addressing hash table; rows without a mergeable pair leave the matrix, and
the others lose the merged column (compaction). Each different piece of a worker's texts is encoded once.

Defined cases: a null or empty text has no ids (n_tokens 0, hashes of the empty string); a text of any length is encoded
whole; repeated rows give repeated results; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Dictionary
from .shared import runs, sub_batches

NONE = np.int32(2**31 - 1)


class Merges:
    """Ranks of a byte-level vocabulary and the hashed table of its mergeable pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        self.words: list[bytes] = [b""] * self.size
        for word, rank in ranks.items():
            self.words[rank] = word
        keys, values = [], []
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self._build(np.array(keys, np.uint64), np.array(values, np.int32))
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.width, self.begin = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.words), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, keys, values) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        free = np.uint64(2**64 - 1)
        self.keys, self.values = np.full(1 << self.bits, free), np.full(1 << self.bits, NONE)
        slot = self._slot(keys)
        while len(keys):
            empty = self.keys[slot] == free
            self.keys[slot[empty]] = keys[empty]  # of several in one slot, one stays
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, NONE where it is no token."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right
        slot, out = self._slot(keys), np.full(len(keys), NONE)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (found != np.uint64(2**64 - 1))
            open_, slot = open_[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def encode(self, pieces: list[bytes], cells: int = 1 << 20) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            least = int(size[order[at]])
            most = max(least, 8) if least <= 8 else least + least // 4  # a bucket: similar lengths, little padding
            end = min(int(np.searchsorted(size[order], most, side="right")), at + max(1, cells // max(1, most)))
            rows = order[at:end]
            self._bucket([pieces[i] for i in rows], rows, out)
            at = end
        return out

    def _bucket(self, pieces: list[bytes], rows: np.ndarray, out: list) -> None:
        n, width = len(pieces), max(1, max(map(len, pieces)))
        length = np.array([len(p) for p in pieces], np.int64)
        ids = np.zeros((n, width), np.uint32)
        inside = np.arange(width) < length[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, width), NONE)  # of the pair that begins in a cell
        pair = inside.copy()
        pair[:, :-1] &= inside[:, 1:]
        pair[:, -1] = False
        r, c = np.nonzero(pair)
        rank[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        while n:
            best = rank.argmin(axis=1)
            line = np.arange(n)
            value = rank[line, best]
            done = value == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = ids[i, : length[i]]
                ids, rank, rows, length = ids[~done], rank[~done], rows[~done], length[~done]
                best, value, n = best[~done], value[~done], int((~done).sum())
                if not n:
                    return
                line = np.arange(n)
            ids[line, best] = value.astype(np.uint32)
            keep = np.ones(ids.shape, bool)
            keep[line, best + 1] = False
            w = ids.shape[1] - 1
            ids, rank = ids[keep].reshape(n, w), rank[keep].reshape(n, w)
            length = length - 1
            if length.max() < w:  # drop padding that no row needs
                w = int(length.max())
                ids, rank = np.ascontiguousarray(ids[:, :w]), np.ascontiguousarray(rank[:, :w])
            for where, ok in ((best, best + 1 < length), (best - 1, best > 0)):
                fresh = np.full(n, NONE)
                a = where[ok]
                fresh[ok] = self.rank(ids[line[ok], a], ids[line[ok], a + 1])
                real = (where >= 0) & (where < w)
                rank[line[real], where[real]] = fresh[real]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self.bytes[runs(self.begin[ids], self.width[ids])].tobytes()


@functools.lru_cache(maxsize=4)
def load(path: str) -> Merges:
    """A `.tiktoken` rank file: base64 of the token and its rank on each line."""
    with open(path, "rb") as f:
        return Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with `keep_ids`, the ids themselves.

    `path` is the rank file on every executor; the rows never leave their task, nothing is shuffled.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, " \
             "decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        merges = load(path)
        seen = Dictionary(merges.encode)
        for batch in batches:
            ids_out, raw = batch.column(0), batch.column(1).to_pylist()
            n, a, b, lists = [], [], [], []
            for lo, hi in sub_batches(raw):
                texts = raw[lo:hi]
                ids, counts = seen.ids(texts)
                at = np.concatenate([[0], np.cumsum(counts)])
                for i in range(hi - lo):
                    mine = ids[at[i]: at[i + 1]]
                    n.append(len(mine))
                    a.append(sha(mine.astype("<u4").tobytes()))
                    b.append(sha(merges.decode(mine)))
                    if keep_ids:
                        lists.append(mine.astype(np.int32))
            cols = [ids_out, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")) \
        .mapInArrow(run, schema)
