"""Cut texts into the matches of the byte-level BPE split pattern, with numpy over whole batches.

The pattern is  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ ; its matches cover every
text. Each code point has a class; a match begins where the class changes, moved to a blank before it, and the last of
several white-space characters before other text stands alone.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from .shared import Hashes, runs

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point. White space is Unicode's White_Space property."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, OTHER, np.uint8)  # from plane 4 on: unassigned, tags, private use
    out[:0x40000] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x40000)]
    for first, last in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[first: last + 1] = SPACE
    return out


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes one after the other, byte offsets at which pieces begin, number of pieces of each text)."""
    whole = "".join(texts)
    data = np.frombuffer(whole.encode(), np.uint8)
    x = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = len(x)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    begins = (np.cumsum(sizes) - sizes)[sizes > 0]
    edge = np.zeros(n + 1, bool)  # first character of a text, and the end
    edge[begins] = True
    edge[n] = True
    c = classes()[x]
    space = c == SPACE
    start = edge[:n].copy()
    changed = c[1:] != c[:-1]
    start[1:] |= changed & ~(x[:-1] == 32)
    # white space: the first of a run, and the last before other text
    start[1:] |= space[1:] & changed
    last = space.copy()
    last[:-1] &= ~space[1:]
    last[-1] = False
    start |= last & ~edge[1:]
    # contractions begin only where a match begins
    at = np.flatnonzero((x == 39) & start)
    at = at[at + 1 < n]
    at = at[(c[at + 1] == LETTER) & ~edge[at + 1]]
    if len(at):
        one = x[at + 1]
        far = np.minimum(at + 2, n - 1)
        two = np.where((at + 2 < n) & ~edge[at + 2], x[far], 0)
        short = np.isin(one, [ord(k) for k in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | (
            (one == ord("l")) & (two == ord("l")))
        start[at[short | long] + 1] = False
        for cut in (at[short] + 2, at[long] + 3):
            cut = cut[cut < n]
            start[cut[c[cut] == LETTER]] = True
    width = 1 + (x > 0x7F).astype(np.int64) + (x > 0x7FF) + (x > 0xFFFF)
    where = np.flatnonzero(start)
    counts = np.zeros(len(texts), np.int64)
    counts[sizes > 0] = np.diff(np.searchsorted(where, np.append(begins, n)))
    return data, (np.cumsum(width) - width)[where], counts


class Dictionary:
    """Ids of pieces already seen by this worker. `encode` turns a list of new pieces (bytes) into lists of ids.

    Pieces are found by a 64-bit hash. When it holds `limit` pieces those that came again since they were learned stay, if
    they are at most half as many, so it is bounded.
    """

    def __init__(self, encode, limit: int = 300_000, seed: int = 7):
        self.encode, self.limit, self.hashes = encode, limit, Hashes(seed)
        self._clear()

    def _clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def _shrink(self) -> None:
        keep = self.again[self.slot]
        if 2 * keep.sum() > self.limit:
            return self._clear()
        self.known, old = self.known[keep], self.slot[keep]
        self.flat = self.flat[runs(self.first[old], self.count[old])]
        self.count = self.count[old]
        self.first = np.cumsum(self.count) - self.count
        self.slot, self.again = np.arange(len(old)), np.zeros(len(old), bool)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        data, begin, counts = split(texts)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        end = np.append(begin[1:], len(data))
        h = self.hashes.of(self.hashes.prefixes(data), begin, end)
        uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self._shrink()
        i = np.searchsorted(self.known, uniq)
        hit = np.zeros(len(uniq), bool)
        inside = i < len(self.known)
        hit[inside] = self.known[i[inside]] == uniq[inside]
        self.again[self.slot[i[hit]]] = True
        if not hit.all():
            self._learn(uniq[~hit], data.tobytes(), begin[where[~hit]], end[where[~hit]])
            i = np.searchsorted(self.known, uniq)
        code = self.slot[i][back]
        lengths = self.count[code]
        out = self.flat[runs(self.first[code], lengths)]
        of_text = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(of_text)

    def _learn(self, hashes, raw: bytes, begin, end) -> None:
        new = self.encode([raw[b:e] for b, e in zip(begin.tolist(), end.tolist())])
        count = np.array([len(x) for x in new], np.int64)
        flat = np.concatenate([np.asarray(x, np.uint32) for x in new])
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        slot = np.arange(len(self.count), len(self.count) + len(count))
        self.count, self.flat = np.concatenate([self.count, count]), np.concatenate([self.flat, flat])
        self.again = np.concatenate([self.again, np.zeros(len(count), bool)])
        at = np.searchsorted(self.known, hashes)
        self.known, self.slot = np.insert(self.known, at, hashes), np.insert(self.slot, at, slot)
