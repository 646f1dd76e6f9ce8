"""Language of texts and of their spans: scripts narrow the candidates, Viterbi labels the words.

Learning counts hashed character n-grams (1 to 4 letters, word edges included) of each language, and the scripts that its
letters use. A word is scored by the log likelihood of its n-grams; languages that never use the word's script are out,
unless none does. Over a text's words, Viterbi with a penalty for each switch of language gives the best labelling, so
spans of mixed texts come out as such; the language with most letters is the text's.

Viterbi runs on all words of a batch at once: a text's first word switches freely, the whole sequence is cut in blocks,
the blocks' transfer matrices are computed side by side, then chained.

Defined cases: a text that is null or has no letter is `und` with score 0 and has no spans; with nothing learned every
text is `und`; equal scores go to the first language in order; texts of any length are used whole; repeated rows get equal
results; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import LETTER, classes
from .shared import _mixed, drawn, runs

BUCKETS = 1 << 15
#: First code points of script ranges (Unicode blocks); a letter's script is the last range that begins
#: at or before it.
SCRIPTS = {"latin": (0x0, 0x1E00, 0x2C60, 0xA720, 0xFF21), "greek": (0x370, 0x1F00), "cyrillic": (0x400, 0x2DE0, 0xA640),
           "armenian": (0x530,), "hebrew": (0x590,), "arabic": (0x600, 0xFB50), "indic": (0x900,), "thai": (0xE00,),
           "georgian": (0x10A0,), "hangul": (0x1100, 0x3130, 0xAC00), "kana": (0x3040, 0x31F0),
           "han": (0x3400, 0x4E00, 0xF900, 0x20000)}


@functools.cache
def script_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((first, i) for i, v in enumerate(SCRIPTS.values()) for first in v)
    return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


@functools.cache
def lowered() -> np.ndarray:
    """Simple lower case of every code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c)) in ("Lu", "Lt") and len(low := chr(c).lower()) == 1:
            out[c] = ord(low)
    return out


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case code points of all texts, first letters of words, their lengths, text of each word)."""
    x = lowered()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    size = np.array([len(t) for t in texts], np.int64)
    letter = classes()[x] == LETTER
    edge = np.zeros(len(x) + 1, bool)
    edge[np.cumsum(size) - size] = True
    before = np.append(False, letter[:-1]) & ~edge[:-1] if len(x) else letter
    first = np.flatnonzero(letter & ~before)
    after = np.append(letter[1:], False) & ~edge[1:] if len(x) else letter
    end = np.flatnonzero(letter & ~after) + 1
    return x, first, end - first, np.searchsorted(np.cumsum(size), first, side="right")


def grams(x: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of the words, with a mark before and after each word."""
    size = length + 2
    out = np.full(int(size.sum()), 32, np.uint64)
    head = np.cumsum(size) - size
    out[runs(head + 1, length)] = x[runs(first, length)]
    owner = np.repeat(np.arange(len(first)), size)
    buckets, of = [], []
    h = np.zeros(len(out), np.uint64)
    for n in range(1, 5):
        keep = len(out) - n + 1
        if keep <= 0:
            break
        h = h[:keep] * np.uint64(0x100000001B3) + out[n - 1:] + np.uint64(1)
        inside = owner[:keep] == owner[n - 1:]
        buckets.append((_mixed(h[inside] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
        of.append(owner[:keep][inside])
    return (np.concatenate(buckets), np.concatenate(of)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Languages:
    """What was learned; its size is set by the number of languages."""

    names: list[str]
    weight: np.ndarray  # (bucket, language): log likelihoods
    scripts: np.ndarray  # (script, language): allowed
    penalty: float = 8.0


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id",
        max_rows: int = 8_000, penalty: float = 8.0) -> Languages:
    """Learn from the whole texts of at most `max_rows` rows with text and language (rows that repeat one of them count
    as it does), picked by hashes of id and text."""
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("g"), F.xxhash64(order_col, text_col).alias("o")) \
        .where("t is not null and g is not null")
    few = drawn(rows.select("o"), ["o"], max_rows).distinct()  # max_rows hashes at most
    rows = rows.join(F.broadcast(few), "o").repartition(16)

    def count(batches):
        for batch in batches:
            tags = np.array(batch.column(1).to_pylist(), object)
            for g in dict.fromkeys(tags.tolist()):
                x, first, length, _ = words([t for t, k in zip(batch.column(0).to_pylist(), tags) if k == g])
                bucket, _ = grams(x, first, length)
                n = np.bincount(bucket, minlength=BUCKETS)
                begins, script = script_table()
                s = np.bincount(script[np.searchsorted(begins, x[runs(first, length)], side="right") - 1],
                                minlength=len(SCRIPTS))
                n = np.concatenate([n, s])
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                                 names=["g", "k", "n"])

    got = rows.select("t", "g").mapInArrow(count, "g string, k long, n long").groupBy("g", "k").agg(F.sum("n")).collect()
    names = sorted({r[0] for r in got})
    table = np.zeros((BUCKETS + len(SCRIPTS), max(1, len(names))))
    for g, k, n in got:
        table[k, names.index(g)] = n
    n, s = table[:BUCKETS] + 0.5, table[BUCKETS:]
    return Languages(names, np.log(n / n.sum(axis=0)), s > 0.01 * np.maximum(1, s.sum(axis=0)), penalty)


def viterbi(score: np.ndarray, begins: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every row of `score` if each change costs `penalty`, but none where `begins`."""
    n, k = score.shape
    if not n:
        return np.zeros(0, np.int64)
    width = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // width)
    s = np.zeros((blocks * width, k))
    s[:n] = score
    cost = np.full(blocks * width, penalty)
    cost[:n][begins] = 0.0
    s, cost = s.reshape(blocks, width, k), cost.reshape(blocks, width)
    move = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(blocks, 0)  # from the state before a block
    for t in range(width):
        move = np.maximum(move, move.max(axis=2, keepdims=True) - cost[:, t, None, None]) + s[:, t, None, :]
    enter = np.zeros((blocks, k))
    for b in range(1, blocks):
        v = (enter[b - 1][:, None] + move[b - 1]).max(axis=0)
        enter[b] = v - v.max()
    back = np.zeros((width, blocks, k), np.int16)
    v, line = enter, np.arange(blocks)
    for t in range(width):
        best = v.argmax(axis=1)
        jump = v[line, best] - cost[:, t]
        stay = v >= jump[:, None]
        back[t] = np.where(stay, np.arange(k), best[:, None])
        v = np.where(stay, v, jump[:, None]) + s[:, t]
    came = np.arange(k)[None].repeat(blocks, 0)
    for t in range(width - 1, -1, -1):
        came = np.take_along_axis(back[t], came, 1)
    state = np.zeros(blocks, np.int64)
    state[-1] = v[-1].argmax()
    for b in range(blocks - 1, 0, -1):
        state[b - 1] = came[b, state[b]]
    out = np.zeros((blocks, width), np.int64)
    for t in range(width - 1, -1, -1):
        out[:, t] = state
        state = back[t][line, state].astype(np.int64)
    return out.reshape(-1)[:n]


class Scores:
    """Scores of words by language; each different word of a worker is scored once (at most `limit` are kept)."""

    def __init__(self, model: Languages, limit: int = 400_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self.known, self.table = np.zeros(0, np.uint64), np.zeros((0, len(self.model.names)))

    def of(self, x, first, length) -> np.ndarray:
        up = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15 | 5, np.uint64))
        part = x[runs(first, length)].astype(np.uint64) * up[runs(np.zeros(len(first), np.int64), length)]
        h = _mixed(np.add.reduceat(part, np.cumsum(length) - length) + length.astype(np.uint64))
        uniq, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self._clear()
        at = np.searchsorted(self.known, uniq)
        new = np.ones(len(uniq), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != uniq[inside]
        if new.any():
            fresh = self._score(x, first[where[new]], length[where[new]])
            i = np.searchsorted(self.known, uniq[new])
            self.known, self.table = np.insert(self.known, i, uniq[new]), np.insert(self.table, i, fresh, axis=0)
            at = np.searchsorted(self.known, uniq)
        return self.table[at][inverse]

    def _score(self, x, first, length) -> np.ndarray:
        m = self.model
        bucket, word = grams(x, first, length)
        out = np.stack([np.bincount(word, m.weight[bucket, g], len(first)) for g in range(len(m.names))], axis=1)
        begins, script = script_table()
        allowed = m.scripts[script[np.searchsorted(begins, x[first], side="right") - 1]]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        out -= np.where(allowed, out, -np.inf).max(axis=1, keepdims=True)
        return np.where(allowed, np.maximum(out, -30.0), -60.0)


def label(texts: list[str], scores: Scores) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first letter within its text, length, text, language) of every word."""
    x, first, length, owner = words(texts)
    if not len(first) or not scores.model.names:
        e = np.zeros(0, np.int64)
        return e, e, e, e
    begins = np.append(True, owner[1:] != owner[:-1])
    path = viterbi(scores.of(x, first, length), begins, scores.model.penalty)
    size = np.array([len(t) for t in texts], np.int64)
    return first - (np.cumsum(size) - size)[owner], length, owner, path


def identify(docs: DataFrame, model: Languages, *, text_col: str = "text", spans: bool = False) -> DataFrame:
    """`docs` without the text, with lang_pred, score (share of the letters) and, if asked for, spans: array of
    (start, end, lang), character offsets in the text, neighbouring words of a language joined. Columns of these names
    are replaced."""
    kept = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "spans")]
    names = [*model.names, "und"]

    def run(batches):
        scores = Scores(model)
        for batch in batches:
            raw = [t or "" for t in batch.column(len(kept)).to_pylist()]
            pred, share, parts = [], [], []
            lo = 0
            while lo < len(raw):
                hi, size = lo, 0
                while hi < len(raw) and (hi == lo or size + len(raw[hi]) <= 1 << 20):
                    size += len(raw[hi])
                    hi += 1
                start, length, owner, path = label(raw[lo:hi], scores)
                k = len(names)
                letters = np.bincount(owner * k + path, length, (hi - lo) * k).reshape(hi - lo, k)
                best, total = letters.argmax(axis=1), letters.sum(axis=1)
                best[total == 0] = k - 1
                pred += [names[i] for i in best]
                share += (letters.max(axis=1) / np.maximum(total, 1)).tolist()
                if spans:
                    parts += _spans(hi - lo, start, length, owner, path, names)
                lo = hi
            cols = batch.columns[:-1] + [pa.array(pred, pa.string()), pa.array(share, pa.float64())]
            if spans:
                cols.append(pa.array(parts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                                                                ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "lang_pred", "score"] + ["spans"] * spans)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    fields += ["lang_pred string", "score double"] + ["spans array<struct<start:long,end:long,lang:string>>"] * spans
    return docs.select(*kept, text_col).mapInArrow(run, ", ".join(fields))


def _spans(n, start, length, owner, path, names) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    if len(start):
        head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (path[1:] != path[:-1])))
        tail = np.append(head[1:], len(start)) - 1
        for a, b in zip(head, tail):
            out[owner[a]].append({"start": int(start[a]), "end": int(start[b] + length[b]), "lang": names[path[a]]})
    return out
