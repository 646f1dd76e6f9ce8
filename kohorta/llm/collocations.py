"""Phrases whose words stand together more often than their parts do, counted by prefix-free parsing.

A text is cut at punctuation and line ends into pieces, these at blanks into words. Parsing looks at windows of `OVERLAP` = 3
words: those whose hash is divisible by `EVERY` are triggers. A chunk reaches from one trigger to the end of the next, so
neighbouring chunks share the three words of a trigger, and equal passages are cut alike wherever they stand. The different
chunks of a language are the dictionary, and how often each occurs is its parse frequency. Phrases of up to four words are counted inside
the different chunks only, weighted by these frequencies. A phrase belongs to the chunk in which it begins before the
shared words (the last chunk of a text owns all of its phrases), so none is counted twice and none lost.

Words and pairs are counted first, then phrases of three words both of whose pairs reach `least`, then of four both of whose
triples do: no other can reach it. A bitmap of fixed size (`BITS`, 8 MB) holds the frequent pairs or triples, the only thing
broadcast; where it fills up, more rows are shuffled, and the counts stay exact. Tasks count equal phrases of a portion
before they emit them. Scores are exact integer quotients of decimals.

Defined cases: null texts are empty; a null language is `und`; empty texts and empty tables give no phrases; texts of any
length are used whole; repeated rows count each time; other columns are not read; ties are ordered by phrase, in byte order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Hashes, _mixed, discard, portions, runs, stored
from .words import LOWER, bytes_of, numbered, spans, strings

OVERLAP, EVERY, LONGEST = 3, 24, 4
BITS = 1 << 26
#: Blank and tab part words; full stop, comma, semicolon, colon, exclamation and question mark, LF, VT, FF, CR part pieces.
BLANKS, BREAKS = (32, 9), (46, 44, 59, 58, 33, 63, 10, 11, 12, 13)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> np.ndarray:
    """Of every byte: 0 in a word, 1 blank, 2 break."""
    out = np.zeros(256, np.uint8)
    out[list(BLANKS)], out[list(BREAKS)] = 1, 2
    return out


def _word_hashes(data, first, end, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, hash of each number)."""
    ids, a, b = numbered(data, first, end)
    size = b - a
    packed = data[runs(a, size)]
    off = np.cumsum(size)
    return ids, hashes.of(hashes.prefixes(packed), off - size, off)


def parse(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, chunk, tail): chunks of all texts, lower case A-Z, words parted by blanks and pieces by line feeds; `tail`
    marks the last chunk of a text, which owns the phrases that begin in its last words."""
    def run(batches):
        hashes, kinds = Hashes(91), _kinds()
        for batch in batches:
            for part in portions(batch, 1):
                data, offsets = bytes_of(part.column(1))
                data = LOWER[data]
                kind = kinds[data]
                first, end, owner = spans(kind == 0, offsets)
                if not len(first):
                    continue
                breaks = np.append(0, np.cumsum(kind == 2))
                last = np.append(owner[1:] != owner[:-1], True)
                after = np.append(first[1:], end[-1])
                parted = (breaks[np.maximum(after, end)] > breaks[end]) & ~last
                # the texts once more: words, each followed by one blank or line feed
                size = end - first + 1
                at = np.cumsum(size) - size
                flat = np.append(data, np.uint8(32))[runs(first, size)]
                flat[at + size - 1] = np.where(parted, 10, 32)
                ids, h = _word_hashes(data, first, end, hashes)
                h = h[ids] + parted.astype(np.uint64)
                n = len(h)
                trigger = np.zeros(n, bool)
                if n >= OVERLAP:
                    w = h[: n - 2] * _STEP + h[1: n - 1]
                    w = _mixed(w * _STEP + (h[2:] - parted[2:].astype(np.uint64)))
                    trigger[: n - 2] = (w % np.uint64(EVERY) == 0) & (owner[: n - 2] == owner[2:])
                head = np.append(True, last[:-1])
                start = np.flatnonzero(head | trigger)
                tail = np.append(head[start[1:]], True)  # the next chunk begins another text
                stop = np.append(start[1:], n) + np.where(tail, 0, OVERLAP)  # first word behind the chunk
                length = at[stop - 1] + size[stop - 1] - 1 - at[start]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner[start])), strings(flat[runs(at[start], length)], length),
                     pa.array(tail)], names=["lang", "chunk", "tail"])

    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t")) \
        .mapInArrow(run, "lang string, chunk string, tail boolean")


def dictionary(chunks: DataFrame) -> DataFrame:
    """(lang, chunk, tail, times): the different chunks and how often each occurs."""
    return chunks.groupBy("lang", "chunk", "tail").agg(F.count(F.lit(1)).alias("times"))


class _Counter:
    """Phrases of a portion of chunks, counted by numbers of words; two portions' counts are added by Spark."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits, self.hashes, self.kinds = bits, Hashes(92), _kinds()

    def _grow(self, name, places, word):
        """(places of phrases longer by a word, name of each place, one place of each name), all exact."""
        k = self.length
        key = name[places] * self.words + word[places + k]
        _, some, number = np.unique(key, return_index=True, return_inverse=True)
        out = np.full(len(word), -1, np.int64)
        out[places] = number
        self.length += 1
        return out, places[some]

    def phrases(self, batch: pa.RecordBatch, lengths: tuple[int, ...]):
        """(lang row, first byte, bytes, words, times) arrays for each of `lengths`, and the portion's bytes; a length
        beyond two leaves out phrases with a part (one word shorter) that the bitmap lacks."""
        data, offsets = bytes_of(batch.column(1))
        kind = self.kinds[data]
        first, end, owner = spans(kind == 0, offsets)
        if not len(first):
            return data, []
        ids, h = _word_hashes(data, first, end, self.hashes)
        langs = batch.column(0).dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
                         for x in langs.dictionary.to_pylist()], np.uint64)
        _, word = np.unique(lang * len(h) + ids, return_inverse=True)  # words of a language
        n, self.words, self.length = len(word), int(word.max()) + 1, 1
        here = np.append(owner[1:] == owner[:-1], False)
        behind = np.cumsum(np.append(1, ~here[:-1])) - 1  # chunk of each word that has words
        count = np.bincount(behind)
        left = (np.cumsum(count))[behind] - np.arange(n)  # words from here to the chunk's end
        tail = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)[owner]
        times = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)[owner]
        own = tail | (left > OVERLAP)
        joined = here & (np.append(kind, 0)[end] == 1)  # the next word belongs to the piece
        out = []
        name, fit, mix = word, np.ones(n, bool), salt[lang] * _STEP + h[ids]
        for k in range(1, max(lengths) + 1):
            if k > 1:
                fit = fit[:n] & np.append(fit[1:], False) & joined if k == 2 else \
                    fit & np.append(fit[1:], False)
                places = np.flatnonzero(fit)
                if not len(places):
                    break
                name, some = self._grow(name, places, word)
                mix[places] = _mixed(mix[places] * _STEP + h[ids[places + k - 1]])
            else:
                places, some = np.arange(n), np.unique(word, return_index=True)[1]
            if k in lengths:
                mine = places[own[places]]
                total = np.zeros(len(some), np.int64)
                np.add.at(total, name[mine], times[mine])
                got = total > 0
                at = some[got]
                out.append((owner[at], first[at], end[at + k - 1] - first[at], np.full(len(at), k), total[got]))
            if self.bits is not None and 2 <= k < max(lengths) and k == min(lengths) - 1:
                ok = self._known(mix[some])
                fit = np.zeros(n, bool)
                fit[places] = ok[name[places]]
        return data, out

    @staticmethod
    def slots(h: np.ndarray) -> np.ndarray:
        return np.stack([h % np.uint64(BITS), (h >> np.uint64(32)) % np.uint64(BITS)]).astype(np.int64)

    def _known(self, h: np.ndarray) -> np.ndarray:
        s = self.slots(h)
        return ((self.bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)

    def marks(self, batch: pa.RecordBatch) -> np.ndarray:
        """Hashes of whole phrases given as chunks."""
        data, offsets = bytes_of(batch.column(1))
        first, end, owner = spans(self.kinds[data] == 0, offsets)
        ids, h = _word_hashes(data, first, end, self.hashes)
        out = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
                        for x in batch.column(0).to_pylist()], np.uint64)
        place = np.arange(len(ids)) - (np.cumsum(np.bincount(owner, minlength=len(out))) -
                                       np.bincount(owner, minlength=len(out)))[owner]
        for k in range(int(place.max()) + 1 if len(place) else 0):
            rows = place == k
            mixed = out[owner[rows]] * _STEP + h[ids[rows]]
            out[owner[rows]] = mixed if not k else _mixed(mixed)
        return out


def _gathered(batches, limit: int = 1 << 23):
    """Batches of about `limit` bytes of chunks."""
    kept, size = [], 0
    for batch in batches:
        for part in portions(batch, 1, limit):
            kept.append(part)
            size += part.column(1).nbytes
            if size >= limit:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, size = [], 0
    if size:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def counted(chunks: DataFrame, lengths: tuple[int, ...], least: int, shorter: DataFrame | None = None) -> DataFrame:
    """(lang, phrase, words, a) of the phrases of `lengths` words that occur `least` times; with a length of one also a row
    per language for all its words (phrase null, words 0). `shorter`: the frequent phrases one word shorter."""
    bits = None if shorter is None else chunks.sparkSession.sparkContext.broadcast(_bitmap(shorter))

    def run(batches):
        counter = _Counter(None if bits is None else bits.value)
        for batch in _gathered(batches):
            data, found = counter.phrases(batch, lengths)
            for row, at, size, words, times in found:
                lang = batch.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([lang, strings(data[runs(at, size)], size), pa.array(words, pa.int32()),
                                                  pa.array(times)], names=["lang", "phrase", "words", "a"])
                if len(words) and words[0] == 1:
                    all_ = pa.table({"lang": lang, "a": times}).group_by("lang").aggregate([("a", "sum")])
                    yield pa.RecordBatch.from_arrays(
                        [all_["lang"].combine_chunks(), pa.nulls(len(all_), pa.string()),
                         pa.array([0] * len(all_), pa.int32()), all_["a_sum"].combine_chunks()],
                        names=["lang", "phrase", "words", "a"])

    got = chunks.select("lang", "chunk", "tail", "times").mapInArrow(
        run, "lang string, phrase string, words int, a long")
    return got.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | F.expr("words = 0"))


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """The frequent phrases as bits: `BITS` bits whatever their number."""
    def run(batches):
        counter = _Counter()
        for batch in batches:
            s = np.unique(_Counter.slots(counter.marks(batch)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(s >> 6), pa.array((np.uint64(1) << (s & 63).astype(np.uint64)).view(np.int64))], names=["i", "b"])

    got = phrases.select("lang", "phrase").mapInArrow(run, "i long, b long").groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[got["i"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30) -> DataFrame:
    """(lang, phrase, words, a): exact counts of all phrases of one to four words that occur `least` times, stored."""
    chunks = stored(dictionary(parse(docs, text_col=text_col, lang_col=lang_col)), "chunks")
    two = stored(counted(chunks, (1, 2), least), "phrases")
    three = stored(counted(chunks, (3,), least, two.where("words = 2")), "phrases")
    four = stored(counted(chunks, (4,), least, three), "phrases")
    discard(chunks)
    return two.unionByName(three).unionByName(four)


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000,
                 scale: int = 2_000_000, cover: int = 80) -> DataFrame:
    """Of each language the `top` phrases of two to four words: lang, rank, phrase, a, l, r, n, score.

    A phrase cut in two parts scores floor(scale * a / (l + r)), its lowest cut counts. Phrases that stand inside a longer one
    which occurs at least `cover` percent as often are left out.
    """
    found = phrases(docs, text_col=text_col, lang_col=lang_col, least=least)
    long_ = found.where("words >= 2")
    inside = found.where("words >= 3").select("lang", F.col("a").alias("most"), F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(0, words - m), i -> "
        "array_join(slice(split(phrase, ' '), i + 1, m), ' '))))")).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = long_.join(inside, ["lang", "phrase"], "left") \
        .where(f"most is null or cast(most as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {int(cover)}")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr(
        "flatten(transform(sequence(1, words - 1), k -> array("
        "named_struct('k', k, 'left', true, 'part', substring_index(phrase, ' ', k)), "
        "named_struct('k', k, 'left', false, 'part', substring_index(phrase, ' ', k - words)))))")).alias("c")) \
        .select("lang", "phrase", "a", "c.k", "c.left", F.col("c.part").alias("part"))
    parts = found.where("words between 1 and 3").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    scored = cuts.join(parts, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.expr("if(left, f, null)")).alias("l"), F.max(F.expr("if(left, null, f)")).alias("r")) \
        .withColumn("score", F.expr(f"(cast(a as decimal(20, 0)) * {int(scale)}BD) div (cast(l as decimal(20, 0)) + r)")) \
        .groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("s")) \
        .select("lang", "phrase", "a", "s.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(found.where("words = 0").select("lang", F.col("a").alias("n")), "lang") \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
