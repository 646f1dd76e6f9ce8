"""Short license notices in texts, found with errors allowed.

A text becomes its words, lower case A-Z, joined by single blanks (words are stretches of digits, letters and bytes beyond
ASCII). A notice of L characters may have k = L * `ERRORS` edits, `MOST` at most. It is split into k + 1 pieces: in a
stretch with at most k edits one piece is left whole (pigeonhole), so an Aho-Corasick automaton of all pieces finds every
place that can match. Around each hit the window that a match could fill is cut out, windows of a notice that touch are
joined, and those without the notice's own words (`mit`, `3`) are passed over. The regex library's bounded-error matching
then goes through the window from left to right, from word to word; the best fit inside each match is the span. Places
where all words stand unchanged are taken from the hits of the first piece by comparison, so that none is hidden by a
longer inexact match.

A span's similarity is 1 - edits / L; the score of a text is the greatest of its spans, 0 without any.

Defined cases: a null or empty text has no words, no spans and score 0; texts of any length are used whole; a notice that
occurs more than once gives a span each; notices may overlap one another, inexact spans of one notice don't overlap its
others; repeated rows and null or repeated ids give a row each; other columns are dropped; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import portions
from .words import LOWER, bytes_of

#: Edits allowed for each character of a notice, and for a whole notice.
ERRORS, MOST = 0.1, 4


@dataclass(frozen=True)
class Notice:
    """A notice in lower-case words joined by single blanks; `own` are words that an inexact match must hold unchanged."""

    label: str
    text: str
    own: tuple[str, ...] = ()
    base: bool = False


#: The phrases of the contract, then notices with which licenses are usually named or begin.
NOTICES = (
    Notice("mit", "under the mit license", ("mit",), base=True),
    Notice("apache-2", "apache license version 2", ("apache", "2"), base=True),
    Notice("cc-by-nc", "cc by nc", ("nc",), base=True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Notice("gpl-3", "gnu general public license version 3", ("general", "3")),
    Notice("gpl-2", "gnu general public license version 2", ("general", "2")),
    Notice("lgpl", "gnu lesser general public license", ("lesser",)),
    Notice("agpl", "gnu affero general public license", ("affero",)),
    Notice("mpl-2", "mozilla public license version 2", ("mozilla", "2")),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("cc-by-sa", "creative commons attribution sharealike", ("sharealike",)),
    Notice("cc-by-nc", "creative commons attribution noncommercial", ("noncommercial",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",)),
)


class Scanner:
    """Automaton and patterns of the notices; texts are bytes of words joined by single blanks, read as Latin-1."""

    def __init__(self, notices: Sequence[Notice], errors: float = ERRORS, most: int = MOST):
        self.notices = notices
        self.sizes = [len(n.text.encode()) for n in notices]
        self.edits = [min(most, int(size * errors)) for size in self.sizes]
        self.texts = [n.text.encode().decode("latin-1") for n in notices]
        self.own = [[f" {w.encode().decode('latin-1')} " for w in n.own] for n in notices]
        self.first, self.best = ([
            regex.compile(f"(?{flag})(?<![^ ])(?! )(?:{regex.escape(t, literal_spaces=True)}){{e<={k}}}(?<! )(?![^ ])")
            for t, k in zip(self.texts, self.edits)] for flag in "eb")
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (t, k) in enumerate(zip(self.texts, self.edits)):
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                pieces.setdefault(t[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(first character, end, notice, edits) of every match, ordered."""
        exact: dict[int, list[int]] = {}
        windows: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for i, offset in uses:
                at, k = last + 1 - size - offset, self.edits[i]
                if not offset and text.startswith(self.texts[i], at) and text[at - 1: at] in ("", " ") and \
                        text[at + self.sizes[i]: at + self.sizes[i] + 1] in ("", " "):
                    exact.setdefault(i, []).append(at)
                lo, hi, mine = max(0, at - k), at + self.sizes[i] + k, windows.setdefault(i, [])
                # pieces end in ascending order, so a window begins before an earlier one by less than the notice's length
                while mine and lo <= mine[-1][1]:
                    lo, hi = min(lo, mine[-1][0]), max(hi, mine.pop()[1])
                mine.append([lo, hi])
        out = [(at, at + self.sizes[i], i, 0) for i, places in exact.items() for at in places]
        for i, mine in windows.items():
            if self.edits[i]:
                taken = np.array(exact.get(i, ()), np.int64)
                for lo, hi in mine:
                    for a, b, e in self._inexact(i, text, lo, hi):
                        j = int(np.searchsorted(taken, a - self.sizes[i], side="right"))
                        if j == len(taken) or taken[j] >= b:
                            out.append((a, b, i, e))
        return sorted(out)

    def _inexact(self, i: int, text: str, lo: int, hi: int):
        """Matches inside a window, from word to word; all its words are whole."""
        if lo and text[lo - 1] != " ":
            lo = text.find(" ", lo, hi) + 1
            if not lo:
                return
        if hi < len(text) and text[hi] != " ":
            hi = text.rfind(" ", lo, hi)
            if hi < 0:
                return
        window, at = f" {text[lo:hi]} ", 0  # with a blank at either end: the library lets no inserted letter begin a string
        if not all(w in window for w in self.own[i]):
            return
        while m := self.first[i].search(window, at):
            fit = self.best[i].search(f" {m[0]} ")
            if fit and all(w in f" {fit[0]} " for w in self.own[i]):
                a = lo + m.start() - 2
                yield a + fit.start(), a + fit.end(), sum(fit.fuzzy_counts)
                at = m.end()
            else:  # a match that begins later may hold the words
                at = window.find(" ", m.start())


SPAN = "struct<label:string,notice:string,base:boolean,first_word:long,n_words:long,first_byte:long,end_byte:long," \
       "edits:long,similarity:double>"


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES, *, errors: float = ERRORS, most: int = MOST,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, spans (array of label, notice, base, first_word, n_words, first_byte and
    end_byte in the text's UTF-8, edits, similarity; by place), score."""
    notices = tuple(notices)
    kind = pa.struct([("label", pa.string()), ("notice", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()),
                      ("n_words", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64()),
                      ("edits", pa.int64()), ("similarity", pa.float64())])
    table = LOWER.copy()  # separators become blanks
    table[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32

    def rows(scanner: Scanner, raw: bytes) -> tuple[int, list[dict]]:
        text = raw.translate(bytes(table))
        words = text.split()
        joined = b" ".join(words).decode("latin-1")
        found = scanner.spans(joined)
        if not found:
            return len(words), []
        inside = np.frombuffer(text, np.uint8) != 32
        step = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        begins = np.concatenate([[0], np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32) + 1])
        out = []
        for a, b, i, edits in found:
            w, v = (int(x) for x in np.searchsorted(begins, [a, b - 1], side="right") - 1)
            out.append({"label": notices[i].label, "notice": notices[i].text, "base": notices[i].base and not edits,
                        "first_word": w, "n_words": v - w + 1, "first_byte": int(first[w]), "end_byte": int(end[v]),
                        "edits": edits, "similarity": 1 - edits / scanner.sizes[i]})
        return len(words), out

    def run(batches):
        scanner = Scanner(notices, errors, most)
        for batch in batches:
            for part in portions(batch, 1):
                data, offsets = bytes_of(part.column(1))
                got = [rows(scanner, data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _ in got], pa.int64()),
                     pa.array([s for _, s in got], pa.list_(kind)),
                     pa.array([max((s["similarity"] for s in found), default=0.0) for _, found in got], pa.float64())],
                    names=["doc_id", "n_words", "spans", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, spans array<{SPAN}>, score double")
