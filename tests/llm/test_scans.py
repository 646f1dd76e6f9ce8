"""License notices, collocations and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kohorta.llm import collocations as C
from kohorta.llm import licenses as L
from kohorta.llm import periodic as P
from kohorta.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", ".", "a", "A" * 3000, "été Été", "a\tb  c\r\nd", "\x00x\x01 y", "the the the the the the the the"]


def saved(spark, tmp_path, rows):
    """A folder with documents.parquet of (doc_id, text, lang)."""
    spark.createDataFrame([(i, t, g, "s", None) for i, t, g in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# ---- license notices ----------------------------------------------------------------------------

def distances(notice, text, most):
    """Least edit distance of the notice to each stretch of whole words."""
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == " "]
    ends, out = {i for i, c in enumerate(text) if c == " "} | {len(text)}, {}
    for a in starts:
        row = list(range(len(notice) + 1))
        for j, c in enumerate(text[a: a + len(notice) + most], 1):
            new = [j]
            for i, q in enumerate(notice, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (q != c)))
            row = new
            if a + j in ends:
                out[a, a + j] = row[-1]
    return out


def mutated(text, n, rnd):
    t = list(text)
    for _ in range(n):
        p = rnd.randrange(len(t))
        t[p: p + rnd.choice([0, 1, 1])] = rnd.choice(["", "e", "t", " "])
    return " ".join("".join(t).split())


SHORT = (L.NOTICES[0], L.NOTICES[1], L.NOTICES[2], L.Notice("mpl-2", "mozilla public license version 2", ("mozilla", "2")))


@pytest.mark.parametrize("seed", range(12))
def test_spans_are_the_places_within_the_bound(seed):
    rnd, scanner = random.Random(seed), L.Scanner(SHORT, L.ERRORS, L.MOST)
    parts = []
    for _ in range(rnd.randint(1, 6)):
        t = rnd.choice(SHORT).text
        parts.append(rnd.choice([t, mutated(t, 1, rnd), mutated(t, 2, rnd), mutated(t, 5, rnd), "the license of 2", "cc by nd", "under the"]))
    text = " ".join(parts)
    got = scanner.spans(text)
    for i, notice in enumerate(SHORT):
        k = scanner.edits[i]
        near = {s: e for s, e in distances(notice.text, text, k).items() if e <= k and (
            not e or all(f" {w} " in f" {text[s[0]:s[1]]} " for w in notice.own))}
        mine = [g for g in got if g[2] == i]
        assert all(near.get((a, b)) == e for a, b, _, e in mine)
        assert {(a, b) for a, b, _, e in mine if not e} == {s for s, e in near.items() if not e}
        # a place whose best fit holds the words is reported, or one that overlaps it
        best = {s: e for s, e in near.items() if not any(o != s and o[0] < s[1] and s[0] < o[1] and f < e for o, f in distances(notice.text, text, k).items())}
        assert all(any(a < s[1] and s[0] < b for a, b, _, _ in mine) for s in best)


def test_scan_of_odd_rows(spark):
    text = "Released UNDER  the MIT-License; under th mit licence. GNU General Public License, version 3"
    rows = [(1, text), (1, text), (None, "cc by-nc cc BY/NC"), (3, None), (4, ""), (5, "limit licensed"), (6, "word " * 40_000 + "under the mit license")]
    df = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, spans string, n_words int, score double")
    got = sorted(L.scan(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in got] == [1, 1, 3, 4, 5, 6, None]
    first = got[0]["spans"]
    assert [(s["label"], s["edits"], s["base"]) for s in first] == [("mit", 0, True), ("mit", 2, False), ("gpl-3", 0, False)]
    raw = text.encode()
    assert [raw[s["first_byte"]: s["end_byte"]].decode() for s in first] == [
        "UNDER  the MIT-License", "under th mit licence", "GNU General Public License, version 3"]
    assert got[0]["spans"] == got[1]["spans"] and got[2]["spans"] == [] and got[3]["score"] == 0.0 and got[4]["spans"] == []
    assert got[5]["n_words"] == 40_004 and got[5]["spans"][0]["first_word"] == 40_000
    assert [s["first_word"] for s in got[6]["spans"]] == [0, 3] and got[6]["score"] == 1.0
    assert L.scan(df.limit(0)).count() == 0


def test_op11_base_places(spark, tmp_path):
    rnd = random.Random(4)
    pieces = ["Under the MIT License.", "apache-license,VERSION 2", "CC BY-NC", "cc by ncé", "under the mit licenses", "GNU General Public License version 2",
              "licence", "é", "under", "mozilla public licence version 2", "\n", "x9"]
    rows = [(i, " ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))), "en") for i in range(120)] + [(500 + i, t, None) for i, t in enumerate(ODD)]
    got = {r["doc_id"]: r for r in QUERIES["op11_licenses"](spark, saved(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(s, n.label) for n in L.NOTICES if n.base for s in range(len(words)) if words[s: s + len(n.text.split())] == n.text.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        labels = [x for x in r["labels"].split(",") if x]
        assert labels == sorted(set(labels)) and set(r["base_labels"].split(",")) - {""} <= set(labels)
        assert r["score"] == 1.0 if places else 0 <= r["score"] <= 1
    assert "gpl-2" in got[next(i for i, t, _ in rows if "GNU" in t)]["labels"]


# ---- collocations -------------------------------------------------------------------------------

def collocations_by_hand(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        g = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[g, tuple(w[i: i + k])] += 1
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    gone = set()
    for (g, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                q = (g, p[i: i + k])
                if q in cand and 100 * a >= 80 * cand[q]:
                    gone.add(q)
    out = {}
    for (g, p), a in cand.items():
        if (g, p) not in gone:
            cuts = [(2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p))]
            s, _, left, right = min(cuts)
            out.setdefault(g, []).append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((g, i + 1, x[2].decode(), -x[1], x[3], x[4], n[g], -x[0]) for g, rs in out.items() for i, x in enumerate(sorted(rs)[:top]))


def prose(rnd, n, words="the of a new york city state le la été x y z"):
    return "".join(rnd.choice(words.split()) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "!"]) for _ in range(n))


def test_op12_against_counting(spark, tmp_path):
    rnd = random.Random(2)
    copy = "New York City is the state of New York; " + prose(rnd, 30)
    rows = [(i, prose(rnd, rnd.randint(0, 900)), rnd.choice(["en", "fr", None])) for i in range(60)]
    rows += [(100 + i, copy, "en") for i in range(60)] + [(300 + i, t, "de") for i, t in enumerate(ODD)]
    rows += [(400, "again and again " * 3000, "de"), (401, "u" * 50_000, "de"), (100, copy, "en")]
    got = sorted(tuple(r) for r in QUERIES["op12_collocations"](spark, saved(spark, tmp_path, rows)).collect())
    assert got == collocations_by_hand(rows) and len({r[0] for r in got}) == 4


def test_collocations_of_odd_tables(spark):
    df = spark.createDataFrame([("a b", "x", 1, "p")] * 40 + [(None, None, None, None)], "text string, lang string, rank int, phrase string")
    got = C.collocations(df, top=1).collect()
    assert [tuple(r) for r in got] == [("x", 1, "a b", 40, 40, 40, 80, 1_000_000)]
    assert C.collocations(df.limit(0)).count() == 0 and C.collocations(df, least=41).count() == 0


def test_chunks_share_triggers_and_lose_no_phrase(spark):
    """Phrases begin before the shared words of one chunk only; copies of a passage are parsed alike."""
    rnd = random.Random(7)
    passage = prose(rnd, 300)
    rows = [(prose(rnd, 50) + "\n" + passage, "en"), (prose(rnd, 80) + "\n" + passage, "en"), ("", "en")]
    chunks = C.dictionary(C.parse(spark.createDataFrame(rows, "text string, lang string"))).collect()
    counts = Counter()
    for r in chunks:
        words, at = [], 0
        for m in re.finditer(r"[^ \n]+", r["chunk"]):
            words.append((m[0], r["chunk"][m.end(): m.end() + 1] == "\n"))
        own = len(words) if r["tail"] else len(words) - C.OVERLAP
        for i in range(own):
            counts[words[i][0]] += r["times"]
        assert r["tail"] or len(words) > C.OVERLAP
    whole = Counter(w for t, _ in rows for piece in re.split(r"[.,;:!?\x0A-\x0D]", t) for w in piece.split())
    assert counts == whole and max(r["times"] for r in chunks) >= 2


def test_bitmap_keeps_every_phrase():
    counter = C._Counter(np.zeros(C.BITS // 64, np.uint64))
    h = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    s = counter.slots(h[:1000])
    np.bitwise_or.at(counter.bits, s >> 6, np.uint64(1) << (s & 63).astype(np.uint64))
    known = counter._known(h)
    assert known[:1000].all() and known[1000:].mean() < 0.01


# ---- periodic runs ------------------------------------------------------------------------------

def runs_by_hand(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                best.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in best.items())


@pytest.mark.parametrize("seed", range(30))
def test_repetitions(seed):
    rnd, ids, owner, expected = random.Random(seed), [], [], []
    for d in range(rnd.randint(1, 4)):
        w = []
        while len(w) < rnd.choice([0, 1, 5, 30, 120]):
            u = [rnd.randint(0, rnd.choice([1, 2, 9])) for _ in range(rnd.randint(1, 9))]
            w += u * rnd.choice([1, 1, 2, 4, 5, 9]) + u[: rnd.randint(0, len(u))]
            w = w * rnd.randint(1, 4) if rnd.random() < 0.3 else w
        expected += [(s + len(ids), n, q) for s, n, q in runs_by_hand(w)]
        ids, owner = ids + w, owner + [d] * len(w)
    got = P.repetitions(np.array(ids, np.int64), np.array(owner, np.int64))
    assert [tuple(map(int, r)) for r in got] == sorted(expected, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_op13_against_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, prose(rnd, rnd.randint(0, 90), "a b c d e") + rnd.choice(["", " x y z" * rnd.randint(1, 9)]), "en") for i in range(250)]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)]
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic"](spark, saved(spark, tmp_path, rows)).collect()}
    changed = 0
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        w = planted(i, words)
        changed += w != words
        runs, r = sorted(runs_by_hand(w), key=lambda x: (x[0], x[2])), got[i]
        kept = [x for j, x in enumerate(w) if not any(s + q <= j < s + n for s, n, q in runs)]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert changed > 10


def test_collapse_of_odd_rows(spark):
    rows = [(None, "a b " * 30_000, 1), (None, None, 2), (7, "  ", 3), (7, "  ", 4), (8, "x " * 5 + "y", 5), (9, "été " * 6, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(P.collapse(df, carry=("runs",)).collect(), key=lambda r: r["_0"])
    assert [r["_0"] for r in got] == [1, 2, 3, 4, 5, 6] and [r["n_words"] for r in got] == [60_000, 0, 0, 0, 6, 6]
    assert [tuple(x) for x in got[0]["runs"]] == [(0, 60_000, 2)] and got[0]["collapsed"] == "a b"
    assert got[1]["collapsed"] == "" and got[1]["runs"] == [] and got[4]["runs"] == [] and got[4]["collapsed"] == "x x x x x y"
    assert got[5]["collapsed"] == "été"
    assert P.collapse(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.collapse(df, times=3)
