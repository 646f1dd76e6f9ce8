"""Text operators against brute force, exact round trips and held-out accuracy, and their defined cases."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kohorta.llm import bpe, langid, lines, packing, quality, simhash, suffix

SCHEMA = "doc_id long, text string, n string, score double, row string, t int"  # names that operators use inside
ODD = [None, "", " ", "\n\n", "a" * 350, "ab" * 150, "日本語 text 😀", "x y z", "'s 's't re 'll", "word " * 30000]


def frame(spark, texts, start=0, parts=3):
    return spark.createDataFrame([(start + i, t, "x", 0.5, "r", 1) for i, t in enumerate(texts)], SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdefgh é", k=400)) for _ in range(6)]
    out = []
    for _ in range(60):
        t = "".join(rng.choices("abcdefgh é\n", k=rng.choice([0, 30, 120, 300])))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 300)
            t += rng.choice(base)[a: a + rng.randint(50, 300)]
        out.append(t)
    return out + [out[5], out[7] * 3, "Annt " * 80, "Annt " * 25, ("q" * 60 + "r") * 5, "xyz" * 20 + "a" * 150]


# ---- byte-level BPE --------------------------------------------------------------------------------------------------
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark, texts):
    rng = random.Random(1)
    signs = ["'", "s", "t", "r", "e", "v", "l", "d", " ", "\n", "\t", "1", "é", "ß", "日", "😀", "!", " ", "　", "²"]
    given = texts + ODD + ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(500)]
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, given), P.path("byte_bpe_50k.tiktoken"), keep_ids=True)
           .collect()}
    enc = library()
    for i, t in enumerate(given):
        want = enc.encode_ordinary(t or "")
        assert got[i].ids == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_empty_table(spark):
    assert bpe.encode_documents(empty(spark), P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_bpe_dictionary_starts_anew_when_full():
    from kohorta.llm.pieces import Dictionary

    merges = bpe.load(P.path("byte_bpe_50k.tiktoken"))
    small, large = Dictionary(merges.encode, limit=3), Dictionary(merges.encode)
    for t in ("one two three four five", "six seven one", "two nine ten"):
        assert small.ids([t])[0].tolist() == large.ids([t])[0].tolist()


# ---- suffix deduplication --------------------------------------------------------------------------------------------
def removed_by_hand(rows, size=100):
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - size + 1):
            if raw[s: s + size] in seen:
                gone[s: s + size] = True
            seen.add(raw[s: s + size])
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())
                    if len(raw) else 0, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_suffix_equals_brute_force(spark, texts):
    given = texts + [t for t in ODD if len(t or "") < 2000]
    got = sorted(tuple(r) for r in suffix.dedup(frame(spark, given)).collect())
    assert got == removed_by_hand(list(enumerate(given)))


def test_suffix_shorter_strings(spark, texts):
    got = sorted(tuple(r) for r in suffix.dedup(frame(spark, texts[:30]), min_bytes=20).collect())
    assert got == removed_by_hand(list(enumerate(texts[:30])), 20)


def test_suffix_repeated_and_null_ids(spark):
    rows = [(1, "b" * 60 + "c" * 60), (1, "b" * 60 + "c" * 60), (None, "c" * 50 + "d" * 80), (2, "c" * 50 + "d" * 80), (1, None)]
    got = sorted((tuple(r) for r in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha1((r[1] or "").encode()).hexdigest()))
    assert [g[1:] for g in got] == [w[1:] for w in sorted(_unsorted(order), key=str)]


def _unsorted(rows):
    marked = removed_by_hand([(k, t) for k, (_, t) in enumerate(rows)])
    return [(rows[m[0]][0], *m[1:]) for m in marked]


def test_suffix_many_rows_of_one_name(spark):
    """A passage shorter than a window's anchor region in many different surroundings, over many partitions."""
    rng = random.Random(5)
    line = "".join(rng.choices("abcdefg", k=130))
    given = ["".join(rng.choices("hijklm", k=60)) + line + "".join(rng.choices("hijklm", k=60)) for _ in range(300)]
    got = sorted(tuple(r) for r in suffix.dedup(frame(spark, given, parts=17)).collect())
    assert got == removed_by_hand(list(enumerate(given)))


def test_suffix_empty_table(spark):
    assert suffix.dedup(empty(spark)).count() == 0


# ---- SimHash ---------------------------------------------------------------------------------------------------------
def fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i: i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def smallest_reachable(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_simhash_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    given = []
    for _ in range(40):
        t = rng.choices(words, k=rng.choice([1, 2, 3, 40, 400, 900]))
        given += [" ".join(t), "\t".join(t).upper(), " ".join(t[:-1] + ["end"])]
    given += ODD
    fps = [fingerprint(t) for t in given]
    linked = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = smallest_reachable(len(fps), linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, given)).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(fps))}


def test_simhash_links_of_close_fingerprints(spark):
    """Chains and dense balls of fingerprints: components equal those of all pairs."""
    rng = random.Random(4)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    from kohorta.llm.graph import components

    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
           .collect()}
    linked = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = smallest_reachable(len(fps), linked)
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, set()).add(signed[i])
    for g in groups.values():
        assert {got.get(x, x) for x in g} == {min(g)}


def test_simhash_repeated_null_and_empty(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (1, None), (2, ""), (None, "a b c d")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
                  .collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (1, 1), (2, 1), (None, 3)], key=str)
    assert simhash.near_duplicates(empty(spark)).count() == 0


# ---- packing ---------------------------------------------------------------------------------------------------------
def check_packing(rows, given, window=1024):
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: model.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(given)}
    at = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        piece = ids[r.doc_id][r.start: r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(x) for i, x in ids.items()}
    seats, padded = {}, 0
    for r in rows:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seats.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= window
        padded += 0 if end & (end - 1) == 0 else window - end
    return padded, sum(r.length for r in rows)


def test_packing_places_every_id_once(spark, texts):
    rng = random.Random(6)
    given = texts + ODD + ["".join(rng.choices("abc de", k=rng.randint(1, 6000))) for _ in range(300)]
    rows = packing.pack(frame(spark, given), P.path("byte_bpe_50k.json")).collect()
    padded, total = check_packing(rows, given)
    assert padded < 0.02 * total


def test_packing_reads_special_strings_as_tokens(spark):
    given = ["a<|endoftext|>b", "<|endoftext|>", "plain text", "x <|endoftext|> " * 900, None]
    check_packing(packing.pack(frame(spark, given), P.path("byte_bpe_50k.json")).collect(), given)


def test_packing_repeated_rows_and_empty_table(spark):
    rows = packing.pack(spark.createDataFrame([(1, "same text")] * 50, "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50
    assert packing.pack(empty(spark), P.path("byte_bpe_50k.json")).count() == 0


def test_plan_covers_the_histogram():
    rng = random.Random(8)
    for counts in ({1: 5}, {1024: 3, 700: 10, 324: 8, 1: 40}, {rng.randint(1, 1024): rng.randint(1, 9999) for _ in range(300)}):
        used = {}
        for pattern, times in packing.plan(counts, 1024):
            assert sum(pattern) <= 1024 and times > 0
            for k in pattern:
                used[k] = used.get(k, 0) + times
        assert used == counts


# ---- line deduplication ----------------------------------------------------------------------------------------------
def sim_of(line):
    words = list(dict.fromkeys(line.split()))
    long = [w for w in words if len(w) >= 5]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (long if len(long) >= 5 else words)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_line_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"word{i}" if i % 7 else f"w{i}" for i in range(9000)]
    given = [" ".join(rng.choices(words, k=k)) for k in (1, 2, 5, 60, 126, 127, 128, 254, 255, 1000, 5000) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(given)), "row long, text string")
    got = {r.row: r.sim & (2**64 - 1) for r in lines.occurrences(df).collect()}
    assert got == {i: sim_of(t) for i, t in enumerate(given)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lines_by_hand(given):
    """The documented rule: leaders of two-block buckets, verified pairs, first occurrence of each group."""
    import re

    norm = lambda x: re.sub(r"[^a-z0-9]+", " ", x.lower()).strip()
    at, count = {}, {}
    for d, t in enumerate(given):
        for p, raw in enumerate((t or "").split("\n")):
            if n := norm(raw):
                at.setdefault(n, (d, p))
                count[n] = count.get(n, 0) + 1
    sim = {n: sim_of(n) for n in at}
    total, top, found = {}, {}, set()
    for n in at:
        total[sim[n]] = total.get(sim[n], 0) + count[n]
        top.setdefault(sim[n], []).append(n)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for x, same in top.items():
        same.sort(key=lambda n: -count[n])
        assert len(same) < 3 or count[same[0]] > count[same[1]]  # else the least hash leads
        found |= {(same[0], n) for n in same[1:]}
    order = {x: (-int(np.log2(total[x])), signed(x)) for x in top}
    edges = (0, 13, 26, 39, 52, 64)
    block = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    for i in range(5):
        for j in range(i + 1, 5):
            buckets = {}
            for x in top:
                buckets.setdefault(x & (block[i] | block[j]), []).append(x)
            for b in buckets.values():
                turn = 0
                while len(b) > 1:
                    turn += 1
                    if turn >= 3 and len(b) <= 128:
                        found |= {(top[x][0], top[y][0]) for x in b for y in b if x < y and (x ^ y).bit_count() <= 3}
                        break
                    lead = min(b, key=order.get)
                    near = [x for x in b if x != lead and (x ^ lead).bit_count() <= 3]
                    found |= {(top[lead][0], top[x][0]) for x in near}
                    b = [x for x in b if x != lead and x not in near]
    names = sorted(at)
    place = {n: i for i, n in enumerate(names)}
    ok = [(place[a], place[b]) for a, b in found if distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    label = smallest_reachable(len(names), ok)
    keep = {}
    for n in names:
        k = label[place[n]]
        keep[k] = min(keep.get(k, at[n]), at[n])
    out = {}
    for d, t in enumerate(given):
        parts = (t or "").split("\n")
        left = [x for p, x in enumerate(parts) if not (n := norm(x)) or keep[label[place[n]]] == (d, p)]
        out[d] = ("\n".join(left) if t is not None else None, len(parts), len(parts) - len(left))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    stock = [rng.choices(words, k=rng.choice([1, 3, 20, 40, 80])) for _ in range(25)]
    given = []
    for _ in range(80):
        doc = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(stock)) if rng.random() < 0.7 else rng.choices(words, k=15)
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = rng.choice(words)
            doc.append((", " if rng.random() < 0.3 else " ").join(line) + rng.choice(["", ".", " "]))
        given.append("\n".join(doc + [""] * rng.randint(0, 2)))
    given += [None, "", "***\n***", given[3].upper()]
    got = {r.doc_id: (r.text, r._lines, r._gone) for r in lines.dedup(frame(spark, given)).collect()}
    want = lines_by_hand(given)
    assert {i: g for i, g in got.items() if g != want[i]} == {}
    assert sum(w[2] for w in want.values()) > 50


def test_lines_plan_has_no_python(spark):
    plan = lines.dedup(frame(spark, ["one two\none two", "x"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_lines_empty_and_long(spark):
    assert lines.dedup(empty(spark)).count() == 0
    clash = spark.createDataFrame([(1, "one two\none two", "k", 5, "o")], "doc_id long, text string, __all string, __row int, all__ string")
    assert tuple(lines.dedup(clash).select("text", "__all", "__row", "all__", "_gone").first()) == ("one two", "k", 5, "o", 1)
    long = "\n".join(["a line of many words " * 2000, "a line of many words " * 2000, "other"])
    r = lines.dedup(frame(spark, [long])).first()
    assert (r._lines, r._gone) == (3, 1)


# ---- quality classifier ----------------------------------------------------------------------------------------------
def test_quality_held_out(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels, learn=quality.by_id("_id", 5) != 0)
    got = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(quality.by_id("doc_id", 5) == 0) \
        .select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_quality_defined_cases(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(8)] + [(2, 0)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, one)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.accepted(docs, model).columns == docs.columns and quality.accepted(docs, model).count() == len(ODD)
    assert quality.score(empty(spark), model).count() == 0


def test_isotonic_is_the_least_squares_monotone_fit():
    x, y, w = np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8]), np.array([1, 2, 1, 1, 3, 1.0])
    at, level = quality.isotonic(x, y, w)
    assert (np.diff(level) > 0).all()
    assert np.allclose(level, [0.1, 1.5 / 4, 3.5 / 4])


# ---- language identification -----------------------------------------------------------------------------------------
def test_viterbi_equals_dynamic_programming():
    rng = np.random.default_rng(0)
    for n, k in ((1, 3), (7, 2), (50, 4), (333, 3)):
        s, begins = rng.normal(size=(n, k)) * 3, rng.random(n) < 0.1
        begins[0] = True
        best = np.zeros(k)
        for t in range(n):
            best = np.maximum(best, best.max() - (0 if begins[t] else 2.5)) + s[t]
        path = langid.viterbi(s, begins, 2.5)
        changes = sum(path[i] != path[i - 1] and not begins[i] for i in range(1, n))
        assert np.isclose(s[np.arange(n), path].sum() - 2.5 * changes, best.max())


def test_language_held_out_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = quality.by_id("doc_id", 4) == 2
    model = langid.fit(docs.where(~held))
    rows = langid.identify(docs.where(held).select("doc_id", "lang", "text"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    de, en = (docs.where(f"lang = '{g}' and n_chars > 400").orderBy("doc_id").first().text[:300] for g in ("de", "en"))
    mixed = langid.identify(frame(spark, [de + " " + en]), model, spans=True).first()
    assert mixed.spans[0].lang == "de" and mixed.spans[-1].lang == "en"
    assert abs(mixed.spans[-1].start - len(de)) < 60 and mixed.spans[-1].end <= len(de) + 1 + len(en)


def test_language_scripts_narrow_candidates(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("hello the world and", "en"), ("привет мир и слово", "ru"), ("καλημέρα κόσμε", "el")] * 5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame(spark, ["zzz qqq", "щщщ", "ωωω ψ", None, "", "123 !?", "日本"]), model).collect()}
    assert [got[i][0] for i in range(3)] == ["en", "ru", "el"] and [got[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3
    assert got[6][0] in ("en", "ru", "el")


def test_language_defined_cases(spark):
    model = langid.fit(spark.createDataFrame([(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(frame(spark, ODD), model).collect()} == {"und"}
    assert langid.identify(empty(spark), model, spans=True).count() == 0


def test_dictionary_keeps_what_comes_again():
    """Frequent pieces aren't encoded anew each time rare ones fill the dictionary; ids stay right."""
    from kohorta.llm.pieces import Dictionary, classes

    asked = []

    def encode(new):
        asked.extend(new)
        return [list(p) for p in new]

    kept = Dictionary(encode, limit=50)
    for i in range(20):
        texts = ["often here", " ".join(f"w{chr(97 + i)}{'x' * j}" for j in range(30))]
        ids, counts = kept.ids(texts)
        assert bytes(ids.astype(np.uint8)).decode() == "".join(texts) and counts.tolist() == [len(t) for t in texts]
        assert len(kept.known) <= 50 + 40
    assert asked.count(b"often") == 1 and asked.count(b" here") == 1
    assert classes()[[0x41, 0x2A6D0, 0x323AF, 0xE0100, 0xF0000, 0x10FFFD]].tolist() == [1, 1, 1, 3, 3, 3]
