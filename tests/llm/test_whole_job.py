"""Operators against all pairs by similarity, not by the operators' own way of finding candidates."""

import random

import numpy as np

import xxhash

import corpus_pipeline
from kohorta.llm import descent, graph, lines, resemblance


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def labels(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def firsts(given):
    """The lines that start a group of lines linked by edit similarity >= 0.8, of all pairs."""
    linked = [(a, b) for a in range(len(given)) for b in range(a)
              if abs(len(given[a]) - len(given[b])) <= (m := int(0.2 * max(len(given[a]), len(given[b])) + 1e-9))
              and distance(given[a], given[b]) <= m]
    return [i for i, x in enumerate(labels(len(given), linked)) if x == i]


def words(rng, n=3000):
    return ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 10))) for _ in range(n)]


def kept(spark, given, **how):
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in lines.dedup(df, **how).where("_gone = 0").collect())


def test_lines_with_one_changed_word_are_found(spark):
    """Pairs of 8 to 60 words that differ in one word, few of them within 3 bits."""
    rng = random.Random(1)
    stock, given = words(rng), []
    for n in (8, 9, 10, 12, 15, 20, 30, 60) * 8:
        line = rng.choices(stock, k=n)
        given.append(" ".join(line))
        line[rng.randrange(n)] = rng.choice(stock)
        given.append(" ".join(line))
    assert kept(spark, given, every=True) == firsts(given)


def test_lines_of_long_words_are_found(spark):
    """One long word of 12 to 30 words changed, half of them long: weighs twice where long words alone are hashed."""
    rng = random.Random(2)
    stock, given = words(rng), []
    for n in (12, 20, 30) * 10:
        line = [rng.choice([w for w in stock[:600] if (len(w) >= 5) == (i % 2 == 0)]) for i in range(n)]
        given.append(" ".join(line))
        line[rng.randrange(n // 2) * 2] = rng.choice([w for w in stock if len(w) >= 5])
        given.append(" ".join(line))
    assert kept(spark, given, every=True) == firsts(given)


def test_lines_unlike_the_leader_meet_each_other(spark):
    """Lines of the same eight long words; the most frequent has other short ones, so only the rest are alike."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=6)) for _ in range(8))
    tails = [" ".join(rng.choices(["a1", "b2", "c3", "d4", "e5", "f6", "g7"], k=30)) for _ in range(4)]
    given = [f"{long} {tails[0]}"] * 3 + [f"{long} {t} {x}" for t in tails[1:] for x in ("u1", "v2", "w3")]
    assert kept(spark, given, every=True) == firsts(given)


def jaccard(a, b, width=5):
    a, b = ({tuple(w[i: i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_resemblance_equals_all_pairs(spark):
    """Copies of 60 to 200 words with some words changed: similarities around 0.8 and far more than 2 bits apart."""
    rng = random.Random(4)
    stock, given = words(rng), []
    for n in (60, 120, 200) * 10:
        doc = rng.choices(stock, k=n)
        given.append(" ".join(doc))
        for changes in rng.sample(range(1, 8), 3):
            copy = list(doc)
            for _ in range(changes):
                copy[rng.randrange(n)] = rng.choice(stock)
            given.append(" ".join(copy))
    given += [given[0], "", "one two", "one two"]
    linked = [(a, b) for a in range(len(given)) for b in range(a) if jaccard(given[a], given[b]) >= 0.8]
    want = [i for i, x in enumerate(labels(len(given), linked)) if x == i]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in resemblance.groups(df, id_col="doc_id").where("doc_id = component_id").collect()) == want
    assert len(want) < len(given) - 25


def fingerprint(text):
    w = text.split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i: i + 3]), 42) for i in range(max(bool(w), len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_near_dedup_stage_equals_all_fingerprint_pairs(spark):
    """The pipeline's stage keeps one document of each group within 2 bits, and every other document, with its columns."""
    rng = random.Random(6)
    stock, given = words(rng), []
    for _ in range(12):
        doc = rng.choices(stock, k=400)
        given.append(" ".join(doc))
        for changes in (1, 1, 2, 40):
            copy = list(doc)
            for _ in range(changes):
                copy[rng.randrange(400)] = rng.choice(stock)
            given.append(" ".join(copy))
    given += [given[0], given[3], "", "  ", "one two", "one two", None]
    fps = [fingerprint(t or "") for t in given]
    linked = [(a, b) for a in range(len(given)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = [i for i, x in enumerate(labels(len(given), linked)) if x == i]
    rows = [(i, t, f"kept {i}") for i, t in enumerate(given)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row__ string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == [rows[i] for i in want]
    assert 12 < len(want) < len(given) - 12


def test_saturated_groups_are_joined(spark):
    """Two groups of 150 vectors, closer inside (above 0.99) than across (0.90 to 0.92): lists hold 80 at most."""
    rng = np.random.default_rng(1)
    a = np.zeros(16)
    a[0] = 1
    b = np.zeros(16)
    b[0], b[1] = 0.91, np.sqrt(1 - 0.91 ** 2)
    x = np.concatenate([c + rng.normal(size=(150, 16)) * 0.01 for c in (a, b)]).astype(np.float32)
    u = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    assert hit[:150, 150:].sum() > 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.component_id, r.n_links) for r in descent.near_duplicates(df, audit=1, rounds=2).collect()}
    assert got == {i: (0, int(hit[i].sum())) for i in range(300)}


def test_unlikely_pairs_are_dropped_in_their_bucket(spark, monkeypatch):
    """Lines that share six words and few min-hashes: only pairs that go on to the edit test are dealt out and stored."""
    rng = random.Random(7)
    stock = words(rng)
    head = " ".join(stock[:6])
    given = [f"{head} {' '.join(rng.choices(stock, k=14))}" for _ in range(80)]
    dealt, tested, put, alike = [], [], graph.stored, lines.alike

    def noted(df, name):
        out = put(df, name)
        if name in ("pairs", "rest"):
            dealt.append(out.count())
        return out

    def seen(docs, places, near, similarity):
        tested.append(near.count())
        return alike(docs, places, near, similarity)

    monkeypatch.setattr(graph, "stored", noted)
    monkeypatch.setattr(lines, "alike", seen)
    assert kept(spark, given, every=True) == firsts(given)
    assert dealt == tested and len(dealt) == 2
