"""WARC archives, vector operators, components, the pipeline and the registered queries."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kohorta.llm import descent, multi_index, warc
from kohorta.llm.graph import components
from kohorta.llm.queries import ORACLES, QUERIES
from kohorta.llm.shared import keyed


# ---- WARC ------------------------------------------------------------------------------------------------------------
def test_warc_round_trip_and_revisits(spark):
    big, small = "<p>é" * 600, "<p>"
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/ü\r\nX: y", small), (4, "http://a/4", small), (5, "", None),
            (6, "http://a/6", "x" * 200_000), (7, "http://a/7", big + "!"), (None, "http://a/n", big), (2, "http://a/2", big)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, file int")
    index = warc.write(pages.repartition(3))
    got = warc.read(index).collect()
    assert len(got) == len(rows)
    want = sorted((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(),
                   "revisit" if h == big and p != 2 else "response", 2 if h == big and p != 2 else None) for p, _, h in rows
                  if p is not None)
    assert sorted(tuple(r)[:5] for r in got if r.page_id is not None) == want
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    some = warc.read(index.where("page_id in (6, 3)"), gap=0, span=1).collect()
    assert sorted(r.page_id for r in some) == [3, 6]


def test_warc_empty_table(spark):
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_says_when_a_record_is_not_the_indexed_one(spark):
    index = warc.write(spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string").coalesce(1))
    with pytest.raises(Exception, match="not the one in the index"):
        warc.read(index.withColumn("digest", F.lit("0"))).collect()


# ---- vectors ---------------------------------------------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, node int")


def clustered(n=600, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, 120):
        x[i] = x[i // 40 * 40] + rng.normal(size=d) * 0.08
    x[200:230] = x[200]
    return x.astype(np.float32)


BAD = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [1.0, 2.0]),
       (905, [float("inf")] + [1.0] * 15), (906, [])]


def test_multi_index_finds_the_nearest(spark):
    x = clustered()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD
    got = {}
    for r in multi_index.search(vectors(spark, rows).repartition(4), F.col("id") % 20 == 0, codes=8, block=64, chunk=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y, hit = x.astype(float), []
    assert set(got) == set(range(0, 600, 20))
    for q, rows_ in got.items():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21)) and q not in [r[1] for r in rows_]
        assert all(np.isclose(y[q] @ y[v], s, rtol=1e-12) for _, v, s in rows_)
        assert [(-s, v) for _, v, s in rows_] == sorted((-s, v) for _, v, s in rows_)
        s = y @ y[q]
        s[q] = -np.inf
        hit.append(len(set(np.argsort(-s, kind="stable")[:20]) & {r[1] for r in rows_}) / 20)
    assert np.mean(hit) >= 0.9


def test_multi_index_walk_is_best_first():
    rng = np.random.default_rng(1)
    index = multi_index.Index(rng.normal(size=(5, 3)), rng.normal(size=(7, 3)), np.ones((5, 7), int))
    q = rng.normal(size=6)
    score = ((index.left @ q[:3])[:, None] + (index.right @ q[3:])[None]).ravel()
    assert np.allclose(score[index.walk(q, 35)], np.sort(score)[::-1])
    assert len(index.walk(q, 4)) == 4


def test_multi_index_small_tables(spark):
    few = multi_index.search(vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])]), F.col("id") % 20 == 0).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in few) == [(1, 1, 1.0), (2, 2, 0.5)]
    assert multi_index.search(vectors(spark, []), F.lit(True)).count() == 0
    assert multi_index.search(vectors(spark, BAD[:4]), F.lit(True)).count() == 0


def test_multi_index_null_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (None, [9.0, 9.0]), (1, [2.0, 1.0]), (2, [0.0, 3.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in multi_index.search(vectors(spark, rows), F.col("id") % 20 == 0, k=2).collect())
    assert got == [(0, 1, 1, 2.0), (0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 2, 2, 0.0)]


def by_hand(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[s[i]]]) for i in range(len(x))])
        if (new == label).all():
            return s.sum(1), label
        label = new


def test_nn_descent_equals_brute_force(spark):
    x = clustered()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in
           descent.near_duplicates(vectors(spark, rows).repartition(4), keep=5, block=16).collect()}
    links, label = by_hand(x.astype(float))
    assert links.max() >= 29
    want = {i: (int(links[i]), int(label[i]), bool(label[i] == i)) for i in range(len(x))} | {i: (0, i, True) for i, _ in BAD}
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)


def test_nn_descent_small_tables(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.001]), (7, [0.0, 1.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in descent.near_duplicates(vectors(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (7, 0, 7, True)], key=str)
    assert descent.near_duplicates(vectors(spark, [])).count() == 0
    assert descent.near_duplicates(vectors(spark, BAD[:2])).count() == 2


# ---- components and keys ---------------------------------------------------------------------------------------------
def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    links += [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(90)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    import itertools

    label = {n: n for n in itertools.chain(*links) if n is not None}
    for _ in range(200):
        for a, b in links:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == {n: c for n, c in label.items() if n != 200}


def test_keyed_orders_repeated_ids(spark):
    df = spark.createDataFrame([(2, "b"), (1, "x"), (2, "a"), (None, "n"), (1, None)], "doc_id long, text string")
    rows = sorted((r["_row"], r.doc_id) for r in keyed(df, "doc_id", "text").collect())
    assert [r[1] for r in rows] == [None, 1, 1, 2, 2]


# ---- registered queries and the pipeline -----------------------------------------------------------------------------
def test_every_operator_has_a_query():
    import re

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_warc_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op1_warc"](spark, sf).collect())
    assert got == sorted(db.execute(ORACLES["op1_warc"]).fetchall())


@pytest.mark.parametrize("case", ["given", "empty"])
def test_pipeline_stages_keep_columns(spark, tmp_path, case):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit(1)).withColumn("_0", F.lit("z"))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    docs = docs.where("false") if case == "empty" else docs
    n = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / str(i)))
        done = spark.read.parquet(str(tmp_path / str(i)))
        if name != "packing":
            assert done.columns == docs.columns
            assert done.count() <= n
            assert done.where("n_chars <> length(text)").count() == 0
            n = done.count()
        docs = done
    assert (docs.count() > 0) == (case == "given")
