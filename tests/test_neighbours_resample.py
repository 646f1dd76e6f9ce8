import numpy as np
import pytest
from pyspark.sql import functions as F

from kohorta.operators import neighbours as nb
from kohorta.operators import resample as rs
from kohorta.operators import evaluate, split


@pytest.fixture(scope="module")
def points(spark):
    """Clusters, a crowd of equal vectors (a third of the rows) and a crowded group."""
    rng = np.random.default_rng(5)
    v = np.vstack([rng.normal(loc=c, size=(60, 3)) for c in (0, 4, 9)] + [np.tile([4.0, 4.0, 4.0], (90, 1))])
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 40}", int(i % 5 == 0), [float(x) for x in r]) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "Record bigint, grp string, label int, v array<double>").repartition(4), v, rows


def brute(v, rows, k, p, skip):
    out = {}
    for i, q in enumerate(v):
        d = np.round((np.abs(v - q) ** p).sum(axis=1) ** (1 / p), 9)
        order = [(d[j], j) for j in range(len(v)) if not skip(i, j)]
        out[i] = [j for _, j in sorted(order)[:k]]
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 16, "max_pivots": 9},
                                     {"broadcast_bytes": 0, "block_rows": 1000, "max_pivots": 1}])
@pytest.mark.parametrize("metric,p,exclude", [("euclidean", 2, "Record"), ("manhattan", 1, "grp"),
                                              ("euclidean", 2, "grp"), ("minkowski", 3, None)])
def test_knn_exact(points, options, metric, p, exclude):
    df, v, rows = points
    skip = {"Record": lambda i, j: i == j, "grp": lambda i, j: rows[i][1] == rows[j][1], None: lambda i, j: False}[exclude]
    got = {}
    for r in nb.knn_join(df, df, 4, metric=metric, p=float(p), exclude=exclude, **options).collect():
        got.setdefault(r["Record"], {})[r["neighbour_rank"]] = r["neighbour"]
    want = brute(v, rows, 4, p, skip)
    assert {i: [g[r] for r in sorted(g)] for i, g in got.items()} == want


@pytest.mark.parametrize("p", [1.0, 2.0])
@pytest.mark.parametrize("spread,shift", [(1.0, 0.0), (1e-6, 3.0), (50.0, -1e9)])
def test_knn_later_rows_are_compared_coarsely(monkeypatch, p, spread, shift):
    """Every pair is compared in full only until a query has k rows; the answer is that of all pairs."""
    rng = np.random.default_rng(11)
    t = rng.normal(size=(9000, 12)) * spread + shift
    t[4000:4100] = t[100:200]
    q, ids, full = t[:300], np.arange(9000), []
    whole = nb._within
    monkeypatch.setattr(nb, "_within", lambda a, b, *rest: full.append(len(a) * len(b)) or whole(a, b, *rest))
    r, c, d = nb._nearest(q, t, 5, p, ids[:300], ids)
    assert sum(full) < 0.5 * len(q) * len(t)
    for i in range(0, 300, 7):
        gap = np.abs(t - q[i])
        far = np.round(gap.sum(axis=1) if p == 1.0 else np.sqrt((gap * gap).sum(axis=1)), nb.DIGITS)
        want = [j for _, j in sorted((x, j) for j, x in enumerate(far) if j != i)[:5]]
        assert c[r == i].tolist() == want and d[r == i].tolist() == far[want].tolist()


def test_knn_coarse_pairs_lose_none():
    rng = np.random.default_rng(12)
    t, q = rng.normal(size=(3000, 20)), rng.normal(size=(200, 20))
    for p in (1.0, 2.0):
        far = np.array([nb._exact(np.broadcast_to(x, t.shape), t, p) for x in q])
        radius = np.sort(far, axis=1)[:, 30]
        coarse = nb._Coarse(q, t, p)
        r, c = coarse.pairs(*coarse.queries(q), radius, 1000, 3000)
        named = set(zip(r.tolist(), (c + 1000).tolist()))
        near = {(i, j) for i, j in zip(*np.nonzero(far <= radius[:, None])) if j >= 1000}
        assert near <= named and len(named) < 1.5 * len(near)


def test_knn_far_queries(spark, points):
    """Queries that live in cells without training rows still find their neighbours."""
    df, v, _ = points
    q = spark.createDataFrame([(1000, [100.0, 0.0, 0.0]), (1001, [-50.0, 2.0, 1.0])], "Record bigint, v array<double>")
    got = nb.knn_join(q, df, 3, broadcast_bytes=0, block_rows=20).collect()
    for qid, x in ((1000, [100, 0, 0]), (1001, [-50, 2, 1])):
        d = np.round(np.linalg.norm(v - np.array(x), axis=1), 9)
        want = [j for _, j in sorted((d[j], j) for j in range(len(v)))[:3]]
        assert [r["neighbour"] for r in sorted(got, key=lambda r: r["neighbour_rank"]) if r["Record"] == qid] == want


def test_unknown_metric(points):
    with pytest.raises(ValueError):
        nb.knn_join(points[0], points[0], 2, metric="cosine")


@pytest.fixture(scope="module")
def imbalanced(spark):
    rng = np.random.default_rng(8)
    rows = [(f"r{i}", "Pathological" if i < 12 else "Control", float(rng.normal(i < 12)), float(rng.normal()))
            for i in range(40)]
    return spark.createDataFrame(rows, "Record string, Diagnosed string, a double, b double")


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 6}])
def test_smote_invariants(imbalanced, options):
    out = rs.resample(imbalanced, k=3, **options).toPandas()
    assert out["Diagnosed"].value_counts().to_dict() == {"Control": 28, "Pathological": 28}
    made = out[out.Is_SMOTE]
    assert len(made) == 16 and (made.Record == "SMOTE").all() and (made.Diagnosed == "Pathological").all()
    base = imbalanced.filter("Diagnosed = 'Pathological'").toPandas()[["a", "b"]].to_numpy()
    for x in made[["a", "b"]].to_numpy():
        def on_segment(p, q):
            return abs(np.linalg.norm(x - p) + np.linalg.norm(x - q) - np.linalg.norm(p - q)) < 1e-9
        assert any(on_segment(p, q) for p in base for q in base)
    again = rs.resample(imbalanced.repartition(7), k=3, **options).toPandas()
    key = ["Record", "a", "b"]
    np.testing.assert_allclose(again.sort_values(key)[["a", "b"]], out.sort_values(key)[["a", "b"]])


@pytest.mark.parametrize("method", rs.METHODS)
def test_methods(imbalanced, method):
    out = rs.resample(imbalanced, method, 3, keep_row_id=True).toPandas()
    assert out["row_id"].is_unique and {"Is_SMOTE", "Diagnosed", "a", "b"} <= set(out.columns)
    if method in ("smote", "borderline_smote"):
        assert (~out.Is_SMOTE).sum() == 40


def test_resample_switches(imbalanced):
    assert rs.resample(imbalanced, enabled=False) is imbalanced
    with pytest.raises(ValueError):
        rs.resample(imbalanced, "other")
    with pytest.raises(ValueError):
        rs.resample(imbalanced, k=12)
    report = rs.resampling_analysis(imbalanced, rs.resample(imbalanced, k=3))
    assert report["balance"].first()["ratio_after"] == 1.0 and report["ks_tests"].count() == 2


def test_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("Record"), F.when(F.col("id") < 200, 1).otherwise(0).alias("label"))
    a = split.train_test_split(df, 0.25, 7)
    assert a.filter("is_test").count() == 250
    moved = split.train_test_split(df.repartition(9), 0.25, 7)
    assert a.exceptAll(moved).count() == 0
    s = split.train_test_split(df, 0.3, 7, stratify="label").filter("is_test").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in s} == {0: 240, 1: 60}
    folds = split.stratified_kfold(df, 5, 1, rows_per_bucket=90).groupBy("label", "fold").count().collect()
    assert {(r["label"], r["count"]) for r in folds} == {(0, 160), (1, 40)}
    assert split.seeds(8) == [42, 123, 1234, 12345, 0, 1, 2, 3]


def test_split_large_bin(spark, monkeypatch):
    """The second histogram is used when the bin of the cut is large."""
    monkeypatch.setattr(split, "_SMALL_BIN", 0)
    df = spark.range(300).select(F.col("id").alias("Record"))
    assert split.train_test_split(df, 0.5, 3).filter("is_test").count() == 150


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_missing_values_are_refused(spark, bad):
    rows = [(f"r{i}", "Pathological" if i < 9 else "Control", float(i), bad if i == 3 else float(i * i % 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "Record string, Diagnosed string, a double, b double")
    with pytest.raises(ValueError, match="missing or infinite"):
        rs.smote(df, k=3)
    v = df.select("Record", nb.vector(["a", "b"]).alias("v"))
    for size in (0, 1 << 20):
        with pytest.raises(ValueError, match="missing or infinite"):
            nb.knn_join(v, v, 2, broadcast_bytes=size)


def test_repeated_records_are_rows_of_their_own(spark):
    rows = [(f"r{i // 2}", "Pathological" if i < 20 else "Control", float(i % 11), float(i * i % 17)) for i in range(70)]
    df = spark.createDataFrame(rows, "Record string, Diagnosed string, a double, b double")
    out = rs.smote(df, k=3, keep_row_id=True)
    counts = {r.Diagnosed: r["count"] for r in out.groupBy("Diagnosed").count().collect()}
    assert counts == {"Pathological": 50, "Control": 50}
    assert out.select("row_id").distinct().count() == 100
    train, test, whole = evaluate.split_and_scale(df, ["a", "b"], 42, method=None)
    assert whole.select("row_id").distinct().count() == 70 and test.count() == 14


@pytest.mark.parametrize("exclude", ["Record", "grp"])
def test_cells_send_a_query_once_to_a_block(spark, monkeypatch, exclude):
    """On data without structure no bound helps: still a query goes to each block once, not to every one of many cells."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 24))
    rows = [(i, i % 50, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "Record bigint, grp int, v array<double>").repartition(3)
    kept = {}
    write = nb.materialise
    monkeypatch.setattr(nb, "materialise", lambda t, name: kept.setdefault(name, write(t, name)))
    got = {}
    for r in nb.knn_join(df, df, 5, exclude=exclude, broadcast_bytes=0, block_rows=4).collect():
        got.setdefault(r["Record"], {})[r["neighbour_rank"]] = r["neighbour"]
    same = (lambda i, j: i == j) if exclude == "Record" else (lambda i, j: i % 50 == j % 50)
    assert {i: [g[r] for r in sorted(g)] for i, g in got.items()} == brute(v, rows, 5, 2, same)
    routes = kept["knn-routes"].selectExpr("size(blocks) AS n", "size(array_distinct(blocks)) AS different").collect()
    assert len(routes) == 600 and all(r["n"] == r["different"] <= 14 for r in routes)


def test_many_pairs_go_by_cells_however_few_bytes(points, monkeypatch):
    """A table that fits a broadcast isn't compared pair by pair when there are too many pairs."""
    df, v, rows = points
    monkeypatch.setattr(nb, "BROADCAST_PAIRS", len(rows) ** 2 - 1)
    monkeypatch.setattr(nb, "_broadcast_join", lambda *a: pytest.fail("all pairs compared"))
    got = nb.knn_join(df, df, 1, exclude="Record").collect()
    want = brute(v, rows, 1, 2, lambda i, j: i == j)
    assert {r["Record"]: [r["neighbour"]] for r in got} == want
