"""Trees against a recursive grower, both ways of growing against each other, leave-out against refits, and the models on top."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from kohorta.operators import evaluate, models, search, select, svm, trees
from kohorta.operators.trees import (BINS, FIXED, MISSING, Boost, Plan, Rules, bin_table, boost_apart, boost_here, forest_plans,
                                     grow, grow_apart, grow_here, grow_side_by_side, left_out_here, left_out_scores, to_bins)


def impurity(rules, a, b):
    if rules.criterion == "newton":
        return -b * b / (a + rules.l2)
    if rules.criterion == "gini":
        return 2 * b * (a - b) / a
    return -sum(x * np.log(x / a) for x in (b, a - b) if x > 0)


def by_hand(plan, bins, a, b):
    """Value b / a of the leaf of every row, by recursion over nodes."""
    rules, out = plan.rules, np.full(len(bins), np.nan)

    def goes_left(rows, f, cut, missing_left):
        return np.where(bins[rows, f] == MISSING, missing_left, bins[rows, f] <= cut)

    def go(rows, all_rows, heap, depth):
        wa, wb, best = a[rows].sum(), b[rows].sum(), None
        mixed = rules.criterion == "newton" or 0 < wb < wa
        if depth < rules.depth and mixed and wa >= 2 * rules.min_leaf:
            tried = plan.tried(np.array([heap]))
            cuts = plan.cuts(np.array([heap]), tried)[0]
            for missing_left in (False, True):
                for j, f in enumerate(tried[0]):
                    x = bins[rows, f]
                    there = x[x != MISSING]
                    cand = range(MISSING)
                    if rules.splitter == "random":
                        if not len(there):
                            continue
                        low = int(there.min())
                        cand = [low + int(cuts[j]) * max(int(there.max()) - low, 1) // trees.PRIME]
                    for cut in cand:
                        left = goes_left(rows, f, cut, missing_left)
                        la, lb = a[rows][left].sum(), b[rows][left].sum()
                        if min(la, wa - la) < max(rules.min_leaf, 1e-300):
                            continue
                        gain = impurity(rules, wa, wb) - impurity(rules, la, lb) - impurity(rules, wa - la, wb - lb)
                        if gain > max(rules.min_gain, 1e-12) and (best is None or gain > best[0] + 1e-12):
                            best = gain, f, cut, missing_left
        if best is None:
            out[all_rows] = wb / wa if wa > 0 else 0.5
            return
        for side in (0, 1):
            part = [r[goes_left(r, *best[1:]) == (side == 0)] for r in (rows, all_rows)]
            go(*part, 2 * heap + side, depth + 1)

    go(np.flatnonzero(a > 0), np.arange(len(bins)), 1, 0)
    return out


def values(tree, bins):
    return np.where(tree.a > 0, tree.b / np.maximum(tree.a, 1e-300), 0.5)[tree.leaf(bins)]


def some_rows(seed, missing=False):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(5, 150)), int(rng.integers(1, 7))
    bins = rng.integers(0, rng.choice([3, 12, MISSING]), (n, d)).astype(np.uint8)
    if missing:
        bins[rng.random((n, d)) < 0.1] = MISSING
    return rng, bins, (bins[:, 0] + rng.integers(0, 15, n) > 14).astype(float), rng.integers(0, 2**32, n)


@pytest.mark.parametrize("seed", range(24))
def test_grower_and_leave_out(seed):
    rng, bins, y, h = some_rows(seed, seed % 2 == 1)
    n, d = bins.shape
    rules = Rules(["gini", "entropy", "newton"][seed % 3], int(rng.integers(1, 8)), ["sqrt", "all", "log2", 2][seed % 4],
                  "random" if seed % 5 == 0 else "best", 3.0 if seed % 7 == 0 else 1.0, float(seed % 2))
    plan = Plan(seed, seed, rules, tuple(range(d)), None, seed % 3 != 2)
    w = plan.weights(h, np.zeros((n, 0), bool))
    a, b = (np.rint(rng.random(n) * FIXED) / FIXED, np.rint((rng.random(n) - 0.5) * FIXED) / FIXED) if seed % 3 == 2 else (w, w * y)
    np.testing.assert_allclose(values(grow_here(plan, bins, a, b), bins), by_hand(plan, bins, a, b), atol=1e-9)
    if seed % 3 == 2:
        return
    two = grow_side_by_side([plan, Plan(seed, 99, rules, tuple(range(d)))], bins, [(a, b), (np.ones(n), y)])
    np.testing.assert_array_equal(values(two[0], bins), values(grow_here(plan, bins, a, b), bins))
    fold = np.arange(n) if seed % 2 else np.unique(rng.integers(0, max(2, n // 3), n), return_inverse=True)[1]
    left_out = left_out_here(plan, bins, a, b, fold, block=17)
    for f in np.unique(fold):
        refit = grow_here(plan, bins, np.where(fold == f, 0, a), np.where(fold == f, 0, b))
        if refit.a[0] > 0:
            np.testing.assert_allclose(left_out[fold == f], values(refit, bins)[fold == f])


def test_best_first_counts_leaves():
    _, bins, y, h = some_rows(5)
    one, rules = np.ones(len(y)), Rules("gini", 60, "all", leaves=6)
    tree = grow_here(Plan(1, 0, rules, tuple(range(bins.shape[1])), None, False), bins, one, y)
    assert (tree.feature < 0).sum() <= 6
    whole = grow_here(Plan(1, 0, Rules("gini", 60, "all"), tuple(range(bins.shape[1])), None, False), bins, one, y)
    gains, open_, taken = dict(zip(whole.heap.tolist(), whole.gain)), {1}, set()
    while len(taken) < 5:
        best = max(open_, key=lambda k: gains[k])
        taken.add(best)
        open_ = (open_ - {best}) | {2 * best, 2 * best + 1}
    assert set(tree.heap[tree.feature >= 0].tolist()) == taken


def boosted_by_hand(boost, bins, y):
    """Newton boosting with trees grown by hand."""
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for r in range(boost.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * FIXED) / FIXED, np.rint(p * (1 - p) * FIXED) / FIXED
        tree = grow_here(boost.plan(r, bins.shape[1]), bins, h, g)
        leaf = tree.leaf(bins)
        for k in np.unique(leaf):
            margin[leaf == k] -= boost.rate * g[leaf == k].sum() / (h[leaf == k].sum() + boost.rules.l2)
    return 1 / (1 + np.exp(-margin))


def test_boosting_rounds():
    _, bins, y, h = some_rows(4, True)
    table = {"bins": bins, "y": y, "h": h, "member": np.zeros((len(y), 0), bool)}
    boost = Boost(Rules("newton", 3, "all", min_leaf=0.1, l2=1.0), 7, 0.3)
    start, grown, steps = boost_here(boost, table)
    np.testing.assert_allclose(boost.forest([], grown, steps, start).scores(bins), boosted_by_hand(boost, bins, y), atol=1e-9)


def test_votes_are_samme():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 12, (80, 3)).astype(np.uint8)
    y = (bins.sum(1) > 16).astype(float)
    table = {"bins": bins, "y": y, "h": np.arange(80), "member": np.zeros((80, 0), bool)}
    boost = Boost(Rules("gini", 1, "all", min_leaf=0.0), 12, 1.0, "samme")
    start, grown, votes = boost_here(boost, table)
    w, total, signed = np.ones(80), 0.0, np.zeros(80)
    for tree in grown:
        leaf = tree.leaf(bins)
        side = {k: 1 if (w * y)[leaf == k].sum() > w[leaf == k].sum() / 2 else -1 for k in np.unique(leaf)}
        s = np.array([side[k] for k in leaf])
        wrong = (s > 0) != (y > 0)
        error = w[wrong].sum() / w.sum()
        alpha = np.log((1 - error) / error)
        w, total, signed = w * np.exp(alpha * wrong), total + alpha, signed + alpha * s
    np.testing.assert_allclose(boost.forest([], grown, votes, start).scores(bins), (signed / total + 1) / 2, atol=1e-6)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.5 * rng.normal(size=240) > 0).astype(int)
    rows = [(f"r{i // 2:03d}:{i % 2}", f"r{i // 2:03d}", int(t), [float("nan") if rng.random() < 0.05 else float(v) for v in r])
            for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id string, Record string, label int, v array<double>")
    return df.repartition(5).select("row_id", "Record", F.lit(False).alias("Is_SMOTE"), "label", array_to_vector("v").alias("features"))


def test_both_ways_grow_the_same_trees(table):
    members = [F.hash("row_id") % 3 != 0, F.lit(True)]
    here = bin_table(table, "row_id", members)
    apart = bin_table(table, "row_id", members, edges=here.edges, local_bytes=0)
    assert here.local is not None and apart.local is None
    t = here.local
    plans = forest_plans(3, 7, Rules(depth=5), range(4), 0) + forest_plans(2, 8, Rules("entropy", 4, "all", "random"), (0, 2), 1)
    plans += [Plan(9, 0, Rules("gini", 20, "all", leaves=5), (0, 1, 2, 3), 1, False)]
    for a, b in zip(grow(here, plans), grow(apart, plans)):
        np.testing.assert_array_equal(values(a, t["bins"]), values(b, t["bins"]))
    few = grow_apart(apart, plans[:2], lambda p, x: (w := p.weights(x["h"], x["member"]), w * x["y"]), cells=300)
    np.testing.assert_array_equal(values(few[1], t["bins"]), values(grow(here, plans)[1], t["bins"]))


@pytest.mark.parametrize("boost", [Boost(Rules("newton", 2, "all", min_leaf=0.01, l2=1.0), 10, 0.3, member=0),
                                   Boost(Rules("newton", 60, "all", min_leaf=0.01, leaves=4), 2, 0.3, top=0.3, rest=0.2),
                                   Boost(Rules("newton", 2, "all", min_leaf=0.01), 2, 0.3, "exponential")])
def test_both_ways_boost_alike(table, boost):
    here = bin_table(table, "row_id", [F.hash("row_id") % 3 != 0])
    apart = bin_table(table, "row_id", [F.hash("row_id") % 3 != 0], edges=here.edges, local_bytes=0)
    a, b = (boost.forest(here.edges, *f[1:], f[0]) for f in (boost_here(boost, here.local), boost_apart(apart, boost)))
    np.testing.assert_allclose(a.scores(here.local["bins"]), b.scores(here.local["bins"]), atol=1e-9)


def test_exact_leave_out(table):
    """The rows a tree model answers without refitting equal refits without each record."""
    rows = evaluate.leave_patient_out("DecisionTree", table, {"max_depth": 4}, folds=None)
    binned = bin_table(table, "row_id", carry=["Record"])
    plans = models.tree_job("DecisionTree", {"max_depth": 4}, 42, 4)
    got = left_out_scores(binned, plans, "Record").toPandas().set_index("row_id")["score"]
    local = binned.table.orderBy("h", "y", "bins").toPandas()
    for record in sorted(local["Record"].unique())[:40]:
        out = (local["Record"] == record).to_numpy()
        w = np.where(out, 0.0, 1.0)
        tree = grow_here(plans[0], binned.local["bins"], w, w * binned.local["y"])
        np.testing.assert_allclose(got[local["row_id"][out]], values(tree, binned.local["bins"])[out])
    hit = got[[r for r in local["row_id"][local["y"] == 1]]] > 0.5
    assert rows.filter("Predicted = 'Pathological'").count() == int(hit.sum())
    with pytest.raises(ValueError):
        left_out_scores(bin_table(table, "row_id", carry=["Record"], local_bytes=0), plans, "Record")


def test_choices_reach_the_rules():
    for name, wanted in (("DecisionTree", {"criterion": "entropy", "splitter": "random", "max_features": "log2"}),
                         ("RandomForest", {"criterion": "entropy", "max_features": "log2"}), ("GradientBoosting", {"loss": "log_loss"})):
        ranges = {p: search.Choice() for p in models.get_model(name).choices}
        low, high = search.bounds(name, ranges)
        assert search.decode(name, ranges, high) == wanted and list(low) == [0.0] * len(ranges)
    plan = models.tree_job("DecisionTree", {"criterion": "entropy", "splitter": "random", "max_features": "log2"}, 1, 9)[0]
    assert (plan.rules.criterion, plan.rules.splitter, plan.rules.count(9)) == ("entropy", "random", 4)
    assert models.tree_job("GradientBoosting", {"loss": "exponential"}, 1, 9).loss == "exponential"
    assert models.tree_job("LightGBM", {"num_leaves": 7}, 1, 9).rules.leaves == 7


def test_bagging_of_neighbours(spark, table):
    complete = table.select("row_id", "label", "features").where(~F.exists(vector_to_array("features"), F.isnan))
    predict = models.fit("Bagging", complete, {"base": "KNearestNeighbor", "n_estimators": 3})
    out = predict(complete).toPandas()
    assert len(out) == complete.count() and (out["Predicted"] == out["label"]).mean() > 0.8
    assert set(np.round(out["score"] * 15).astype(int)) <= set(range(16))


def dense_machine(k, y, c, steps=60):
    """The same machine from the whole kernel matrix, by Newton steps over its support."""
    n = len(y)
    beta, b = np.zeros(n), 0.0
    for _ in range(steps):
        on = np.flatnonzero(1 - y * (k @ beta + b) > 0)
        m = np.zeros((len(on) + 1, len(on) + 1))
        m[1:, 1:], m[0, 1:], m[1:, 0] = k[np.ix_(on, on)] + np.eye(len(on)) / (2 * c), 1, 1
        solved = np.linalg.lstsq(m, np.append(0.0, y[on]), rcond=None)[0]
        beta, b = np.zeros(n), solved[0]
        beta[on] = solved[1:]
    return k @ beta + b


@pytest.mark.parametrize("kernel", svm.KERNELS)
def test_kernels_against_dense(spark, kernel):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    label = (x[:, 0] ** 3 + x[:, 1] > 0) if kernel in ("poly", "linear", "sigmoid") else ((x ** 2).sum(1) > 2.5)
    df = spark.createDataFrame([(i, int(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, label))],
                               "id int, label int, v array<double>").select("id", "label", array_to_vector("v").alias("features"))
    out = models.fit("SupportVectorMachine", df, {"kernel": kernel, "n_features": 256})(df).orderBy("id").toPandas()
    g, dot = 1 / (3 * x.var()), x @ x.T
    k = {"linear": dot, "rbf": np.exp(-g * ((x[:, None] - x[None]) ** 2).sum(-1)), "poly": (g * dot) ** 3, "sigmoid": np.tanh(g * dot)}[kernel]
    if kernel == "sigmoid":
        w, v = np.linalg.eigh(k)
        k = (v * np.maximum(w, 0)) @ v.T
    dense = dense_machine(k, 2.0 * label - 1, 1.0) > 0
    mine = out["Predicted"].to_numpy() == 1
    assert (mine == dense).mean() >= (0.98 if kernel in ("linear", "sigmoid") else 0.93)
    assert (mine == label).mean() > (dense == label).mean() - 0.04
    s = out["score"].to_numpy()
    assert np.corrcoef(s, label)[0, 1] > 0.6 and ((0 <= s) & (s <= 1)).all()


def test_sketch_stands_for_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    z = svm.sketch_map(5, 4096, 0.2, 1.0, 3, 1)(x)
    exact = (0.2 * x @ x.T + 1.0) ** 3
    assert np.abs(z @ z.T - exact).mean() < 0.1 * np.abs(exact).mean()


def test_elimination_of_many_seeds_is_that_of_each(table):
    names = ["a", "b", "c", "d"]
    both = select.rfe_stability(table, names, 2, [42, 123], trees=10, key="row_id").toPandas().set_index("Feature")
    each = [dict(zip(names, select.rfe_path(table, 4, s, 2, trees=10, key="row_id")[0])) for s in (42, 123)]
    for f in names:
        assert both["Average Ranking"][f] == np.mean([e[f] for e in each])
        assert both["Stability Index"][f] == np.mean([e[f] == 1 for e in each])


def test_generations_share_folds(table, monkeypatch):
    made = []
    real = search.stratified_kfold
    monkeypatch.setattr(search, "stratified_kfold", lambda *a, **k: made.append(1) or real(*a, **k))
    ranges = {"max_depth": search.Range(1, 4), "criterion": search.Choice("gini", "entropy")}
    best = search.swarm_search("DecisionTree", table.select("row_id", "label", "features"), ranges, swarm=3, iterations=3, k=2,
                               key="row_id")
    assert made == [1] and best["max_depth"] in (1, 2, 3, 4)


def test_missing_values_have_a_bin():
    edges = [np.array([0.0, 1.0])]
    assert to_bins(np.array([[-1.0], [0.0], [0.5], [2.0], [np.nan]]), edges)[:, 0].tolist() == [0, 0, 1, 2, MISSING]


def test_tables_of_one_feature_and_of_none(spark):
    df = spark.createDataFrame([(i, int(i > 5), [float(i)]) for i in range(12)], "id int, label int, v array<double>").select(
        "id", "label", array_to_vector("v").alias("features"))
    out = models.fit("DecisionTree", df)(df)
    assert out.where("Predicted <> label").count() == 0
    assert trees.edges_of(df.limit(0)) == []


def test_best_first_looks_ahead(table, monkeypatch):
    """A tree of 16 leaves takes passes for its depth, not for its leaves, and is the same."""
    passes, splits = [], trees._splits
    monkeypatch.setattr(trees, "_splits", lambda *a: passes.append(1) or splits(*a))
    here = bin_table(table, "row_id")
    apart = bin_table(table, "row_id", edges=here.edges, local_bytes=0)
    plan = Plan(9, 0, Rules("gini", 20, "all", leaves=16), (0, 1, 2, 3), None, False)
    tree = grow_apart(apart, [plan], lambda p, x: (np.ones(len(x["y"])), x["y"]))[0]
    t = here.local
    np.testing.assert_array_equal(values(tree, t["bins"]), values(grow_here(plan, t["bins"], np.ones(len(t["y"])), t["y"]), t["bins"]))
    assert (tree.feature < 0).sum() == 16 and len(passes) <= 10


def test_depths_of_one_tree_grow_once(table, monkeypatch):
    """Plans that differ by their depth only are levels of one tree, equal ones the same tree."""
    binned, asked = bin_table(table, "row_id", [F.hash("row_id") % 3 != 0]), []
    plans = [p for d in (2, 6, 0, 4, 6) for p in forest_plans(2, 7, Rules(depth=d), range(4), 0)]
    plans += [Plan(9, 0, Rules("gini", d, "all", leaves=5), (0, 1, 2, 3), 0, False) for d in (2, 20)]
    each = trees._grow_each
    alone = [each(binned, [p])[0] for p in plans]
    monkeypatch.setattr(trees, "_grow_each", lambda b, some: asked.extend(some) or each(b, some))
    for p, a, b in zip(plans, grow(binned, plans), alone):
        for name in trees.Tree.__dataclass_fields__:
            np.testing.assert_array_equal(getattr(a, name), getattr(b, name), err_msg=f"{p} {name}")
    assert len(asked) == 4


def test_equal_candidates_are_fitted_once(table, monkeypatch):
    xy, asked = table.select("row_id", "label", "features"), []
    whole = search.tree_job
    monkeypatch.setattr(search, "tree_job", lambda name, p, *rest: asked.append(p) or whole(name, p, *rest))
    got = search.cv_accuracy("DecisionTree", xy, [{"maxDepth": 2}, {"maxDepth": 3}, {"maxDepth": 2}], k=2, key="row_id")
    assert len(asked) == 4 and got[0] == got[2]
    assert got[:2] == [search.cv_accuracy("DecisionTree", xy, [{"maxDepth": d}], k=2, key="row_id")[0] for d in (2, 3)]


@pytest.mark.parametrize("criterion", ["gini", "newton"])
def test_large_nodes_alone_and_small_ones_together(monkeypatch, criterion):
    """Trees don't depend on which nodes have rows of their own."""
    rng = np.random.default_rng(3)
    n, d = 500, 5
    bins = rng.integers(0, BINS, (n, d)).astype(np.uint8)
    y, h = (bins[:, 0] + rng.integers(0, 30, n) > 25).astype(float), rng.integers(0, 2**32, n)
    plans = forest_plans(3, 5, Rules(criterion, 8, 2, min_leaf=0.01), range(d))
    stats = [(np.rint(rng.random(n) * FIXED) / FIXED, np.rint((rng.random(n) - 0.5) * FIXED) / FIXED) if criterion == "newton"
             else (w := p.weights(h, np.zeros((n, 0), bool)), w * y) for p in plans]
    grown = []
    for alone in (1, 40, 1 << 30):
        monkeypatch.setattr(trees, "ALONE", alone)
        grown.append(grow_side_by_side(plans, bins, stats))
    for other in grown[1:]:
        for a, b in zip(grown[0], other):
            for name in trees.Tree.__dataclass_fields__:
                np.testing.assert_array_equal(getattr(a, name), getattr(b, name))
    assert min((t.feature < 0).sum() for t in grown[0]) > 8
