import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohorta.functions.formulas import exact_gap_tail, exact_u_tail
from kohorta.operators import clean, metrics, scale, stats


def pairs(spark, y, p, **extra):
    return spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(y, p))], "Record int, y int, p int")


@pytest.mark.parametrize("y,p,cells", [
    ("000111", "001110", (2, 1, 1, 2)), ("0011", "1100", (0, 2, 2, 0)), ("0000011111", "0001011011", None)])
def test_confusion(spark, y, p, cells):
    got = metrics.confusion(pairs(spark, y, p)).first()
    if cells:
        assert tuple(got) == cells
    m = metrics.metric_columns(metrics.confusion(pairs(spark, y, p))).first()
    assert m["Weighted Balanced Accuracy"] == pytest.approx((m["Sensitivity"] + m["Specificity"]) / 2)


def test_sensitivity_edges(spark):
    def one(y, p):
        return metrics.metric_columns(metrics.confusion(pairs(spark, y, p))).first()
    assert one("001111", "001100")["Sensitivity"] == 0.5
    assert one("0000", "0101")["Sensitivity"] == 0.0
    assert one("1111", "1111")["Specificity"] == 0.0


def test_auc_and_roc(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), np.round(rng.normal(size=300), 1)
    s = s + 0.5 * y
    df = spark.createDataFrame([("m", i % 3, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "Model string, fold int, y int, score double")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert metrics.auc_roc(df).first()["AUC"] == pytest.approx(want)
    assert metrics.auc_roc(df, rows_per_bucket=25).first()["AUC"] == pytest.approx(want)
    points = metrics.roc_points(df, rows_per_bucket=40)
    assert metrics.trapezoid_auc(points).first()["AUC"] == pytest.approx(want)
    curve, summary = metrics.mean_roc(df)
    tprs = []
    for f in range(3):
        yy, ss = y[np.arange(300) % 3 == f], s[np.arange(300) % 3 == f]
        cuts = np.unique(ss)[::-1]
        fpr = np.r_[0, [(ss[yy == 0] >= c).mean() for c in cuts]]
        tpr = np.r_[0, [(ss[yy == 1] >= c).mean() for c in cuts]]
        t = np.interp(np.linspace(0, 1, 100), fpr, tpr)
        t[0] = 0.0
        tprs.append(t)
    mean = np.mean(tprs, axis=0)
    mean[-1] = 1.0
    got = [r["tpr"] for r in curve.orderBy("g").collect()]
    np.testing.assert_allclose(got, mean, atol=1e-9)
    assert summary.first()["mean_auc"] == pytest.approx(np.trapezoid(mean, np.linspace(0, 1, 100)))


def test_single_class_auc_is_null(spark):
    assert metrics.auc_roc(spark.createDataFrame([(1, 0.5), (1, 0.2)], "y int, score double")).first()["AUC"] is None


def test_mann_whitney_brute_force(spark, cohort):
    local = cohort.toPandas()
    got = {r["Feature"]: r for r in stats.mann_whitney(cohort, rows_per_bucket=7).collect()}
    for f in ("good", "noise", "constant"):
        a = local[local.Diagnosed == "Control"][f].to_numpy()
        b = local[local.Diagnosed == "Pathological"][f].to_numpy()
        u = np.sum((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :]))
        assert got[f]["U"] == pytest.approx(u)
    assert got["good"]["P-Value"] < 1e-3 < got["noise"]["P-Value"]
    ranked = stats.statistical_selection(cohort).collect()
    assert [r["Feature"] for r in ranked][:2] in (["copy", "good"], ["good", "copy"])
    assert ranked[0]["Reject Null Hypothesis"] and ranked[0]["Adjusted P-Value"] == pytest.approx(ranked[0]["P-Value"] * 5)
    assert {r["Feature"]: r["P-Value"] for r in ranked}["constant"] == 1.0


def test_ks(spark, cohort):
    after = cohort.withColumn("good", F.col("good") + 0.7)
    for limit in (None, 6):
        got = {r["Feature"]: r for r in stats.ks_test(cohort, after, rows_per_bucket=limit).collect()}
        local = cohort.filter("Diagnosed = 'Pathological'").toPandas()
        a, b = np.sort(local["good"]), np.sort(local["good"] + 0.7)
        grid = np.r_[a, b]
        gap = np.max(np.abs(np.searchsorted(a, grid, "right") / 20 - np.searchsorted(b, grid, "right") / 20))
        assert got["good"]["Statistic"] == pytest.approx(gap)
        assert got["noise"]["Statistic"] == 0 and got["noise"]["P-Value"] == 1.0


def test_t_test(spark):
    rows = [("RF", "SMOTE", 0.9, 1), ("RF", "SMOTE", 0.92, 2), ("RF", "SMOTE", 0.88, 3),
            ("SVM", "SMOTE", 0.7, 1), ("SVM", "SMOTE", 0.72, 2), ("SVM", "SMOTE", 0.74, 3)]
    df = spark.createDataFrame(rows, "Model string, Method string, Accuracy double, `Number of execution` int")
    got = stats.t_test_pairs(df, names=["Accuracy"]).first()
    a, b = np.array([0.9, 0.92, 0.88]), np.array([0.7, 0.72, 0.74])
    sp = math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2 * 2 / 3)
    assert got["T-statistic"] == pytest.approx((a.mean() - b.mean()) / sp)
    assert got["Better Model"] == "RF*" and got["Significant"]
    agg = metrics.aggregate_metrics(df).toPandas().set_index("Model")
    assert agg.loc["RF", "Accuracy_mean"] == pytest.approx(0.9)
    assert agg.loc["RF", "Number of execution_std"] == pytest.approx(1.0)
    flat = df.withColumn("Accuracy", F.lit(0.5))
    assert stats.t_test_pairs(flat, names=["Accuracy"]).first()["Better Model"] is None


def test_loo_summaries(spark):
    rows = [("RF", f"r{i}", 1 + i // 5, int(i % 3 > 0)) for i in range(10)]
    loo = spark.createDataFrame(rows, "Model string, Record string, Execution int, Accuracy int")
    s = metrics.loo_summary(loo).first()
    assert s["N_Executions"] == 2 and s["Mean"] == pytest.approx(0.6)
    assert metrics.loo_summary(loo.limit(0)).count() == 0
    assert metrics.loo_metrics(loo).first()["LOO_Median"] == 1.0


def test_patient_summaries(spark):
    rows = [("m", "a", "Pathological", "Pathological"), ("m", "a", "Pathological", "Control"),
            ("m", "b", "Pathological", "Control"), ("m", "c", "Pathological", "Pathological")]
    df = spark.createDataFrame(rows, "Model string, Record string, True_Label string, Predicted string")
    r = metrics.patient_accuracy(df).first()
    v = np.array([0.5, 0.0, 1.0])
    assert r["Patient_Accuracy_Mean"] == pytest.approx(0.5) and r["Patient_Accuracy_Std"] == pytest.approx(v.std(ddof=1))
    assert r["Patient_Accuracy_IQR"] == pytest.approx(0.5)
    per, model = metrics.misclassification(df)
    assert per.count() == 3 and model.first()["Misclassified"] == pytest.approx(0.5)


@pytest.mark.parametrize("method", ["poisson", "multinomial"])
def test_bootstrap(spark, method):
    df = pairs(spark, "00011111" * 20, "00111011" * 20)
    rows = {r["Metric"]: r for r in stats.bootstrap_ci(df, method=method).collect()}
    exact = metrics.metric_columns(metrics.confusion(df)).first()
    for name, r in rows.items():
        assert r["ci_lower"] <= r["mean"] <= r["ci_upper"]
        assert abs(r["mean"] - exact[name]) < 0.05
    again = {r["Metric"]: r["mean"] for r in stats.bootstrap_ci(df.repartition(5), method=method).collect()}
    assert all(again[k] == pytest.approx(r["mean"]) for k, r in rows.items())


def test_bootstrap_custom_metric(spark):
    df = pairs(spark, "00011111", "00111011")
    share = {"share": lambda: F.sum(F.col("w") * F.col("p")) / F.sum("w")}
    r = stats.bootstrap_ci(df, metrics=share).collect()
    assert [x["Metric"] for x in r] == ["share"] and 0 < r[0]["mean"] < 1


def test_cleaning(spark, cohort):
    kept, removed = clean.clean(cohort)
    assert removed == {"low_variance": ["constant", "tiny"], "correlated": ["copy"]}
    assert kept.columns == ["Record", "Diagnosed", "good", "noise"]
    small = spark.createDataFrame([(5, i, "x") for i in range(1, 6)], "constant int, varying int, text string")
    assert clean.remove_low_variance(small)[0].columns == ["varying", "text"]
    df = spark.createDataFrame([(1.0, 1), (1.01, 10), (1.02, 20), (0.99, 5), (1.0, 15)], "low_var double, high_var int")
    assert clean.remove_low_variance(df, 0.01)[1] == ["low_var"]
    report = {r["reason"]: (r["n"], r["shown"]) for r in clean.removal_report(clean.removal_log(spark, removed)).collect()}
    assert report["low_variance"] == (2, "constant,tiny")


def test_correlation_paths_agree(spark, cohort):
    gaps = cohort.withColumn("noise", F.when(F.col("Record") > "r10", F.col("noise") + 1e6))
    local = gaps.toPandas()[["good", "copy", "noise", "constant", "tiny"]].corr()
    for narrow in (1, 99):
        for r in clean.corr_matrix(gaps, narrow=narrow).collect():
            want = local.loc[r["fi"], r["fj"]]
            assert (r["r"] is None and math.isnan(want)) or r["r"] == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("method", scale.METHODS)
def test_scalers(spark, cohort, method):
    s = scale.Scaler(method)
    with pytest.raises(ValueError):
        s.transform(cohort)
    out = s.fit_transform(cohort).toPandas()
    v = cohort.toPandas()
    assert (out["Record"] == v["Record"]).all() and (out["constant"] == 0).all()
    x = v["good"]
    want = {"standard": (x - x.mean()) / x.std(ddof=0), "minmax": (x - x.min()) / (x.max() - x.min()),
            "robust": (x - x.median()) / (x.quantile(0.75) - x.quantile(0.25))}[method]
    np.testing.assert_allclose(out["good"], want)
    back = s.inverse_transform(s.transform(cohort)).toPandas()
    np.testing.assert_allclose(back["good"], x)
    with pytest.raises(ValueError):
        scale.Scaler("other")


# ---- exact tails of small samples ---------------------------------------------------------------

def test_exact_tails_are_full_enumeration():
    for n1, n2 in ((1, 1), (2, 3), (3, 3), (4, 5), (4, 8)):
        u = np.array([sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)])
        for k in range(n1 * n2 + 1):
            assert exact_u_tail(n1, n2, k) == pytest.approx(min(1.0, 2 * (u >= max(k, n1 * n2 - k)).mean()), abs=1e-12)
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 6)):
        gaps = []
        for c in itertools.combinations(range(n + m), n):
            i = np.cumsum(np.isin(np.arange(n + m), c))
            gaps.append(np.abs(i * m - (np.arange(1, n + m + 1) - i) * n).max())
        for k in range(1, n * m + 1):
            assert exact_gap_tail(n, m, k / (n * m)) == pytest.approx((np.array(gaps) >= k).mean(), abs=1e-12)


def test_exact_tails_meet_the_asymptotic_ones(spark):
    assert exact_gap_tail(1500, 1500, 0.05) == pytest.approx(0.0469, abs=0.002)
    rng = np.random.default_rng(4)
    rows = [("Control" if i < 7 else "Pathological", float(v)) for i, v in enumerate(rng.permutation(60))]
    df = spark.createDataFrame(rows, "Diagnosed string, x double")
    exact, rough = (stats.mann_whitney(df, ["x"], method=m).first() for m in ("auto", "asymptotic"))
    assert exact["U"] == rough["U"] and exact["P-Value"] == pytest.approx(exact_u_tail(7, 53, exact["U"]))
    assert exact["P-Value"] != rough["P-Value"] and exact["P-Value"] == pytest.approx(rough["P-Value"], abs=0.03)
    tied = df.unionAll(df)
    assert stats.mann_whitney(tied, ["x"]).first()["P-Value"] == stats.mann_whitney(tied, ["x"], method="asymptotic").first()["P-Value"]
    gap = stats.ks_test(df.where("x < 30"), df.where("x >= 20"), ["x"], label=None).first()
    assert gap["P-Value"] == pytest.approx(exact_gap_tail(30, 40, gap["Statistic"]))
