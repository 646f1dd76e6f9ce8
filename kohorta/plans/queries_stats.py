"""Aggregates, series functionals, windows, scalers, tests and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean, functionals, metrics, perturbation, scale, stats
from ..operators.ordered import mid_rank, quantiles, running
from ..operators.split import train_test_split
from ..session import materialise
from . import bindings as B
from .bindings import with_sql
from .queries_tables import hash_sql, kolmogorov_sql, labelled_predictions, normal_sql, student8_sql
from .registry import query

FEATS = B.COHORT_FEATURES
LONG = with_sql("long")

# ---- cleaning -----------------------------------------------------------------------------------

_VARIANCES = """SELECT "Feature", VAR_SAMP(value) AS variance FROM long GROUP BY "Feature" """


@query("AG1_low_variance", LONG + f" SELECT * FROM ({_VARIANCES}) WHERE variance < 0.1::DOUBLE", "variance")
def _(spark, sf):
    return clean.low_variance(B.cohort(spark, sf))


def corr_sql(feats, source="cohort") -> str:
    cols = " UNION ALL ".join(
        f"""SELECT {i} AS i, {j} AS j, '{a}' AS fi, '{b}' AS fj, CORR("{a}", "{b}") AS r FROM {source}"""
        for i, a in enumerate(feats) for j, b in enumerate(feats) if i < j)
    return cols


@query("AG2_corr_matrix", with_sql("cohort") + " " + corr_sql(FEATS), "r")
def _(spark, sf):
    return clean.corr_matrix(B.cohort(spark, sf))


_WIDE_SQL = with_sql("vectors") + """, e AS (SELECT "Record", UNNEST(v) AS x, GENERATE_SUBSCRIPTS(v, 1) - 1 AS i FROM vectors)"""


@query("AG2_corr_matrix_wide", _WIDE_SQL + """ SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, printf('e%02d', a.i) AS fi,
    printf('e%02d', b.i) AS fj, CORR(a.x, b.x) AS r FROM e a JOIN e b ON a."Record" = b."Record" AND a.i < b.i GROUP BY a.i, b.i""", "r")
def _(spark, sf):
    return clean.corr_matrix(B.wide_vectors(spark, sf))


@query("AG3_correlated_features", with_sql("cohort") + f""", m AS ({corr_sql(FEATS)})
    SELECT fj AS "Feature", MAX(ABS(r)) AS max_abs_r FROM m GROUP BY fj HAVING MAX(ABS(r)) > 0.8::DOUBLE""", "max_abs_r")
def _(spark, sf):
    return clean.correlated_features(B.cohort(spark, sf), 0.8)


_KEPT = [f for f in FEATS if f not in ("disc_mean", "tax_mean")]


@query("AG4_clean", with_sql("cohort") + """ SELECT "Record", "Diagnosed", n_lines, qty_sum, price_mean, price_std, price_sum, "Pr01", "Pr02"
    FROM cohort""", "n_lines, qty_sum, price_mean, price_std, price_sum, Pr01, Pr02")
def _(spark, sf):
    return clean.clean(B.cohort(spark, sf))[0]


@query("AG5_removal_report", LONG + f""", v AS ({_VARIANCES}), m AS ({corr_sql(_KEPT)}),
    gone AS (SELECT 'low_variance' AS reason, "Feature", list_position({FEATS!r}, "Feature") AS p FROM v WHERE variance < 0.1::DOUBLE
    UNION ALL SELECT 'correlated', fj, list_position({FEATS!r}, fj) FROM (SELECT DISTINCT fj FROM m WHERE ABS(r) > 0.9::DOUBLE))
    SELECT reason, COUNT(*) AS n, STRING_AGG("Feature", ',' ORDER BY p) AS shown, GREATEST(0, COUNT(*) - 10) AS more FROM gone GROUP BY reason""")
def _(spark, sf):
    _, removed = clean.clean(B.cohort(spark, sf))
    return clean.removal_report(clean.removal_log(spark, removed))


@query("AG6_marker_report", with_sql("cohort") + "".join(
    f"""{' UNION ALL ' if k else ' '}SELECT '{m}' AS "Marker", '{n}' AS "Name", '{c}' AS "Category", AVG("{m}") AS "Mean",
    STDDEV_SAMP("{m}") AS "Std", MIN("{m}") AS "Min", MAX("{m}") AS "Max", COUNT(*) - COUNT("{m}") AS "Missing" FROM cohort"""
    for k, (m, n, c) in enumerate([("Pr01", "Fundamental Frequency", "A"), ("Pr02", "Ratio of cycles in closing", "B")])),
    "Mean, Std, Min, Max")
def _(spark, sf):
    df = B.cohort(spark, sf)
    return clean.marker_report(df, C.marker_columns(df))


@query("AG7_class_counts", with_sql("markers") + ' SELECT "Diagnosed", COUNT(*) AS n FROM markers GROUP BY "Diagnosed"')
def _(spark, sf):
    return metrics.class_counts(B.markers(spark, sf))


@query("AG8_class_balance_report", with_sql("cohort") + """, b AS (SELECT COUNT(*) AS n FROM cohort GROUP BY "Diagnosed"),
    a AS (SELECT COUNT(*) AS n FROM cohort WHERE price_std IS NOT NULL GROUP BY "Diagnosed")
    SELECT (SELECT MIN(n) / CAST(MAX(n) AS DOUBLE) FROM b) AS ratio_before, (SELECT MIN(n) / CAST(MAX(n) AS DOUBLE) FROM a) AS ratio_after,
    CAST((SELECT SUM(n) FROM b) AS BIGINT) AS rows_before, CAST((SELECT SUM(n) FROM a) AS BIGINT) AS rows_after,
    CAST((SELECT SUM(n) FROM a) - (SELECT SUM(n) FROM b) AS BIGINT) AS rows_added""", "ratio_before, ratio_after")
def _(spark, sf):
    df = B.cohort(spark, sf)
    return metrics.class_balance(df, C.drop_missing(df))


# ---- series -------------------------------------------------------------------------------------

def moments_sql(x: str, prefix: str = "", ddof: int = 1) -> str:
    """mean, stdev, biased skew and excess kurtosis by raw central moments."""
    std = "STDDEV_SAMP" if ddof else "STDDEV_POP"
    m = f"AVG({x})"
    m2 = f"(AVG({x} * {x}) - {m} * {m})"
    m3 = f"(AVG({x} * {x} * {x}) - 3 * {m} * AVG({x} * {x}) + 2 * {m} * {m} * {m})"
    return (f"{m} AS {prefix}mean, {std}({x}) AS {prefix}stdev, {m3} / NULLIF(POW({m2}, 1.5), 0) AS {prefix}skew, "
            f"KURTOSIS_POP({x}) AS {prefix}kurtosis")


FRAMES = with_sql("frames")
FUNCTIONALS = "mean, stdev, skew, kurtosis"


@query("AG11_functionals", FRAMES + f' SELECT "Record", series, {moments_sql("value")} FROM frames GROUP BY "Record", series', FUNCTIONALS)
def _(spark, sf):
    return functionals.functionals(B.frames(spark, sf))


@query("AG11_functionals_voiced", FRAMES + f""", f AS (SELECT "Record", series, CASE WHEN value < 20.0::DOUBLE THEN 0.0::DOUBLE ELSE value END AS value FROM frames),
    a AS (SELECT "Record", series, {moments_sql("value")} FROM f GROUP BY "Record", series),
    b AS (SELECT "Record", series, AVG(value) AS mean, STDDEV_SAMP(value) AS stdev FROM f WHERE value > 0 GROUP BY "Record", series)
    SELECT a."Record", a.series, b.mean, b.stdev, a.skew, a.kurtosis FROM a LEFT JOIN b ON a."Record" = b."Record" """, FUNCTIONALS)
def _(spark, sf):
    v = F.col("value")
    return functionals.functionals(B.frames(spark, sf).withColumn("value", F.when(v < 20, 0.0).otherwise(v)),
                                   voiced_only_level=True)


_DELTAS = """, d AS (SELECT *, value - LAG(value, 1) OVER w AS delta1, value - LAG(value, 2) OVER w AS delta2
    FROM frames WINDOW w AS (PARTITION BY "Record", series ORDER BY t))"""


@query("WN1_WN2_deltas", FRAMES + _DELTAS + " SELECT * FROM d", "value, delta1, delta2")
def _(spark, sf):
    return functionals.deltas(B.frames(spark, sf))


@query("WN1_deltas_chunked", FRAMES + _DELTAS + " SELECT * FROM d", "value, delta1, delta2")
def _(spark, sf):
    return functionals.deltas(B.frames(spark, sf), chunk_rows=16)


@query("AG12_delta_stats", FRAMES + _DELTAS + f""" SELECT "Record", series, {moments_sql("delta1", "Delta1_")},
    {moments_sql("delta2", "Delta2_")} FROM d GROUP BY "Record", series""",
    ", ".join(f"Delta{i}_{c}" for i in (1, 2) for c in ("mean", "stdev", "skew", "kurtosis")))
def _(spark, sf):
    return functionals.delta_stats(B.frames(spark, sf))


def _weights_sql(weights) -> str:
    terms = " + ".join(f"({w!r})::DOUBLE * near[s + {i + 1}]" for i, w in enumerate(weights))
    return f"CASE WHEN len(near) >= 9 THEN {terms} END"


_SG = f""", n AS (SELECT *, LIST(value) OVER (w ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS near,
    COUNT(*) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l FROM frames WINDOW w AS (PARTITION BY "Record", series ORDER BY t)),
    p AS (SELECT *, LEAST(GREATEST(l, 4), len(near) - 5) - 4 AS s FROM n),
    sg AS (SELECT "Record", series, t, value, {_weights_sql(functionals.SLOPE_WEIGHTS)} AS slope,
    {_weights_sql(functionals.CURVE_WEIGHTS)} AS curve FROM p)"""


@query("WN3_WN4_savitzky_golay", FRAMES + _SG + " SELECT * FROM sg", "value, slope, curve")
def _(spark, sf):
    return functionals.savitzky_golay(B.frames(spark, sf))


_CEPSTRAL = ", ".join(f"{p}{c}" for p in ("", "Delta_", "Delta2_") for c in ("mean", "stdev", "skew", "kurtosis"))


@query("AG11_cepstral_functionals", FRAMES + _SG + f""" SELECT "Record", series, {moments_sql("value", "", 0)}, {moments_sql("slope", "Delta_", 0)},
    {moments_sql("curve", "Delta2_", 0)} FROM sg GROUP BY "Record", series""", _CEPSTRAL)
def _(spark, sf):
    return functionals.cepstral_functionals(B.frames(spark, sf))


@query("JN8_hconcat", FRAMES + _DELTAS + """, a AS (SELECT "Record", AVG(value) AS f0_mean FROM frames GROUP BY "Record"),
    b AS (SELECT "Record", AVG(delta1) AS d1_mean FROM d GROUP BY "Record") SELECT a."Record", f0_mean, d1_mean FROM a JOIN b ON a."Record" = b."Record" """,
    "f0_mean, d1_mean")
def _(spark, sf):
    frames = B.frames(spark, sf)
    a = functionals.to_wide(functionals.functionals(frames), ["F0"]).select("Record", F.col("F0_mean").alias("f0_mean"))
    b = functionals.to_wide(functionals.delta_stats(frames), ["F0"]).select("Record", F.col("F0_Delta1_mean").alias("d1_mean"))
    return functionals.join_record_tables(a, b)


_FLOOR, _CEIL, _FACTOR = 5.0, 400.0, 3.0


def _pairs_sql(span: int, usable: str, factor: float) -> str:
    shift = [f"{'LAG' if k < 0 else 'LEAD'}(value, {abs(k)}) OVER w AS v{'m' if k < 0 else ''}{abs(k)}"
             for k in range(-span, span + 1) if k]
    def v(k):
        return f"v{'m' if k < 0 else ''}{abs(k)}"
    oks = [f"COALESCE(GREATEST({v(k - 1)}, {v(k)}) / NULLIF(LEAST({v(k - 1)}, {v(k)}), 0) <= {factor}::DOUBLE AND "
           f"{usable.format(x=v(k - 1))} AND {usable.format(x=v(k))}, FALSE) AS ok{'m' if k < 0 else ''}{abs(k)}"
           for k in range(-span + 1, span + 1)]
    return (f", nb AS (SELECT *, value AS v0, {', '.join(shift)} FROM frames WINDOW w AS (PARTITION BY \"Record\", series ORDER BY t)), "
            f"o AS (SELECT *, {', '.join(oks)} FROM nb)")


def _all_ok(a: int, b: int) -> str:
    return " AND ".join(f"ok{'m' if k < 0 else ''}{abs(k)}" for k in range(a + 1, b + 1))


def _gap_sql(h: int) -> str:
    total = " + ".join(f"v{'m' if k < 0 else ''}{abs(k)}" for k in range(-h, h + 1))
    return f"AVG(CASE WHEN {_all_ok(-h, h)} THEN ABS(v0 - ({total}) / {2 * h + 1}.0::DOUBLE) END)"


_USABLE = f"({{x}} BETWEEN {_FLOOR}::DOUBLE AND {_CEIL}::DOUBLE)"


@query("WN5_jitter", FRAMES + _pairs_sql(2, _USABLE, _FACTOR) + f""", j AS (SELECT "Record", series,
    AVG(CASE WHEN ok0 THEN ABS(v0 - vm1) END) AS a1, {_gap_sql(1)} AS rap, {_gap_sql(2)} AS ppq,
    AVG(CASE WHEN ok0 AND ok1 THEN ABS(v1 - 2 * v0 + vm1) END) AS ddp, AVG(CASE WHEN {_USABLE.format(x='v0')} THEN v0 END) AS lv
    FROM o GROUP BY "Record", series) SELECT "Record", series, a1 / lv AS "Local_jitter", a1 AS "Local_absolute_jitter",
    rap / lv AS "RAP_jitter", ppq / lv AS "PPQ5_jitter", ddp / lv AS "DDP_jitter" FROM j""",
    "Local_jitter, Local_absolute_jitter, RAP_jitter, PPQ5_jitter, DDP_jitter")
def _(spark, sf):
    return perturbation.jitter(B.frames(spark, sf), _FLOOR, _CEIL, _FACTOR)


@query("WN5_shimmer", FRAMES + _pairs_sql(5, "({x} > 0)", 4.0) + f""", j AS (SELECT "Record", series,
    AVG(CASE WHEN ok0 THEN ABS(v0 - vm1) END) AS a1, AVG(CASE WHEN ok0 THEN ABS(20 * LOG10(v0 / vm1)) END) AS db,
    {_gap_sql(1)} AS q3, {_gap_sql(2)} AS q5, {_gap_sql(5)} AS q11,
    AVG(CASE WHEN ok0 AND ok1 THEN ABS(v1 - 2 * v0 + vm1) END) AS dda, AVG(v0) AS lv FROM o GROUP BY "Record", series)
    SELECT "Record", series, a1 / lv AS "Local_shimmer", db AS "Local_dB_shimmer", q3 / lv AS "APQ3_shimmer", q5 / lv AS "APQ5_shimmer",
    q11 / lv AS "APQ11_shimmer", dda / lv AS "DDA_shimmer" FROM j""",
    "Local_shimmer, Local_dB_shimmer, APQ3_shimmer, APQ5_shimmer, APQ11_shimmer, DDA_shimmer")
def _(spark, sf):
    return perturbation.shimmer(B.frames(spark, sf), 4.0)


# ---- ranks and distributions --------------------------------------------------------------------

_RANKED = """, ranked AS (SELECT "Feature", "Diagnosed", value, RANK() OVER (PARTITION BY "Feature" ORDER BY value)
    + (COUNT(*) OVER (PARTITION BY "Feature", value) - 1) / 2.0::DOUBLE AS mid_rank FROM long)"""


def _long(spark, sf):
    return C.unpivot(B.cohort(spark, sf), FEATS, ["Diagnosed"]).filter(F.col("value").isNotNull())


@query("WN6_mid_rank", LONG + _RANKED + """ SELECT "Feature", value, COUNT(*) AS n, MAX(mid_rank) AS mid_rank FROM ranked GROUP BY "Feature", value""",
       "value, mid_rank")
def _(spark, sf):
    return mid_rank(_long(spark, sf), ["Feature"], "value").select("Feature", "value", "n", "mid_rank")


@query("WN6_mid_rank_split", LONG + _RANKED + """ SELECT "Feature", value, COUNT(*) AS n, MAX(mid_rank) AS mid_rank FROM ranked GROUP BY "Feature", value""",
       "value, mid_rank")
def _(spark, sf):
    return mid_rank(_long(spark, sf), ["Feature"], "value", rows_per_bucket=2000).select("Feature", "value", "n", "mid_rank")


_ECDF = """, e AS (SELECT "Feature", value, SUM(CASE WHEN "Diagnosed" = 'Control' THEN 1 ELSE 0 END) AS c, SUM(CASE WHEN "Diagnosed" = 'Control' THEN 0 ELSE 1 END) AS p
    FROM long GROUP BY "Feature", value),
    r AS (SELECT "Feature", SUM(c) OVER w AS cc, SUM(p) OVER w AS cp, SUM(c) OVER (PARTITION BY "Feature") AS tc, SUM(p) OVER (PARTITION BY "Feature") AS tp
    FROM e WINDOW w AS (PARTITION BY "Feature" ORDER BY value))"""


@query("WN7_ecdf_gap", LONG + _ECDF + ' SELECT "Feature", MAX(ABS(cc / CAST(tc AS DOUBLE) - cp / CAST(tp AS DOUBLE))) AS "Statistic" FROM r GROUP BY "Feature"', "Statistic")
def _(spark, sf):
    df = B.cohort(spark, sf)
    return stats.ks_test(C.filter_class(df, "Control"), C.filter_class(df, "Pathological"), FEATS, label=None, method="asymptotic").select(
        "Feature", "Statistic")


_RANK_SUM = LONG + _RANKED + f""", s AS (SELECT "Feature", CAST(COUNT(*) FILTER ("Diagnosed" = 'Control') AS DOUBLE) AS n1,
    CAST(COUNT(*) FILTER ("Diagnosed" <> 'Control') AS DOUBLE) AS n2, SUM(mid_rank) FILTER ("Diagnosed" = 'Control') AS r1 FROM ranked GROUP BY "Feature"),
    k AS (SELECT "Feature", SUM(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT "Feature", value, COUNT(*) AS c FROM long GROUP BY "Feature", value) GROUP BY "Feature"),
    z AS (SELECT s."Feature", n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, SQRT(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM s JOIN k ON s."Feature" = k."Feature"),
    t AS (SELECT *, (GREATEST(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5::DOUBLE) / sd AS z FROM z)"""


@query("ST1_mann_whitney", _RANK_SUM + f"""
    SELECT "Feature", CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u AS "U", z, {normal_sql('z')} AS "P-Value" FROM t""", "U, z, P-Value")
def _(spark, sf):
    return stats.mann_whitney(B.cohort(spark, sf), FEATS)


@query("SO1_ST2_statistical_selection", _RANK_SUM + f""", s2 AS (SELECT "Feature", {normal_sql('z')} AS "P-Value" FROM t)
    SELECT *, LEAST(1.0::DOUBLE, "P-Value" * COUNT(*) OVER ()) AS "Adjusted P-Value", "P-Value" <= 0.05::DOUBLE / COUNT(*) OVER () AS "Reject Null Hypothesis" FROM s2""",
    "P-Value, Adjusted P-Value")
def _(spark, sf):
    return stats.statistical_selection(B.cohort(spark, sf), FEATS)


@query("ST2_bonferroni", """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS "Feature", MIN(value) / 500.0::DOUBLE AS "P-Value" FROM events GROUP BY user_id)
    SELECT *, LEAST(1.0::DOUBLE, "P-Value" * COUNT(*) OVER ()) AS "Adjusted P-Value", "P-Value" <= 0.05::DOUBLE / COUNT(*) OVER () AS "Reject Null Hypothesis" FROM p""",
    "P-Value, Adjusted P-Value")
def _(spark, sf):
    p = B.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("Feature")).agg(
        (F.min("value") / 500.0).alias("P-Value"))
    return stats.bonferroni(p)


_SPLIT_ECDF = f""", b AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {hash_sql('"Record"', '42')}, "Record") <= CEIL(0.5::DOUBLE * COUNT(*) OVER ()) AS side FROM cohort),
    pl AS (SELECT * FROM (SELECT * FROM b WHERE "Diagnosed" = 'Pathological') UNPIVOT (value FOR "Feature" IN ({", ".join(f'"{c}"' for c in FEATS)}))),
    e AS (SELECT "Feature", value, SUM(CASE WHEN side THEN 1 ELSE 0 END) AS c, SUM(CASE WHEN side THEN 0 ELSE 1 END) AS p FROM pl GROUP BY "Feature", value),
    r AS (SELECT "Feature", SUM(c) OVER w AS cc, SUM(p) OVER w AS cp, CAST(SUM(c) OVER (PARTITION BY "Feature") AS DOUBLE) AS tc, CAST(SUM(p) OVER (PARTITION BY "Feature") AS DOUBLE) AS tp
    FROM e WINDOW w AS (PARTITION BY "Feature" ORDER BY value)),
    g AS (SELECT "Feature", MAX(ABS(cc / tc - cp / tp)) AS d, MAX(tc) AS ta, MAX(tp) AS tb FROM r GROUP BY "Feature")"""


@query("ST3_ks_test", with_sql("cohort") + _SPLIT_ECDF + f""" SELECT "Feature", d AS "Statistic", {kolmogorov_sql('d', 'ta', 'tb')} AS "P-Value",
    {kolmogorov_sql('d', 'ta', 'tb')} < 0.05::DOUBLE AS "Significant" FROM g""", "Statistic, P-Value")
def _(spark, sf):
    df = train_test_split(B.cohort(spark, sf), 0.5, 42)
    return stats.ks_test(df.filter("is_test").drop("is_test"), df.filter(~F.col("is_test")).drop("is_test"), FEATS, method="asymptotic")


# ---- prediction metrics -------------------------------------------------------------------------

DOCS = with_sql("docs")
PRED = with_sql("predictions")
_CELLS = """COUNT(*) FILTER (y = 0 AND p = 0) AS tn, COUNT(*) FILTER (y = 0 AND p = 1) AS fp,
    COUNT(*) FILTER (y = 1 AND p = 0) AS fn, COUNT(*) FILTER (y = 1 AND p = 1) AS tp"""
METRIC_FLOATS = "Accuracy, Weighted Balanced Accuracy, Sensitivity, Specificity, F1"


def metrics_sql(keys: str) -> str:
    def ratio(a, b):
        return f"CASE WHEN {b} > 0 THEN ({a}) / CAST({b} AS DOUBLE) ELSE 0.0::DOUBLE END"
    sens, spec = ratio("tp", "(tp + fn)"), ratio("tn", "(tn + fp)")
    return (f"SELECT {keys}{ratio('tp + tn', '(tp + tn + fp + fn)')} AS \"Accuracy\", ({sens} + {spec}) / 2 AS \"Weighted Balanced Accuracy\", "
            f"{sens} AS \"Sensitivity\", {spec} AS \"Specificity\", {ratio('2 * tp', '(2 * tp + fp + fn)')} AS \"F1\" FROM cells")


@query("AG19_confusion", DOCS + f" SELECT {_CELLS} FROM docs")
def _(spark, sf):
    return metrics.confusion(B.labelled_docs(spark, sf))


@query("AG20_metrics", DOCS + f", cells AS (SELECT {_CELLS} FROM docs) " + metrics_sql(""), METRIC_FLOATS)
def _(spark, sf):
    return metrics.metric_columns(metrics.confusion(B.labelled_docs(spark, sf)))


@query("AG20_metric_functions", DOCS + f", cells AS (SELECT {_CELLS} FROM docs) " + metrics_sql(""), METRIC_FLOATS)
def _(spark, sf):
    return B.labelled_docs(spark, sf).agg(*[f().alias(n) for n, f in metrics.METRIC_FUNCTIONS.items()])


_METRICS = (f', cells AS (SELECT "Model", "Method", "Execution", {_CELLS} FROM predictions GROUP BY "Model", "Method", "Execution"), '
            'metrics AS (' + metrics_sql('"Model", "Method", "Execution" AS "Number of execution", ') + ')')


def metrics_table(spark, sf):
    return metrics.compute_all_metrics(B.predictions(spark, sf))


@query("AG21_compute_all_metrics", PRED + _METRICS + " SELECT * FROM metrics", METRIC_FLOATS)
def _(spark, sf):
    return metrics_table(spark, sf)


_AUC = """, rk AS (SELECT {k} y, RANK() OVER ({p} ORDER BY score) + (COUNT(*) OVER ({q}) - 1) / 2.0::DOUBLE AS mr FROM {t} WHERE score IS NOT NULL)
    , auc AS (SELECT {k} (SUM(mr) FILTER (y = 1) - SUM(y) * (SUM(y) + 1) / 2.0::DOUBLE) / (SUM(y) * CAST(SUM(1 - y) AS DOUBLE)) AS "AUC" FROM rk {g})"""


@query("AG21_metrics_with_auc", PRED + _METRICS + _AUC.format(
    k='"Model", "Method", "Execution",', p='PARTITION BY "Model", "Method", "Execution"', q='PARTITION BY "Model", "Method", "Execution", score',
    t="predictions", g='GROUP BY "Model", "Method", "Execution"') + """ SELECT m.*, a."AUC" FROM metrics m JOIN auc a ON m."Model" = a."Model"
    AND m."Method" = a."Method" AND m."Number of execution" = a."Execution" """, METRIC_FLOATS + ", AUC")
def _(spark, sf):
    return metrics.compute_all_metrics(B.predictions(spark, sf), score="score")


@query("AG22_auc_roc", DOCS + _AUC.format(k="", p="", q="PARTITION BY score", t="docs", g="") + ' SELECT * FROM auc', "AUC")
def _(spark, sf):
    return metrics.auc_roc(B.labelled_docs(spark, sf))


def roc_sql(keys: list[str], source: str) -> str:
    k = "".join(f'"{c}", ' for c in keys)
    part = f"PARTITION BY {k[:-2]}" if keys else ""
    return f""", c AS (SELECT {k} score, SUM(y) AS pos, SUM(1 - y) AS neg FROM {source} GROUP BY {k} score),
    q AS (SELECT {k} score, pos, neg, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, CAST(SUM(pos) OVER ({part}) AS DOUBLE) AS n1,
    CAST(SUM(neg) OVER ({part}) AS DOUBLE) AS n0 FROM c WINDOW w AS ({part} ORDER BY score DESC)),
    roc AS (SELECT {k} score, (fp - neg) / n0 AS fpr0, (tp - pos) / n1 AS tpr0, fp / n0 AS fpr, tp / n1 AS tpr FROM q)"""


@query("WN13_roc_points", DOCS + roc_sql([], "docs") + " SELECT * FROM roc", "score, fpr0, tpr0, fpr, tpr")
def _(spark, sf):
    return metrics.roc_points(B.labelled_docs(spark, sf))


@query("WN14_trapezoid", DOCS + roc_sql([], "docs") + ' SELECT SUM((fpr - fpr0) * (tpr + tpr0) / 2) AS "AUC" FROM roc', "AUC")
def _(spark, sf):
    return metrics.trapezoid_auc(metrics.roc_points(B.labelled_docs(spark, sf)))


@query("PD9_roc_comparison", PRED + roc_sql(["Model"], "predictions") + " SELECT * FROM roc", "score, fpr0, tpr0, fpr, tpr")
def _(spark, sf):
    return metrics.roc_points(B.predictions(spark, sf), ["Model"])


ROC_GRID = """, grid AS (SELECT CAST(g AS INTEGER) AS g, g / 99.0::DOUBLE AS x FROM range(0, 100) r(g)),
    onto AS (SELECT "Model", "Execution", grid.g, grid.x, CASE WHEN grid.g = 0 THEN 0.0::DOUBLE ELSE tpr0 + (x - fpr0) * ((tpr - tpr0) / (fpr - fpr0)) END AS tpr
    FROM roc JOIN grid ON x >= fpr0 AND x < fpr UNION ALL SELECT DISTINCT "Model", "Execution", 99, 1.0::DOUBLE, 1.0::DOUBLE FROM roc),
    curve AS (SELECT "Model", g, x, AVG(tpr) AS tpr, STDDEV_POP(tpr) AS std_tpr FROM onto GROUP BY "Model", g, x)"""


@query("EV5_mean_roc_curve", PRED + roc_sql(["Model", "Execution"], "predictions") + ROC_GRID + """ SELECT *, GREATEST(0.0::DOUBLE, tpr - std_tpr) AS lower,
    LEAST(1.0::DOUBLE, tpr + std_tpr) AS upper FROM curve""", "x, tpr, std_tpr, lower, upper")
def _(spark, sf):
    return metrics.mean_roc(B.predictions(spark, sf), "Execution")[0]


ROC_SUMMARY = """,
    fa AS (SELECT "Model", "Execution", SUM((fpr - fpr0) * (tpr + tpr0) / 2) AS auc FROM roc GROUP BY "Model", "Execution"),
    sd AS (SELECT "Model", STDDEV_POP(auc) AS std_auc FROM fa GROUP BY "Model"),
    ma AS (SELECT "Model", SUM(tpr * CASE WHEN g IN (0, 99) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) / 99.0::DOUBLE AS mean_auc FROM curve GROUP BY "Model")
    SELECT ma."Model", mean_auc, std_auc FROM ma JOIN sd ON ma."Model" = sd."Model" """


@query("EV5_mean_roc_summary", PRED + roc_sql(["Model", "Execution"], "predictions") + ROC_GRID + ROC_SUMMARY, "mean_auc, std_auc")
def _(spark, sf):
    return metrics.mean_roc(B.predictions(spark, sf), "Execution")[1]


# ---- summaries ----------------------------------------------------------------------------------

_COLS = ["Number of execution", "Accuracy", "Weighted Balanced Accuracy", "Sensitivity", "Specificity", "F1"]


@query("AG13_mean_by", PRED + _METRICS + ' SELECT "Model", "Method", ' + ", ".join(f'AVG("{c}") AS "{c}"' for c in _COLS)
       + ' FROM metrics GROUP BY "Model", "Method"', ", ".join(_COLS))
def _(spark, sf):
    return metrics.mean_by(metrics_table(spark, sf))


@query("AG13_std_by", PRED + _METRICS + ' SELECT "Model", "Method", ' + ", ".join(f'STDDEV_SAMP("{c}") AS "{c}"' for c in _COLS)
       + ' FROM metrics GROUP BY "Model", "Method"', ", ".join(_COLS))
def _(spark, sf):
    return metrics.std_by(metrics_table(spark, sf))


_LOO = """, loo AS (SELECT "Model", "Record", "Execution", y AS "True_Label", p AS "Predicted", CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a FROM predictions),
    ls AS (SELECT "Model", AVG(a) AS "LOO_Mean", STDDEV_SAMP(a) AS "LOO_Std", QUANTILE_CONT(a, 0.5) AS "LOO_Median",
    QUANTILE_CONT(a, 0.75) - QUANTILE_CONT(a, 0.25) AS "LOO_IQR" FROM loo GROUP BY "Model")"""
LOO_FLOATS = "LOO_Mean, LOO_Std, LOO_Median, LOO_IQR"


def loo_table(spark, sf):
    p = B.predictions(spark, sf)
    return p.select("Model", "Record", "Execution", F.col("y").alias("True_Label"), F.col("p").alias("Predicted"),
                    (F.col("y") == F.col("p")).cast("int").alias("Accuracy"))


_AGG_COLS = [f"{c}_{s}" for c in _COLS for s in ("mean", "std")]


@query("AG14_JN3_aggregate_metrics", PRED + _METRICS + _LOO + ', am AS (SELECT "Model", ' + ", ".join(
    f'AVG("{c}") AS "{c}_mean", STDDEV_SAMP("{c}") AS "{c}_std"' for c in _COLS) + """ FROM metrics GROUP BY "Model")
    SELECT am.*, "LOO_Mean", "LOO_Std", "LOO_Median", "LOO_IQR" FROM am LEFT JOIN ls ON am."Model" = ls."Model" """, ", ".join(_AGG_COLS) + ", " + LOO_FLOATS)
def _(spark, sf):
    return metrics.aggregate_metrics(metrics_table(spark, sf), loo_table(spark, sf))


@query("AG15_loo_metrics", PRED + _LOO + " SELECT * FROM ls", LOO_FLOATS)
def _(spark, sf):
    return metrics.loo_metrics(loo_table(spark, sf))


@query("AG16_loo_summary", PRED + _LOO + """, pe AS (SELECT "Model", "Execution", AVG(a) AS a FROM loo GROUP BY "Model", "Execution")
    SELECT "Model", AVG(a) AS "Mean", STDDEV_SAMP(a) AS "Std", QUANTILE_CONT(a, 0.5) AS "Median", QUANTILE_CONT(a, 0.75) - QUANTILE_CONT(a, 0.25) AS "IQR",
    MIN(a) AS "Min", MAX(a) AS "Max", QUANTILE_CONT(a, 0.25) AS "Q1", QUANTILE_CONT(a, 0.75) AS "Q3", COUNT(DISTINCT "Execution") AS "N_Executions"
    FROM pe GROUP BY "Model" """, "Mean, Std, Median, IQR, Min, Max, Q1, Q3")
def _(spark, sf):
    return metrics.loo_summary(loo_table(spark, sf))


_PATIENT = "Patient_Accuracy_Mean, Patient_Accuracy_Std, Patient_Accuracy_Median, Patient_Accuracy_IQR"
# customers stand in for patients: several orders each
_BY_CUSTOMER = """, pc AS (SELECT "Model", o_custkey AS customer, CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit
    FROM predictions JOIN orders ON "Record" = o_orderkey), pa AS (SELECT {k} customer, AVG(hit) AS a FROM pc GROUP BY {k} customer)
    SELECT {k} AVG(a) AS "Patient_Accuracy_Mean", STDDEV_SAMP(a) AS "Patient_Accuracy_Std", QUANTILE_CONT(a, 0.5) AS "Patient_Accuracy_Median",
    QUANTILE_CONT(a, 0.75) - QUANTILE_CONT(a, 0.25) AS "Patient_Accuracy_IQR" FROM pa {g}"""


def _customer_predictions(spark, sf):
    orders = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("Record"), F.col("o_custkey").alias("customer"))
    return B.predictions(spark, sf).join(orders, "Record")


@query("AG17_patient_accuracy", PRED + _BY_CUSTOMER.format(k='"Model",', g='GROUP BY "Model"'), _PATIENT)
def _(spark, sf):
    return metrics.patient_accuracy(_customer_predictions(spark, sf), True, "customer", "y", "p")


@query("AG17_patient_accuracy_overall", PRED + _BY_CUSTOMER.format(k="", g=""), _PATIENT)
def _(spark, sf):
    return metrics.patient_accuracy(_customer_predictions(spark, sf), False, "customer", "y", "p")


_MISS = """, pm AS (SELECT "Record", "Model", AVG(CASE WHEN p = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS "Misclassified" FROM predictions GROUP BY "Record", "Model")"""


@query("AG18_misclassification_per_patient", PRED + _MISS + " SELECT * FROM pm", "Misclassified")
def _(spark, sf):
    return metrics.misclassification(labelled_predictions(spark, sf))[0]


@query("AG18_misclassification_per_model", PRED + _MISS + ' SELECT "Model", AVG("Misclassified") AS "Misclassified" FROM pm GROUP BY "Model"', "Misclassified")
def _(spark, sf):
    return metrics.misclassification(labelled_predictions(spark, sf))[1]


@query("AG23_distinct_patients", with_sql("cohort") + """ SELECT DISTINCT "Record" FROM cohort WHERE "Diagnosed" = 'Pathological'""")
def _(spark, sf):
    from ..operators.assemble import distinct_patients
    return distinct_patients(C.flag_original(B.cohort(spark, sf)))


@query("AG24_best_model", PRED + _METRICS + ' SELECT * FROM metrics ORDER BY "Accuracy" DESC, "Model", "Method", "Number of execution" LIMIT 1', METRIC_FLOATS)
def _(spark, sf):
    return metrics.best_model(metrics_table(spark, sf))


_TALL = ", tall AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "Metric", "Method", "Model", "{c}" AS score FROM metrics""" for c in metrics.METRICS) + """),
    per AS (SELECT "Metric", "Method", "Model", COUNT(score) AS n, AVG(score) AS m, VAR_SAMP(score) AS v FROM tall GROUP BY "Metric", "Method", "Model"),
    pairs AS (SELECT a."Metric", a."Method", a."Model" AS "Model 1", b."Model" AS "Model 2", a.n AS n1, a.m AS m1, a.v AS v1, b.n AS n2, b.m AS m2, b.v AS v2
    FROM per a JOIN per b ON a."Metric" = b."Metric" AND a."Method" = b."Method" AND a."Model" < b."Model")"""


@query("JN5_model_pairs", PRED + _METRICS + _TALL + " SELECT * FROM pairs", "m1, v1, m2, v2")
def _(spark, sf):
    return stats.model_pairs(metrics_table(spark, sf))


_T_SQL = PRED + _METRICS + _TALL + """ SELECT "Metric", "Method", "Model 1", "Model 2", CAST(n1 + n2 - 2 AS DOUBLE) AS dof,
    (m1 - m2) / NULLIF(SQRT(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 0) AS "T-statistic"
    FROM pairs WHERE n1 > 1 AND n2 > 1"""


@query("ST4_t_test_statistic", _T_SQL, "dof, T-statistic")
def _(spark, sf):
    return stats.t_test_pairs(metrics_table(spark, sf)).select("Metric", "Method", "Model 1", "Model 2", "dof", "T-statistic")


@query("ST4_t_test_pairs", f"""SELECT *, COALESCE("P-value" < 0.05::DOUBLE, FALSE) AS "Significant", CASE WHEN "T-statistic" > 0 THEN "Model 1"
    WHEN "T-statistic" IS NOT NULL THEN "Model 2" END || CASE WHEN "P-value" < 0.05::DOUBLE THEN '*' ELSE '' END AS "Better Model"
    FROM (SELECT *, CASE WHEN dof = 8 THEN {student8_sql('"T-statistic"')} END AS "P-value" FROM ({_T_SQL}) AS a) AS b""",
       "dof, T-statistic, P-value")
def _(spark, sf):
    return stats.t_test_pairs(metrics_table(spark, sf))


def _poisson_sql(u: str) -> str:
    import math
    total, term, parts = 0.0, math.exp(-1.0), []
    for k in range(12):
        total += term
        parts.append(f"CASE WHEN {u} >= {total!r}::DOUBLE THEN 1 ELSE 0 END")
        term /= k + 1
    return "(" + " + ".join(parts) + ")"


_BOOT_CELLS = "SUM(CASE WHEN y = {a} AND p = {b} THEN w ELSE 0 END)"


@query("ST5_bootstrap_ci", DOCS + f""", wt AS (SELECT b, y, p, {_poisson_sql("u")} AS w FROM (SELECT b, y, p,
    CAST('0x' || substr(md5(CAST("Record" AS VARCHAR) || ':42:' || CAST(b AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM docs, range(0, 100) r(b))),
    cells AS (SELECT b, {_BOOT_CELLS.format(a=0, b=0)} AS tn, {_BOOT_CELLS.format(a=0, b=1)} AS fp, {_BOOT_CELLS.format(a=1, b=0)} AS fn, {_BOOT_CELLS.format(a=1, b=1)} AS tp FROM wt GROUP BY b),
    m AS ({metrics_sql("b, ")}), tall AS (""" + " UNION ALL ".join(f"""SELECT '{c}' AS "Metric", "{c}" AS s FROM m""" for c in metrics.METRICS) + """)
    SELECT "Metric", AVG(s) AS mean, STDDEV_POP(s) AS std, QUANTILE_CONT(s, 0.025) AS ci_lower, QUANTILE_CONT(s, 0.975) AS ci_upper FROM tall GROUP BY "Metric" """,
    "mean, std, ci_lower, ci_upper")
def _(spark, sf):
    return stats.bootstrap_ci(B.labelled_docs(spark, sf), method="poisson")


@query("ST5_bootstrap_ci_cells")
def _(spark, sf):
    return stats.bootstrap_ci(B.labelled_docs(spark, sf))


# ---- scalers ------------------------------------------------------------------------------------

_SCALED = list(FEATS)


def _scaler(name: str, method: str, centre: str, spread: str):
    cols = ", ".join(f'("{c}" - {centre.format(c=c)}) / {spread.format(c=c)} AS "{c}"' for c in _SCALED)

    @query(f"{name}_{method}", with_sql("cohort") + f' SELECT "Record", {cols} FROM cohort', ", ".join(_SCALED))
    def _(spark, sf):
        return scale.Scaler(method).fit_transform(B.cohort(spark, sf).select("Record", *_SCALED))


def _over(f: str) -> str:
    return f"(SELECT {f} FROM cohort)"


_scaler("SL1", "standard", _over('AVG("{c}")'), _over('STDDEV_POP("{c}")'))
_scaler("SL2", "minmax", _over('MIN("{c}")'), _over('MAX("{c}") - MIN("{c}")'))
_scaler("SL3", "robust", _over('QUANTILE_CONT("{c}", 0.5)'), _over('QUANTILE_CONT("{c}", 0.75) - QUANTILE_CONT("{c}", 0.25)'))


@query("SL3_quantiles", LONG + """ SELECT "Feature", QUANTILE_CONT(value, 0.1) AS q10, QUANTILE_CONT(value, 0.5) AS q50, QUANTILE_CONT(value, 0.9) AS q90 FROM long GROUP BY "Feature" """,
       "q10, q50, q90")
def _(spark, sf):
    return quantiles(_long(spark, sf), ["Feature"], "value", {"q10": 0.1, "q50": 0.5, "q90": 0.9}, rows_per_bucket=4000)


@query("SL5_inverse_transform", with_sql("cohort") + ' SELECT "Record", ' + ", ".join(f'"{c}"' for c in _SCALED) + " FROM cohort", ", ".join(_SCALED))
def _(spark, sf):
    df = B.cohort(spark, sf).select("Record", *_SCALED)
    s = scale.Scaler("minmax").fit(df)
    return s.inverse_transform(s.transform(df))


@query("SL6_standardize_split", with_sql("cohort") + f""", b AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {hash_sql('"Record"', '42')}, "Record")
    <= CEIL(0.2::DOUBLE * COUNT(*) OVER ()) AS is_test FROM cohort) SELECT "Record", is_test, """ + ", ".join(
    f'("{c}" - (SELECT AVG("{c}") FROM b WHERE NOT is_test)) / (SELECT STDDEV_POP("{c}") FROM b WHERE NOT is_test) AS "{c}"' for c in _SCALED) + " FROM b", ", ".join(_SCALED))
def _(spark, sf):
    df = train_test_split(B.cohort(spark, sf).select("Record", *_SCALED), 0.2, 42)
    train, test, _s = scale.standardize_split(df.filter(~F.col("is_test")), df.filter("is_test"), features=_SCALED)
    return train.unionByName(test)


for _method, _sql, _names in (
    ("standard", 'AVG(value) AS "Mean", STDDEV_POP(value) AS "Scale"', "Mean, Scale"),
    ("minmax", 'MIN(value) AS "Min", MAX(value) AS "Max", 1.0::DOUBLE / (MAX(value) - MIN(value)) AS "Scale"', "Min, Max, Scale"),
    ("robust", 'QUANTILE_CONT(value, 0.5) AS "Center", QUANTILE_CONT(value, 0.75) - QUANTILE_CONT(value, 0.25) AS "Scale"', "Center, Scale"),
):
    def _stats(spark, sf, method=_method):
        return scale.feature_stats(B.cohort(spark, sf), method, FEATS)

    query(f"SL7_feature_stats_{_method}", LONG + f' SELECT "Feature", {_sql} FROM long GROUP BY "Feature"', _names)(_stats)


@query("AG_running_totals", LONG + """, n AS (SELECT "Feature", value, COUNT(*) AS c FROM long GROUP BY "Feature", value)
    SELECT "Feature", value, CAST(SUM(c) OVER (PARTITION BY "Feature" ORDER BY value) AS BIGINT) AS cum FROM n""", "value")
def _(spark, sf):
    counts = _long(spark, sf).groupBy("Feature", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "counts")  # sized, cut and summed: derived once
    return running(counts, ["Feature"], ["value"], {"cum": F.col("n")}, rows_per_bucket=1000).drop("n")
