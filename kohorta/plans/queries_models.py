"""Neighbours, resampling, selection, models, evaluation loops and plot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluate, models, neighbours, plotdata, resample, search, select, split
from ..operators.metrics import compute_all_metrics
from ..operators.scale import Scaler
from ..session import materialise
from . import bindings as B
from .bindings import with_sql
from .forest_sql import EDGES_SQL, bins_sql, elimination_sql, forest_sql, tree_rows
from .queries_stats import ROC_GRID, ROC_SUMMARY, corr_sql, roc_sql
from .queries_tables import hash_sql
from .registry import query
from .workflow import run_study

FEATS = B.COHORT_FEATURES
LONG, VECTORS = with_sql("long"), with_sql("vectors")
WIDE = [f"e{i:02d}" for i in range(64)]

# ---- nearest neighbours -------------------------------------------------------------------------

_PAIRS = """, near AS (SELECT * FROM (SELECT q."Record", t."Record" AS neighbour, t.label, ROUND(list_distance(q.v, t.v), 9) AS distance,
    CAST(ROW_NUMBER() OVER (PARTITION BY q."Record" ORDER BY ROUND(list_distance(q.v, t.v), 9), t."Record") AS INTEGER) AS neighbour_rank
    FROM vectors q JOIN vectors t ON q."Record" <> t."Record") WHERE neighbour_rank <= {k})"""


@query("JN6_knn_join", VECTORS + _PAIRS.format(k=5) + ' SELECT "Record", neighbour_rank, neighbour, distance FROM near', "distance")
def _(spark, sf):
    v = B.vectors(spark, sf)
    return neighbours.knn_join(v, v, 5, exclude="Record")


@query("JN6_knn_join_cells", VECTORS + _PAIRS.format(k=5) + ' SELECT "Record", neighbour_rank, neighbour, distance FROM near', "distance")
def _(spark, sf):
    v = B.vectors(spark, sf)
    return neighbours.knn_join(v, v, 5, exclude="Record", broadcast_bytes=0, block_rows=128)


@query("JN6_knn_join_manhattan", VECTORS + """, d AS (SELECT q."Record", t."Record" AS neighbour,
    ROUND(list_sum(list_transform(list_zip(q.v, t.v), lambda z: ABS(z[1] - z[2]))), 9) AS distance FROM vectors q JOIN vectors t ON q."Record" <> t."Record")
    SELECT * FROM (SELECT "Record", neighbour, distance, CAST(ROW_NUMBER() OVER (PARTITION BY "Record" ORDER BY distance, neighbour) AS INTEGER) AS neighbour_rank FROM d)
    WHERE neighbour_rank <= 3""", "distance")
def _(spark, sf):
    v = B.vectors(spark, sf)
    return neighbours.knn_join(v, v, 3, metric="manhattan", exclude="Record")


_VOTES = """ SELECT "Record", AVG(CAST(label AS DOUBLE)) AS score, CASE WHEN AVG(CAST(label AS DOUBLE)) > 0.5::DOUBLE THEN 1 ELSE 0 END AS "Predicted" FROM near GROUP BY "Record" """


@query("ML7_knn_classifier", VECTORS + f""", s AS (SELECT *, {hash_sql('"Record"', '42')} % 10000 < 2000 AS is_test FROM vectors),
    near AS (SELECT * FROM (SELECT q."Record", t.label, ROW_NUMBER() OVER (PARTITION BY q."Record" ORDER BY ROUND(list_distance(q.v, t.v), 9), t."Record") AS r
    FROM s q JOIN s t ON q.is_test AND NOT t.is_test) WHERE r <= 5)""" + _VOTES, "score")
def _(spark, sf):
    s = split.hash_split(B.vectors(spark, sf), 0.2, 42)
    return neighbours.knn_predict(s.filter("is_test"), s.filter(~F.col("is_test")), 5)


@query("ML7_knn_classifier_weighted", VECTORS + _PAIRS.format(k=5) + """ SELECT "Record", SUM(label / distance) / SUM(1.0::DOUBLE / distance) AS score,
    CASE WHEN SUM(label / distance) / SUM(1.0::DOUBLE / distance) > 0.5::DOUBLE THEN 1 ELSE 0 END AS "Predicted" FROM near GROUP BY "Record" """, "score")
def _(spark, sf):
    v = B.vectors(spark, sf)
    return neighbours.knn_predict(v, v, 5, weights="distance", exclude="Record")


def _vector_table(spark, sf, *extra):
    v = B.vectors(spark, sf)
    from pyspark.ml.functions import array_to_vector
    return v.select(F.col("Record").alias("row_id"), "Record", F.lit(False).alias("Is_SMOTE"), "label",
                    array_to_vector("v").alias("features"), *extra)


_LEFT_OUT = VECTORS + _PAIRS.format(k=5) + """, vote AS (SELECT "Record", CASE WHEN AVG(CAST(label AS DOUBLE)) > 0.5::DOUBLE THEN 1 ELSE 0 END AS p FROM near GROUP BY "Record")"""


@query("EV2_leave_patient_out", _LEFT_OUT + """ SELECT vectors."Record", 'KNearestNeighbor' AS "Model", 'Pathological' AS "True_Label",
    CASE p WHEN 1 THEN 'Pathological' ELSE 'Control' END AS "Predicted" FROM vectors JOIN vote ON vectors."Record" = vote."Record" WHERE label = 1""")
def _(spark, sf):
    return evaluate.leave_patient_out("KNearestNeighbor", _vector_table(spark, sf))


@query("EV2_leave_group_out_knn", VECTORS + """, g AS (SELECT *, "Record" % 50 AS grp FROM vectors),
    near AS (SELECT * FROM (SELECT q."Record", t.label, ROW_NUMBER() OVER (PARTITION BY q."Record" ORDER BY ROUND(list_distance(q.v, t.v), 9), t."Record") AS r
    FROM g q JOIN g t ON q.grp <> t.grp) WHERE r <= 5)""" + _VOTES, "score")
def _(spark, sf):
    g = B.vectors(spark, sf).withColumn("grp", F.col("Record") % 50)
    return neighbours.knn_predict(g, g, 5, exclude="grp", broadcast_bytes=0, block_rows=200)


@query("EV3_leave_one_out", _LEFT_OUT + """ SELECT vectors."Record", CASE WHEN p = label THEN 1 ELSE 0 END AS "Accuracy", label AS "True_Label", p AS "Predicted",
    'KNearestNeighbor' AS "Model", 1 AS "Execution", FALSE AS "Is_SMOTE" FROM vectors JOIN vote ON vectors."Record" = vote."Record" """)
def _(spark, sf):
    return evaluate.leave_one_out("KNearestNeighbor", _vector_table(spark, sf))


_PERSON = VECTORS + """, g AS (SELECT *, "Record" // 2 AS person FROM vectors),
    near AS (SELECT * FROM (SELECT q."Record", t.label, ROW_NUMBER() OVER (PARTITION BY q."Record" ORDER BY ROUND(list_distance(q.v, t.v), 9), t."Record") AS r
    FROM g q JOIN g t ON {apart}) WHERE r <= 5),
    vote AS (SELECT "Record", CASE WHEN AVG(CAST(label AS DOUBLE)) > 0.5::DOUBLE THEN 1 ELSE 0 END AS p FROM near GROUP BY "Record")"""


def _people(spark, sf):
    """Two recordings of each person."""
    return _vector_table(spark, sf).withColumn("Record", F.floor(F.col("Record") / 2))


@query("EV2_leave_patient_out_repeated", _PERSON.format(apart="q.person <> t.person") + """ SELECT person AS "Record", 'KNearestNeighbor' AS "Model", 'Pathological' AS "True_Label",
    CASE p WHEN 1 THEN 'Pathological' ELSE 'Control' END AS "Predicted" FROM g JOIN vote ON g."Record" = vote."Record" WHERE label = 1""")
def _(spark, sf):
    return evaluate.leave_patient_out("KNearestNeighbor", _people(spark, sf))


@query("EV3_leave_one_out_repeated", _PERSON.format(apart='q."Record" <> t."Record"') + """ SELECT person AS "Record", CASE WHEN p = label THEN 1 ELSE 0 END AS "Accuracy", label AS "True_Label", p AS "Predicted",
    'KNearestNeighbor' AS "Model", 1 AS "Execution", FALSE AS "Is_SMOTE" FROM g JOIN vote ON g."Record" = vote."Record" """)
def _(spark, sf):
    return evaluate.leave_one_out("KNearestNeighbor", _people(spark, sf))


def _scaled_sql(target: str = """CASE WHEN "Diagnosed" = 'Pathological' THEN 1 ELSE 0 END""", features=None) -> str:
    """CTEs up to `rows` and `cells` (see forest_sql) of the complete cohort, standardised."""
    features = features or FEATS
    complete = " AND ".join(f'"{c}" IS NOT NULL' for c in FEATS)
    cols = ", ".join(f'("{c}" - AVG("{c}") OVER ()) / (CASE WHEN STDDEV_POP("{c}") OVER () = 0 THEN 1 ELSE STDDEV_POP("{c}") OVER () END) AS "{c}"'
                     for c in features)
    return with_sql("cohort") + f""", complete AS (SELECT * FROM cohort WHERE {complete}), scaled AS MATERIALIZED (SELECT "Record", {target} AS label, {cols} FROM complete),
    """ + bins_sql("scaled", features, '"Record"', "label", hash_sql('"Record"', "0"))


_VECTOR_ROWS = VECTORS + f""", fv AS MATERIALIZED (SELECT "Record" AS row, UNNEST(range(0, 64))::INTEGER AS f, UNNEST(v) AS x FROM vectors),
    {EDGES_SQL}, rows AS MATERIALIZED (SELECT "Record" AS row, {hash_sql('"Record"', '0')} AS h, label AS y FROM vectors)"""


def _fold_sql(k: int, source: str, seed: int = 42) -> str:
    """CTEs of k stratified folds: trees, allowed, used and held; the seed of a tree is the fold that it hasn't seen."""
    return f"""folded AS MATERIALIZED (SELECT row, (ROW_NUMBER() OVER (PARTITION BY label ORDER BY h, row) - 1) % {k} AS fold FROM
    (SELECT "Record" AS row, label, {hash_sql('"Record"', str(seed))} AS h FROM {source})),
    trees AS MATERIALIZED (SELECT k AS tree, k AS seed, 0 AS number FROM range(0, {k}) t(k)),
    used AS MATERIALIZED (SELECT t.seed, row FROM trees t JOIN folded ON fold <> seed), held AS MATERIALIZED (SELECT fold AS seed, row FROM folded)"""


def _allowed_sql(d: int) -> str:
    return f"allowed AS MATERIALIZED (SELECT seed, f FROM (SELECT DISTINCT seed FROM trees), (SELECT UNNEST(range(0, {d}))::INTEGER AS f))"


@query("EV3_leave_one_out_folds", _VECTOR_ROWS + ", " + _fold_sql(10, "vectors") + ", " + _allowed_sql(64) + ", "
       + forest_sql("t_", "trees", "allowed", "used", 64, tried="all", bootstrap=False, held="held")
       + """ SELECT row AS "Record", CASE WHEN (ROUND(score, 9) > 0.5::DOUBLE) = (y = 1) THEN 1 ELSE 0 END AS "Accuracy", y AS "True_Label",
    CASE WHEN ROUND(score, 9) > 0.5::DOUBLE THEN 1 ELSE 0 END AS "Predicted", 'DecisionTree' AS "Model", 1 AS "Execution", FALSE AS "Is_SMOTE"
    FROM t_score JOIN rows USING (row)""")
def _(spark, sf):
    return evaluate.leave_one_out("DecisionTree", _vector_table(spark, sf))


@query("EV2_leave_patient_out_exact", _VECTOR_ROWS + """, trees AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row) AS tree, row AS seed, 0 AS number FROM rows WHERE y = 1),
    used AS MATERIALIZED (SELECT seed, row FROM trees JOIN rows ON row <> seed), held AS MATERIALIZED (SELECT seed, seed AS row FROM trees), """ + _allowed_sql(64) + ", "
       + forest_sql("t_", "trees", "allowed", "used", 64, 3, tried="all", bootstrap=False, held="held")
       + """ SELECT row AS "Record", 'DecisionTree' AS "Model", 'Pathological' AS "True_Label",
    CASE WHEN ROUND(score, 9) > 0.5::DOUBLE THEN 'Pathological' ELSE 'Control' END AS "Predicted" FROM t_score""")
def _(spark, sf):
    """A tree of depth three for every record, each without the record; none is grown whole."""
    return evaluate.leave_patient_out("DecisionTree", _vector_table(spark, sf), {"max_depth": 3}, folds=None)


# ---- resampling ---------------------------------------------------------------------------------

def _wide_draw(tag: str) -> str:
    return f"CAST('0x' || substr(md5(CAST(d AS VARCHAR) || ':42:{tag}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


def _draw(tag: str) -> str:
    return f"CAST('0x' || substr(md5(CAST(d AS VARCHAR) || ':42:{tag}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


_ROWS = """, rows AS (SELECT CAST("Record" AS VARCHAR) AS rid, "Diagnosed", v FROM vectors), mino AS (SELECT rid, v FROM rows WHERE "Diagnosed" = 'Pathological'),
    size AS (SELECT (SELECT COUNT(*) FROM mino) AS n_min, (SELECT COUNT(*) FROM rows) - 2 * (SELECT COUNT(*) FROM mino) AS n_new)"""
_DANGER = """, danger AS (SELECT rid FROM (SELECT q.rid, t."Diagnosed" AS other, ROW_NUMBER() OVER (PARTITION BY q.rid ORDER BY ROUND(list_distance(q.v, t.v), 9), t.rid) AS r
    FROM mino q JOIN rows t ON q.rid <> t.rid) WHERE r <= 10 GROUP BY rid HAVING COUNT(*) FILTER (other <> 'Pathological') BETWEEN 5 AND 9),
    start AS (SELECT mino.* FROM mino JOIN danger ON mino.rid = danger.rid)"""
_ALL_START = ", start AS (SELECT * FROM mino)"
_SMOTE = f""", mate AS (SELECT * FROM (SELECT q.rid, t.rid AS mate, t.v AS w, ROW_NUMBER() OVER (PARTITION BY q.rid ORDER BY ROUND(list_distance(q.v, t.v), 9), t.rid) AS r
    FROM start q JOIN mino t ON q.rid <> t.rid) WHERE r <= 7),
    placed AS (SELECT rid, v, ROW_NUMBER() OVER (ORDER BY rid) - 1 AS pos FROM start),
    draws AS (SELECT d, CAST(FLOOR({_wide_draw('row')} * (SELECT COUNT(*) FROM start)) AS BIGINT) AS pos, CAST(FLOOR({_draw('neighbour')} * 7) AS BIGINT) + 1 AS r, {_draw('step')} AS step
    FROM range(0, (SELECT n_new FROM size)) t(d)),
    made AS (SELECT 's:' || CAST(d AS VARCHAR) AS row_id, 'SMOTE' AS "Record", 'Pathological' AS "Diagnosed", TRUE AS "Is_SMOTE",
    list_transform(list_zip(p.v, m.w), lambda z: z[1] + step * (z[2] - z[1])) AS v FROM draws JOIN placed p ON draws.pos = p.pos JOIN mate m ON m.rid = p.rid AND m.r = draws.r),
    resampled AS (SELECT 'o:' || rid AS row_id, rid AS "Record", "Diagnosed", FALSE AS "Is_SMOTE", v FROM rows UNION ALL SELECT * FROM made)"""
_NN = """, nn AS (SELECT * FROM (SELECT q.row_id, t.row_id AS mate, q."Diagnosed" AS own, t."Diagnosed" AS other,
    ROW_NUMBER() OVER (PARTITION BY q.row_id ORDER BY ROUND(list_distance(q.v, t.v), 9), t.row_id) AS r FROM resampled q JOIN resampled t ON q.row_id <> t.row_id) WHERE r <= {k})"""
_TOMEK = _NN.format(k=1) + """, gone AS (SELECT a.row_id FROM nn a JOIN nn b ON a.mate = b.row_id AND b.mate = a.row_id WHERE a.own <> a.other)"""
_ENN = _NN.format(k=3) + """, gone AS (SELECT DISTINCT row_id FROM nn WHERE own <> other)"""
_OUT = ' SELECT row_id, "Record", "Diagnosed", "Is_SMOTE", ' + ", ".join(f"v[{i + 1}] AS {c}" for i, c in enumerate(WIDE)) + " FROM resampled"
_KEEP = " WHERE row_id NOT IN (SELECT row_id FROM gone)"

for _name, _method, _sql in (
    ("RS1_smote", "smote", _ALL_START + _SMOTE + _OUT),
    ("RS2_borderline_smote", "borderline_smote", _DANGER + _SMOTE + _OUT),
    ("RS3_smote_tomek", "smote_tomek", _ALL_START + _SMOTE + _TOMEK + _OUT + _KEEP),
    ("RS4_smote_enn", "smote_enn", _ALL_START + _SMOTE + _ENN + _OUT + _KEEP),
):
    def _resampled(spark, sf, method=_method):
        return resample.resample(B.wide_vectors(spark, sf), method, 7, 42, keep_row_id=True)

    query(_name, VECTORS + _ROWS + _sql, ", ".join(WIDE))(_resampled)


@query("RS1_smote_repeated_records", VECTORS + """, r AS (SELECT "Record" // 2 AS "Record", "Diagnosed" FROM vectors),
    n AS (SELECT COUNT(*) FILTER ("Diagnosed" = 'Control') AS c, COUNT(*) FILTER ("Diagnosed" = 'Pathological') AS p FROM r)
    SELECT CAST("Record" AS VARCHAR) AS "Record", "Diagnosed", FALSE AS "Is_SMOTE", COUNT(*) AS n, COUNT(*) AS row_ids FROM r GROUP BY ALL
    UNION ALL SELECT 'SMOTE', 'Pathological', TRUE, c - p, c - p FROM n""")
def _(spark, sf):
    """Two recordings of each person: as many new rows as the classes differ by, every row with an id of its own."""
    twice = B.wide_vectors(spark, sf).withColumn("Record", F.floor(F.col("Record") / 2))
    return resample.smote(twice, keep_row_id=True).groupBy("Record", "Diagnosed", "Is_SMOTE").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("row_ids"))


@query("RS2_danger_rows", VECTORS + _ROWS + _DANGER.replace("SELECT rid FROM (SELECT", "SELECT rid, COUNT(*) FILTER (other <> 'Pathological') AS other FROM (SELECT")
       .replace(", start AS (SELECT mino.* FROM mino JOIN danger ON mino.rid = danger.rid)", "") + " SELECT rid, other FROM danger")
def _(spark, sf):
    return resample.danger_rows(B.wide_vectors(spark, sf), "Pathological", WIDE)


@query("RS5_resample_disabled", VECTORS + ' SELECT "Record", "Diagnosed" FROM vectors')
def _(spark, sf):
    return resample.resample(B.vectors(spark, sf), enabled=False).select("Record", "Diagnosed")


@query("RS6_resampling_analysis", VECTORS + _ROWS + _ALL_START + _SMOTE + """, lb AS (SELECT UNNEST(v) AS x, GENERATE_SUBSCRIPTS(v, 1) - 1 AS i, 1 AS a FROM mino),
    la AS (SELECT UNNEST(v) AS x, GENERATE_SUBSCRIPTS(v, 1) - 1 AS i, 0 AS a FROM resampled WHERE "Diagnosed" = 'Pathological'),
    c AS (SELECT i, x, SUM(a) AS na, SUM(1 - a) AS nb FROM (SELECT * FROM lb UNION ALL SELECT * FROM la) GROUP BY i, x),
    g AS (SELECT i, ABS(SUM(na) OVER w / CAST(SUM(na) OVER (PARTITION BY i) AS DOUBLE) - SUM(nb) OVER w / CAST(SUM(nb) OVER (PARTITION BY i) AS DOUBLE)) AS gap FROM c WINDOW w AS (PARTITION BY i ORDER BY x))
    SELECT printf('e%02d', i) AS "Feature", MAX(gap) AS "Statistic" FROM g GROUP BY i""", "Statistic")
def _(spark, sf):
    before = B.wide_vectors(spark, sf)
    after = resample.resample(before)
    return resample.resampling_analysis(before, after, WIDE)["ks_tests"].select("Feature", "Statistic")


_RESAMPLED = VECTORS + _ROWS + _ALL_START + _SMOTE


@query("RS6_class_counts", _RESAMPLED + """ SELECT 'before' AS "Stage", "Diagnosed", COUNT(*) AS n FROM rows GROUP BY "Diagnosed"
    UNION ALL SELECT 'after', "Diagnosed", COUNT(*) FROM resampled GROUP BY "Diagnosed" """)
def _(spark, sf):
    before = B.wide_vectors(spark, sf)
    tables = resample.resampling_analysis(before, resample.resample(before), WIDE)
    return tables["before"].withColumn("Stage", F.lit("before")).unionByName(tables["after"].withColumn("Stage", F.lit("after"))) \
        .select("Stage", "Diagnosed", "n")


@query("RS6_class_balance", _RESAMPLED + """, b AS (SELECT COUNT(*) AS n FROM rows GROUP BY "Diagnosed"), a AS (SELECT COUNT(*) AS n FROM resampled GROUP BY "Diagnosed")
    SELECT (SELECT MIN(n) / MAX(n)::DOUBLE FROM b) AS ratio_before, (SELECT MIN(n) / MAX(n)::DOUBLE FROM a) AS ratio_after,
    (SELECT SUM(n)::BIGINT FROM b) AS rows_before, (SELECT SUM(n)::BIGINT FROM a) AS rows_after, (SELECT SUM(n)::BIGINT FROM a) - (SELECT SUM(n)::BIGINT FROM b) AS rows_added""",
       "ratio_before, ratio_after")
def _(spark, sf):
    before = B.wide_vectors(spark, sf)
    return resample.resampling_analysis(before, resample.resample(before), WIDE)["balance"]


# the share of lattice paths from (0, 0) to (n, m) that touch a gap of d: inside paths are counted a step at a time, as chances
_GAP_TAIL = """, sizes AS (SELECT n_min AS na, (SELECT COUNT(*) FROM resampled WHERE "Diagnosed" = 'Pathological') AS nb FROM size),
    lb AS (SELECT UNNEST(v) AS x, GENERATE_SUBSCRIPTS(v, 1) - 1 AS i, 1 AS a FROM mino),
    la AS (SELECT UNNEST(v) AS x, GENERATE_SUBSCRIPTS(v, 1) - 1 AS i, 0 AS a FROM resampled WHERE "Diagnosed" = 'Pathological'),
    c AS (SELECT i, x, SUM(a) AS na, SUM(1 - a) AS nb FROM (SELECT * FROM lb UNION ALL SELECT * FROM la) GROUP BY i, x),
    g AS (SELECT i, ABS(SUM(na) OVER w * (SELECT nb FROM sizes) - SUM(nb) OVER w * (SELECT na FROM sizes)) AS gap FROM c WINDOW w AS (PARTITION BY i ORDER BY x)),
    top AS (SELECT i AS feature, MAX(gap)::BIGINT AS gap FROM g GROUP BY i), bounds AS (SELECT DISTINCT gap AS bound FROM top WHERE gap > 0),
    walk AS (SELECT bound, na, nb, 0::BIGINT AS t, list_transform(range(0, na + 1), lambda k: CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, 0.0::DOUBLE AS hit FROM bounds, sizes
    UNION ALL SELECT bound, na, nb, t + 1, list_transform(s, lambda v, k: CASE WHEN ABS((k - 1) * nb - (t + 2 - k) * na) >= bound THEN 0.0::DOUBLE ELSE v END),
    hit + list_sum(list_transform(s, lambda v, k: CASE WHEN ABS((k - 1) * nb - (t + 2 - k) * na) >= bound THEN v ELSE 0.0::DOUBLE END))
    FROM (SELECT *, list_transform(p, lambda v, k: CASE WHEN t + 1 - k < 0 OR t + 1 - k > nb THEN 0.0::DOUBLE ELSE v * (1.0::DOUBLE - (na + 1 - k) / (na + nb - t)::DOUBLE) END
    + CASE WHEN k = 1 OR t + 2 - k < 0 OR t + 2 - k > nb THEN 0.0::DOUBLE ELSE p[k - 1] * ((na + 2 - k) / (na + nb - t)::DOUBLE) END) AS s FROM walk WHERE t < na + nb)),
    tails AS (SELECT bound, hit FROM walk WHERE t = na + nb)
    SELECT printf('e%02d', feature) AS "Feature", gap / (na * nb)::DOUBLE AS "Statistic", COALESCE(LEAST(1.0::DOUBLE, hit), 1.0::DOUBLE) AS "P-Value",
    COALESCE(LEAST(1.0::DOUBLE, hit), 1.0::DOUBLE) < 0.05::DOUBLE AS "Significant" FROM top CROSS JOIN sizes LEFT JOIN tails ON bound = gap"""


@query("RS6_exact_gap_tests", (_RESAMPLED + _GAP_TAIL).replace("WITH ", "WITH RECURSIVE ", 1), "Statistic, P-Value")
def _(spark, sf):
    before = B.wide_vectors(spark, sf)
    return resample.resampling_analysis(before, resample.resample(before), WIDE)["ks_tests"]


# ---- selection ----------------------------------------------------------------------------------

def _complete(spark, sf):
    return C.drop_missing(B.cohort(spark, sf))


def _xy(spark, sf, features=FEATS):
    complete = materialise(_complete(spark, sf), "cohort")  # read for the scales, the folds and the rows: derived once
    return models.prepare_xy(Scaler().fit_transform(complete, features), features)


_D = len(FEATS)
_NAMES_OF = f"(SELECT UNNEST({FEATS})  AS \"Feature\", UNNEST(range(0, {_D})) AS f)"


@query("FS1_rfe", _scaled_sql() + ", used AS (SELECT 42::BIGINT AS seed, row FROM rows), " + elimination_sql([42], _D, 3)
       + f""" SELECT "Feature", COALESCE(size - 2, 1)::INTEGER AS rank FROM {_NAMES_OF} LEFT JOIN edrop USING (f)""")
def _(spark, sf):
    table = models.training_table(_xy(spark, sf))
    ranking, _curve = select.rfe_path(table, len(FEATS), 42, 3)
    return spark.createDataFrame(list(zip(FEATS, ranking)), "Feature string, rank int")


@query("FS2_rfe_stability")
def _(spark, sf):
    return select.rfe_stability(models.training_table(_xy(spark, sf)), FEATS, 4, split.seeds(10))


def _seventy_sql(seeds) -> str:
    """CTEs used and held: the rows outside and inside each seed's 30 % of least hashes."""
    parts = " UNION ALL ".join(f"""SELECT {s}::BIGINT AS seed, "Record" AS row, ROW_NUMBER() OVER (ORDER BY {hash_sql('"Record"', str(s))}, "Record")
    <= CEIL(0.3::DOUBLE * COUNT(*) OVER ()) AS out FROM scaled""" for s in seeds)
    return f"parted AS MATERIALIZED ({parts}), used AS (SELECT seed, row FROM parted WHERE NOT out), held AS (SELECT seed, row FROM parted WHERE out)"


@query("FS3_PD8_rfe_curve", _scaled_sql() + ", " + _seventy_sql([42]) + ", " + elimination_sql([42], _D, 1, held="held")
       + f' SELECT size::INTEGER AS "Number of Features", error AS "Score" FROM eerr WHERE size < {_D}', "Score")
def _(spark, sf):
    return select.rfe_curve(_xy(spark, sf), len(FEATS))


def _psi(n: str) -> str:
    from ..functions.formulas import _SMALL_DIGAMMA
    table = "[" + ", ".join(f"({v!r})::DOUBLE" for v in _SMALL_DIGAMMA) + "]"
    x = f"CAST({n} AS DOUBLE)"
    i2 = f"(1.0::DOUBLE / ({x} * {x}))"
    return (f"(CASE WHEN {n} < 10 THEN {table}[CAST({n} AS INTEGER)] ELSE LN({x}) - 0.5::DOUBLE / {x} - {i2} * ({1 / 12!r}::DOUBLE - {i2} * "
            f"({1 / 120!r}::DOUBLE - {i2} * {1 / 252!r}::DOUBLE)) END)")


_MI = LONG + """, p AS (SELECT "Feature", "Diagnosed", value AS x, ROW_NUMBER() OVER w AS t, LAG(value, 1) OVER w AS l1, LAG(value, 2) OVER w AS l2, LAG(value, 3) OVER w AS l3,
    LEAD(value, 1) OVER w AS r1, LEAD(value, 2) OVER w AS r2, LEAD(value, 3) OVER w AS r3 FROM long WINDOW w AS (PARTITION BY "Feature", "Diagnosed" ORDER BY value)),
    g AS (SELECT *, list_sort(list_filter([x - l1, x - l2, x - l3, r1 - x, r2 - x, r3 - x], lambda y: y IS NOT NULL)) AS gaps FROM p),
    q AS (SELECT *, gaps[LEAST(3, len(gaps))] AS r FROM g),
    b AS (SELECT "Feature", "Diagnosed", t, r, CASE WHEN r1 - x = r THEN r1 WHEN r2 - x = r THEN r2 WHEN r3 - x = r THEN r3 ELSE x + r END AS hi,
    CASE WHEN x - l1 = r THEN l1 WHEN x - l2 = r THEN l2 WHEN x - l3 = r THEN l3 ELSE x - r END AS lo FROM q),
    ev AS (SELECT "Feature", value AS place, 1 AS side, 0 AS s, COUNT(*) AS n, NULL::VARCHAR AS "Diagnosed", NULL::BIGINT AS t FROM long GROUP BY "Feature", value
    UNION ALL SELECT "Feature", hi, CASE WHEN r = 0 THEN 2 ELSE 0 END, 1, 0, "Diagnosed", t FROM b
    UNION ALL SELECT "Feature", lo, CASE WHEN r = 0 THEN 0 ELSE 2 END, -1, 0, "Diagnosed", t FROM b),
    run AS (SELECT *, SUM(n) OVER (PARTITION BY "Feature" ORDER BY place, side) AS cum FROM ev),
    inside AS (SELECT "Feature", "Diagnosed", t, CAST(SUM(s * cum) AS BIGINT) AS m FROM run WHERE s <> 0 GROUP BY "Feature", "Diagnosed", t),
    pc AS (SELECT "Feature", "Diagnosed", COUNT(*) AS n, SUM(""" + _psi("m") + """) AS pm FROM inside GROUP BY "Feature", "Diagnosed"),
    tot AS (SELECT "Feature", CAST(SUM(n) AS BIGINT) AS total, SUM(pm) AS pm, SUM(n * """ + _psi("LEAST(3, n - 1)") + ") AS pk, SUM(n * " + _psi("n") + """) AS pn FROM pc GROUP BY "Feature")
    SELECT "Feature", GREATEST(0.0::DOUBLE, """ + _psi("total") + """ + (pk - pn - pm) / total) AS "Mutual Information" FROM tot"""


@query("FS4_mutual_information", _MI, "Mutual Information")
def _(spark, sf):
    return select.mutual_information(B.cohort(spark, sf), FEATS)


@query("FS4_binned_mutual_information", LONG + """, rk AS (SELECT "Feature", CASE WHEN "Diagnosed" = 'Pathological' THEN 1 ELSE 0 END AS y, RANK() OVER (PARTITION BY "Feature" ORDER BY value)
    + (COUNT(*) OVER (PARTITION BY "Feature", value) - 1) / 2.0::DOUBLE AS mr, CAST(COUNT(*) OVER (PARTITION BY "Feature") AS DOUBLE) AS n FROM long),
    c AS (SELECT "Feature", n, LEAST(31, FLOOR((mr - 0.5::DOUBLE) * 32 / n)) AS b, CAST(COUNT(*) AS DOUBLE) AS nb, CAST(SUM(y) AS DOUBLE) AS np FROM rk GROUP BY "Feature", n, b),
    m AS (SELECT *, SUM(np) OVER (PARTITION BY "Feature") AS tp FROM c)
    SELECT "Feature", SUM(CASE WHEN np > 0 THEN np / n * LN(np * n / (nb * tp)) ELSE 0 END + CASE WHEN nb > np THEN (nb - np) / n * LN((nb - np) * n / (nb * (n - tp))) ELSE 0 END) AS "Mutual Information"
    FROM m GROUP BY "Feature" """, "Mutual Information")
def _(spark, sf):
    return select.binned_mutual_information(B.cohort(spark, sf), FEATS)


@query("FS5_rf_importance", _scaled_sql() + ", " + _seventy_sql(split.seeds(10)) + f", trees AS MATERIALIZED ({tree_rows(split.seeds(10), 100)}), "
       + _allowed_sql(_D) + ", " + forest_sql("t_", "trees", "allowed", "used", _D)
       + f""" SELECT "Feature", AVG(weight) AS "Importance" FROM t_imp JOIN {_NAMES_OF} USING (f) GROUP BY "Feature" """, "Importance")
def _(spark, sf):
    return select.rf_importance(models.training_table(_xy(spark, sf)), FEATS, split.seeds(10))


@query("FS6_lasso")
def _(spark, sf):
    return select.lasso(_complete(spark, sf), FEATS)


_CFS = (with_sql("cohort").replace("WITH ", "WITH RECURSIVE ", 1)
        + """, coded AS (SELECT *, CASE WHEN "Diagnosed" = 'Pathological' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "_y" FROM cohort), m AS ("""
        + corr_sql([*FEATS, "_y"], "coded") + """), target AS (SELECT fi AS f, r FROM m WHERE fj = '_y')""")


@query("FS7_target_correlation", _CFS + ' SELECT f AS "Feature", r FROM target', "r")
def _(spark, sf):
    return select.target_correlation(B.cohort(spark, sf), FEATS)


@query("FS7_cfs", _CFS + """, o AS (SELECT f, ROW_NUMBER() OVER (ORDER BY ABS(r) DESC NULLS LAST, f) AS place FROM target),
    c AS (SELECT o.f, o.place, LIST(x.b) AS bad FROM o LEFT JOIN (SELECT fi AS a, fj AS b, r FROM m UNION ALL SELECT fj, fi, r FROM m) x
    ON x.a = o.f AND ABS(x.r) > 0.8::DOUBLE AND x.b <> '_y' GROUP BY o.f, o.place),
    walk AS (SELECT CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS kept UNION ALL
    SELECT w.place + 1, CASE WHEN list_has_any(w.kept, c.bad) THEN w.kept ELSE list_append(w.kept, c.f) END FROM walk w JOIN c ON c.place = w.place + 1),
    final AS (SELECT kept FROM walk ORDER BY place DESC LIMIT 1)
    SELECT CAST(GENERATE_SUBSCRIPTS(kept, 1) AS INTEGER) AS position, UNNEST(kept) AS "Feature" FROM final""")
def _(spark, sf):
    return select.cfs(B.cohort(spark, sf), features=FEATS)


@query("FS9_select_features")
def _(spark, sf):
    out = select.select_features(_complete(spark, sf), FEATS)
    return out["features_to_use"]


# ---- models -------------------------------------------------------------------------------------

def _parts(spark, sf):
    return models.training_table(split.hash_split(_xy(spark, sf), 0.2, 42))


_TEST = f"""({hash_sql('row', '42')} % 10000 < 2000)"""

for _key, _model, _trees_n, _tried in (("ML1", "RandomForest", 100, "sqrt"), ("ML2", "DecisionTree", 1, "all"), ("ML6", "Bagging", 10, "all")):
    def _rows(spark, sf, name=_model):
        """A model with its default parameters, fitted on four fifths and asked for the rest."""
        s = _parts(spark, sf)
        predict = models.fit(name, s.filter(~F.col("is_test")).select("Record", "label", "features"), {})
        return predict(s.filter("is_test").select("Record", "label", "features")).select("Record", "score", "Predicted")

    query(f"{_key}_{_model}_predictions", _scaled_sql().replace("quantile_cont(x,", f"quantile_cont(CASE WHEN NOT {_TEST} THEN x END,")
          + f""", trees AS MATERIALIZED ({tree_rows([42], _trees_n)}), used AS (SELECT 42::BIGINT AS seed, row FROM rows WHERE NOT {_TEST}),
    held AS (SELECT 42::BIGINT AS seed, row FROM rows WHERE {_TEST}), """ + _allowed_sql(_D) + ", "
          + forest_sql("t_", "trees", "allowed", "used", _D, tried=_tried, bootstrap=_model != "DecisionTree", held="held")
          + """ SELECT row AS "Record", score, CASE WHEN ROUND(score, 9) > 0.5::DOUBLE THEN 1 ELSE 0 END AS "Predicted" FROM t_score""", "score")(_rows)


#: What is asked: whether the lines' price adds up to more than the mean of all records; the sums themselves are held back.
_ASKED = [c for c in FEATS if c not in ("price_sum", "rev")]
_HELD = with_sql("cohort") + f""", complete AS (SELECT *, price_sum > AVG(price_sum) OVER () AS above FROM cohort WHERE price_std IS NOT NULL),
    s AS (SELECT * FROM complete WHERE {hash_sql('"Record"', '42')} % 10000 < 2000)
    SELECT '{{name}}' AS "Model", COUNT(*) AS n_test, COUNT(*) FILTER (above) AS positives, TRUE AS accurate, TRUE AS calibrated, TRUE AS metrics_agree FROM s"""


def _holdout(spark, sf, name: str):
    """A model with its default parameters, fitted on four fifths and asked for the rest. SQL can't state the fit; it
    states the rows asked, that at least 9 of 10 answers are right (one class has little more than half of the rows), that
    scores rank and are of the right size, and that each metric is the function of the answers it should be."""
    complete = _complete(spark, sf)
    complete = materialise(complete, "cohort")
    mean = complete.agg(F.avg("price_sum")).first()[0]
    label = F.when(F.col("price_sum") > mean, "Pathological").otherwise("Control")
    asked = complete.withColumn("Diagnosed", label)
    s = models.training_table(split.hash_split(models.prepare_xy(Scaler().fit_transform(asked, _ASKED), _ASKED), 0.2, 42))
    predict = models.fit(name, s.filter(~F.col("is_test")).drop("is_test"), {})
    rows = models.training_table(predict(s.filter("is_test").drop("is_test")).select(
        F.lit(name).alias("Model"), F.lit("hold-out").alias("Method"), F.lit(1).alias("Execution"),
        F.col("label").alias("y"), F.col("Predicted").alias("p"), "score"), "Model")
    metrics = compute_all_metrics(rows, score="score")
    y, p = F.col("y") == 1, F.col("p") == 1
    facts = rows.groupBy("Model").agg(
        F.count(F.lit(1)).alias("n_test"), F.count_if(y).alias("positives"), (F.avg((y == p).cast("int")) >= 0.9).alias("accurate"),
        ((F.avg(F.abs(F.col("score") - F.col("y"))) < 0.4) & (F.corr("score", F.col("y").cast("double")) > 0.8)).alias("calibrated"),
        F.avg((y == p).cast("int")).alias("_a"), (F.count_if(y & p) / F.count_if(y)).alias("_s"))
    near = lambda x, z: F.abs(F.col(x) - F.col(z)) < 1e-9
    return metrics.join(facts, "Model").select("Model", "n_test", "positives", "accurate", "calibrated",
                                               (near("Accuracy", "_a") & near("Sensitivity", "_s")).alias("metrics_agree"))


for _key, _model in (("ML1", "RandomForest"), ("ML2", "DecisionTree"), ("ML3", "GradientBoosting"), ("ML4", "XGBoost"),
                     ("ML4", "LightGBM"), ("ML5", "AdaBoost"), ("ML6", "Bagging"), ("ML7", "KNearestNeighbor"),
                     ("ML8", "SupportVectorMachine")):
    def _run(spark, sf, name=_model):
        return _holdout(spark, sf, name)

    query(f"{_key}_{_model}_holdout", _HELD.format(name=_model))(_run)


@query("HP1_random_search")
def _(spark, sf):
    best = search.random_search("DecisionTree", _xy(spark, sf), {"maxDepth": search.Range(2, 6)})
    return spark.createDataFrame([(k, str(v)) for k, v in best.items()], "parameter string, value string")


@query("HP2_swarm_search")
def _(spark, sf):
    ranges = {"maxDepth": search.Range(2, 5), "impurity": search.Choice("gini", "entropy")}
    best = search.swarm_search("DecisionTree", _xy(spark, sf), ranges)
    return spark.createDataFrame([(k, str(v)) for k, v in best.items()], "parameter string, value string")


@query("EV1_train_all")
def _(spark, sf):
    return evaluate.train_all(B.wide_vectors(spark, sf), ["KNearestNeighbor", "DecisionTree"])["metrics"]


@query("EV4_repeat_executions")
def _(spark, sf):
    return evaluate.repeat_executions(_complete(spark, sf), ["DecisionTree", "RandomForest"])["metrics"]


@query("EV5_cv_roc", _scaled_sql() + ", " + _fold_sql(5, "scaled") + ", " + _allowed_sql(_D) + ", "
       + forest_sql("t_", "trees", "allowed", "used", _D, tried="all", bootstrap=False, held="held")
       + """, predictions AS (SELECT 'DecisionTree' AS "Model", seed AS "Execution", y, score FROM t_score JOIN rows USING (row))"""
       + roc_sql(["Model", "Execution"], "predictions") + ROC_GRID + ROC_SUMMARY, "mean_auc, std_auc")
def _(spark, sf):
    return evaluate.cv_roc(_xy(spark, sf), ["DecisionTree"])[1]


@query("WF_run_study")
def _(spark, sf):
    tables = run_study(B.cohort(spark, sf), ["DecisionTree", "KNearestNeighbor"])
    return tables["metrics_aggregated"]


# ---- plot tables --------------------------------------------------------------------------------

@query("PD1_pca")
def _(spark, sf):
    coords, _share = plotdata.pca(_complete(spark, sf), FEATS)
    return coords.withColumns({c: F.abs(c) for c in ("PC1", "PC2")})


@query("PD1_pca_explained")
def _(spark, sf):
    return plotdata.pca(B.wide_vectors(spark, sf), WIDE, 3)[1]


@query("PD2_kernel_pca")
def _(spark, sf):
    coords, _share = plotdata.kernel_pca(B.wide_vectors(spark, sf), "rbf", WIDE, landmarks=64)
    return coords.withColumns({c: F.abs(c) for c in ("PC1", "PC2")})


@query("PD3_class_distribution", with_sql("cohort") + """ SELECT 'Before' AS "Stage", "Diagnosed", COUNT(*) AS n FROM cohort GROUP BY "Diagnosed"
    UNION ALL SELECT 'After', "Diagnosed", COUNT(*) FROM cohort WHERE price_std IS NOT NULL GROUP BY "Diagnosed" """)
def _(spark, sf):
    df = B.cohort(spark, sf)
    return plotdata.class_distribution(df, C.drop_missing(df))


_DENSITY = LONG + """, sides AS (SELECT 'Before' AS "Stage", "Feature", value FROM long UNION ALL SELECT 'After', l."Feature", l.value FROM long l
    JOIN cohort c ON l."Record" = c."Record" WHERE c.price_std IS NOT NULL),
    s AS (SELECT "Stage", "Feature", COUNT(*) AS n, POW(COUNT(*), -0.2::DOUBLE) * STDDEV_SAMP(value) AS h, MIN(value) AS a, MAX(value) AS b FROM sides GROUP BY "Stage", "Feature"),
    grid AS (SELECT s.*, CAST(g AS INTEGER) AS g, (a - 3 * h) + (b - a + 6 * h) * g / 199.0::DOUBLE AS x FROM s, range(0, 200) r(g))
    SELECT grid."Stage", grid."Feature", g, x, SUM(EXP(-0.5::DOUBLE * ((x - value) / h) * ((x - value) / h))) / MAX(n * h * SQRT(2 * PI())) AS density
    FROM grid JOIN sides ON grid."Stage" = sides."Stage" AND grid."Feature" = sides."Feature" GROUP BY grid."Stage", grid."Feature", g, x"""


@query("PD4_feature_density", _DENSITY, "x, density")
def _(spark, sf):
    df = B.cohort(spark, sf)
    return plotdata.feature_density(df, C.drop_missing(df))


@query("PD5_correlation_heatmap", with_sql("cohort") + " " + corr_sql(FEATS), "r")
def _(spark, sf):
    return plotdata.correlation_heatmap(B.cohort(spark, sf), len(FEATS))


@query("PD6_top_importance", LONG + """ SELECT "Feature", STDDEV_POP(value) / AVG(value) AS "Importance" FROM long GROUP BY "Feature" ORDER BY 2 DESC, 1 LIMIT 5""", "Importance")
def _(spark, sf):
    long = C.unpivot(B.cohort(spark, sf), FEATS, []).filter(F.col("value").isNotNull())
    weights = long.groupBy("Feature").agg((F.stddev_pop("value") / F.avg("value")).alias("Importance"))
    return plotdata.top_importance(weights, 5)


_BOX = with_sql("cohort") + """, q AS (SELECT "Diagnosed", QUANTILE_CONT(price_std, 0.25) AS q1, QUANTILE_CONT(price_std, 0.5) AS median, QUANTILE_CONT(price_std, 0.75) AS q3
    FROM cohort GROUP BY "Diagnosed"), p AS (SELECT c."Diagnosed", price_std AS value, q1, median, q3,
    price_std BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM cohort c JOIN q ON c."Diagnosed" = q."Diagnosed" WHERE price_std IS NOT NULL)"""


@query("PD7_boxplot_stats", _BOX + """ SELECT "Diagnosed", MAX(q1) AS q1, MAX(median) AS median, MAX(q3) AS q3, MIN(value) FILTER (inside) AS whisker_low,
    MAX(value) FILTER (inside) AS whisker_high, COUNT(*) FILTER (NOT inside) AS n_outliers FROM p GROUP BY "Diagnosed" """, "q1, median, q3, whisker_low, whisker_high")
def _(spark, sf):
    return plotdata.boxplot_stats(B.cohort(spark, sf), "price_std")[0]


@query("PD7_boxplot_outliers", _BOX + ' SELECT "Diagnosed", value FROM p WHERE NOT inside', "value")
def _(spark, sf):
    return plotdata.boxplot_stats(B.cohort(spark, sf), "price_std")[1]
