"""Scans and sinks, projections, joins, set operations, scalar functions, sorts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.formulas import hash32, kolmogorov_tail, normal_two_sided
from ..operators import assemble, clean, quality, split
from ..operators import select as S
from ..session import shared_dir
from ..sources import tables as IO
from . import bindings as B
from .bindings import with_sql
from .registry import query

FEATURES_SQL = ", ".join(f'"{c}"' for c in B.COHORT_FEATURES)
COHORT_FLOATS = ", ".join(B.COHORT_FEATURES)


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- scans and sinks ----------------------------------------------------------------------------

@query("SC1_read_dataset", "SELECT * FROM orders", "o_totalprice")
def _(spark, sf):
    return IO.read_dataset(spark, "orders.parquet", [f"{sf}/results/datasets", sf])


def _marker_file(spark, sf, label: str) -> str:
    path = scratch(spark, f"markers-{label.lower()}")
    IO.write_csv(C.filter_class(B.markers(spark, sf), label).drop("Diagnosed"), path)
    return path


_MARKER_SQL = (with_sql("markers") + ' SELECT CAST("Record" AS VARCHAR) AS "Record", ROUND("Pr01", 4) AS "Pr01", '
               'ROUND("Pr02", 4) AS "Pr02"{extra} FROM markers')


@query("SC2_read_markers", _MARKER_SQL.format(extra=', "Diagnosed"') + """ WHERE "Diagnosed" = 'Control'""", "Pr01, Pr02")
def _(spark, sf):
    return IO.read_markers(spark, _marker_file(spark, sf, "Control"), "Control")


@query("SC3_read_markers_checked", _MARKER_SQL.format(extra="") + """ WHERE "Diagnosed" = 'Pathological'""", "Pr01, Pr02")
def _(spark, sf):
    df = IO.read_markers(spark, _marker_file(spark, sf, "Pathological"))
    if IO.check_markers(df):
        raise ValueError("no marker columns")
    return df


@query("SC4_read_marker_groups", _MARKER_SQL.format(extra=', "Diagnosed"'), "Pr01, Pr02")
def _(spark, sf):
    return IO.read_marker_groups(spark, _marker_file(spark, sf, "Control"), _marker_file(spark, sf, "Pathological"))


_NAME = "list_extract(string_split(path, '/'), -1)"
_EXT = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1))"


@query("SC5_list_recordings", with_sql("recordings") + f"""
    SELECT path, length FROM recordings WHERE NOT starts_with({_NAME}, '.') AND {_EXT} IN ('.wav', '.mp3', '.flac')""")
def _(spark, sf):
    return IO.list_recordings(B.recordings(spark, sf))


@query("SC5_pick_recordings", with_sql("recordings") + f"""
    SELECT path, length FROM recordings WHERE {_NAME} IN ('en_5.mp3', 'fr_8.wav', 'en_12.wav', 'de_36.wav', 'es_60.wav')""")
def _(spark, sf):
    return IO.pick_recordings(B.recordings(spark, sf), ["en_5.mp3", "fr_8", "en_12", "de_36", "es_60"])


@query("SC6_validate_files", with_sql("recordings") + f"""
    SELECT path, CASE WHEN {_EXT} NOT IN ('.wav', '.mp3', '.flac', '.ogg') OR length = 0 THEN 'error' ELSE 'success' END AS severity,
    CASE WHEN {_EXT} NOT IN ('.wav', '.mp3', '.flac', '.ogg') THEN 'unsupported format' WHEN length = 0 THEN 'file is empty'
    ELSE 'valid' END AS message FROM recordings""")
def _(spark, sf):
    return IO.validate_files(B.recordings(spark, sf))


def _half_up(c: str) -> str:
    """Four decimals, halves of the shortest decimal form up, as CSV text has them."""
    return f'CAST(ROUND(CAST(CAST("{c}" AS VARCHAR) AS DECIMAL(30, 10)), 4) AS DECIMAL(30, 4))'


@query("SC7_write_dataset", with_sql("cohort") + ' SELECT "Record", "Diagnosed", ' + ", ".join(
    f'CAST({_half_up(c)} AS VARCHAR) AS "{c}" ' for c in B.COHORT_FEATURES) + " FROM cohort")
def _(spark, sf):
    df = B.cohort(spark, sf).select("Record", "Diagnosed", *B.COHORT_FEATURES)
    path = scratch(spark, "results")
    file = IO.write_result(df, path, "dataset", "dataset.csv")
    text = "Record bigint, Diagnosed string, " + ", ".join(f"{c} string" for c in B.COHORT_FEATURES)
    return spark.read.schema(text).option("header", True).csv(file)


@query("SC8_read_back", with_sql("cohort") + """ SELECT CAST("Record" AS VARCHAR) AS "Record", "Diagnosed", """ + ", ".join(
    f'CAST({_half_up(c)} AS DOUBLE) AS "{c}"' for c in B.COHORT_FEATURES) + " FROM cohort", COHORT_FLOATS)
def _(spark, sf):
    root = scratch(spark, "results")
    IO.write_result(B.cohort(spark, sf), root, "features", "features.csv")
    return IO.read_result(spark, root, "features", "features.csv")


@query("SC9_save_load_dataframe", with_sql("cohort") + f' SELECT "Record", "Diagnosed", {FEATURES_SQL} FROM cohort', COHORT_FLOATS)
def _(spark, sf):
    path = scratch(spark, "cohort") + ".parquet"
    IO.save_dataframe(B.cohort(spark, sf), path, "parquet")
    return IO.load_dataframe(spark, path)


@query("SC10_stage_outputs", with_sql("cohort") + """ SELECT 'dataset' AS name, COUNT(*) AS n FROM cohort
    UNION ALL SELECT 'dataset_clean', COUNT(*) FROM cohort WHERE price_std IS NOT NULL""")
def _(spark, sf):
    df = B.cohort(spark, sf)
    paths = IO.stage_outputs(scratch(spark, "run"), {"dataset": df, "dataset_clean": C.drop_missing(df)})
    parts = [spark.read.parquet(p).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, p in paths.items()]
    return assemble.concat_results(*parts)


_BAD_FRAMES = "bad AS (SELECT DISTINCT \"Record\" FROM frames WHERE value > 450.0::DOUBLE)"


@query("SC11_frames_from_records", with_sql("frames") + f""", {_BAD_FRAMES}
    SELECT "Record", COUNT(*) AS frames, AVG(value) AS mean FROM frames
    WHERE "Record" NOT IN (SELECT "Record" FROM bad) GROUP BY "Record" """, "mean")
def _(spark, sf):
    frames = B.frames(spark, sf).withColumn("value", F.when(F.col("value") <= 450.0, F.col("value")))
    good, _bad = IO.quarantine(frames)
    return good.groupBy("Record").agg(F.count(F.lit(1)).alias("frames"), F.avg("value").alias("mean"))


@query("SC11_quarantined_frames", with_sql("frames") + f""", {_BAD_FRAMES}
    SELECT "Record", COUNT(*) AS frames FROM frames WHERE "Record" IN (SELECT "Record" FROM bad) GROUP BY "Record" """)
def _(spark, sf):
    frames = B.frames(spark, sf).withColumn("value", F.when(F.col("value") <= 450.0, F.col("value")))
    _good, bad = IO.quarantine(frames)
    return bad.groupBy("Record").agg(F.count(F.lit(1)).alias("frames"))


# ---- projections and filters --------------------------------------------------------------------

@query("PR1_assign_label", with_sql("signal") + """ SELECT "Record", qty_sum, 'Pathological' AS "Diagnosed" FROM signal""", "qty_sum")
def _(spark, sf):
    return C.assign_label(B.signal(spark, sf).select("Record", "qty_sum"), 1)


@query("PR2_label_name", """SELECT vec_id, CASE label WHEN 0 THEN 'Control' WHEN 1 THEN 'Pathological' ELSE 'Unknown' END AS name
    FROM embeddings""")
def _(spark, sf):
    return B.table(spark, sf, "embeddings").select("vec_id", C.label_name(F.col("label")).alias("name"))


@query("PR3_reorder_columns", with_sql("markers") + ' SELECT "Record", "Diagnosed", "Pr02", "Pr01" FROM markers', "Pr01, Pr02")
def _(spark, sf):
    return C.reorder_columns(B.markers(spark, sf).select("Pr02", "Diagnosed", "Pr01", "Record"))


def _named(spark, df, names):
    """Rows counted per selected column: which columns a rule picks, read from the data."""
    return df.agg(*[F.count(f"`{c}`").alias(c) for c in names]).unpivot([], [F.col(f"`{c}`") for c in names], "name", "n")


@query("PR4_feature_columns", with_sql("long") + ' SELECT "Feature" AS name, COUNT(*) AS n FROM long GROUP BY "Feature"')
def _(spark, sf):
    df = B.cohort(spark, sf)
    return _named(spark, df, C.feature_columns(df))


@query("PR5_marker_columns", with_sql("long") + """ SELECT "Feature" AS name, COUNT(*) AS n FROM long
    WHERE starts_with("Feature", 'Pr') GROUP BY "Feature" """)
def _(spark, sf):
    df = B.cohort(spark, sf)
    return _named(spark, df, C.marker_columns(df))


@query("PR6_significant_markers", with_sql("cohort") + """ SELECT "Record", price_mean AS "Pr06", price_sum AS "Pr13" FROM cohort""",
       "Pr06, Pr13")
def _(spark, sf):
    return C.significant_markers(B.cohort(spark, sf).withColumnsRenamed({"price_mean": "Pr06", "price_sum": "Pr13"}))


@query("PR7_drop_columns", with_sql("cohort") + f" SELECT {FEATURES_SQL} FROM cohort", COHORT_FLOATS)
def _(spark, sf):
    return C.drop_columns(B.cohort(spark, sf), ["Record", "Diagnosed", "Is_SMOTE"])


@query("PR8_drop_missing", with_sql("cohort") + ' SELECT "Record", price_std, rev FROM cohort WHERE price_std IS NOT NULL', "price_std, rev")
def _(spark, sf):
    return C.drop_missing(B.cohort(spark, sf)).select("Record", "price_std", "rev")


_INF = "CASE WHEN disc_mean = 0 THEN 'infinity'::DOUBLE ELSE disc_mean END"


def _with_inf(spark, sf):
    d = F.col("disc_mean")
    return B.cohort(spark, sf).withColumn("disc_mean", F.when(d == 0, float("inf")).otherwise(d))


@query("PR9_inf_to_null", with_sql("cohort") + ' SELECT "Record", NULLIF(disc_mean, 0) AS disc_mean FROM cohort', "disc_mean")
def _(spark, sf):
    return C.inf_to_null(_with_inf(spark, sf)).select("Record", "disc_mean")


@query("PR10_filter_class", with_sql("cohort") + """ SELECT "Record", rev FROM cohort WHERE "Diagnosed" = 'Pathological'""", "rev")
def _(spark, sf):
    return C.filter_class(B.cohort(spark, sf), "Pathological").select("Record", "rev")


@query("PR11_project_selected", with_sql("cohort") + ' SELECT "Diagnosed", "Record", rev, "Pr01" FROM cohort', "rev, Pr01")
def _(spark, sf):
    return C.project_selected(B.cohort(spark, sf), ["rev", "Pr01", "absent"])


# a ranking table read off the data: features ordered by variation, stability = share of non-zero values
_RANKING = """, ranking AS (SELECT "Feature", AVG(value) / NULLIF(STDDEV_SAMP(value), 0) AS "Average Ranking",
    AVG(CASE WHEN value > 40000.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS "Stability Index" FROM long GROUP BY "Feature")"""


def _ranking(spark, sf):
    long = C.unpivot(B.cohort(spark, sf), B.COHORT_FEATURES, []).filter(F.col("value").isNotNull())
    return long.groupBy("Feature").agg(
        (F.avg("value") / F.nullif(F.stddev_samp("value"), F.lit(0.0))).alias("Average Ranking"),
        F.avg((F.col("value") > 40000).cast("double")).alias("Stability Index"))


@query("PR12_stable_filter", with_sql("long") + _RANKING + ' SELECT * FROM ranking WHERE "Stability Index" >= 0.4::DOUBLE',
       "Average Ranking, Stability Index")
def _(spark, sf):
    return S.stable_features(_ranking(spark, sf))


@query("PR13_positive_filter", with_sql("cohort") + ' SELECT "Record", "Pr02" AS value FROM cohort WHERE "Pr02" > 0', "value")
def _(spark, sf):
    return C.positive_values(B.cohort(spark, sf).select("Record", F.col("Pr02").alias("value")))


@query("PR14_flag_original", with_sql("markers") + ' SELECT "Record", "Diagnosed", FALSE AS "Is_SMOTE" FROM markers')
def _(spark, sf):
    return C.flag_original(B.markers(spark, sf).select("Record", "Diagnosed"))


_LABELLED = """, labelled AS (SELECT "Model", "Execution", "Record", CASE y WHEN 1 THEN 'Pathological' ELSE 'Control' END AS "True_Label",
    CASE p WHEN 1 THEN 'Pathological' ELSE 'Control' END AS "Predicted" FROM predictions)"""


def labelled_predictions(spark, sf):
    return B.predictions(spark, sf).select(
        "Model", "Execution", "Record", C.decode_label(F.col("y")).alias("True_Label"),
        C.decode_label(F.col("p")).alias("Predicted"))


@query("PR15_flag_misclassified", with_sql("predictions") + _LABELLED + """
    SELECT "Record", "Model", "Predicted", "Predicted" <> 'Pathological' AS "Misclassified" FROM labelled""")
def _(spark, sf):
    return C.flag_misclassified(labelled_predictions(spark, sf)).select("Record", "Model", "Predicted", "Misclassified")


@query("PR16_prepare_xy", with_sql("cohort") + """, complete AS (SELECT * FROM cohort WHERE price_std IS NOT NULL)
    SELECT "Record", CASE WHEN "Diagnosed" = 'Pathological' THEN 1 ELSE 0 END AS label, """ + ", ".join(
    f'("{c}" - (SELECT AVG("{c}") FROM complete)) / (SELECT STDDEV_POP("{c}") FROM complete) AS "{c}"' for c in B.COHORT_FEATURES)
    + " FROM complete", ", ".join(B.COHORT_FEATURES))
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    from ..operators.models import prepare_xy
    from ..operators.scale import Scaler
    df = C.drop_missing(B.cohort(spark, sf))
    xy = prepare_xy(Scaler().fit_transform(df, B.COHORT_FEATURES), B.COHORT_FEATURES)
    v = vector_to_array("features")
    return xy.select("Record", "label", *[v[i].alias(c) for i, c in enumerate(B.COHORT_FEATURES)])


# ---- joins --------------------------------------------------------------------------------------

@query("JN1_merge_features", with_sql("cohort") + ' SELECT "Record", qty_sum, rev, "Pr01", "Pr02", \'Control\' AS "Diagnosed" FROM cohort',
       "qty_sum, rev, Pr01, Pr02")
def _(spark, sf):
    signal = B.signal(spark, sf).select("Record", "qty_sum", "rev")
    return assemble.merge_features(signal, B.markers(spark, sf).select("Record", "Pr01", "Pr02"), "Control")


_SIDES = """, l AS (SELECT "Record", qty_sum FROM signal WHERE qty_sum > 100.0::DOUBLE),
    r AS (SELECT "Record", "Pr01" FROM markers WHERE "Pr01" > 200000.0::DOUBLE)"""


def _register_merge(how: str):
    sql_how = {"outer": "FULL OUTER"}.get(how, how.upper())

    @query(f"JN2_merge_on_record_{how}", with_sql("signal", "markers") + _SIDES + f"""
        SELECT COALESCE(l."Record", r."Record") AS "Record", qty_sum, "Pr01" FROM l {sql_how} JOIN r ON l."Record" = r."Record" """,
           "qty_sum, Pr01")
    def _(spark, sf):
        left = B.signal(spark, sf).select("Record", "qty_sum").filter("qty_sum > 100")
        right = B.markers(spark, sf).select("Record", "Pr01").filter("Pr01 > 200000")
        return assemble.merge_on_record(left, right, how)


for _how in ("inner", "left", "right", "outer"):
    _register_merge(_how)


@query("JN4_marker_lookup", with_sql("long") + """, m AS (SELECT CASE "Feature" WHEN 'rev' THEN 'Pr13' WHEN 'n_lines' THEN 'Pr99' ELSE "Feature" END AS marker, value FROM long)
    SELECT marker, COUNT(*) AS n, CASE marker WHEN 'Pr01' THEN 'Fundamental Frequency' WHEN 'Pr02' THEN 'Ratio of cycles in closing'
    WHEN 'Pr13' THEN 'Instability index' ELSE 'Unknown' END AS name FROM m WHERE starts_with(marker, 'Pr') GROUP BY marker""")
def _(spark, sf):
    df = B.cohort(spark, sf).withColumnsRenamed({"rev": "Pr13", "n_lines": "Pr99"})
    report = clean.marker_report(df, C.marker_columns(df))
    n = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return report.select(F.col("Marker").alias("marker"), (F.lit(n) - F.col("Missing")).alias("n"), F.col("Name").alias("name"))


@query("JN7_leave_group_out", with_sql("cohort") + """ SELECT "Record", rev FROM cohort WHERE "Record" NOT IN
    (SELECT "Record" FROM cohort WHERE "Diagnosed" = 'Pathological')""", "rev")
def _(spark, sf):
    df = B.cohort(spark, sf)
    return assemble.leave_group_out(df, assemble.distinct_patients(df)).select("Record", "rev")


@query("JN9_append_columns", with_sql("cohort") + ' SELECT "Record", "Diagnosed", FALSE AS "Is_SMOTE", rev FROM cohort', "rev")
def _(spark, sf):
    return C.flag_original(B.cohort(spark, sf).select("Record", "Diagnosed", "rev"))


@query("JN9_append_to_resampled", with_sql("cohort") + f""", complete AS (SELECT * FROM cohort WHERE {" AND ".join(f'"{c}" IS NOT NULL' for c in B.COHORT_FEATURES)}),
    n AS (SELECT COUNT(*) FILTER ("Diagnosed" = 'Control') AS c, COUNT(*) FILTER ("Diagnosed" = 'Pathological') AS p FROM complete)
    SELECT 'o:' || CAST("Record" AS VARCHAR) AS row_id, CAST("Record" AS VARCHAR) AS "Record", "Diagnosed", FALSE AS "Is_SMOTE" FROM complete
    UNION ALL SELECT 's:' || CAST(UNNEST(range(0, c - p)) AS VARCHAR), 'SMOTE', 'Pathological', TRUE FROM n""")
def _(spark, sf):
    """Record, class and origin of every row of a resampled matrix."""
    from ..operators import resample
    df = C.drop_missing(B.cohort(spark, sf))
    return resample.smote(df, features=B.COHORT_FEATURES, keep_row_id=True).select("row_id", "Record", "Diagnosed", "Is_SMOTE")


# ---- set operations -----------------------------------------------------------------------------

@query("SE1_concatenate_groups", with_sql("cohort") + """ SELECT "Record", "Diagnosed", rev, NULL::DOUBLE AS "Pr01" FROM cohort WHERE "Diagnosed" = 'Control'
    UNION ALL SELECT "Record", "Diagnosed", NULL, "Pr01" FROM cohort WHERE "Diagnosed" = 'Pathological'""", "rev, Pr01")
def _(spark, sf):
    df = B.cohort(spark, sf)
    return assemble.concatenate_groups(C.filter_class(df, "Control").select("Record", "Diagnosed", "rev"),
                                       C.filter_class(df, "Pathological").select("Record", "Diagnosed", "Pr01"))


@query("SE2_concat_results", with_sql("predictions") + ' SELECT "Model", "Record", p FROM predictions')
def _(spark, sf):
    p = B.predictions(spark, sf).select("Model", "Record", "p")
    return assemble.concat_results(*[p.filter(F.col("Model") == m) for m in B.RULES])


@query("SE4a_missing_columns", with_sql("signal") + """ SELECT 'Diagnosed' AS missing, COUNT(*) AS n FROM signal""")
def _(spark, sf):
    df = B.signal(spark, sf)
    absent = C.missing_columns(df)
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(c) for c in absent])).alias("missing"), "n")


@query("SE4b_invalid_labels", """SELECT o_orderpriority AS "Diagnosed", COUNT(*) AS n FROM orders
    WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY o_orderpriority""")
def _(spark, sf):
    df = B.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("Diagnosed"))
    return quality.invalid_labels(df, ["1-URGENT", "2-HIGH"])


@query("SE5_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem", "l_quantity")
def _(spark, sf):
    return B.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").dropDuplicates()


# ---- scalar functions ---------------------------------------------------------------------------

@query("SF1_encode_decode_label", with_sql("markers") + """ SELECT "Record", CASE WHEN "Diagnosed" = 'Pathological' THEN 1 ELSE 0 END AS code,
    "Diagnosed" AS label FROM markers""")
def _(spark, sf):
    code = C.encode_label(F.col("Diagnosed"))
    return B.markers(spark, sf).select("Record", code.alias("code"), C.decode_label(code).alias("label"))


@query("SF2_path_parts", with_sql("recordings") + f"""
    SELECT path, CASE WHEN regexp_matches({_NAME}, '^.+\\.[^.]*$') THEN regexp_extract({_NAME}, '^(.+)\\.[^.]*$', 1) ELSE {_NAME} END AS stem,
    {_EXT} AS extension, starts_with({_NAME}, '.') AS hidden,
    CASE WHEN regexp_matches(lower({_NAME}), '\\.(wav|mp3|flac)$') THEN {_NAME} ELSE {_NAME} || '.wav' END AS audio_name FROM recordings""")
def _(spark, sf):
    p = F.col("path")
    return B.recordings(spark, sf).select(
        "path", C.file_stem(p).alias("stem"), C.file_extension(p).alias("extension"), C.is_hidden(p).alias("hidden"),
        C.with_audio_suffix(C.file_name(p)).alias("audio_name"))


@query("SF4_fixed4", """SELECT o_orderkey, printf('%.4f', o_totalprice) AS text FROM orders""")
def _(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", C.fixed4(F.col("o_totalprice")).alias("text"))


@query("SF5_is_inf", with_sql("cohort") + """ SELECT "Record", disc_mean = 0 AS infinite, price_std IS NULL AS missing, ABS("Pr02") AS size FROM cohort""", "size")
def _(spark, sf):
    return _with_inf(spark, sf).select("Record", C.is_inf(F.col("disc_mean")).alias("infinite"),
                                       F.col("price_std").isNull().alias("missing"), F.abs("Pr02").alias("size"))


@query("SF6_clip_round_index", """SELECT c_custkey, CASE WHEN pos <= 0.5::DOUBLE THEN 'uniform' WHEN pos < 1.5::DOUBLE THEN 'distance' ELSE 'both' END AS choice
    FROM (SELECT c_custkey, c_acctbal / 3000.0::DOUBLE AS pos FROM customer)""")
def _(spark, sf):
    choices = F.array(F.lit("uniform"), F.lit("distance"), F.lit("both"))
    return B.table(spark, sf, "customer").select(
        "c_custkey", C.clip_round_index(F.col("c_acctbal") / F.lit(3000.0), choices).alias("choice"))


@query("SF7_clip_seed", "SELECT o_orderkey, GREATEST(100, LEAST(10000, o_orderkey)) AS seed FROM orders")
def _(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", C.clip_seed(F.col("o_orderkey"), 100, 10000).alias("seed"))


@query("SF8_log_exp", """SELECT o_orderkey, 20.0::DOUBLE * LOG10(o_totalprice) AS db, SQRT(o_totalprice) AS root, LN(o_totalprice) AS ln_price,
    EXP(-o_totalprice / 100000.0::DOUBLE) AS kernel FROM orders""", "db, root, ln_price, kernel")
def _(spark, sf):
    x = F.col("o_totalprice")
    return B.table(spark, sf, "orders").select(
        "o_orderkey", (20.0 * F.log10(x)).alias("db"), F.sqrt(x).alias("root"), F.ln(x).alias("ln_price"),
        F.exp(-x / 100000.0).alias("kernel"))


def erfc_sql(x: str) -> str:
    """1 - exp(-x^2) sum of x^(2n+1) / Gamma(n + 3/2), to the 15th decimal."""
    total = f"list_sum(list_transform(range(0, 160), lambda n: EXP((2 * n + 1) * LN({x}) - ({x}) * ({x}) - LGAMMA(n + 1.5::DOUBLE))))"
    return f"(CASE WHEN ({x}) = 0 THEN 1.0::DOUBLE WHEN ({x}) > 6 THEN 0.0::DOUBLE ELSE GREATEST(0.0::DOUBLE, 1.0::DOUBLE - {total}) END)"


def normal_sql(z: str) -> str:
    return f"LEAST(1.0::DOUBLE, {erfc_sql(f'(ABS({z}) / SQRT(2.0::DOUBLE))')})"


def kolmogorov_sql(d: str, n: str, m: str) -> str:
    lam = f"(({d}) * SQRT(({n}) * ({m}) / (({n}) + ({m}))))"
    return (f"CASE WHEN {lam} < 0.2::DOUBLE THEN 1.0::DOUBLE ELSE GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, "
            f"list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * "
            f"EXP(-2.0::DOUBLE * k * k * {lam} * {lam}))))) END")


@query("SF9_normal_tail", f"SELECT event_id, {normal_sql('(value / 100.0::DOUBLE)')} AS p FROM events", "p")
def _(spark, sf):
    return B.table(spark, sf, "events").select("event_id", normal_two_sided(F.col("value") / 100.0).alias("p"))


@query("SF9_kolmogorov_tail", "SELECT event_id, " + kolmogorov_sql("value / 1000.0::DOUBLE", "80.0::DOUBLE", "120.0::DOUBLE") + " AS p FROM events", "p")
def _(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", kolmogorov_tail(F.col("value") / 1000.0, F.lit(80.0), F.lit(120.0)).alias("p"))


def student8_sql(t: str) -> str:
    """Two-sided tail of Student's t with 8 degrees of freedom, by the finite series for even degrees."""
    c = f"(8.0::DOUBLE / (8.0::DOUBLE + {t} * {t}))"
    return f"(1.0::DOUBLE - ABS({t}) / SQRT(8.0::DOUBLE + {t} * {t}) * (1.0::DOUBLE + {c} / 2 + 3 * {c} * {c} / 8 + 15 * {c} * {c} * {c} / 48))"


@query("SF9_student_tail", f"SELECT event_id, {student8_sql('(value / 100.0::DOUBLE)')} AS p FROM events", "p")
def _(spark, sf):
    from ..functions.formulas import student_two_sided
    t = B.table(spark, sf, "events").select("event_id", (F.col("value") / 100.0).alias("t"), F.lit(8.0).alias("dof"))
    return t.select("event_id", student_two_sided("t", "dof").alias("p"))


# ---- sorts and limits ---------------------------------------------------------------------------

_IMPORTANCE = """, importance AS (SELECT "Feature", STDDEV_POP(value) / AVG(value) AS "Importance" FROM long GROUP BY "Feature")"""


def _importance(spark, sf):
    long = C.unpivot(B.cohort(spark, sf), B.COHORT_FEATURES, []).filter(F.col("value").isNotNull())
    return long.groupBy("Feature").agg((F.stddev_pop("value") / F.avg("value")).alias("Importance"))


@query("SO1_sort_by_importance", with_sql("long") + _IMPORTANCE + """ SELECT "Feature", "Importance",
    ROW_NUMBER() OVER (ORDER BY "Importance" DESC, "Feature") AS place FROM importance""", "Importance")
def _(spark, sf):
    from pyspark.sql import Window
    ordered = _importance(spark, sf)
    return ordered.withColumn("place", F.row_number().over(Window.orderBy(F.desc("Importance"), "Feature")))


@query("SO2_bottom_k", with_sql("long") + _RANKING + ' SELECT "Feature" FROM ranking WHERE "Stability Index" >= 0.4::DOUBLE ORDER BY "Average Ranking", "Feature" LIMIT 3')
def _(spark, sf):
    return S.final_features(_ranking(spark, sf), 3)


@query("SO3_top_k", with_sql("long") + _IMPORTANCE + ' SELECT * FROM importance ORDER BY "Importance" DESC, "Feature" LIMIT 4', "Importance")
def _(spark, sf):
    from ..operators.plotdata import top_importance
    return top_importance(_importance(spark, sf), 4)


@query("SO4_first_n", with_sql("cohort") + ' SELECT "Record", n_lines, qty_sum, price_mean FROM cohort', "n_lines, qty_sum, price_mean")
def _(spark, sf):
    df = B.cohort(spark, sf)
    return df.select("Record", *C.feature_columns(df)[:3])


@query("SO5_smallest_within_tolerance", """WITH curve AS (SELECT l_linenumber AS n, AVG(l_discount) AS score FROM lineitem GROUP BY l_linenumber)
    SELECT MIN(n) AS n FROM curve WHERE score <= 1.05::DOUBLE * (SELECT MIN(score) FROM curve)""")
def _(spark, sf):
    curve = B.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("Number of Features")).agg(
        F.avg("l_discount").alias("Score"))
    return S.sizes_within_tolerance(curve)


# ---- splits -------------------------------------------------------------------------------------

def hash_sql(key: str, seed: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT)"


@query("WN8_shuffle", with_sql("markers") + f""" SELECT "Record", ROW_NUMBER() OVER (ORDER BY {hash_sql('"Record"', '42')}, "Record") AS place FROM markers""")
def _(spark, sf):
    from ..operators.ordered import row_index
    df = B.markers(spark, sf).select("Record").withColumn("h", hash32(F.col("Record"), 42))
    return row_index(df, [], ["h", "Record"], "place").select("Record", "place")


@query("WN9_train_test_split", with_sql("markers") + f""" SELECT "Record", ROW_NUMBER() OVER (ORDER BY {hash_sql('"Record"', '42')}, "Record")
    <= CEIL(0.2::DOUBLE * COUNT(*) OVER ()) AS is_test FROM markers""")
def _(spark, sf):
    return split.train_test_split(B.markers(spark, sf).select("Record"), 0.2, 42)


@query("WN9_train_test_split_stratified", with_sql("markers") + f""" SELECT "Record", "Diagnosed",
    ROW_NUMBER() OVER (PARTITION BY "Diagnosed" ORDER BY {hash_sql('"Record"', '42')}, "Record")
    <= CEIL(0.3::DOUBLE * COUNT(*) OVER (PARTITION BY "Diagnosed")) AS is_test FROM markers""")
def _(spark, sf):
    return split.train_test_split(B.markers(spark, sf).select("Record", "Diagnosed"), 0.3, 42, stratify="Diagnosed")


@query("WN9_hash_split", with_sql("markers") + f""" SELECT "Record", {hash_sql('"Record"', '7')} % 10000 < 2000 AS is_test FROM markers""")
def _(spark, sf):
    return split.hash_split(B.markers(spark, sf).select("Record"), 0.2, 7)


@query("WN10_stratified_kfold", with_sql("markers") + f""" SELECT "Record", CAST((ROW_NUMBER() OVER (PARTITION BY "Diagnosed"
    ORDER BY {hash_sql('"Record"', '42')}, "Record") - 1) % 5 AS INTEGER) AS fold FROM markers""")
def _(spark, sf):
    return split.stratified_kfold(B.markers(spark, sf), 5, 42, label="Diagnosed").select("Record", "fold")


@query("WN11_group_kfold", f"""SELECT l_orderkey AS "Record", l_linenumber, CAST({hash_sql('l_orderkey', '42')} % 5 AS INTEGER) AS fold FROM lineitem""")
def _(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("Record"), "l_linenumber")
    return split.group_kfold(rows, 5, 42)


# ---- validation ---------------------------------------------------------------------------------

_NAMES = ["Record", "Diagnosed", *B.COHORT_FEATURES]


_VALIDATION = (with_sql("cohort") + """, c AS (SELECT * REPLACE (""" + _INF + """ AS disc_mean) FROM cohort)
    SELECT 'required_columns' AS "check", 'success' AS severity, 'all' AS detail, 0 AS n """ + "".join(
    f"""UNION ALL SELECT 'missing_values', CASE WHEN COUNT(*) > COUNT("{c}") THEN 'warning' ELSE 'success' END, '{c}', COUNT(*) - COUNT("{c}") FROM c """
    for c in _NAMES) + "".join(
    f"""UNION ALL SELECT 'infinite_values', CASE WHEN COUNT(*) FILTER (isinf("{c}")) > 0 THEN 'warning' ELSE 'success' END, '{c}', COUNT(*) FILTER (isinf("{c}")) FROM c """
    for c in B.COHORT_FEATURES) + """UNION ALL SELECT 'labels', 'error', COALESCE("Diagnosed", 'NULL'), COUNT(*) FROM c
    WHERE "Diagnosed" IS NULL OR "Diagnosed" NOT IN ('Control', 'Pathological') GROUP BY "Diagnosed"
    UNION ALL SELECT 'labels', 'success', '', 0 WHERE NOT EXISTS (SELECT 1 FROM c WHERE "Diagnosed" IS NULL OR "Diagnosed" NOT IN ('Control', 'Pathological'))
    UNION ALL SELECT 'duplicates', CASE WHEN COUNT(*) > COUNT(DISTINCT "Record") THEN 'warning' ELSE 'success' END, 'Record', COUNT(*) - COUNT(DISTINCT "Record") FROM c""")


@query("AG9_validate_dataset", _VALIDATION)
def _(spark, sf):
    return quality.validate_dataset(_with_inf(spark, sf))


@query("AG10_validation_result", f"""SELECT COUNT(*) FILTER (severity = 'error') = 0 AS is_valid, COUNT(*) FILTER (severity = 'warning') > 0 AS has_warnings,
    COUNT(*) FILTER (severity = 'error') AS errors, COUNT(*) FILTER (severity = 'warning') AS warnings,
    COUNT(*) FILTER (severity = 'success') AS successes FROM ({_VALIDATION}) AS checks""")
def _(spark, sf):
    return quality.validation_summary(quality.validate_dataset(_with_inf(spark, sf)))


_LINES = """SELECT CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank,
    CONCAT_WS(' ', UPPER(severity), "check", detail, CAST(n AS VARCHAR)) AS line FROM {checks}"""


@query("AG10_validation_text", _LINES.format(checks=f"({_VALIDATION}) AS checks"))
def _(spark, sf):
    return quality.validation_text(quality.validate_dataset(_with_inf(spark, sf)))


@query("AG10_validation_merge", f"""SELECT COUNT(*) FILTER (severity = 'error') = 0 AS is_valid, COUNT(*) FILTER (severity = 'warning') > 0 AS has_warnings,
    COUNT(*) FILTER (severity = 'error') AS errors, COUNT(*) FILTER (severity = 'warning') AS warnings, COUNT(*) FILTER (severity = 'success') AS successes
    FROM (SELECT severity FROM ({_VALIDATION}) AS checks UNION ALL SELECT CASE WHEN COUNT(*) > COUNT(DISTINCT o_custkey) THEN 'warning' ELSE 'success' END FROM orders
    UNION ALL SELECT CASE WHEN COUNT(*) > COUNT(o_custkey) THEN 'warning' ELSE 'success' END FROM orders UNION ALL SELECT 'error') AS merged""")
def _(spark, sf):
    """The cohort's checks and those of another table that lacks the class column."""
    other = B.table(spark, sf, "orders").select(F.col("o_custkey").cast("bigint").alias("Record"))
    return quality.validation_summary(quality.validate_dataset(_with_inf(spark, sf)).unionByName(quality.validate_dataset(other)))


@query("AG25_shape", with_sql("cohort") + " SELECT COUNT(*) AS n_rows, 12 AS n_columns FROM cohort")
def _(spark, sf):
    return quality.shape(B.cohort(spark, sf))


@query("AG26_pca_conditions", with_sql("cohort") + """ SELECT COUNT(*) FILTER (price_std IS NULL) AS rows_missing,
    COUNT(*) FILTER (n_lines = qty_sum AND qty_sum = price_std) AS rows_flat,
    (SELECT COUNT(*) FROM (SELECT DISTINCT n_lines, qty_sum, price_std FROM cohort)) >= 2 AS two_distinct,
    COUNT(*) FILTER (price_std IS NULL) = 0 AND COUNT(*) FILTER (n_lines = qty_sum AND qty_sum = price_std) = 0 AS ok FROM cohort""")
def _(spark, sf):
    return quality.pca_conditions(B.cohort(spark, sf), ["n_lines", "qty_sum", "price_std"])



