"""Cohort tables derived from the star schema the queries run on (same definitions in Spark and in the check SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import row_index

COHORT_FEATURES = ["n_lines", "qty_sum", "price_mean", "price_std", "disc_mean", "tax_mean", "price_sum", "rev",
                   "Pr01", "Pr02"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of floats depend on their order in the last bits; rounding makes equal measurements equal on any cluster."""
    price = F.col("l_extendedprice")

    def fixed(c):
        return F.round(c, 6)

    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("Record")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("qty_sum"),
        fixed(F.avg(price)).alias("price_mean"), fixed(F.stddev_samp(price)).alias("price_std"),
        fixed(F.avg("l_discount")).alias("disc_mean"), fixed(F.avg("l_tax")).alias("tax_mean"),
        fixed(F.sum(price)).alias("price_sum"), fixed(F.sum(price * (1 - F.col("l_discount")))).alias("rev"))


def markers(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("Record"), F.when(urgent, "Pathological").otherwise("Control").alias("Diagnosed"),
        F.col("o_totalprice").alias("Pr01"), F.col("c_acctbal").alias("Pr02"))


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    return signal(spark, sf).join(markers(spark, sf), "Record").select("Record", "Diagnosed", *COHORT_FEATURES)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Event values of each user as a numbered series."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("Record"), "ts", "event_id", "value")
    return row_index(events, ["Record"], ["ts", "event_id"], "t").select(
        "Record", F.lit("F0").alias("series"), "t", "value")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(Record, Diagnosed, label 0/1, v array<double>)."""
    rare = F.col("label") == 0
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("Record"), F.when(rare, "Pathological").otherwise("Control").alias("Diagnosed"),
        F.when(rare, 1).otherwise(0).alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def wide_vectors(spark: SparkSession, sf: str, width: int = 64) -> DataFrame:
    v = vectors(spark, sf)
    return v.select("Record", "Diagnosed", *[F.col("v")[i].alias(f"e{i:02d}") for i in range(width)])


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("Record"), F.col("quality").alias("y"), (1 - F.col("toxic")).alias("p"),
        F.col("n_chars").cast("double").alias("score"))


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """A file listing (path, length) made from the documents: hidden, empty and foreign files included."""
    i = F.col("doc_id")
    ext = F.element_at(F.array(F.lit(".wav"), F.lit(".mp3"), F.lit(".FLAC"), F.lit(".txt")), (i % 4 + 1).cast("int"))
    name = F.concat(F.when(i % 7 == 0, ".").otherwise(""), "lang", F.lit("_"), i.cast("string"), ext)
    return table(spark, sf, "documents").select(
        F.concat(F.lit("/data/"), "source", F.lit("/"), name).alias("path"),
        F.when(i % 11 == 0, 0).otherwise(F.col("n_chars")).cast("bigint").alias("length"))


RULES = {"price": ("Pr01", 150000.0), "quantity": ("qty_sum", 100.0), "lines": ("n_lines", 4.0)}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three rule models on the cohort: one row per record and model, from a single pass over it."""
    base = cohort(spark, sf)
    votes = F.array(*[F.struct(F.lit(m).alias("Model"), (F.col(c) > F.lit(t)).cast("int").alias("p"),
                               F.col(c).alias("score")) for m, (c, t) in RULES.items()])
    return base.select("Record", (F.col("Diagnosed") == "Pathological").cast("int").alias("y"),
                       F.explode(votes).alias("m")).select(
        "m.Model", F.lit("RULE").alias("Method"), (F.col("Record") % 5 + 1).cast("int").alias("Execution"), "Record",
        "y", "m.p", "m.score")


# ---- the same tables as SQL ---------------------------------------------------------------------

SQL = {
    "signal": """signal AS (SELECT l_orderkey AS "Record", CAST(COUNT(*) AS DOUBLE) AS n_lines, SUM(l_quantity) AS qty_sum,
        ROUND(AVG(l_extendedprice), 6) AS price_mean, ROUND(STDDEV_SAMP(l_extendedprice), 6) AS price_std,
        ROUND(AVG(l_discount), 6) AS disc_mean, ROUND(AVG(l_tax), 6) AS tax_mean,
        ROUND(SUM(l_extendedprice), 6) AS price_sum, ROUND(SUM(l_extendedprice * (1 - l_discount)), 6) AS rev
        FROM lineitem GROUP BY l_orderkey)""",
    "markers": """markers AS (SELECT o_orderkey AS "Record",
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'Pathological' ELSE 'Control' END AS "Diagnosed",
        o_totalprice AS "Pr01", c_acctbal AS "Pr02" FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "cohort": """cohort AS (SELECT s."Record", m."Diagnosed", n_lines, qty_sum, price_mean, price_std, disc_mean,
        tax_mean, price_sum, rev, m."Pr01", m."Pr02" FROM signal s JOIN markers m ON s."Record" = m."Record")""",
    "frames": """frames AS (SELECT user_id AS "Record", 'F0' AS series,
        ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value FROM events)""",
    "vectors": """vectors AS (SELECT vec_id AS "Record", CASE WHEN label = 0 THEN 'Pathological' ELSE 'Control' END AS "Diagnosed",
        CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
    "recordings": """recordings AS (SELECT '/data/' || source || '/' || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || lang || '_' ||
        CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.wav' WHEN 1 THEN '.mp3' WHEN 2 THEN '.FLAC' ELSE '.txt' END AS path,
        CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars END AS BIGINT) AS length FROM documents)""",
    "docs": """docs AS (SELECT l.doc_id AS "Record", l.quality AS y, 1 - l.toxic AS p, CAST(d.n_chars AS DOUBLE) AS score
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
    "predictions": """predictions AS (SELECT model AS "Model", 'RULE' AS "Method", CAST("Record" % 5 + 1 AS INTEGER) AS "Execution",
        "Record", CASE WHEN "Diagnosed" = 'Pathological' THEN 1 ELSE 0 END AS y, p, score FROM (
        SELECT 'price' AS model, "Record", "Diagnosed", CASE WHEN "Pr01" > 150000.0::DOUBLE THEN 1 ELSE 0 END AS p, "Pr01" AS score FROM cohort
        UNION ALL SELECT 'quantity', "Record", "Diagnosed", CASE WHEN qty_sum > 100.0::DOUBLE THEN 1 ELSE 0 END, qty_sum FROM cohort
        UNION ALL SELECT 'lines', "Record", "Diagnosed", CASE WHEN n_lines > 4.0::DOUBLE THEN 1 ELSE 0 END, n_lines FROM cohort))""",
}
# every measurement of the cohort as (Record, Diagnosed, Feature, value), missing values left out
SQL["long"] = f"""long AS (SELECT * FROM cohort UNPIVOT (value FOR "Feature" IN ({", ".join(f'"{c}"' for c in COHORT_FEATURES)})))"""
_NEEDS = {"long": ["signal", "markers", "cohort"], "cohort": ["signal", "markers"], "predictions": ["signal", "markers", "cohort"]}


def with_sql(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` for the named tables and what they need."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ", ".join(SQL[x] for x in order)
