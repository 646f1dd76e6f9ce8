"""Classifier registry. Training tables have an id column, `label` (0/1) and `features` (ML vector); predictions add
`score` (probability-like value of class 1) and `Predicted`."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import encode_label, feature_columns
from ..functions.formulas import uniform
from ..session import discard, materialise
from .neighbours import knn_predict
from .stats import poisson_weight
from .svm import fit_machine, margin_column
from .trees import Binned, Boost, Forest, Plan, Rules, bin_table, boost_models, forest_plans, grow_forests, score_column

Predict = Callable[[DataFrame], DataFrame]


def prepare_xy(df: DataFrame, features: Sequence[str] | None = None, keep: Sequence[str] = ("Record",)) -> DataFrame:
    """(keep..., label, features): encoded label and one vector column. Rows with a missing value are dropped."""
    features = list(features or feature_columns(df))
    cols = [F.col(f"`{c}`").cast("double") for c in features]
    return df.dropna(subset=features).select(
        *[c for c in keep if c in df.columns], encode_label(F.col("Diagnosed")).alias("label"),
        array_to_vector(F.array(*cols)).alias("features"))


def training_table(df: DataFrame, key: str = "Record") -> DataFrame:
    """Stored and evenly spread by key: iterative fits pass over it many times, and a small table that arrives in one
    partition would otherwise keep one slot busy. Stored, it survives lost executors and holds no memory afterwards."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialise(df.repartition(n, key), "training")


# ---- trees --------------------------------------------------------------------------------------

#: Names of a parameter: the first is the one to use.
_NAMES = {"n_estimators": ("numTrees", "maxIter"), "max_depth": ("maxDepth",), "criterion": ("impurity",),
          "max_features": ("featureSubsetStrategy",), "learning_rate": ("stepSize",)}

#: Defaults of the tree families. Bagging looks at every feature in every node.
_FORESTS = {"RandomForest": {"n_estimators": 100, "max_features": "sqrt", "bootstrap": True},
            "DecisionTree": {"n_estimators": 1, "max_features": "all", "bootstrap": False},
            "Bagging": {"n_estimators": 10, "max_features": "all", "bootstrap": True}}
_BOOSTED = {"GradientBoosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "loss": "log_loss"},
            "XGBoost": {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 6, "reg_lambda": 1.0, "min_child_weight": 1.0},
            "LightGBM": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 60, "num_leaves": 31, "min_child_weight": 1e-3},
            "AdaBoost": {"n_estimators": 50, "learning_rate": 1.0, "max_depth": 1, "loss": "samme"}}


def is_tree(name: str, params: dict | None = None) -> bool:
    """Whether a model is a set of trees, so that any number of its fits grow together."""
    return name in _FORESTS and (params or {}).get("base", "DecisionTree") == "DecisionTree" or name in _BOOSTED


def tree_job(name: str, params: dict | None, seed: int, d: int, member: int | None = None) -> list[Plan] | Boost:
    """What is to be grown for one fit of a tree family over `d` features."""
    given = params or {}
    known = {**(_FORESTS.get(name) or _BOOSTED[name])}
    for p, value in given.items():
        known[next((k for k, other in _NAMES.items() if p in other), p)] = value
    depth = int(known.get("max_depth", 10))
    if depth < 0:
        raise ValueError(f"max_depth {depth} is below zero")
    if name in _FORESTS:
        rules = Rules(known.get("criterion", "gini"), depth, known["max_features"] or "all", known.get("splitter", "best"),
                      float(known.get("min_samples_leaf", 1)))
        rules.count(d)  # refuses what it can't read here, not in a task
        return forest_plans(int(known["n_estimators"]), seed, rules, range(d), member, known["bootstrap"])
    loss = {"log_loss": "log"}.get(known.get("loss", "log_loss"), known.get("loss"))
    rules = Rules("gini" if loss == "samme" else "newton", depth, known.get("max_features") or "all", "best",
                  float(known.get("min_child_weight", 0.0 if loss == "samme" else 1e-3)), float(known.get("reg_lambda", 0.0)),
                  float(known.get("gamma", 0.0)), known.get("num_leaves") and int(known["num_leaves"]))
    return Boost(rules, int(known["n_estimators"]), float(known["learning_rate"]), loss, float(known.get("top_rate", 1.0)),
                 float(known.get("other_rate", 0.0)), member, seed)


def grow_jobs(binned: Binned, jobs: Sequence[list[Plan] | Boost]) -> list[Forest]:
    """The ensembles of all jobs, in order; forests grow in one go, boosted ones side by side."""
    forests = grow_forests(binned, [j for j in jobs if not isinstance(j, Boost)])
    boosted = boost_models(binned, [j for j in jobs if isinstance(j, Boost)]) if any(isinstance(j, Boost) for j in jobs) else []
    forests, boosted = iter(forests), iter(boosted)
    return [next(boosted if isinstance(j, Boost) else forests) for j in jobs]


def id_column(train: DataFrame) -> str:
    return next(c for c in train.columns if c not in ("label", "features"))


def with_predictions(df: DataFrame, model: Forest) -> DataFrame:
    return df.withColumn("score", score_column(model, df.sparkSession)).withColumn("Predicted", predicted_label("score"))


def predicted_label(score: str) -> Column:
    return (F.round(F.col(score), 9) > 0.5).cast("int")


def _trees(name: str) -> Callable:
    def fit(train: DataFrame, params: dict, seed: int) -> Predict:
        binned = bin_table(train, id_column(train))
        model = grow_jobs(binned, [tree_job(name, params, seed, binned.d)])[0]
        discard(binned.table)
        return lambda df: with_predictions(df, model)
    return fit


def fit_bagging(train: DataFrame, params: dict, seed: int) -> Predict:
    """Votes of `n_estimators` members, each fitted on rows repeated as often as a Poisson draw says. `base` names any
    registered model (its parameters in `base_params`); trees grow together."""
    base = params.get("base", "DecisionTree")
    if base == "DecisionTree":
        return _trees("Bagging")(train, {k: v for k, v in params.items() if k != "base"}, seed)
    id = id_column(train)
    members = []
    for i in range(int(params.get("n_estimators", 10))):
        times = poisson_weight(uniform(F.col(id), f"{seed}:{i}"))
        rows = train.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(20)))).where(F.col("_i") <= times)
        rows = rows.withColumn(id, F.concat_ws(":", F.col(id).cast("string"), F.col("_i").cast("string"))).drop("_i")
        members.append(fit_model(base, materialise(rows, "bag"), params.get("base_params"), seed + i))

    def predict(df: DataFrame) -> DataFrame:
        votes = [m(df.withColumn(id, F.col(id).cast("string"))).select(F.col(id).alias("_id"), "score") for m in members]
        mean = functools.reduce(DataFrame.unionByName, votes).groupBy("_id").agg(F.avg("score").alias("score"))
        return df.join(mean, F.col(id).cast("string") == F.col("_id")).drop("_id").withColumn("Predicted", predicted_label("score"))
    return predict


# ---- nearest neighbours -------------------------------------------------------------------------

def fit_knn(train: DataFrame, params: dict, seed: int) -> Predict:
    id = next(c for c in train.columns if c not in ("label", "features"))
    table = train.select(id, "label", vector_to_array("features").alias("v"))
    k = int(params.get("n_neighbors", 5))
    weights, metric = params.get("weights", "uniform"), params.get("metric", "euclidean")

    def predict(df: DataFrame) -> DataFrame:
        votes = knn_predict(df.select(id, vector_to_array("features").alias("v")), table, k, id, weights=weights,
                            metric=metric, p=float(params.get("p", 2.0)))
        return df.join(votes, id)
    return predict


# ---- kernel machines ----------------------------------------------------------------------------

def fit_svm(train: DataFrame, params: dict, seed: int) -> Predict:
    """Margin classifier with a linear, rbf, poly or sigmoid kernel; the class is the margin's sign, the score its probability."""
    machine = fit_machine(train, id_column(train), params, seed)

    def predict(df: DataFrame) -> DataFrame:
        out = df.withColumn("_m", margin_column(machine))
        odds = F.lit(machine.slope) * F.col("_m") + F.lit(machine.offset)
        return out.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).withColumn(
            "Predicted", (F.col("_m") > 0).cast("int")).drop("_m")
    return predict


# ---- registry -----------------------------------------------------------------------------------

@dataclass
class Model:
    name: str
    abbreviation: str
    fit: Callable[[DataFrame, dict, int], Predict]
    seeded: bool = True
    choices: dict[str, list] = field(default_factory=dict)  # categorical parameters the search may index


#: Categorical parameters in the order of their indices.
CHOICES = {
    "KNearestNeighbor": {"weights": ["uniform", "distance"], "metric": ["manhattan", "euclidean", "minkowski"]},
    "SupportVectorMachine": {"kernel": ["linear", "rbf", "poly", "sigmoid"]},
    "RandomForest": {"criterion": ["gini", "entropy"], "max_features": ["sqrt", "log2"]},
    "GradientBoosting": {"loss": ["exponential", "log_loss"]},
    "DecisionTree": {"criterion": ["gini", "entropy"], "splitter": ["best", "random"], "max_features": ["sqrt", "log2"]},
}

MODELS = {name: Model(name, short, fit_, seeded, CHOICES.get(name, {})) for name, short, fit_, seeded in (
    ("AdaBoost", "ADA", _trees("AdaBoost"), True),
    ("KNearestNeighbor", "KNN", fit_knn, False),
    ("SupportVectorMachine", "SVM", fit_svm, True),
    ("Bagging", "BAG", fit_bagging, True),
    ("RandomForest", "RF", _trees("RandomForest"), True),
    ("GradientBoosting", "GB", _trees("GradientBoosting"), True),
    ("XGBoost", "XGB", _trees("XGBoost"), True),
    ("LightGBM", "LGB", _trees("LightGBM"), True),
    ("DecisionTree", "DT", _trees("DecisionTree"), True),
)}


def get_model(name: str) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; one of {sorted(MODELS)}")
    return MODELS[name]


def fit(name: str, train: DataFrame, params: dict | None = None, seed: int = 42) -> Predict:
    return get_model(name).fit(train, params or {}, seed)


fit_model = fit
