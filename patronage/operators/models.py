"""Churn, value and next-category models with Spark ML.

Rows carry: customer_id, split, fold, label columns, weight, ``features`` (raw vector) and
``scaled`` (standardised vector). Training tables are written or persisted before they get here,
because every search reads them many times.
"""
from __future__ import annotations

import itertools
import random
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.config import DEFAULTS, Settings
from patronage.operators import boosting, dealing
from patronage.operators import encode as E
from patronage.operators import evaluate as M
from patronage.operators import forests
from patronage.operators import neighbours as N
from patronage.operators import perceptron
from patronage.operators.segment import Standardiser
from patronage.operators.trees import cut_forest, saved_nodes
from patronage.session import materialise, shared_folder

# Parameter names and grids of the searches, trees and rounds. Results depend on them.
SEARCH_SPACES: dict[str, dict[str, list[Any]]] = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.0, 1.0]},
    "decision_tree": {"max_depth": [3, 5, 8, 12], "min_samples_leaf": [5, 20, 50]},
    "random_forest": {"n_estimators": [150, 250], "max_depth": [6, 10, 16], "min_samples_leaf": [2, 5, 10]},
    "boosted_trees": {"learning_rate": [0.03, 0.05, 0.1], "max_depth": [3, 4, 6], "subsample": [0.7, 0.85, 1.0],
                      "colsample": [0.6, 0.8, 1.0]},
    "boosted_leaves": {"learning_rate": [0.03, 0.05, 0.1], "num_leaves": [15, 31, 63], "subsample": [0.7, 0.85, 1.0],
                       "colsample": [0.6, 0.8, 1.0]},
    "knn": {"n_neighbors": [15, 25, 41, 61], "weights": ["uniform", "distance"]},
    "ann": {"hidden_units": [(128, 64)]},
    "clv_ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "clv_boosted": {"max_depth": [3, 4, 6], "learning_rate": [0.03, 0.05, 0.1], "n_estimators": [200, 400]},
}
BOOSTED_ROUNDS, BOOSTED_PATIENCE = 600, 30
ANN_ITERATIONS = 150
CATEGORY_TREES, CATEGORY_MIN_LEAF = 300, 3
#: Spark's trees end at 30 levels; the category forest has no other limit.
CATEGORY_MAX_DEPTH = 30
PRODUCTION_CANDIDATES = ["random_forest", "boosted_trees", "boosted_leaves"]
BOOSTED = {"boosted_trees": {}, "boosted_leaves": {"reg_lambda": 1e-9, "min_child_weight": 1e-3, "min_child_samples": 20}}
NESTED = ("decision_tree", "random_forest")
#: Rows remember the node they are in, so a level need not send the whole forest to every task and walk it from the root. Same trees.
NODE_IDS = {"cacheNodeIds": True}
#: Fits that run at the same time.
PARALLEL_FITS = 4
#: Rows of a table whose fits may take a core each.
SMALL_ROWS = 50_000


# ---------------------------------------------------------------- training table
@dataclass(frozen=True)
class Encoder:
    """What is fitted on the training snapshot: country levels, kept columns, scaling."""
    levels: list[str]
    columns: list[str]
    scaler: Standardiser

    def transform(self, snapshot: DataFrame, keep: Sequence[str], settings: Settings = DEFAULTS) -> DataFrame:
        """``keep`` columns plus ``features`` and ``scaled`` vectors. A projection: no shuffle."""
        kept = [k for k in keep if k not in settings.feature_columns]
        matrix = E.model_matrix(snapshot, self.levels, settings, kept)
        return self.scaler.vector(E.assemble(matrix, self.columns), "scaled")


def training_table(train: DataFrame, settings: Settings = DEFAULTS, prune: bool = True) -> tuple[DataFrame, Encoder]:
    """Rows for all models plus the fitted encoder. ``train``: labelled snapshot with engagement filled."""
    levels = E.country_levels(train, settings)
    names = E.model_columns(levels, settings)
    matrix = E.model_matrix(train, levels, settings)
    kept = E.prune_by_vif(matrix, names, settings.vif_threshold, settings.vif_protected)[0] if prune else names
    marked = materialise(M.stratified_parts(train, "churn", "customer_id", settings), "split-rows")
    fit_rows = E.model_matrix(marked.where("split = 'train'"), levels, settings)
    encoder = Encoder(levels, kept, Standardiser.fit(fit_rows, kept))
    weighted = M.with_weights(marked, "churn", M.class_weights(marked.where("split = 'train'"), "churn"))
    rows = encoder.transform(weighted, ["customer_id", "split", "fold", "churn", "clv_target", "next_category", "weight"], settings)
    return rows.withColumn("label", F.col("churn").cast("double")), encoder


# ---------------------------------------------------------------- search
def candidates(space: Mapping[str, Sequence[Any]], n: int, seed: int) -> list[dict[str, Any]]:
    """min(n, grid size) different parameter sets, drawn with a seed."""
    grid = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    return random.Random(seed).sample(grid, min(n, len(grid)))


def churn_estimator(name: str, params: Mapping[str, Any], n_rows: int, n_columns: int, settings: Settings = DEFAULTS) -> Estimator:
    """Estimator for one parameter set. ``n_rows`` turns a total penalty into Spark's mean penalty."""
    common = dict(labelCol="label", weightCol="weight", probabilityCol="probability", rawPredictionCol="raw")
    if name == "logistic_regression":
        return LogisticRegression(featuresCol="scaled", regParam=1.0 / (params["C"] * n_rows), elasticNetParam=params["l1_ratio"],
                                  standardization=False, maxIter=200, **common)
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=params["max_depth"], minInstancesPerNode=params["min_samples_leaf"], seed=settings.seed, **NODE_IDS, **common)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=params["n_estimators"], maxDepth=params["max_depth"],
                                      minInstancesPerNode=params["min_samples_leaf"], featureSubsetStrategy="sqrt", seed=settings.seed, **NODE_IDS, **common)
    if name == "ann":
        return MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=[n_columns, *params["hidden_units"], 2],
                                              maxIter=params.get("max_iter", ANN_ITERATIONS), seed=settings.seed, rawPredictionCol="raw")
    raise ValueError(f"unknown model {name}")


def side_by_side(work, tasks: Sequence, threads: int = PARALLEL_FITS) -> list:
    """Results of ``work(task)`` in order. Plain threads: each has Spark properties of its own, so no fit sees those of another."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(work, tasks))


def fits_at_once(rows: DataFrame, n_rows: int) -> int:
    """Fits that run at the same time: one a core where a small table has fewer partitions than there are cores, else PARALLEL_FITS."""
    if n_rows > SMALL_ROWS:  # the trees of a fit grow with its rows, and the driver holds those of all fits that run
        return PARALLEL_FITS
    return max(PARALLEL_FITS, rows.sparkSession.sparkContext.defaultParallelism // max(1, rows.rdd.getNumPartitions()))


def models_at_once(n_rows: int) -> int:
    """Models that are trained at the same time. A fit of a larger table fills the cluster alone; more of them only add to what the driver holds."""
    return 1 if n_rows > dealing.FEW_ROWS else PARALLEL_FITS


def oversampled(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Training rows with synthetic ones that bring the labels level, neighbours taken in the scaled features; all weigh 1."""
    arrays = rows.select(F.col("customer_id").alias("id"), vector_to_array("scaled").alias("x"), vector_to_array("features").alias("also"), F.col("churn").alias("label"))
    made = N.oversample(arrays, settings).select(
        F.col("id").alias("customer_id"), F.col("label").alias("churn"), F.col("label").cast("double").alias("label"),
        array_to_vector("also").alias("features"), array_to_vector("x").alias("scaled"))
    given = rows.select("customer_id", "churn", "label", "features", "scaled").withColumn("is_new", F.lit(False))
    return given.unionByName(made.withColumn("is_new", F.lit(True))).withColumn("weight", F.lit(1.0))


def fit_parts(rows: DataFrame, settings: Settings) -> dict[int | None, DataFrame]:
    """What the fit without each fold, and the fit on all rows (None), learn from."""
    parts = {fold: rows.where(F.col("fold") != fold) for fold in range(settings.cv_folds)} | {None: rows}
    if settings.imbalance != "smote":
        return parts
    return {k: materialise(oversampled(v, settings), "oversampled") for k, v in parts.items()}


def search(make, sets: list[dict], rows: DataFrame, evaluator, settings: Settings, parts: dict[int | None, DataFrame] | None = None) -> tuple[dict, float, float]:
    """(best parameter set, mean and deviation of its cross-validated score), folds from the fold column."""
    parts = parts or {fold: rows.where(F.col("fold") != fold) for fold in range(settings.cv_folds)}

    def score(task: tuple[int, int]) -> float:
        i, fold = task
        model = make(sets[i]).fit(parts[fold])
        return evaluator.evaluate(model.transform(rows.where(F.col("fold") == fold)))

    tasks = [(i, fold) for i in range(len(sets)) for fold in range(settings.cv_folds)]
    found = np.array(side_by_side(score, tasks)).reshape(len(sets), settings.cv_folds)
    best = int(found.mean(1).argmax())
    return sets[best], float(found[best].mean()), float(found[best].std())


def nested_search(make, sets: list[dict], rows: DataFrame, settings: Settings, parts: dict[int | None, DataFrame], threads: int = PARALLEL_FITS) -> tuple[dict, float, float]:
    """search() for trees and forests with one fit per fold and leaf size.

    Splits are chosen from the top down, so a tree holds every shallower one, and a forest every one with fewer trees:
    the largest of a leaf size is fitted, the others are cut out of it.
    """
    spark, groups = rows.sparkSession, {}
    for i, p in enumerate(sets):
        groups.setdefault(p["min_samples_leaf"], []).append(i)
    folder = f"{shared_folder(spark).rstrip('/')}/patronage/fits-{uuid.uuid4().hex}"
    trees = lambda p: p.get("n_estimators", 1)

    def scores(task: tuple[int, int]) -> list[tuple[int, float]]:
        leaf, fold = task
        mine = groups[leaf]
        largest = dict(sets[mine[0]], max_depth=max(sets[i]["max_depth"] for i in mine))
        if "n_estimators" in largest:
            largest["n_estimators"] = max(trees(sets[i]) for i in mine)
        path = f"{folder}/{leaf}-{fold}"
        make(largest).fit(parts[fold]).write().save(path)
        nodes = saved_nodes(spark, path)
        models = [(i, fold, cut_forest(nodes, sets[i]["max_depth"], trees(sets[i]))) for i in mine]
        held = rows.where(F.col("fold") == fold).withColumn("part", F.col("fold"))
        return [(i, v[0]) for i, v in boosting.fold_scores(held, "label", models).items()]

    found: dict[int, list[float]] = {}
    for part in side_by_side(scores, [(leaf, fold) for leaf in groups for fold in range(settings.cv_folds)], threads):
        for i, value in part:
            found.setdefault(i, []).append(value)
    best = max(found, key=lambda i: (np.mean(found[i]), -i))
    return sets[best], float(np.mean(found[best])), float(np.std(found[best]))


# ---------------------------------------------------------------- neighbours as a model
@dataclass
class NeighbourVote:
    """Share of label 1 among the k nearest training rows, in the scaled features."""
    points: DataFrame  # id, x, label
    k: int
    weights: str

    def transform(self, df: DataFrame) -> DataFrame:
        asked = df.select(F.col("customer_id").alias("id"), vector_to_array("scaled").alias("x"))
        near = N.nearest(asked, self.points.select("id", "x"), self.k)
        share = N.vote(near, self.points.select("id", "label"), self.weights).where("label = 1").select(F.col("id").alias("_id"), F.col("share").alias("_p"))
        out = df.join(share, F.col("customer_id") == F.col("_id"), "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
        return out.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_id", "_p")


def neighbour_search(sets: list[dict], rows: DataFrame, settings: Settings, parts: dict[int | None, DataFrame]) -> tuple[dict, float, float]:
    """search() for neighbour votes: one search of the largest k a fold, all parameter sets read off its ranks."""
    most = max(p["n_neighbors"] for p in sets)
    found = None
    for fold in range(settings.cv_folds):
        points = materialise(_points(parts[fold]), "vote-points")
        held = rows.where(F.col("fold") == fold)
        near = N.nearest(held.select(F.col("customer_id").alias("id"), vector_to_array("scaled").alias("x")), points.select("id", "x"), most)
        near = near.join(points.select(F.col("id").alias("neighbour"), F.col("label").alias("vote")), "neighbour")
        near = near.join(held.select(F.col("customer_id").alias("id"), F.col("label").alias("y")), "id").withColumn("part", F.lit(fold))
        found = near if found is None else found.unionByName(near)
    shares = []
    for i, p in enumerate(sets):
        inside = F.col("rank") <= p["n_neighbors"]
        weight = F.lit(1.0) if p["weights"] == "uniform" else F.try_divide(F.lit(1.0), F.col("distance"))
        zero = inside & (F.col("distance") == 0)
        share = F.coalesce(F.avg(F.when(zero, F.col("vote"))) if p["weights"] != "uniform" else F.lit(None),
                           F.try_divide(F.sum(F.when(inside, weight * F.col("vote"))), F.sum(F.when(inside, weight))))
        shares.append(F.struct(F.lit(i).alias("candidate"), F.round(share, 12).alias("score")))
    scored = found.groupBy("part", "id").agg(F.max("y").alias("y"), F.array(*shares).alias("s")).select("part", "y", F.explode("s").alias("s")).select("part", "y", "s.*")
    scores: dict[int, list[float]] = {}
    for r in M.roc_auc_by(materialise(scored, "vote-scores"), "y", "score", ["candidate", "part"]).orderBy("candidate", "part").collect():  # candidates x folds
        scores.setdefault(r["candidate"], []).append(float(r["roc_auc"] or 0.0))
    best = max(scores, key=lambda i: (np.mean(scores[i]), -i))
    return sets[best], float(np.mean(scores[best])), float(np.std(scores[best]))


def _points(rows: DataFrame) -> DataFrame:
    """(id, x, label): synthetic rows share the id of the row they come from, so rows get numbers of their own."""
    return rows.select(F.monotonically_increasing_id().alias("id"), vector_to_array("scaled").alias("x"), "label")


# ---------------------------------------------------------------- churn
@dataclass
class ChurnResult:
    name: str
    model: Any
    params: dict
    threshold: float
    cv_mean: float
    cv_std: float
    val: dict = field(default_factory=dict)
    test: dict = field(default_factory=dict)
    seconds: float = 0.0


def probability(scored: DataFrame, name: str = "p") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1])


def quality(scored: DataFrame, threshold: float, label: str = "churn", score: str = "p") -> dict[str, float]:
    row = M.confusion(scored, label, score, threshold).first().asDict()
    return {**row, "roc_auc": M.roc_auc(scored, label, score).first()["roc_auc"], "threshold": threshold}


def train_churn(name: str, rows: DataFrame, settings: Settings = DEFAULTS, space: Mapping | None = None) -> ChurnResult:
    """Search, fit, threshold on validation, one evaluation on test."""
    fit_rows = rows.where("split = 'train'")
    n_rows, n_columns = fit_rows.count(), len(rows.select("features").first()["features"])
    make = lambda p: churn_estimator(name, p, n_rows, n_columns, settings)
    sets = candidates(space or SEARCH_SPACES[name], settings.search_iterations, settings.seed)
    start = time.time()
    parts = fit_parts(fit_rows, settings)
    if name in BOOSTED:
        made = None
        if settings.imbalance == "smote":
            for held, part in parts.items():
                new = part.where("is_new").withColumn("part", F.lit(boosting.SYNTHETIC + (boosting.VALIDATION if held is None else held)))
                made = new if made is None else made.unionByName(new)
        found = boosting.search(rows, "label", [{**BOOSTED[name], **p} for p in sets], settings.cv_folds, BOOSTED_ROUNDS, BOOSTED_PATIENCE,
                                weight="weight" if made is None else None, seed=settings.seed, synthetic=made)
        model, best, mean, std = found.model, {**found.params, "rounds": found.rounds}, found.score, found.deviation
    elif name == "random_forest" and settings.imbalance != "smote" and forests.grown_by_tree(n_rows):
        best, mean, std, model = forests.search(fit_rows, sets, settings.cv_folds, n_rows, settings.seed)
    elif name == "ann" and settings.imbalance != "smote" and perceptron.fitted_in_tasks(n_rows):
        best, mean, std, model = perceptron.search(fit_rows, sets, settings.cv_folds, BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="raw"), ANN_ITERATIONS, settings.seed)
    elif name == "knn":
        best, mean, std = neighbour_search(sets, fit_rows, settings, parts)
        model = NeighbourVote(materialise(_points(parts[None]), "vote-points"), best["n_neighbors"], best["weights"])
    else:
        if name in NESTED:
            best, mean, std = nested_search(make, sets, fit_rows, settings, parts, fits_at_once(fit_rows, n_rows))
        else:
            best, mean, std = search(make, sets, fit_rows, BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="raw"), settings, parts)
        model = make(best).fit(parts[None])
    seconds = time.time() - start
    scored = probability(model.transform(rows.where("split <> 'train'"))).select("split", "churn", "p").persist()
    try:
        val, test = scored.where("split = 'val'"), scored.where("split = 'test'")
        threshold = float(M.best_threshold(val, "churn", "p", settings.min_recall).first()["threshold"])
        return ChurnResult(name, model, best, threshold, mean, std, quality(val, threshold), quality(test, threshold), seconds)
    finally:
        scored.unpersist()


def choose_production(results: Sequence[ChurnResult], allowed: Sequence[str] = tuple(PRODUCTION_CANDIDATES)) -> ChurnResult:
    """Best validation AUC, then recall, among the tree models. Looks at a handful of metric rows."""
    return max((x for x in results if x.name in allowed), key=lambda x: (x.val["roc_auc"], x.val["recall"]))


# ---------------------------------------------------------------- value
def train_value(rows: DataFrame, settings: Settings = DEFAULTS, spaces: Mapping[str, Mapping] | None = None):
    """Ridge and boosted trees on ``clv_target``; the better cross-validated R2 wins. Returns (winner, results)."""
    fit_rows = rows.where("split = 'train'")
    facts = fit_rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("clv_target").alias("sd")).first()
    evaluator = RegressionEvaluator(labelCol="clv_target", metricName="r2")

    def ridge(p):
        # Spark divides the penalty by the label's deviation and the loss by n
        return LinearRegression(featuresCol="scaled", labelCol="clv_target", elasticNetParam=0.0, standardization=False,
                                regParam=p["alpha"] / facts["n"] * float(facts["sd"] or 1.0))

    results = {}
    for name in ("clv_ridge", "clv_boosted"):
        sets = candidates((spaces or SEARCH_SPACES)[name], settings.search_iterations, settings.seed)
        if name == "clv_ridge":
            best, mean, std = search(ridge, sets, fit_rows, evaluator, settings)
            model = ridge(best).fit(fit_rows)
        else:  # rounds up to n_estimators, as many as the held-out loss asks for
            found = boosting.search(rows, "clv_target", sets, settings.cv_folds, max(p["n_estimators"] for p in sets), BOOSTED_PATIENCE, squared=True, seed=settings.seed)
            model, best, mean, std = found.model, {**found.params, "rounds": found.rounds}, found.score, found.deviation
        held = model.transform(rows.where("split <> 'train'"))
        metrics = {s: M.regression_quality(held.where(F.col("split") == s), "clv_target", "prediction").first().asDict() for s in ("val", "test")}
        results[name] = {"model": model, "params": best, "cv_r2": mean, "cv_r2_std": std, **metrics}
    return max(results, key=lambda k: results[k]["cv_r2"]), results


# ---------------------------------------------------------------- next category
def train_next_category(rows: DataFrame, settings: Settings = DEFAULTS, trees: int = CATEGORY_TREES):
    """Forest on customers with a next category. Returns (model, labels in probability order, test quality)."""
    known = rows.where(F.col("next_category").isNotNull()).drop("weight")
    fit_rows = known.where("split = 'train'")
    weighted = M.with_weights(fit_rows, "next_category", M.class_weights(fit_rows, "next_category"))
    indexer = StringIndexer(inputCol="next_category", outputCol="category_index", stringOrderType="alphabetAsc", handleInvalid="skip")
    fitted_index = indexer.fit(weighted)
    labels, n_rows = list(fitted_index.labels), fit_rows.count()
    if forests.grown_by_tree(n_rows) and len(labels) > 1:
        scoring = forests.fit_classes(fitted_index.transform(weighted), "category_index", labels, n_rows, CATEGORY_MIN_LEAF, CATEGORY_MAX_DEPTH, trees, settings.seed)
        return scoring, labels, category_quality(scoring, known)
    forest = RandomForestClassifier(labelCol="category_index", weightCol="weight", numTrees=trees, minInstancesPerNode=CATEGORY_MIN_LEAF,
                                    maxDepth=CATEGORY_MAX_DEPTH, seed=settings.seed, predictionCol="category_prediction", probabilityCol="category_probability",
                                    rawPredictionCol="category_raw", **NODE_IDS)
    back = IndexToString(inputCol="category_prediction", outputCol="predicted_category", labels=labels)
    forest_model = forest.fit(fitted_index.transform(weighted))
    scoring = PipelineModel(stages=[forest_model, back])
    return scoring, labels, category_quality(scoring, known)


def category_quality(scoring, known: DataFrame) -> dict[str, float]:
    test = scoring.transform(known.where("split = 'test'"))
    return M.multiclass_quality(test, "next_category", "predicted_category").first().asDict()
