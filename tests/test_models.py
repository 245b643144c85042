from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from patronage.config import DEFAULTS
from patronage.functions.expressions import hash_unit
from patronage.operators import anomaly as A
from patronage.operators import evaluate as M
from patronage.operators import explain as X
from patronage.operators import explain_models as XM
from patronage.operators import models as P
from patronage.operators import segment as G
from patronage.session import materialise

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    """A label that follows two of three hash-derived features."""
    u = lambda s: hash_unit(F.col("customer_id"), s)
    df = spark.range(3000).withColumnRenamed("id", "customer_id").select(
        "customer_id", *[(u(c) * 4 - 2).alias(c) for c in COLS])
    logit = 2.0 * F.col("a") - 1.5 * F.col("b")
    df = df.withColumn("churn", (u("noise") < 1 / (1 + F.exp(-logit))).cast("int")).withColumn("label", F.col("churn").cast("double"))
    df = df.withColumns({"clv_target": 3 * F.col("a") + u("n2"), "weight": F.lit(1.0), "split": F.when(u("split") < 0.7, "train").when(u("split") < 0.85, "val").otherwise("test"),
                         "fold": F.pmod(F.col("customer_id"), F.lit(2)).cast("int"),
                         "next_category": F.when(F.col("a") > 0.5, "toys").when(F.col("b") > 0, "bags").otherwise("other")})
    scaler = G.Standardiser.fit(df.where("split = 'train'"), COLS)
    return materialise(scaler.vector(VectorAssembler(inputCols=COLS, outputCol="features").transform(df), "scaled"), "planted")


FAST = DEFAULTS.with_(cv_folds=2, search_iterations=2)


@pytest.mark.parametrize("name,space,floor", [
    ("logistic_regression", {"C": [0.1, 1.0], "l1_ratio": [0.0, 1.0]}, 0.85),
    ("decision_tree", {"max_depth": [4], "min_samples_leaf": [20]}, 0.78),
    ("random_forest", {"n_estimators": [15], "max_depth": [5], "min_samples_leaf": [5]}, 0.82),
    ("boosted_trees", {"learning_rate": [0.1], "max_depth": [3], "subsample": [0.85], "colsample": [1.0], "n_estimators": [15]}, 0.82),
    ("boosted_leaves", {"learning_rate": [0.1], "num_leaves": [7], "subsample": [0.85], "colsample": [1.0], "n_estimators": [15]}, 0.82),
    ("knn", {"n_neighbors": [15, 41], "weights": ["uniform", "distance"]}, 0.80),
    ("ann", {"hidden_units": [(8, 4)], "max_iter": [40]}, 0.80)])
def test_churn_models_find_the_signal(planted, name, space, floor):
    r = P.train_churn(name, planted, FAST, space)
    assert r.test["roc_auc"] > floor and r.val["recall"] >= 0.7 - 1e-9 and r.cv_mean > floor - 0.05
    scored = P.probability(r.model.transform(planted))
    low, high = scored.agg(F.avg(F.when(F.col("a") < -1, F.col("p"))), F.avg(F.when(F.col("a") > 1, F.col("p")))).first()
    assert low < high


@pytest.mark.parametrize("name,space", [
    ("logistic_regression", {"C": [1.0], "l1_ratio": [0.0]}), ("decision_tree", {"max_depth": [4], "min_samples_leaf": [20]}), ("knn", {"n_neighbors": [15], "weights": ["distance"]}),
    ("boosted_trees", {"learning_rate": [0.2], "max_depth": [3], "subsample": [1.0], "colsample": [1.0], "n_estimators": [8]})])
def test_synthetic_rows_level_the_labels_of_every_fit(planted, name, space):
    rare = materialise(planted.where("label = 1 OR customer_id % 5 = 0 OR split <> 'train'").withColumn("weight", F.lit(1.0)), "rare")
    settings = FAST.with_(imbalance="smote")
    parts = P.fit_parts(rare.where("split = 'train'"), settings)
    for fold, part in parts.items():
        n = {r["label"]: r["count"] for r in part.groupBy("label").count().collect()}
        assert abs(n[0.0] - n[1.0]) < 0.08 * n[1.0]
        assert part.where("is_new AND label = 1").count() == 0  # the rarer label is made
    r = P.train_churn(name, rare, settings, space)
    assert r.test["roc_auc"] > 0.75 and r.cv_mean > 0.7


def test_value_and_category_models(planted):
    winner, results = P.train_value(planted, FAST, {"clv_ridge": {"alpha": [1.0, 10.0]}, "clv_boosted": {"max_depth": [2], "learning_rate": [0.1], "n_estimators": [5]}})
    assert winner == "clv_ridge" and results[winner]["test"]["r2"] > 0.95
    rows = planted.where("split = 'train'").select("scaled", "clv_target").collect()
    x, y = np.array([r["scaled"].toArray() for r in rows]), np.array([r["clv_target"] for r in rows])
    alpha = results["clv_ridge"]["params"]["alpha"]
    want = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(3), (x - x.mean(0)).T @ (y - y.mean()))
    assert list(results["clv_ridge"]["model"].coefficients) == pytest.approx(list(want), rel=1e-3, abs=1e-3)
    _model, labels, found = P.train_next_category(planted, FAST, 10)
    assert labels == ["bags", "other", "toys"] and found["accuracy"] > 0.85


def test_shapley_adds_up_and_matches_a_linear_model(planted):
    model = LinearRegression(featuresCol="features", labelCol="clv_target").fit(planted)
    rows = planted.where("customer_id < 40")
    base = XM.background_rows(planted.where("customer_id = 77"), 10, 1)  # one background row
    got = XM.permutation_shapley(rows, base, model, COLS, permutations=2)
    centre = planted.where("customer_id = 77").first()["features"].toArray()
    w = model.coefficients.toArray()
    for r in got.collect():
        i = COLS.index(r["feature"])
        assert r["contribution"] == pytest.approx(w[i] * (r["value"] - centre[i]), abs=1e-9)
    classifier = LogisticRegression(featuresCol="features", labelCol="label").fit(planted)
    many = XM.background_rows(planted, 50, 1)
    sums = {r["customer_id"]: r["s"] for r in XM.permutation_shapley(rows, many, classifier, COLS, permutations=4)
            .groupBy("customer_id").agg(F.sum("contribution").alias("s")).collect()}
    p = {r["customer_id"]: r["p"] for r in P.probability(classifier.transform(rows)).collect()}
    mean_base = P.probability(classifier.transform(planted)).agg(F.avg("p")).first()[0]
    assert len(sums) == 40 and all(abs(sums[c] - (p[c] - mean_base)) < 0.8 for c in p)
    assert np.corrcoef([sums[c] for c in p], [p[c] for c in p])[0, 1] > 0.7
    arrays = XM.as_contributions(got, COLS).first()["contributions"]
    assert [c["feature"] for c in arrays] == COLS


def test_local_surrogate_and_partial_dependence(planted):
    model = LogisticRegression(featuresCol="features", labelCol="label").fit(planted)
    base = XM.background_rows(planted, 100, 1)
    got = XM.local_surrogate(planted.where("a > 1.5 AND b < -1.5 AND customer_id < 500"), base, model, COLS, samples=400)
    mean = {r["feature"]: r["w"] for r in got.groupBy("feature").agg(F.avg("weight").alias("w")).collect()}
    assert mean["a"] > 0.1 and mean["b"] > 0.1 and abs(mean["c"]) < 0.05  # both keep marks raise the score
    curve = [r["mean_score"] for r in XM.partial_dependence(planted, model, COLS, "a", 6).orderBy("grid_value").collect()]
    assert curve == sorted(curve) and curve[-1] - curve[0] > 0.4


def test_anomaly_scores_find_planted_rows(spark):
    cols = list(A.ANOMALY_FEATURES)
    u = lambda s: hash_unit(F.col("customer_id"), s)
    common = u("size") * 3
    df = spark.range(1500).withColumnRenamed("id", "customer_id").select(
        "customer_id", *[F.expm1(common + 0.2 * u(c)).alias(c) for c in cols])
    odd = F.col("customer_id") == 7  # large and small values where all others move together
    df = df.withColumns({c: F.when(odd, F.expm1(F.lit(9.0)) if i % 2 else F.lit(0.0)).otherwise(F.col(c)) for i, c in enumerate(cols)})
    model = A.fit_reconstruction(df.where(~odd))
    out = model.score(df)
    assert out.orderBy(F.col("anomaly_score").desc()).first()["customer_id"] == 7
    assert 0.005 < out.where(~odd).agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0] <= 0.0101
    maha = A.fit_mahalanobis(df)
    rows = maha.score(df).orderBy("customer_id").collect()
    z = np.log1p(np.array([[r[c] for c in cols] for r in rows]))
    z = (z - z.mean(0)) / z.std(0)
    want = np.einsum("ij,jk,ik->i", z, np.linalg.inv(np.cov(z.T) + 1e-6 * np.eye(len(cols))), z)
    assert [r["mahalanobis"] for r in rows] == pytest.approx(list(want), rel=1e-6)
    iso = A.fit_isolation(df, trees=30).score(df).orderBy(F.col("isolation").desc()).select("customer_id", "isolation").collect()
    assert [r["customer_id"] for r in iso].index(7) < 15 and 0 < iso[-1]["isolation"] < iso[0]["isolation"] < 1


def test_segment_names_and_search(spark):
    centres = [(10.0, 5.0, 100.0), (200.0, 1.0, 20.0), (40.0, 20.0, 5000.0)]
    rows = [(3 * i + j, *[v * (1 + 0.02 * ((i * 7 + k) % 11)) for k, v in enumerate(c)]) for i in range(80) for j, c in enumerate(centres)]
    df = spark.createDataFrame(rows, "customer_id long, recency_days double, frequency double, total_spend double").withColumns(
        {"avg_basket_size": F.col("total_spend") / 10, "return_rate": F.lit(0.1), "seasonal_concentration": F.lit(0.3), "discount_sensitivity": F.lit(0.2),
         "avg_spend": F.col("total_spend") / F.col("frequency"), "engagement_score": F.lit(50.0), "historical_clv": F.col("total_spend")})
    assignments, profiles, metrics = G.segment_customers(df, DEFAULTS.with_(k_max=4, kmeans_restarts=2))
    assert metrics["k"] == 3 and assignments.count() == 240
    truth = assignments.withColumn("truth", (F.col("customer_id") % 3).cast("int"))
    assert G.adjusted_rand(truth, "kmeans_segment", "truth").first()[0] == pytest.approx(1.0)
    assert "Loyal High-Value" in {r["segment_label"] for r in profiles.collect()}
    same = df.withColumn("s", F.col("customer_id") % 4).withColumns({c: F.lit(1.0) for c in G.NAMING_COLUMNS})
    assert [r["segment_label"] for r in G.label_segments(same, "s").orderBy("s").collect()] == \
        ["Steady Mid-Value (A)", "Steady Mid-Value (B)", "Steady Mid-Value (C)", "Steady Mid-Value"]


def test_reason_text(spark):
    df = spark.createDataFrame([(1, 0.62, [("recency_days", 1234.5, 0.3), ("affinity_toys_games", 0.1, -0.4), ("country_France", 1.0, 0.1), ("frequency", None, 0.01)])],
                               "customer_id long, churn_probability double, contributions array<struct<feature string, value double, contribution double>>")
    text = X.reasons(df, {"recency_days": 30.0, "affinity_toys_games": 0.1, "country_France": 0.0}, 0.5).first()["top_reasons"]
    assert text == ("This customer is flagged as HIGH churn risk: predicted churn probability 62%, at or above the 50% operating threshold. "
                    "Main drivers (relative to the average customer): share of spend on toys games = 0.10 (typical) lowers the risk; "
                    "days since last purchase = 1,234.50 (higher than typical) raises the risk; country (France) = 1.00 raises the risk.")


def test_forests_remember_the_node_of_a_row():
    """Without this a level sends all trees grown so far to every task."""
    assert P.churn_estimator("random_forest", {"n_estimators": 2, "max_depth": 2, "min_samples_leaf": 1}, 10, 2).getCacheNodeIds()
    assert P.churn_estimator("decision_tree", {"max_depth": 2, "min_samples_leaf": 1}, 10, 2).getCacheNodeIds()


def test_a_saved_forest_is_read_once_for_all_its_cuts(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("customer_id"), (F.col("id") % 2).cast("int").alias("churn"), (F.col("id") % 2).cast("double").alias("label"),
                                  F.lit(1.0).alias("weight"), (F.floor(F.col("id") / 2) % 2).cast("int").alias("fold"), F.lit("train").alias("split"),
                                  (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"))
    rows = materialise(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows), "few-rows")
    settings = DEFAULTS.with_(cv_folds=2)
    read, cut = [], []
    saved, cuts = P.saved_nodes, P.cut_forest
    monkeypatch.setattr(P, "saved_nodes", lambda *a: read.append(a) or saved(*a))
    monkeypatch.setattr(P, "cut_forest", lambda *a: cut.append(a) or cuts(*a))
    sets = [{"n_estimators": n, "max_depth": d, "min_samples_leaf": 2} for n in (2, 4) for d in (1, 3)]
    P.nested_search(lambda p: P.churn_estimator("random_forest", p, 60, 2, settings), sets, rows, settings, P.fit_parts(rows, settings))
    assert (len(read), len(cut)) == (2, 8)  # folds; folds x parameter sets
