"""Queries of models train what they report, and no more."""
from __future__ import annotations

from types import SimpleNamespace

import pytest

import registry.model_queries as Q
from patronage.config import DEFAULTS
from patronage.operators import models as P
from patronage.plans import score as S
from registry.base import QUERIES

FIGURES = {"roc_auc": 0.5, "recall": 0.7, "f1": 0.4, "threshold": 0.3, "mae": 1.0, "rmse": 2.0}


@pytest.fixture
def ctx(spark, monkeypatch):
    monkeypatch.setattr(P, "training_table", lambda train, settings: (spark.range(1), None))
    return SimpleNamespace(spark=spark, train=spark.range(1), settings=DEFAULTS, folder="none")


@pytest.mark.parametrize("query, name", [("p02_logistic_regression", "logistic_regression"), ("p03_decision_tree", "decision_tree"),
                                         ("p04_random_forest", "random_forest"), ("p05_boosted_trees", "boosted_trees"), ("p06_feed_forward_network", "ann")])
def test_one_churn_model_is_trained(ctx, monkeypatch, query, name):
    asked = []
    monkeypatch.setattr(S, "fit_all", lambda *a, **k: asked.append("all") or (None, []))
    monkeypatch.setattr(P, "train_churn", lambda n, *a: asked.append(n) or P.ChurnResult(n, None, {}, 0.3, 0.6, 0.0, FIGURES, FIGURES))
    found = QUERIES[query](ctx).orderBy("split").collect()
    assert asked == [name] and [(r["split"], r["cv_roc_auc_mean"]) for r in found] == [("test", 0.6), ("val", 0.6)]


def test_value_models_and_anomaly_report_train_no_churn_model(ctx, monkeypatch):
    monkeypatch.setattr(S, "fit_all", lambda *a, **k: pytest.fail("trains every model"))
    one = {"val": FIGURES, "test": FIGURES, "cv_r2": 0.25}
    monkeypatch.setattr(P, "train_value", lambda *a: ("clv_ridge", {"clv_ridge": one, "clv_boosted": one}))
    assert QUERIES["p07_value_models"](ctx).count() == 4
    monkeypatch.setattr(S, "fit_anomaly", lambda *a: (None, {"threshold": 3}))
    assert [tuple(r) for r in QUERIES["p14_anomaly_report"](ctx).collect()] == [("threshold", 3.0)]


def test_scoring_trains_the_models_that_production_takes(ctx, monkeypatch):
    asked = []
    monkeypatch.setattr(S, "fit_all", lambda *a, **k: asked.append(k["churn_models"]) or ("models", []))
    assert Q.fitted(ctx) == "models" == Q.fitted(ctx)
    assert asked == [tuple(P.PRODUCTION_CANDIDATES)]
