"""The batch flow: lines -> clean table -> snapshots -> models -> scored and segmented customers -> published tables.

Each stage reads written tables and writes its own, so a stage can be run again alone, and a lost
executor costs a task, not the flow.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from patronage.config import DEFAULTS, Settings
from patronage.operators import clean as C
from patronage.operators import encode as E
from patronage.operators import features as X
from patronage.operators import segment as G
from patronage.operators.validate import validate_features, validate_transactions
from patronage.plans import score as S
from patronage.session import Scratch, materialise
from patronage.sources import invoices, runlog, sinks


@dataclass(frozen=True)
class Paths:
    root: str

    def of(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def stage_land(frames: Sequence[DataFrame], paths: Paths) -> None:
    """Standardise and unite the sources."""
    invoices.land(invoices.combine_sources(frames), paths.of("lines_raw"))


def stage_clean(spark: SparkSession, paths: Paths, settings: Settings = DEFAULTS) -> dict[str, Any]:
    """Validate, clean, write by month; returns the cleaning report (one row of counts)."""
    raw = spark.read.parquet(paths.of("lines_raw"))
    raw_stats = validate_transactions(raw, settings)
    distinct = materialise(C.drop_exact_duplicates(C.drop_incomplete(raw)), "distinct-lines", compact=True)
    fences = C.tukey_fences(distinct, settings.iqr_multiplier)
    sinks.replace_table(fences.coalesce(1), paths.of("fences"))
    edges = spark.read.parquet(paths.of("fences")).first()
    sinks.replace_table(C.product_table(distinct, settings), paths.of("products"))
    clean = C.clean_distinct(distinct, settings, C.Fences.saved(edges["q_hi"], edges["p_hi"]), spark.read.parquet(paths.of("products")))
    sinks.write_clean(clean, paths.of("lines_clean"))
    back = clean_lines(spark, paths)
    complete = C.drop_incomplete(raw).count()
    report = {**C.cleaning_counts(back).first().asDict(), "rows_complete": complete, "exact_duplicates_removed": complete - distinct.count()}
    clean_stats = validate_transactions(back, settings)
    return {**report, "rows_in": raw_stats["rows"], "raw_validation": raw_stats, "clean_validation": clean_stats,
            "fences": edges.asDict()}


def clean_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.parquet(paths.of("lines_clean"))


def stage_features(spark: SparkSession, paths: Paths, settings: Settings = DEFAULTS) -> dict[str, Any]:
    """Training snapshot with labels and scoring snapshot, engagement filled from the training values."""
    train, scoring, popularity = X.train_and_scoring(clean_lines(spark, paths), settings)
    train = materialise(train, "train-base", *X.KEY)
    scoring = materialise(scoring, "scoring-base", *X.KEY)
    sinks.write_snapshots(E.fill_engagement(train, train), E.fill_engagement(scoring, train), paths.of("snapshots"))
    sinks.replace_table(popularity.select("stock_code", "popularity"), paths.of("popularity"))
    return {name: validate_features(snapshot(spark, paths, name), settings.feature_columns) for name in ("train", "scoring")}


def snapshot(spark: SparkSession, paths: Paths, name: str) -> DataFrame:
    return sinks.read_snapshot(spark, paths.of("snapshots"), name)


def stage_train(spark: SparkSession, paths: Paths, run_id: str, settings: Settings = DEFAULTS, **options: Any) -> S.FittedModels:
    train = snapshot(spark, paths, "train")
    models, log = S.fit_all(train, run_id, settings, **options)
    report = E.vif_report(train, settings)
    sinks.replace_table(spark.createDataFrame(report, "feature string, vif double, status string").coalesce(1), paths.of("vif_report"))
    runlog.append(spark, paths.of("run_log"), log)
    S.save(models, paths.of("models"))
    return models


def stage_segment(spark: SparkSession, paths: Paths, settings: Settings = DEFAULTS, run_id: str = "", secondary: str = "mixture") -> dict[str, Any]:
    assignments, profiles, metrics = G.segment_customers(snapshot(spark, paths, "scoring"), settings, secondary)
    told = {f"{n}_{k}": v for n in ("kmeans", "secondary") for k, v in metrics[f"{n}_quality"].items()}
    runlog.append(spark, paths.of("run_log"), [runlog.record(run_id, "segmentation", secondary, "all", {**told, "k": metrics["k"], "adjusted_rand": metrics["adjusted_rand"]})])
    sinks.replace_table(assignments, paths.of("segments"))
    sinks.replace_table(profiles, paths.of("segment_profiles_base"))
    return metrics


def stage_score(spark: SparkSession, paths: Paths, settings: Settings = DEFAULTS, models: S.FittedModels | None = None) -> dict[str, int]:
    """Score and explain the scoring snapshot, add churn to the segment profiles, publish the serving tables at once."""
    models = models or S.load(spark, paths.of("models"))
    scoring = snapshot(spark, paths, "scoring")
    plain = materialise(S.score_snapshot(scoring, models, settings).drop(*settings.feature_columns), "plain-scores")
    sinks.replace_table(S.explained(scoring, plain, models, settings), paths.of("scores"))
    scores = spark.read.parquet(paths.of("scores"))
    segments = spark.read.parquet(paths.of("segments"))
    profiles = G.add_churn_to_profile(
        spark.read.parquet(paths.of("segment_profiles_base")).withColumnRenamed("segment", "kmeans_segment"), segments,
        scores.select("customer_id", "churn_probability", "risk_tier"), "kmeans_segment")
    predictions = scores.select("customer_id", "churn_probability", "churn_predicted", "risk_tier", "predicted_clv_90d", "at_risk_value",
                                "anomaly_score", "is_anomaly", "recommended_categories", "shap_json", "top_reasons", "model_version", "scored_at")
    return sinks.replace_all({
        "customers": sinks.publish_customers(scoring, settings.feature_columns),
        "transactions": sinks.publish_lines(clean_lines(spark, paths), scoring),
        "predictions": predictions,
        "segments": segments,
        "segment_profiles": profiles,
    }, paths.of("published"))


def run(spark: SparkSession, frames: Sequence[DataFrame], root: str, run_id: str, settings: Settings = DEFAULTS, secondary: str = "mixture",
        **options: Any) -> dict[str, Any]:
    """All stages in order. Each stage's intermediate tables go at its end."""
    paths = Paths(root)
    with Scratch():
        stage_land(frames, paths)
        report = stage_clean(spark, paths, settings)
    with Scratch():
        checks = stage_features(spark, paths, settings)
    with Scratch():
        stage_train(spark, paths, run_id, settings, **options)
        models = S.load(spark, paths.of("models"))
    with Scratch():
        segmentation = stage_segment(spark, paths, settings, run_id, secondary)
        counts = stage_score(spark, paths, settings, models)
    return {"cleaning": report, "features": checks, "segmentation": segmentation, "published": counts}


__all__ = ["Paths", "stage_land", "stage_clean", "stage_features", "stage_train", "stage_segment", "stage_score", "run", "snapshot",
           "clean_lines"]
