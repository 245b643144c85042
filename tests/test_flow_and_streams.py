from __future__ import annotations

import re
from datetime import datetime

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from patronage.functions import ordering as O
from patronage.operators import clean as C
from patronage.operators import encode as E
from patronage.operators import evaluate as M
from patronage.operators import explain as EX
from patronage.operators import explain_models as XM
from patronage.operators import features as X
from patronage.operators.validate import split_records
from patronage.plans import flow, reports
from patronage.plans import score as S
from patronage.sources import runlog, sinks
from patronage.sources.retail_view import raw_lines
from patronage.streaming import jobs
from registry.context import RETAIL

SHORT = {
    "logistic_regression": {"C": [0.1, 1.0], "l1_ratio": [0.0, 1.0]},
    "decision_tree": {"max_depth": [3, 5], "min_samples_leaf": [20]},
    "random_forest": {"n_estimators": [20], "max_depth": [6], "min_samples_leaf": [5, 10]},
    "boosted_trees": {"learning_rate": [0.1], "max_depth": [3], "subsample": [0.85], "colsample": [0.8, 1.0], "n_estimators": [8]},
    "clv_ridge": {"alpha": [1.0, 100.0]},
    "clv_boosted": {"max_depth": [3], "learning_rate": [0.1], "n_estimators": [8]},
}
QUICK = RETAIL.with_(cv_folds=2, search_iterations=1, k_max=3, kmeans_restarts=1)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("flow"))
    raw = raw_lines(spark, SMALL)
    halves = [raw.where(F.year("invoice_date") < 1999), raw.where(F.year("invoice_date") >= 1999)]
    result = flow.run(spark, halves, root, "run-1", QUICK, spaces=SHORT, churn_models=("logistic_regression", "random_forest"), category_trees=5)
    return flow.Paths(root), result


def test_flow_writes_whole_tables(spark, built):
    paths, result = built
    report = result["cleaning"]
    assert report["rows_in"] - report["rows_out"] > 0 and report["n_entry_errors"] > 0
    scoring = flow.snapshot(spark, paths, "scoring")
    n = scoring.count()
    published = result["published"]
    assert published["customers"] == published["predictions"] == published["segments"] == n
    read = lambda t: sinks.read_published(spark, paths.of("published"), t)[0]
    p = read("predictions")
    assert p.select("customer_id").distinct().count() == n
    assert p.where("churn_probability < 0 OR churn_probability > 1 OR predicted_clv_90d < 0 OR risk_tier NOT IN ('High', 'Medium', 'Low')").isEmpty()
    assert sinks.orphans(read("transactions"), read("customers")).isEmpty()
    view = reports.scored_view(read("customers"), p, read("segments"))
    assert reports.key_figures(view).first()["customers"] == n
    assert reports.leaderboard(view, 10).count() == min(10, n)
    profile = read("segment_profiles").collect()
    assert sum(r["customers"] for r in profile) == n and all(r["mean_churn_probability"] is not None for r in profile)
    table = M.comparison_table(runlog.read(spark, paths.of("run_log")), "run-1").collect()
    assert [r["rank"] for r in table] == [1, 2]


def test_published_predictions_carry_reasons(spark, built):
    """Contributions of every customer add up to the score less the mean score of the background rows walked from."""
    paths, _ = built
    p, = sinks.read_published(spark, paths.of("published"), "predictions")
    models = S.load(spark, paths.of("models"))
    d = len(models.encoder.columns)
    got = p.select("customer_id", "churn_probability", "top_reasons", F.map_values(F.from_json("shap_json", "map<string,double>")).alias("c"))
    rows = got.select("*", F.aggregate("c", F.lit(0.0), lambda a, b: a + b).alias("sum"), F.size("c").alias("n")).collect()
    assert all(r["n"] == d and r["top_reasons"].endswith(".") for r in rows)
    scoring = models.encoder.transform(flow.snapshot(spark, paths, "scoring"), ["customer_id"], QUICK)
    plain = XM.permutation_shapley(scoring, models.background, models.churn, models.encoder.columns, seed=QUICK.seed).groupBy("customer_id").agg(F.sum("contribution").alias("s"))
    want = {r["customer_id"]: r["s"] for r in plain.collect()}
    assert all(r["sum"] == pytest.approx(want[r["customer_id"]], abs=2e-5 * d) for r in rows)
    assert reports_top(spark, p)


def reports_top(spark, predictions) -> bool:
    top = EX.top_contributions(predictions, 3)
    return top.groupBy("customer_id").count().where("count <> 3").isEmpty()


def test_reports_of_the_run(spark, built):
    paths, result = built
    vif = spark.read.parquet(paths.of("vif_report")).collect()
    assert {r["status"] for r in vif} <= {"kept", "dropped"} and all(r["vif"] <= 10 or r["feature"] in QUICK.vif_protected for r in vif if r["status"] == "kept")
    log = runlog.read(spark, paths.of("run_log"), "run-1")
    anomaly = log.where("task = 'anomaly'").select(*[runlog.metric(m).alias(m) for m in ("flag_rate_train", "flag_rate_val", "flag_rate_test", "spearman_vs_mahalanobis")]).first()
    assert 0 < anomaly["flag_rate_train"] < 0.05 and -1 <= anomaly["spearman_vs_mahalanobis"] <= 1
    seg = log.where("task = 'segmentation'").select(runlog.metric("kmeans_silhouette").alias("s"), runlog.metric("kmeans_davies_bouldin").alias("d"), runlog.metric("adjusted_rand").alias("a")).first()
    assert -1 <= seg["s"] <= 1 and seg["d"] > 0 and -1 <= seg["a"] <= 1
    assert result["segmentation"]["secondary_algorithm"] == "mixture"


def test_a_failed_reload_leaves_the_old_version_whole(spark, tmp_path):
    folder = str(tmp_path / "published")
    one = {"a": spark.range(3), "b": spark.range(4)}
    assert sinks.replace_all(one, folder) == {"a": 3, "b": 4}
    broken = spark.range(5).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.replace_all({"a": spark.range(30), "b": broken}, folder)
    assert [t.count() for t in sinks.read_published(spark, folder, "a", "b")] == [3, 4]
    held = sinks.read_published(spark, folder, "a")[0]
    for n in (10, 11, 12):
        sinks.replace_all({"a": spark.range(n), "b": spark.range(n)}, folder)
        assert [t.count() for t in sinks.read_published(spark, folder, "a", "b")] == [n, n]
        if n == 10:
            assert held.count() == 3  # a reader of the version before goes on
    assert len(list((tmp_path / "published" / "manifests").glob("*.json"))) == 2


def test_saved_models_score_the_same(spark, built):
    paths, _ = built
    scoring = flow.snapshot(spark, paths, "scoring")
    again = S.score(scoring, S.load(spark, paths.of("models")), QUICK).select("customer_id", F.round("churn_probability", 9).alias("p"))
    stored = sinks.read_published(spark, paths.of("published"), "predictions")[0].select("customer_id", F.round("churn_probability", 9).alias("p"))
    assert again.exceptAll(stored).isEmpty() and again.count() == stored.count()


def test_month_folders_are_pruned(spark, built):
    clean = flow.clean_lines(spark, built[0])
    plan = X.point_in_time(clean, [datetime(1996, 1, 1)])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*invoice_month", plan)


def test_stream_scores_equal_batch_scores(spark, built, tmp_path):
    paths, _ = built
    models = S.load(spark, paths.of("models"))
    records = flow.snapshot(spark, paths, "scoring").drop("engagement_score").withColumn(
        "return_rate", F.when(F.col("customer_id") % 5 == 0, 2.0).otherwise(F.col("return_rate")))
    records.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), records.schema, files_per_batch=1)
    jobs.start(stream, jobs.score_batches(models, str(tmp_path / "out"), str(tmp_path / "bad"), QUICK), str(tmp_path / "check")).awaitTermination()
    valid, rejects = split_records(records)
    batch = S.score(E.fill_engagement(valid, flow.snapshot(spark, paths, "train")).drop("category_affinity"), models, QUICK)
    shape = lambda d: d.select("customer_id", "risk_tier", F.round("churn_probability", 9), F.round("engagement_score", 6))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert shape(out).exceptAll(shape(batch)).isEmpty() and out.count() == batch.count() > 0
    assert spark.read.parquet(str(tmp_path / "bad")).count() == rejects.count() > 0


def test_upsert_is_idempotent(spark, tmp_path):
    table = str(tmp_path / "p")
    write = jobs.upsert_batches(table)
    one = spark.createDataFrame([(1, 0.1, 1), (1, 0.2, 2), (2, 0.3, 1)], "customer_id long, p double, scored_at int")
    two = spark.createDataFrame([(2, 0.9, 5), (3, 0.4, 5)], "customer_id long, p double, scored_at int")
    for batch, i in ((one, 0), (two, 1), (two, 1), (one, 0)):
        write(batch, i)
    rows = lambda t: {r["customer_id"]: r["p"] for r in jobs.current_rows(spark, t).collect()}
    assert rows(table) == {1: 0.2, 2: 0.9, 3: 0.4}
    jobs.compact(spark, table, str(tmp_path / "q"))
    assert rows(str(tmp_path / "q")) == rows(table)


def test_stream_cleaning_drops_copies_across_batches(spark, tmp_path):
    raw = raw_lines(spark, SMALL).limit(500)
    for i in range(2):  # the same rows arrive twice
        raw.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    distinct = C.drop_exact_duplicates(C.drop_incomplete(raw))
    stream = jobs.read_stream(spark, str(tmp_path / "in/*"), raw.schema, files_per_batch=1)
    run = jobs.clean_batches(str(tmp_path / "out"), str(tmp_path / "keys"), C.Fences.saved(113.0, 13104.0), C.product_table(distinct, RETAIL), RETAIL)
    jobs.start(stream, run, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == distinct.count()


def test_late_lines_are_kept_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    line = lambda invoice, day: (invoice, "P1", "MUG", 1.0, datetime.fromisoformat(day), 2.0, 1, "FRANCE")
    frame = lambda *rows: spark.createDataFrame(rows, raw_lines(spark, SMALL).schema)
    batches = [frame(line("1", "2011-06-01"), line("1", "2011-06-01")), frame(line("2", "2011-06-02"), line("1", "2011-06-01")), frame(line("3", "2010-01-05"))]
    products = C.product_table(batches[0], RETAIL)
    run = jobs.clean_batches(str(tmp_path / "out"), str(tmp_path / "keys"), C.Fences.saved(113.0, 13104.0), products, RETAIL)
    for i in (0, 1, 2, 2, 1, 0):
        run(batches[i], i)
    assert sorted(r["invoice"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def test_map_and_null_shares_are_scored(spark, built):
    paths, _ = built
    models = S.load(spark, paths.of("models"))
    columns = flow.snapshot(spark, paths, "scoring").limit(20).drop("engagement_score")
    first = columns.first()
    shares = [c for c in columns.columns if c.startswith("affinity_")]
    as_map = columns.withColumn("category_affinity", F.map_from_entries(F.array(*[F.struct(F.lit(c[9:]).alias("key"), F.col(c).alias("value")) for c in shares]))).drop(*shares)
    nulls = columns.withColumn(shares[0], F.lit(None).cast("double"))
    zeros = columns.withColumn(shares[0], F.lit(0.0))

    def scores(records):
        valid, rejects = split_records(records)
        assert rejects.isEmpty()
        out = S.score(E.fill_from_steps(valid, models.ecdf).drop("category_affinity"), models, QUICK)
        return {r["customer_id"]: (round(r["churn_probability"], 9), *[r[c] for c in shares]) for r in out.collect()}

    assert scores(as_map) == scores(columns) and first["customer_id"] in scores(columns)
    assert scores(nulls) == scores(zeros)


def test_newest_version_wins_over_a_later_batch(spark, tmp_path):
    table = str(tmp_path / "p")
    write = jobs.upsert_batches(table)
    write(spark.createDataFrame([(1, 0.9, 5)], "customer_id long, p double, scored_at int"), 0)
    write(spark.createDataFrame([(1, 0.1, 2)], "customer_id long, p double, scored_at int"), 1)
    assert jobs.current_rows(spark, table).first()["p"] == 0.9


def test_log_and_reload(spark, tmp_path):
    path = str(tmp_path / "log")
    for run in ("a", "b"):
        runlog.append(spark, path, [runlog.record(run, "churn", "m", "test", {"roc_auc": 0.5, "note": "text"}, {"C": 1.0, "units": [1, 2]}, 1.23456)])
    flat = runlog.flat(runlog.read(spark, path, "b")).collect()
    assert {(r["metric"], r["value"]) for r in flat} == {("roc_auc", 0.5), ("note", None)}
    df = spark.range(25)
    assert sinks.replace_table(df, str(tmp_path / "t")) == 25 and sinks.replace_table(df, str(tmp_path / "t")) == 25
    assert spark.read.parquet(str(tmp_path / "t")).count() == 25
    sinks.export_csv(spark.createDataFrame([(1, ["a", "b"], 'x "y", z')], "id long, c array<string>, t string"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back["c"] == "a,b" and back["t"] == 'x "y", z'


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_pairwise_joins_and_hash_aggregations(spark, small):
    sub = X.point_in_time(small.clean, [small.cutoffs[0]])
    frames = {
        "features": X.customer_features(small.clean, [small.cutoffs[0]], RETAIL),
        "labels": X.labels(small.clean, [small.cutoffs[0]], RETAIL),
        "orders": X.orders(sub, RETAIL),
        "clean": C.clean_distinct(small.distinct, RETAIL, small.fences),
        "ecdf": E.with_ecdf(small.scoring, small.train),
        "auc": M.roc_auc(small.scored_train, "y", "p"),
        "tiers": E.value_tiers(small.scoring),
    }
    for name, df in frames.items():
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    for name in ("labels", "orders"):
        assert "SortAggregate" not in plan_of(frames[name]), name
    limited = plan_of(O.hash_sample(small.scoring, "customer_id", 10, 1))
    assert "TakeOrderedAndProject" in limited
