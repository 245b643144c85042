"""Models, anomaly scores, clusters, explanations of models, neighbours and streams.

Rows-only unless the result has an SQL form. All run on whole tables with the default settings.
"""
from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from patronage.fixed_values import ANOMALY_FEATURES, SEGMENT_FEATURES, SEGMENT_LOG_FEATURES
from patronage.operators import anomaly as A
from patronage.operators import evaluate as M
from patronage.operators import explain as X
from patronage.operators import explain_models as XM
from patronage.operators import models as P
from patronage.operators import neighbours as N
from patronage.operators import segment as G
from patronage.plans import score as S
from patronage.session import materialise, shared_folder
from patronage.sources import runlog
from patronage.streaming import jobs
from registry.base import query, r, rounded
from registry.sqlbase import block, unit_hash

def model_rows(ctx):
    if not hasattr(ctx, "_model_rows"):
        rows, encoder = P.training_table(ctx.train, ctx.settings)
        ctx._model_rows = (materialise(rows, "model-rows"), encoder)
    return ctx._model_rows


@contextmanager
def training_rows(ctx):
    """Rows of one training, as ``fit_all`` makes and holds them."""
    rows = P.training_table(ctx.train, ctx.settings)[0].persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def fitted(ctx):
    """The models that score customers. Of the churn models only those that can go into production are trained: no other has
    a say in the choice, the threshold or a score."""
    if not hasattr(ctx, "_fitted"):
        ctx._fitted = S.fit_all(ctx.train, "run-1", ctx.settings, churn_models=tuple(P.PRODUCTION_CANDIDATES))[0]
    return ctx._fitted


# ------------------------------------------------------------------ preparation
def z_sql(columns, log=()):
    v = lambda c: f"ln(1 + greatest({c}, 0))" if c in log else c
    return r(*[f"({v(c)} - avg({v(c)}) OVER ()) / CASE WHEN stddev_pop({v(c)}) OVER () > 0 THEN stddev_pop({v(c)}) OVER () ELSE 1 END AS {c}" for c in columns])


def z_plain(columns, log=None):
    """SQL of standardised columns, unrounded; logarithms as the anomaly scores take them."""
    v = lambda c: f"ln(1 + greatest({c}, 0))"
    return [f"({v(c)} - avg({v(c)}) OVER ()) / CASE WHEN stddev_pop({v(c)}) OVER () > 0 THEN stddev_pop({v(c)}) OVER () ELSE 1 END AS {c}" for c in columns]


@query("p01_standardised_features", f"SELECT customer_id, {z_sql(ANOMALY_FEATURES)} FROM feats_tr", "feats_tr")
def _(ctx):
    scaler = G.Standardiser.fit(ctx.train, ANOMALY_FEATURES)
    return rounded(ctx.train.select("customer_id", *[v.alias(c) for c, v in zip(ANOMALY_FEATURES, scaler.values())]))


@query("g01_segmentation_features", f"SELECT customer_id, {z_sql(SEGMENT_FEATURES, SEGMENT_LOG_FEATURES)} FROM feats_sc", "feats_sc")
def _(ctx):
    scaler = G.Standardiser.fit(ctx.scoring, SEGMENT_FEATURES, SEGMENT_LOG_FEATURES)
    return rounded(ctx.scoring.select("customer_id", *[v.alias(c) for c, v in zip(SEGMENT_FEATURES, scaler.values())]))


# ------------------------------------------------------------------ churn, value, category
def _figures(ctx, name, by_split, figures):
    rows = [(name, split, *[float(found[f]) for f in figures]) for split, found in by_split.items()]
    return rounded(ctx.spark.createDataFrame(rows, "model string, split string, " + ", ".join(f"{f} double" for f in figures)))


def _churn(ctx, name):
    """Figures of one churn model; the others are not trained for them."""
    with training_rows(ctx) as rows:
        found = P.train_churn(name, rows, ctx.settings)
    by_split = {s: {**m, "cv_roc_auc_mean": found.cv_mean} for s, m in (("val", found.val), ("test", found.test))}
    return _figures(ctx, name, by_split, ("roc_auc", "recall", "f1", "threshold", "cv_roc_auc_mean"))


for _key, _name in (("p02_logistic_regression", "logistic_regression"), ("p03_decision_tree", "decision_tree"),
                    ("p04_random_forest", "random_forest"), ("p05_boosted_trees", "boosted_trees"), ("p06_feed_forward_network", "ann")):
    query(_key)(lambda ctx, name=_name: _churn(ctx, name))


@query("p07_value_models")
def _(ctx):
    with training_rows(ctx) as rows:
        _winner, found = P.train_value(rows, ctx.settings)
    parts = [_figures(ctx, name, {s: {**x[s], "cv_r2_mean": x["cv_r2"]} for s in ("val", "test")}, ("mae", "rmse", "cv_r2_mean"))
             for name, x in found.items()]
    return parts[0].unionByName(parts[1])


@query("p08_next_category")
def _(ctx):
    rows, _encoder = model_rows(ctx)
    scoring, _labels, _found = P.train_next_category(rows, ctx.settings)
    return scoring.transform(rows).groupBy("split", "next_category", "predicted_category").agg(F.count(F.lit(1)).alias("n"))


@query("p09_p10_train_all")
def _(ctx):
    _models, log = S.fit_all(ctx.train, "run-1", ctx.settings)
    path = f"{shared_folder(ctx.spark).rstrip('/')}/patronage/train-log-{uuid.uuid4().hex}"
    runlog.append(ctx.spark, path, log)
    return rounded(M.comparison_table(runlog.read(ctx.spark, path), "run-1"))


@query("p15_p16_scored_snapshot")
def _(ctx):
    return rounded(S.score_snapshot(ctx.scoring, fitted(ctx), ctx.settings).drop("scored_at").select(
        "customer_id", "churn_probability", "churn_predicted", "risk_tier", "predicted_clv_90d", "next_purchase_probability",
        "anomaly_score", "is_anomaly", "recommended_categories", "at_risk_value", "model_version"))


@query("m10_search_candidates")
def _(ctx):
    """Cross-validated score of the drawn parameter sets of one model on the training rows."""
    rows, _encoder = model_rows(ctx)
    fit_rows = rows.where("split = 'train'")
    n_rows = fit_rows.count()
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    best, mean, std = P.search(lambda p: P.churn_estimator("logistic_regression", p, n_rows, 1, ctx.settings),
                               P.candidates(P.SEARCH_SPACES["logistic_regression"], ctx.settings.search_iterations, ctx.settings.seed), fit_rows,
                               BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="raw"), ctx.settings)
    return rounded(ctx.spark.createDataFrame([(str(sorted(best.items())), mean, std)], "best string, cv_mean double, cv_std double"))


# ------------------------------------------------------------------ anomalies
@query("p11_reconstruction_score")
def _(ctx):
    train = ctx.train.join(model_rows(ctx)[0].where("split = 'train'").select("customer_id"), "customer_id", "left_semi")
    return rounded(A.fit_reconstruction(train, ctx.settings).score(ctx.scoring).select("customer_id", "anomaly_score", "is_anomaly"))


def mahalanobis_sql(columns, ridge=1e-6) -> str:
    """Distance to the centre of the training rows by a Cholesky factor of their covariance, one step a subquery."""
    d, v = len(columns), lambda c, t: f"ln(1 + greatest({t}{c}, 0))"
    moments = ", ".join(f"avg({v(c, '')}) AS m_{i}, CASE WHEN stddev_pop({v(c, '')}) > 0 THEN stddev_pop({v(c, '')}) ELSE 1 END AS s_{i}" for i, c in enumerate(columns))
    z = ", ".join(f"({v(c, 't.')} - m_{i}) / s_{i} AS z_{i}" for i, c in enumerate(columns))
    cov = ", ".join(f"covar_samp(z_{i}, z_{j}){f' + {ridge}' if i == j else ''} AS c_{i}_{j}" for i in range(d) for j in range(i + 1))
    factor = f"(SELECT {cov} FROM (SELECT {z} FROM snap_tr t, fit))"
    less = lambda i, k: "".join(f" - l_{i}_{m} * l_{k}_{m}" for m in range(k))
    for k in range(d):
        factor = f"(SELECT *, sqrt(c_{k}_{k}{less(k, k)}) AS l_{k}_{k} FROM {factor})"
        if k + 1 < d:
            factor = f"(SELECT *, {', '.join(f'(c_{i}_{k}{less(i, k)}) / l_{k}_{k} AS l_{i}_{k}' for i in range(k + 1, d))} FROM {factor})"
    rows = f"(SELECT t.customer_id, {z}, {', '.join(f'l_{i}_{j}' for i in range(d) for j in range(i + 1))} FROM snap_sc t, fit, factor)"
    for k in range(d):
        rows = f"(SELECT *, (z_{k}{''.join(f' - l_{k}_{m} * y_{m}' for m in range(k))}) / l_{k}_{k} AS y_{k} FROM {rows})"
    square = " + ".join(f"y_{k} ** 2" for k in range(d))
    return f"SELECT * FROM (WITH fit AS (SELECT {moments} FROM snap_tr), factor AS (SELECT * FROM {factor}) SELECT customer_id, {r(f'{square} AS mahalanobis', digits=3)} FROM {rows})"


@query("p12_mahalanobis", mahalanobis_sql(ANOMALY_FEATURES), "snap_tr", "snap_sc")
def _(ctx):
    return rounded(A.fit_mahalanobis(ctx.train).score(ctx.scoring).select("customer_id", "mahalanobis"), 3)


@query("p13_isolation")
def _(ctx):
    return rounded(A.fit_isolation(ctx.train).score(ctx.scoring).select("customer_id", "isolation"))


@query("p14_anomaly_report")
def _(ctx):
    with training_rows(ctx) as rows:
        _model, report = S.fit_anomaly(ctx.train, rows, ctx.settings)
    return rounded(ctx.spark.createDataFrame([(k, float(v)) for k, v in sorted(report.items())], "figure string, value double"))


# ------------------------------------------------------------------ clusters
@query("g02_g04_g07_g10_segmentation")
def _(ctx):
    assignments, _profiles, _metrics = G.segment_customers(ctx.scoring, ctx.settings)
    return rounded(assignments)


@query("g03_silhouette")
def _(ctx):
    vectors, _ = G.prepare(ctx.scoring)
    vectors = vectors.persist()
    _model, table = G.kmeans_search(vectors, ctx.settings)
    vectors.unpersist()
    return rounded(ctx.spark.createDataFrame(table, "k int, inertia double, silhouette double"))


@query("g12_hierarchy")
def _(ctx):
    vectors, _ = G.prepare(ctx.scoring)
    return rounded(G.hierarchy(vectors).transform(vectors).groupBy("leaf").agg(F.count(F.lit(1)).alias("customers")))


def _vectors(ctx):
    return ctx.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


PAIRS = "FROM embeddings a, embeddings b"


@query("m12_nearest_neighbours", f"""
  SELECT a.vec_id AS id, b.vec_id AS neighbour, {r('sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS distance')}
  {PAIRS} WHERE a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), b.vec_id) <= 5""")
def _(ctx):
    v = _vectors(ctx)
    return rounded(N.nearest(v, v, 5, exclude_self=True).select("id", "neighbour", "distance"))


@query("m12_approximate_neighbours")
def _(ctx):
    v = _vectors(ctx)
    return rounded(N.approximate_nearest(v, v, 5, exclude_self=True, bucket=128, tables=16).select("id", "neighbour", "distance"))


block("near", f"""SELECT a.vec_id AS id, b.label AS label, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS d
  {PAIRS} WHERE a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), b.vec_id) <= 15""")


@query("m12_neighbour_vote", f"""
  SELECT id, label::BIGINT AS label, {r('sum(1 / sqrt(d)) / any_value(t) AS share')} FROM (SELECT *, sum(1 / sqrt(d)) OVER (PARTITION BY id) AS t FROM near) GROUP BY id, label""", "near")
def _(ctx):
    v = _vectors(ctx)
    return rounded(N.vote(N.nearest(v, v, 15, exclude_self=True), v, "distance"))


block("z_tr", f"SELECT customer_id AS id, [{', '.join(z.rsplit(' AS ', 1)[0] for z in z_plain(ANOMALY_FEATURES))}] AS x, churn FROM feats_tr JOIN labels_tr USING (customer_id)", "feats_tr", "labels_tr")
block("minor_tr", """
  SELECT id, x, (SELECT max(n) - min(n) FROM (SELECT count(*) AS n FROM z_tr GROUP BY churn)) / count(*) OVER () AS need, least(5, count(*) OVER () - 1) AS width
  FROM z_tr WHERE churn = (SELECT churn FROM z_tr GROUP BY churn ORDER BY count(*), churn LIMIT 1)""", "z_tr")


@query("m03_oversampling", f"""
  SELECT * FROM (WITH pairs AS (
    SELECT a.id, b.x AS y, row_number() OVER (PARTITION BY a.id ORDER BY list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) ** 2)), b.id) AS rank
    FROM minor_tr a JOIN minor_tr b ON a.id <> b.id),
  drawn AS (
    SELECT id, x, width, unnest(range(1, (floor(need) + CASE WHEN {unit_hash('id', 'extra-42')} < need - floor(need) THEN 1 ELSE 0 END)::BIGINT + 1)) AS copy FROM minor_tr),
  picked AS (SELECT *, floor({unit_hash("(id || '#' || copy)", 'pick-42')} * width) + 1 AS pick, {unit_hash("(id || '#' || copy)", 'gap-42')} AS gap FROM drawn)
  SELECT d.id, d.copy::BIGINT AS copy, {r(*[f'd.x[{i}] + gap * (y[{i}] - d.x[{i}]) AS x{i}' for i in range(1, 1 + len(ANOMALY_FEATURES))], digits=3)}
  FROM picked d JOIN pairs p ON d.id = p.id AND p.rank = d.pick)""", "minor_tr")
def _(ctx):
    rows = A.fit_reconstruction(ctx.train, ctx.settings)
    x = F.array(*rows.scaler.values())
    made = N.oversample(ctx.train.select(F.col("customer_id").alias("id"), x.alias("x"), F.col("churn").alias("label")), ctx.settings)
    return rounded(made.select("id", "copy", *[F.col("x")[i].alias(f"x{i + 1}") for i in range(len(ANOMALY_FEATURES))]), 3)


SEGMENT_Z = [f"(({v}) - avg({v}) OVER ()) / CASE WHEN stddev_pop({v}) OVER () > 0 THEN stddev_pop({v}) OVER () ELSE 1 END"
             for v in (f"ln(1 + greatest({c}, 0))" if c in SEGMENT_LOG_FEATURES else c for c in SEGMENT_FEATURES)]
block("z_sc", f"SELECT customer_id AS id, [{', '.join(SEGMENT_Z)}] AS x FROM snap_sc", "snap_sc")
block("far_sc", "SELECT a.id, b.id AS other, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) ** 2))) AS d FROM z_sc a, z_sc b", "z_sc")
block("reach_sc", f"SELECT quantile_cont(d, 0.9) AS eps FROM (SELECT id, d FROM far_sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = {2 * len(SEGMENT_FEATURES)})", "far_sc")
block("near_sc", "SELECT id, other FROM far_sc, reach_sc WHERE d <= eps", "far_sc", "reach_sc")
block("core_sc", f"SELECT id FROM near_sc GROUP BY id HAVING count(*) >= {2 * len(SEGMENT_FEATURES)}", "near_sc")


@query("g05_density_clusters", """
  SELECT * FROM (WITH RECURSIVE links AS MATERIALIZED (SELECT id, other FROM near_sc WHERE id IN (FROM core_sc) AND other IN (FROM core_sc)),
  walk AS (SELECT id, id AS root FROM core_sc UNION SELECT l.other, w.root FROM walk w JOIN links l ON l.id = w.id WHERE w.root < l.other),
  named AS (SELECT id, min(root) AS cluster FROM walk GROUP BY id)
  SELECT z.id, coalesce(n.cluster, (SELECT min(m.cluster) FROM near_sc e JOIN named m ON e.other = m.id WHERE e.id = z.id), -1)::BIGINT AS cluster
  FROM z_sc z LEFT JOIN named n ON z.id = n.id)""", "z_sc", "near_sc", "core_sc")
def _(ctx):
    scaler = G.Standardiser.fit(ctx.scoring, SEGMENT_FEATURES, SEGMENT_LOG_FEATURES)
    points = materialise(ctx.scoring.select(F.col("customer_id").alias("id"), F.array(*scaler.values()).alias("x")), "cluster-points")
    k = 2 * len(SEGMENT_FEATURES)
    return N.density_clusters(points, N.neighbour_distance(points, k), k)


# ------------------------------------------------------------------ explanations of models
@query("x01_shapley_high_risk")
def _(ctx):
    rows, encoder = model_rows(ctx)
    model = fitted(ctx).churn
    base = XM.background_rows(rows.where("split = 'train'"), ctx.settings.background_size, ctx.settings.seed)
    scored = S.score(ctx.scoring, fitted(ctx), ctx.settings).where("risk_tier = 'High'").select("customer_id")
    high = fitted(ctx).encoder.transform(ctx.scoring.join(scored, "customer_id", "left_semi"), ["customer_id"], ctx.settings)
    return rounded(XM.permutation_shapley(high, base, model, encoder.columns))


@query("x03_local_surrogate")
def _(ctx):
    rows, encoder = model_rows(ctx)
    models = fitted(ctx)
    scored = S.score(ctx.scoring, models, ctx.settings)
    chosen = X.representatives(scored, models.threshold).first()  # three customers
    train_base = XM.background_rows(rows.where("split = 'train'"), ctx.settings.background_size, ctx.settings.seed)
    wanted = models.encoder.transform(ctx.scoring.where(F.col("customer_id").isin([int(v) for v in chosen])), ["customer_id"], ctx.settings)
    return rounded(XM.local_surrogate(wanted, train_base, models.churn, encoder.columns, ctx.settings))


def contributions(ctx):
    """Contributions of every customer's features to the churn score."""
    if not hasattr(ctx, "_contributions"):
        models = fitted(ctx)
        rows = models.encoder.transform(ctx.scoring, ["customer_id"], ctx.settings)
        ctx._contributions = materialise(XM.batch_contributions(rows, models.background, models.churn, models.encoder.columns, seed=ctx.settings.seed), "contributions")
    return ctx._contributions


@query("x01_contributions_of_all")
def _(ctx):
    return rounded(X.long_form(contributions(ctx)))


@query("x05_partial_dependence")
def _(ctx):
    """Curves of the three features that matter most."""
    rows, encoder = model_rows(ctx)
    strongest = X.global_importance(contributions(ctx)).orderBy(F.desc("mean_abs_contribution"), "feature").limit(3).collect()
    out = None
    for feature in (r["feature"] for r in strongest):
        curve = XM.partial_dependence(rows, fitted(ctx).churn, encoder.columns, feature).withColumn("feature", F.lit(feature))
        out = curve if out is None else out.unionByName(curve)
    return rounded(out)


class LinearScore:
    """A linear score of the feature vector, with the interface of a model."""

    def __init__(self, weights):
        self.weights = weights

    def transform(self, df):
        terms = [vector_to_array("features")[i] * F.lit(float(w)) for i, w in enumerate(self.weights)]
        return df.withColumn("prediction", sum(terms[1:], terms[0]))


LINEAR = {"recency_days": 0.5, "frequency": -2.0, "return_rate": 30.0}


@query("x05_dependence_of_a_linear_score", f"""
  SELECT * FROM (WITH ends AS (SELECT quantile_cont(recency_days, 0.05) AS lo, quantile_cont(recency_days, 0.95) AS hi FROM snap_tr),
  rest AS (SELECT {' + '.join(f'avg({c}) * {w}' for c, w in LINEAR.items() if c != 'recency_days')} AS rest FROM snap_tr)
  SELECT 'recency_days' AS feature, {r('lo + (hi - lo) * i / 19.0 AS grid_value', '(lo + (hi - lo) * i / 19.0) * 0.5 + rest AS mean_score')}
  FROM ends, rest, range(20) t(i))""", "snap_tr")
def _(ctx):
    rows = VectorAssembler(inputCols=list(LINEAR), outputCol="features").transform(ctx.train.select(*[F.col(c).cast("double").alias(c) for c in LINEAR]))
    return rounded(XM.partial_dependence(rows, LinearScore(list(LINEAR.values())), list(LINEAR), "recency_days"))


# ------------------------------------------------------------------ streams over files written from the given tables
def _scratch(ctx, name):
    return f"{shared_folder(ctx.spark).rstrip('/')}/patronage/{name}-{uuid.uuid4().hex}"


@query("r01_stream_scoring", f"""
  SELECT customer_id, customer_id % 10 <> 0 AS scored, {r('CASE WHEN customer_id % 10 <> 0 THEN engagement_score END AS engagement_score')} FROM snap_sc""", "snap_sc")
def _(ctx):
    source, scored, rejects, check = (_scratch(ctx, x) for x in ("records", "scored", "rejects", "check"))
    spoiled = ctx.scoring.withColumn("return_rate", F.when(F.col("customer_id") % 10 == 0, 1.5).otherwise(F.col("return_rate")))
    spoiled = spoiled.drop("engagement_score")
    spoiled.repartition(3).write.parquet(source)
    stream = jobs.read_stream(ctx.spark, source, spoiled.schema, files_per_batch=1)
    jobs.start(stream, jobs.score_batches(fitted(ctx), scored, rejects, ctx.settings), check).awaitTermination()
    good = ctx.spark.read.parquet(scored).select("customer_id", F.lit(True).alias("scored"), "engagement_score")
    bad = ctx.spark.read.parquet(rejects).select("customer_id", F.lit(False).alias("scored"), F.lit(None).cast("double").alias("engagement_score"))
    return rounded(good.unionByName(bad))


@query("r02_stream_upsert", f"""
  SELECT customer_id, {r('CASE WHEN customer_id % 7 = 0 THEN 0.9 ELSE churn_probability END AS churn_probability')} FROM scored_sc""", "scored_sc")
def _(ctx):
    source, target, check = (_scratch(ctx, x) for x in ("updates", "predictions", "check"))
    first = ctx.scored.select("customer_id", "churn_probability", F.lit(1).alias("scored_at"))
    first.coalesce(1).write.parquet(f"{source}/a")
    stream = jobs.read_stream(ctx.spark, f"{source}/*", first.schema)
    jobs.start(stream, jobs.upsert_batches(target), check).awaitTermination()
    first.where("customer_id % 7 = 0").withColumns({"churn_probability": F.lit(0.9), "scored_at": F.lit(2)}).coalesce(1).write.parquet(f"{source}/b")
    jobs.start(jobs.read_stream(ctx.spark, f"{source}/*", first.schema), jobs.upsert_batches(target), check).awaitTermination()
    return rounded(jobs.current_rows(ctx.spark, target).select("customer_id", "churn_probability"))


@query("r03_stream_cleaning", """
  SELECT invoice, stock_code, description, quantity, customer_id, is_return, is_admin_code, is_outlier, category FROM clean""", "clean")
def _(ctx):
    source, target, check = (_scratch(ctx, x) for x in ("lines", "clean-stream", "check"))
    ctx.raw.repartition(4).write.parquet(source)  # files in no order of time
    from patronage.operators import clean as C
    stream = jobs.read_stream(ctx.spark, source, ctx.raw.schema, files_per_batch=2)
    products = materialise(C.product_table(ctx.distinct, ctx.settings), "products")
    jobs.start(stream, jobs.clean_batches(target, _scratch(ctx, "stream-keys"), ctx.fences, products, ctx.settings), check).awaitTermination()
    return ctx.spark.read.parquet(target).select("invoice", "stock_code", "description", "quantity", "customer_id", "is_return",
                                                 "is_admin_code", "is_outlier", "category")


