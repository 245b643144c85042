"""Splits, metrics, segmentation and explanation operators with SQL checks."""
from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from patronage.config import DEFAULTS
from patronage.operators import encode as E
from patronage.operators import evaluate as M
from patronage.operators import explain as X
from patronage.operators import scoring as P
from patronage.operators import segment as G
from patronage.session import shared_folder
from patronage.sources import runlog
from registry.base import n, query, r, rounded
from registry.sqlbase import block, unit_hash

SLOT = "('0x' || substr(md5(customer_id::VARCHAR || '#42'), 1, 8))::BIGINT"
block("parts_tr", f"""
  SELECT customer_id, churn, CASE WHEN place <= round(size * 0.7) THEN 'train' WHEN place <= round(size * 0.85) THEN 'val' ELSE 'test' END AS split,
         (place - 1) % {DEFAULTS.cv_folds} AS fold
  FROM (SELECT customer_id, churn, row_number() OVER (PARTITION BY churn ORDER BY {SLOT}, customer_id) AS place, count(*) OVER (PARTITION BY churn) AS size
        FROM labels_tr)""", "labels_tr")


def parts(ctx):
    return M.stratified_parts(ctx.train.select("customer_id", "churn"), "churn", "customer_id", ctx.settings)


@query("m01_splits", "SELECT customer_id, churn::BIGINT AS churn, split FROM parts_tr", "parts_tr")
def _(ctx):
    return rounded(parts(ctx).drop("fold"))


@query("m02_class_weights", f"""
  SELECT next_category, {n('count(*) AS n')}, {r('sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight')}
  FROM labels_tr WHERE next_category IS NOT NULL GROUP BY 1""", "labels_tr")
def _(ctx):
    return rounded(M.class_weights(ctx.train, "next_category"))


@query("m02_positive_weight", f"SELECT {r('(count(*) - sum(churn)) / sum(churn) AS positive_weight')} FROM labels_tr", "labels_tr")
def _(ctx):
    return rounded(M.positive_weight(ctx.train, "churn"))


@query("m04_confusion", f"""
  SELECT {n('tn', 'fp', 'fn', 'tp')}, {r('(tp + tn) / (tp + tn + fp + fn) AS accuracy', 'tp / (tp + fp) AS precision', 'tp / (tp + fn) AS recall', '2 * tp / (2 * tp + fp + fn) AS f1')}
  FROM (SELECT count(*) FILTER (y = 0 AND p < 0.6) AS tn, count(*) FILTER (y = 0 AND p >= 0.6) AS fp,
               count(*) FILTER (y = 1 AND p < 0.6) AS fn, count(*) FILTER (y = 1 AND p >= 0.6) AS tp FROM scored_tr)""", "scored_tr")
def _(ctx):
    return rounded(M.confusion(ctx.scored_train, "y", "p", 0.6))


@query("m05_roc_auc", f"""
  SELECT {r('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS roc_auc')}
  FROM (SELECT y, avg(pos) OVER (PARTITION BY p) AS rk FROM (SELECT y, p, row_number() OVER (ORDER BY p) AS pos FROM scored_tr))""", "scored_tr")
def _(ctx):
    return rounded(M.roc_auc(ctx.scored_train, "y", "p"))


block("curve", """
  SELECT t.p AS threshold, count(*) FILTER (y = 1) AS tp, count(*) FILTER (y = 0) AS fp,
         (SELECT count(*) FROM scored_tr WHERE y = 1) - count(*) FILTER (y = 1) AS fn
  FROM (SELECT DISTINCT p FROM scored_tr) t JOIN scored_tr s ON s.p >= t.p GROUP BY t.p""", "scored_tr")
CURVE = r("threshold", "coalesce(tp / nullif(tp + fn, 0), 0) AS recall", "CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1")


@query("m06_threshold_curve", f"SELECT {n('tp', 'fp', 'fn')}, {CURVE} FROM curve", "curve")
def _(ctx):
    return rounded(M.threshold_curve(ctx.scored_train, "y", "p"))


@query("m06_operating_threshold", f"""
  SELECT {CURVE} FROM curve ORDER BY (tp / (tp + fn) >= 0.7) DESC, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END DESC, threshold LIMIT 1""", "curve")
def _(ctx):
    return rounded(M.best_threshold(ctx.scored_train, "y", "p", ctx.settings.min_recall))


@query("m07_regression_quality", f"""
  SELECT {r('avg(abs(target - prediction)) AS mae', 'sqrt(avg((target - prediction) ** 2)) AS rmse',
            '1 - sum((target - prediction) ** 2) / (SELECT sum((target - m) ** 2) FROM scored_tr, (SELECT avg(target) AS m FROM scored_tr)) AS r2')} FROM scored_tr""", "scored_tr")
def _(ctx):
    return rounded(M.regression_quality(ctx.scored_train, "target", "prediction"))


block("guess", f"""
  SELECT customer_id, next_category AS y, CASE WHEN {unit_hash('customer_id', 'guess')} < 0.6 THEN next_category
         WHEN {unit_hash('customer_id', 'guess')} < 0.8 THEN 'other' ELSE 'toys_games' END AS z FROM labels_tr WHERE next_category IS NOT NULL""", "labels_tr")


@query("m08_multiclass_quality", f"""
  SELECT {r('(SELECT avg((y = z)::INT) FROM guess) AS accuracy', 'avg(2.0 * tp / (a + s)) AS macro_f1')} FROM (
    SELECT c, (SELECT count(*) FROM guess WHERE y = c AND z = c) AS tp, (SELECT count(*) FROM guess WHERE y = c) AS a,
           (SELECT count(*) FROM guess WHERE z = c) AS s FROM (SELECT y AS c FROM guess UNION SELECT z FROM guess))""", "guess")
def _(ctx):
    from patronage.functions.expressions import hash_unit
    u = hash_unit(F.col("customer_id"), "guess")
    g = ctx.train.where("next_category IS NOT NULL").withColumn(
        "z", F.when(u < 0.6, F.col("next_category")).when(u < 0.8, "other").otherwise("toys_games"))
    return rounded(M.multiclass_quality(g, "next_category", "z"))


@query("m09_folds", f"SELECT fold::BIGINT AS fold, churn::BIGINT AS churn, {n('count(*) AS n')} FROM parts_tr WHERE split = 'train' GROUP BY ALL", "parts_tr")
def _(ctx):
    return rounded(parts(ctx).where("split = 'train'").groupBy("fold", "churn").agg(F.count(F.lit(1)).alias("n")))


@query("m11_comparison_table", f"""
  SELECT country AS model, {n('row_number() OVER (ORDER BY round(avg(is_return::INT), 2) DESC, count(*) DESC, country) AS rank')},
         {r('round(avg(is_return::INT), 2) AS roc_auc', 'count(*) AS recall')} FROM clean GROUP BY country""", "clean")
def _(ctx):
    import uuid
    path = f"{shared_folder(ctx.spark).rstrip('/')}/patronage/compare-{uuid.uuid4().hex}"
    facts = ctx.clean.groupBy("country").agg(F.round(F.avg(F.col("is_return").cast("double")), 2).alias("auc"), F.count(F.lit(1)).alias("recall"))
    for run in ("old", "new"):
        runlog.append_frame(facts.select(
            F.lit(run).alias("run_id"), F.lit("2001-01-01T00:00:00").alias("timestamp"), F.lit("churn").alias("task"),
            F.col("country").alias("model"), F.explode(F.array(F.lit("val"), F.lit("test"))).alias("split"),
            F.from_json(F.lit("{}"), "map<string,string>").alias("params"), F.lit(1.0).alias("train_time_sec"),
            F.create_map(F.lit("roc_auc"), F.col("auc").cast("string"), F.lit("recall"), F.col("recall").cast("string")).alias("metrics")), path)
    return rounded(M.comparison_table(runlog.read(ctx.spark, path), "new").select("model", "rank", "roc_auc", "recall"))


# ------------------------------------------------------------------ rank agreement, tiers, recommendations
@query("p14_spearman", f"""
  SELECT {r('corr(ra, rb) AS spearman')} FROM (
    SELECT avg(pa) OVER (PARTITION BY frequency) AS ra, avg(pb) OVER (PARTITION BY return_rate) AS rb FROM (
      SELECT frequency, round(return_rate, 6) AS return_rate, row_number() OVER (ORDER BY frequency) AS pa,
             row_number() OVER (ORDER BY round(return_rate, 6)) AS pb FROM feats_sc))""", "feats_sc")
def _(ctx):
    return rounded(M.spearman(ctx.scoring.withColumn("return_rate", F.round("return_rate", 6)), "frequency", "return_rate"))


@query("p14_flag_overlap", f"""
  SELECT {n('count(*) FILTER (is_anomaly) AS flagged')}, {r('avg((rk <= greatest(floor(0.05 * n), 1))::INT) FILTER (is_anomaly) AS overlap')} FROM (
    SELECT is_anomaly, row_number() OVER (ORDER BY frequency DESC, customer_id) AS rk, count(*) OVER () AS n FROM scored_sc)""", "scored_sc")
def _(ctx):
    return rounded(M.flagged_in_top(ctx.scored, "is_anomaly", "frequency", "customer_id"))


TIER = "CASE WHEN churn_probability >= 0.55 THEN 'High' WHEN churn_probability >= 0.6::DOUBLE * 0.55 THEN 'Medium' ELSE 'Low' END"


@query("p15_tiers_and_categories", f"""
  SELECT customer_id, {TIER} AS risk_tier, (churn_probability >= 0.55)::BIGINT AS churn_predicted,
         list_reverse(list_sort([(p1, 1, 'a'), (p2, 2, 'b'), (p3, 3, 'c'), (p4, 4, 'd')]))[1][3] || ',' ||
         list_reverse(list_sort([(p1, 1, 'a'), (p2, 2, 'b'), (p3, 3, 'c'), (p4, 4, 'd')]))[2][3] || ',' ||
         list_reverse(list_sort([(p1, 1, 'a'), (p2, 2, 'b'), (p3, 3, 'c'), (p4, 4, 'd')]))[3][3] AS recommended_categories
  FROM (SELECT *, floor({unit_hash('customer_id', 'p1')} * 5) AS p1, floor({unit_hash('customer_id', 'p2')} * 5) AS p2,
               floor({unit_hash('customer_id', 'p3')} * 5) AS p3, floor({unit_hash('customer_id', 'p4')} * 5) AS p4 FROM scored_sc)""", "scored_sc")
def _(ctx):
    from patronage.functions.expressions import hash_unit
    prob = F.array(*[F.floor(hash_unit(F.col("customer_id"), f"p{i}") * 5).cast("double") for i in (1, 2, 3, 4)])
    out = P.decision_columns(ctx.scored, 0.55, ctx.settings)
    return rounded(out.select("customer_id", "risk_tier", "churn_predicted",
                              F.array_join(P.recommended(prob, ["a", "b", "c", "d"]), ",").alias("recommended_categories")))


@query("p16_scored_rows", f"""
  SELECT customer_id, {r('churn_probability * historical_clv AS at_risk_value')}, 'a,b' AS recommended_categories, 'run-1' AS model_version FROM scored_sc""", "scored_sc")
def _(ctx):
    out = P.finish_scores(ctx.scored.withColumn("recommended_categories", F.array(F.lit("a"), F.lit("b"))), "run-1")
    return rounded(out.select("customer_id", "at_risk_value", "recommended_categories", "model_version"))


# ------------------------------------------------------------------ segmentation
DIMS = ["recency_days", "frequency", "return_rate"]
block("centres", "SELECT segment_id AS c, " + ", ".join(f"avg({d}) AS m_{d}" for d in DIMS) + " FROM scored_sc GROUP BY 1", "scored_sc")
block("spreads", "SELECT c, any_value(m_recency_days) AS m_recency_days, any_value(m_frequency) AS m_frequency, any_value(m_return_rate) AS m_return_rate, avg(sqrt("
      + " + ".join(f"({d} - m_{d}) ** 2" for d in DIMS) + ")) AS s FROM scored_sc JOIN centres ON segment_id = c GROUP BY c", "centres")


@query("g03_davies_bouldin", f"""
  SELECT {r('avg(worst) AS davies_bouldin')} FROM (
    SELECT a.c, max((a.s + b.s) / sqrt({' + '.join(f'(a.m_{d} - b.m_{d}) ** 2' for d in DIMS)})) AS worst
    FROM spreads a JOIN spreads b ON a.c <> b.c GROUP BY a.c)""", "spreads")
def _(ctx):
    return rounded(G.davies_bouldin(ctx.scored, "segment_id", DIMS))


block("groups_sc", "SELECT segment_id AS c, count(*)::DOUBLE AS n, " + ", ".join(f"sum({d}) AS s_{d}" for d in DIMS)
      + ", sum(" + " + ".join(f"{d} ** 2" for d in DIMS) + ") AS q FROM scored_sc GROUP BY 1", "scored_sc")


@query("g03_silhouette_of_labels", f"""
  SELECT {r('avg(CASE WHEN greatest(own, other) > 0 THEN (other - own) / greatest(own, other) ELSE 0 END) AS silhouette')} FROM (
    SELECT customer_id, max(away * n / greatest(n - 1, 1)) FILTER (c = segment_id) AS own, min(away) FILTER (c <> segment_id) AS other FROM (
      SELECT s.customer_id, s.segment_id, g.c, g.n, {' + '.join(f's.{d} ** 2' for d in DIMS)} + g.q / g.n - 2 * ({' + '.join(f's.{d} * g.s_{d}' for d in DIMS)}) / g.n AS away
      FROM scored_sc s, groups_sc g) GROUP BY customer_id)""", "groups_sc")
def _(ctx):
    rows = VectorAssembler(inputCols=DIMS, outputCol="z").transform(ctx.scored.select("segment_id", *[F.col(d).cast("double").alias(d) for d in DIMS]))
    return rounded(ctx.spark.createDataFrame([(G.silhouette(rows, "segment_id"),)], "silhouette double"))


block("cells", "SELECT segment_id AS a, (customer_id % 4)::INT AS b, count(*)::DOUBLE AS n FROM scored_sc GROUP BY ALL", "scored_sc")


@query("g06_adjusted_rand", f"""
  SELECT {r('(v - va * vb / t) / ((va + vb) / 2 - va * vb / t) AS adjusted_rand', digits=8)} FROM (
    SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS v, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM cells GROUP BY a)) AS va,
           (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM cells GROUP BY b)) AS vb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM cells) AS t)""", "cells")
def _(ctx):
    two = ctx.scored.withColumn("b", (F.col("customer_id") % 4).cast("int"))
    return rounded(G.adjusted_rand(two, "segment_id", "b"), 8)


block("segmeans", "SELECT segment_id, " + ", ".join(f"avg({c}) AS {c}" for c in G.NAMING_COLUMNS) + " FROM scored_sc GROUP BY 1", "scored_sc")
block("segz", "SELECT segment_id, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END AS {c}" for c in G.NAMING_COLUMNS) + " FROM segmeans", "segmeans")
block("segnames", """
  SELECT segment_id, CASE WHEN place < cnt THEN name || ' (' || chr((64 + place)::INT) || ')' ELSE name END AS segment_label FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY segment_id) AS place, count(*) OVER (PARTITION BY name) AS cnt FROM (
      SELECT segment_id, CASE WHEN total_spend > 0.5 AND recency_days > 0.3 THEN 'Lapsed High-Value' WHEN total_spend > 0.5 THEN 'Loyal High-Value'
        WHEN seasonal_concentration > 0.7 THEN 'Seasonal Gift Shopper' WHEN frequency > 0.3 AND total_spend < 0 THEN 'High-Frequency Low-Value'
        WHEN recency_days > 0.3 THEN 'At-Risk / Lapsing' WHEN recency_days < -0.3 AND frequency < 0 THEN 'Recent Occasional Buyer'
        ELSE 'Steady Mid-Value' END AS name FROM segz))""", "segz")


@query("g08_segment_names", "SELECT segment_id::BIGINT AS segment_id, segment_label FROM segnames", "segnames")
def _(ctx):
    return rounded(G.label_segments(ctx.scored, "segment_id"))


PROFILE = ["recency_days", "frequency", "total_spend", "avg_spend", "avg_basket_size", "return_rate", "seasonal_concentration", "discount_sensitivity", "engagement_score"]


@query("g09_segment_profile", f"""
  SELECT segment_id::BIGINT AS segment_id, segment_label, {n('count(*) AS customers')},
         {r('round_even(100.0 * count(*) / (SELECT count(*) FROM scored_sc), 1) AS share_pct', *[f'round_even(avg({c}), 3) AS {c}' for c in PROFILE])}
  FROM scored_sc JOIN segnames USING (segment_id) GROUP BY 1, 2""", "scored_sc", "segnames")
def _(ctx):
    named = ctx.scored.join(G.label_segments(ctx.scored, "segment_id"), "segment_id")
    return rounded(G.profile_segments(named, "segment_id"))


@query("g11_profile_with_churn", f"""
  SELECT segment_id::BIGINT AS segment_id, {n('count(*) AS customers')}, {r('round_even(avg(churn_probability), 3) AS mean_churn_probability',
  "round_even(100 * avg((churn_probability >= 0.55)::INT), 3) AS high_risk_pct")} FROM scored_sc GROUP BY 1""", "scored_sc")
def _(ctx):
    s = P.decision_columns(ctx.scored, 0.55, ctx.settings)
    profile = s.groupBy("segment_id").agg(F.count(F.lit(1)).alias("customers"))
    return rounded(G.add_churn_to_profile(profile, s.select("customer_id", "segment_id"),
                                          s.select("customer_id", "churn_probability", "risk_tier"), "segment_id"))


# ------------------------------------------------------------------ explanations of a linear score
WEIGHTS = {"recency_days": 0.004, "frequency": -0.08, "total_spend": -1e-6, "avg_spend": 2e-6, "historical_clv": -1.5e-6, "avg_basket_size": 0.003,
           "freq_trend": -0.7, "gap_variance": 1e-5, "seasonal_concentration": 0.6, "return_rate": 0.9, "discount_sensitivity": -0.35,
           "avg_product_popularity": 5.0, "affinity_kitchen_dining": -0.3, "affinity_jewelry_accessories": 0.45}
OTHER = {f: w * (1.5 if i % 3 else -0.5) for i, (f, w) in enumerate(WEIGHTS.items())}
num = lambda w: f"({w!r})::DOUBLE"


def contrib_block(name: str, weights: dict) -> None:
    block(name, " UNION ALL ".join(
        f"SELECT customer_id, {i} AS pos, '{f}' AS feature, {f} AS value, ({f} - (SELECT avg({f}) FROM snap_sc)) * {num(w)} AS contribution FROM snap_sc"
        for i, (f, w) in enumerate(weights.items())), "snap_sc")


contrib_block("contrib", WEIGHTS)
contrib_block("contrib_other", OTHER)


def _contrib(ctx, weights=WEIGHTS):
    return X.linear_contributions(ctx.scored, weights, X.feature_means(ctx.scoring, list(WEIGHTS)))


@query("x01_linear_contributions", f"SELECT customer_id, feature, {r('value', 'contribution')} FROM contrib", "contrib")
def _(ctx):
    return rounded(X.long_form(_contrib(ctx)))


@query("x02_global_importance", f"SELECT feature, {r('avg(abs(contribution)) AS mean_abs_contribution')} FROM contrib GROUP BY 1", "contrib")
def _(ctx):
    return rounded(X.global_importance(_contrib(ctx)))


block("ranked", "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, pos) AS rk FROM contrib", "contrib")
block("ranked_other", "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, pos) AS rk FROM contrib_other", "contrib_other")


@query("x04_explanation_agreement", f"""
  SELECT customer_id, {r('sum((a.rk <= 5 AND b.rk <= 5)::INT) / 5 AS overlap_fraction',
         'avg((sign(a.contribution) = sign(b.contribution))::INT) FILTER (a.contribution <> 0) AS sign_agreement')}
  FROM ranked a JOIN ranked_other b USING (customer_id, feature) GROUP BY customer_id""", "ranked", "ranked_other")
def _(ctx):
    both = X.linear_contributions(_contrib(ctx, OTHER).withColumnRenamed("contributions", "second"), WEIGHTS, X.feature_means(ctx.scoring, list(WEIGHTS)))
    return rounded(X.compare_explanations(both, "contributions", "second").select("customer_id", "overlap_fraction", "sign_agreement"))


@query("x06_representatives", """
  SELECT arg_min(customer_id, (churn_probability, customer_id)) AS low_risk, arg_min(customer_id, (-churn_probability, customer_id)) AS high_risk,
         arg_min(customer_id, (abs(churn_probability - 0.55::DOUBLE), customer_id)) AS borderline FROM scored_sc""", "scored_sc")
def _(ctx):
    return X.representatives(ctx.scored, 0.55)


FRIENDLY = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.FRIENDLY_NAMES.items()) + " ELSE 'share of spend on ' || replace(substr(feature, 10), '_', ' ') END"
PCT = "format('{:.0f}%', churn_probability * 100)"


@query("x07_reasons_in_words", f"""
  SELECT customer_id, CASE WHEN churn_probability >= 0.55 THEN 'This customer is flagged as HIGH churn risk: predicted churn probability ' || {PCT} || ', at or above the 55% operating threshold'
    WHEN churn_probability >= 0.6::DOUBLE * 0.55 THEN 'This customer has MEDIUM churn risk: predicted churn probability ' || {PCT} || ' (threshold 55%)'
    ELSE 'This customer is LOW churn risk: predicted churn probability ' || {PCT} || ' (threshold 55%)' END
    || '. Main drivers (relative to the average customer): ' || words || '.' AS top_reasons
  FROM scored_sc JOIN (
    SELECT customer_id, string_agg({FRIENDLY} || ' = ' || format('{{:,.2f}}', value) ||
      CASE WHEN round(value, 6) > round(median, 6) THEN ' (higher than typical)' WHEN round(value, 6) < round(median, 6) THEN ' (lower than typical)' ELSE ' (typical)' END
      || CASE WHEN contribution > 0 THEN ' raises' ELSE ' lowers' END || ' the risk', '; ' ORDER BY rk) AS words
    FROM ranked JOIN (SELECT feature, median(value) AS median FROM contrib GROUP BY 1) USING (feature) WHERE rk <= 3 GROUP BY 1) USING (customer_id)""",
       "scored_sc", "ranked")
def _(ctx):
    medians = {row["feature"]: row["median"] for row in E.medians(ctx.scoring, list(WEIGHTS)).collect()}  # one row per feature
    return X.reasons(_contrib(ctx), medians, 0.55, ctx.settings).select("customer_id", "top_reasons")


@query("q06_top_contributions", f"""
  SELECT customer_id, rank::BIGINT AS rank, feature, {r('contribution')} FROM (
    SELECT customer_id, feature, c AS contribution, row_number() OVER (PARTITION BY customer_id ORDER BY abs(c) DESC, feature) AS rank
    FROM (SELECT *, round(contribution, 5) AS c FROM contrib)) WHERE rank <= 10""", "contrib")
def _(ctx):
    stored = _contrib(ctx).select("customer_id", X.contributions_json(F.col("contributions")).alias("shap_json"))
    return rounded(X.top_contributions(stored))
