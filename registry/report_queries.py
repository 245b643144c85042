"""Reporting and serving queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import encode as E
from patronage.operators import features as X
from patronage.operators import scoring as P
from patronage.operators.segment import label_segments
from patronage.plans import reports as Q
from registry.base import n, query, r, rounded
from registry.quality_queries import TIER
from registry.sqlbase import CATS, block

block("view_sc", f"""
  SELECT s.*, {TIER} AS risk_tier, churn_probability * historical_clv AS at_risk_value, segment_label,
         CASE WHEN customer_id % 3 = 0 THEN 'Low' WHEN customer_id % 3 = 1 THEN 'Medium' ELSE 'High' END AS value_tier
  FROM scored_sc s JOIN segnames USING (segment_id)""", "scored_sc", "segnames")


def _view(ctx):
    s = P.decision_columns(ctx.scored, 0.55, ctx.settings)
    predictions = s.select(
        "customer_id", "churn_probability", "risk_tier", "is_anomaly", (F.col("churn_probability") * F.col("historical_clv")).alias("at_risk_value"))
    m = F.col("customer_id") % 3
    segments = s.join(label_segments(s, "segment_id"), "segment_id").select(
        "customer_id", "segment_label", F.when(m == 0, "Low").when(m == 1, "Medium").otherwise("High").alias("value_tier"))
    customers = ctx.scoring.select("customer_id", "country", "recency_days", "frequency", "total_spend", "historical_clv", "engagement_score")
    return Q.scored_view(customers, predictions, segments)


@query("q01_scored_view", f"""
  SELECT customer_id, country, risk_tier, segment_label, value_tier, is_anomaly, {r('churn_probability', 'at_risk_value', 'engagement_score', 'frequency')} FROM view_sc""", "view_sc")
def _(ctx):
    return rounded(_view(ctx).select("customer_id", "country", "risk_tier", "segment_label", "value_tier", "is_anomaly",
                                     "churn_probability", "at_risk_value", "engagement_score", "frequency"))


@query("q02_filters", """
  SELECT customer_id, country, value_tier FROM view_sc WHERE country IN ('NATION_1', 'NATION_5', 'NATION_7') AND value_tier IN ('High', 'Low')""", "view_sc")
def _(ctx):
    return Q.filtered(_view(ctx), [], ["NATION_1", "NATION_5", "NATION_7"], ["High", "Low"]).select("customer_id", "country", "value_tier")


@query("q03_key_figures", f"""
  SELECT {n('count(*) AS customers', "count(*) FILTER (risk_tier = 'High') AS high_risk", 'count(*) FILTER (is_anomaly) AS anomalies')},
         {r("sum(at_risk_value) FILTER (risk_tier = 'High') AS revenue_at_risk", digits=2)} FROM view_sc""", "view_sc")
def _(ctx):
    return rounded(Q.key_figures(_view(ctx)), 2)


@query("q04_segment_summary", f"""
  SELECT segment_label, {n('count(*) AS customers')}, {r('avg(recency_days) AS avg_recency_days', 'avg(frequency) AS avg_orders',
  'avg(historical_clv) AS avg_net_revenue', 'avg(churn_probability) AS avg_churn_risk', digits=2)} FROM view_sc GROUP BY 1""", "view_sc")
def _(ctx):
    return rounded(Q.segment_summary(_view(ctx)), 2)


@query("q05_leaderboard", f"""
  SELECT customer_id, country, segment_label, risk_tier, {r('churn_probability', 'historical_clv', 'at_risk_value', 'recency_days', digits=3)}
  FROM view_sc ORDER BY view_sc.at_risk_value DESC, customer_id LIMIT 50""", "view_sc")
def _(ctx):
    return rounded(Q.leaderboard(_view(ctx), 50), 3)


block("usable", "SELECT * FROM clean WHERE use_for_customer_model", "clean")
block("monthly", "SELECT date_trunc('month', invoice_date)::TIMESTAMP AS month, sum(line_total) AS revenue, max(invoice_date) AS last_date FROM usable GROUP BY 1", "usable")
block("monthly_country", "SELECT country, date_trunc('month', invoice_date)::TIMESTAMP AS month, sum(line_total) AS revenue, max(invoice_date) AS last_date FROM usable GROUP BY ALL", "usable")


def _usable(ctx):
    return ctx.clean.where("use_for_customer_model")


@query("q07_monthly_revenue", f"SELECT month, last_date, {r('revenue', digits=2)} FROM monthly", "monthly")
def _(ctx):
    return rounded(Q.monthly_revenue(_usable(ctx)), 2)


@query("q08_filled_months", f"""
  SELECT stock_code, m AS month, {r('coalesce(rev, 0) AS revenue', digits=2)} FROM (
    SELECT stock_code, unnest(generate_series(date_trunc('month', min(invoice_date))::TIMESTAMP, date_trunc('month', max(invoice_date))::TIMESTAMP, INTERVAL 1 MONTH)) AS m
    FROM usable WHERE is_return GROUP BY 1) LEFT JOIN (
    SELECT stock_code, date_trunc('month', invoice_date)::TIMESTAMP AS m, sum(line_total) AS rev FROM usable WHERE is_return GROUP BY ALL) USING (stock_code, m)""", "usable")
def _(ctx):
    returned = _usable(ctx).where("is_return")
    return rounded(Q.fill_months(Q.monthly_revenue(returned, "stock_code"), "stock_code"), 2)


block("whole_months", """
  SELECT * FROM monthly_country c WHERE NOT (month = (SELECT max(month) FROM monthly_country d WHERE d.country = c.country)
    AND last_date::DATE < last_day(month) - 2)""", "monthly_country")


@query("q09_drop_partial_month", f"SELECT country, month, last_date, {r('revenue', digits=2)} FROM whole_months", "whole_months")
def _(ctx):
    return rounded(Q.drop_partial_last_month(Q.monthly_revenue(_usable(ctx), "country"), "country"), 2)


block("monthly_customer", "SELECT customer_id, date_trunc('month', invoice_date)::TIMESTAMP AS month, sum(line_total) AS revenue, max(invoice_date) AS last_date FROM usable GROUP BY ALL", "usable")
block("series", """
  SELECT 'country ' || country AS series, month, revenue FROM whole_months UNION ALL
  SELECT 'customer ' || customer_id, month, revenue FROM monthly_customer c WHERE NOT (month = (SELECT max(month) FROM monthly_customer d WHERE d.customer_id = c.customer_id)
    AND last_date::DATE < last_day(month) - 2)""", "whole_months", "monthly_customer")
block("numbered", "SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS x, count(*) OVER (PARTITION BY series) AS n FROM series", "series")
block("fitted", """
  SELECT series, max(n) AS n, max(month) AS last, regr_slope(revenue, x) AS slope, regr_intercept(revenue, x) AS icpt, arg_max(revenue, month) AS latest,
         sum(revenue) FILTER (x >= n - 12) / greatest(sum(revenue) FILTER (x >= n - 24 AND x < n - 12), 1e-9) AS growth FROM numbered GROUP BY 1""", "numbered")


@query("q10_forecast", f"""
  SELECT f.series, (last + to_months((i + 1)::INT))::TIMESTAMP AS month, CASE WHEN f.n >= 24 THEN 'seasonal-naive x YoY growth' ELSE 'linear trend' END AS method,
         {r('CASE WHEN f.n >= 24 THEN s.revenue * growth WHEN f.n = 1 THEN greatest(latest, 0) ELSE greatest(slope * (f.n + i) + icpt, 0) END AS revenue', digits=2)}
  FROM fitted f CROSS JOIN range(14) t(i) LEFT JOIN numbered s ON s.series = f.series AND s.x = f.n - 12 + i % 12
""", "fitted")
def _(ctx):
    def series(by: str):
        whole = Q.drop_partial_last_month(Q.monthly_revenue(_usable(ctx), by), by)
        return whole.select(F.concat_ws(" ", F.lit(by.removesuffix("_id")), by).alias("series"), "month", "revenue")
    return rounded(Q.forecast(series("country").unionByName(series("customer_id")), 14, "series"), 2)


@query("q11_flag_rates", f"SELECT {r(*[f'100 * avg({c}::INT) AS {c}' for c in Q.FLAGS])} FROM clean", "clean")
def _(ctx):
    return rounded(Q.flag_rates(ctx.clean))


@query("q12_orders_by_calendar_month", f"SELECT {n('month(invoice_date) AS month', 'count(DISTINCT invoice) AS orders')} FROM usable WHERE NOT is_return GROUP BY 1", "usable")
def _(ctx):
    return rounded(Q.orders_by_calendar_month(ctx.clean))


@query("q13_top_countries", f"SELECT country, {r('sum(line_total) AS revenue', digits=2)} FROM usable WHERE NOT is_return GROUP BY 1 ORDER BY sum(line_total) DESC LIMIT 8", "usable")
def _(ctx):
    return rounded(Q.revenue_by(ctx.clean, "country", 8), 2)


@query("q13_revenue_by_category", f"SELECT category, {r('sum(line_total) AS revenue', digits=2)} FROM usable WHERE NOT is_return GROUP BY 1", "usable")
def _(ctx):
    return rounded(Q.revenue_by(ctx.clean, "category"), 2)


@query("q14_churn_by_recency_quintile", f"""
  SELECT {n('bin')}, {r('min(edges[bin]) AS low', 'max(edges[bin + 1]) AS high')}, {n('count(*) AS n')}, {r('avg(churn) AS mean_target')} FROM (
    SELECT greatest(len(list_filter(edges, lambda x: x < recency_days)), 1) AS bin, churn, edges FROM feats_tr JOIN labels_tr USING (customer_id),
      (SELECT list_sort(list_distinct(quantile_cont(recency_days, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS edges FROM feats_tr)) GROUP BY bin""", "feats_tr", "labels_tr")
def _(ctx):
    return rounded(E.quantile_bins(ctx.train, "recency_days", "churn"))


@query("q15_mean_category_share", " UNION ALL ".join(f"SELECT '{c}' AS category, {r(f'avg(affinity_{c}) AS mean_share')} FROM feats_tr" for c in CATS), "feats_tr")
def _(ctx):
    return rounded(Q.mean_category_shares(ctx.train, ctx.settings.affinity_columns))


@query("q16_leakage_audit", "SELECT 'first' AS side, 0::BIGINT AS rows UNION ALL SELECT 'second', 0::BIGINT")
def _(ctx):
    """Change every line at or after the cutoff; the features must not change."""
    at = ctx.cutoffs[0]
    future = F.col("invoice_date") >= F.lit(str(at)).cast("timestamp_ntz")
    altered = ctx.clean.withColumns({
        "quantity": F.when(future, 999.0).otherwise(F.col("quantity")), "line_total": F.when(future, 998001.0).otherwise(F.col("line_total")),
        "unit_price": F.when(future, 999.0).otherwise(F.col("unit_price")), "category": F.when(future, "other").otherwise(F.col("category"))})
    diff = Q.differing_rows(X.customer_features(ctx.clean, [at], ctx.settings), X.customer_features(altered, [at], ctx.settings))
    counts = diff.agg(F.count_if(F.col("side") == "first").alias("first"), F.count_if(F.col("side") == "second").alias("second"))
    return counts.select(F.explode(F.array(F.struct(F.lit("first").alias("side"), F.col("first").alias("rows")),
                                           F.struct(F.lit("second").alias("side"), F.col("second").alias("rows")))).alias("s")).select("s.*")
