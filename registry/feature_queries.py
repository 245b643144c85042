"""Point-in-time features, labels, sequences, encoding and statistics."""
from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from patronage.config import DEFAULTS

from patronage.fixed_values import BASE_FEATURES
from patronage.operators import encode as E
from patronage.operators import features as X
from patronage.operators import sequences as S
from patronage.session import materialise
from registry.base import n, query, r, rounded
from registry.sqlbase import CATS, block

AFF = [f"affinity_{c}" for c in CATS]
PLAIN = [c for c in BASE_FEATURES if c != "engagement_score"]


def _sub(ctx):
    return X.point_in_time(ctx.clean, [ctx.cutoffs[0]])


def _customers(ctx):
    sub = _sub(ctx)
    names = materialise(X.country_names(sub), "countries")
    return X.with_country(X.customers(X.order_days(X.orders(X.with_country_code(sub, names), ctx.settings, X.customers_fit(sub)), ctx.settings), ctx.settings), names)


@query("flagship_churn_by_recency", f"""
  SELECT {n('least(floor(recency_days / 30), 12) AS recency_band', 'count(*) AS customers')}, {r('avg(churn) AS churn_rate',
         'sum(historical_clv) FILTER (churn = 1) AS revenue_at_risk', 'avg(return_rate) AS mean_return_rate')}
  FROM feats_tr JOIN labels_tr USING (customer_id) GROUP BY 1""", "feats_tr", "labels_tr")
def _(ctx):
    """Clean, build features and labels, report: the whole relational flow in one query."""
    t = ctx.train
    band = F.least(F.floor(F.col("recency_days") / 30), F.lit(12)).cast("long")
    out = t.groupBy(band.alias("recency_band")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("churn").alias("churn_rate"),
        F.sum(F.when(F.col("churn") == 1, F.col("historical_clv"))).alias("revenue_at_risk"), F.avg("return_rate").alias("mean_return_rate"))
    return rounded(out)


@query("f01_point_in_time", "SELECT invoice, stock_code, quantity, invoice_date, customer_id FROM sub_tr", "sub_tr")
def _(ctx):
    return _sub(ctx).select("invoice", "stock_code", "quantity", "invoice_date", "customer_id")


@query("f02_cutoffs", f"SELECT train, scoring FROM cuts", "cuts")
def _(ctx):
    train, scoring = X.cutoffs(ctx.clean, ctx.settings)
    last = ctx.clean.agg(F.max("invoice_date").alias("last"))
    return last.select(F.lit(str(train)).cast("timestamp_ntz").alias("train"), F.lit(str(scoring)).cast("timestamp_ntz").alias("scoring"))


@query("f03_orders", f"SELECT customer_id, invoice, order_date, {r('order_value', 'units')}, country FROM orders_tr", "orders_tr")
def _(ctx):
    sub = _sub(ctx)
    names = materialise(X.country_names(sub), "countries")
    return rounded(X.with_country(X.orders(X.with_country_code(sub, names), ctx.settings).where("order_date IS NOT NULL"), names)
                   .select("customer_id", "invoice", "order_date", "order_value", "units", "country"))


@query("f04_f08_recency_frequency_money", f"""
  SELECT customer_id, country, first_purchase, last_purchase, {r('recency_days', 'frequency', 'total_spend', 'avg_spend', 'avg_basket_size', 'historical_clv')}
  FROM rfm_tr JOIN net_tr USING (customer_id)""", "rfm_tr", "net_tr")
def _(ctx):
    return rounded(_customers(ctx).select("customer_id", "country", "first_purchase", "last_purchase", "recency_days", "frequency",
                                          "total_spend", "avg_spend", "avg_basket_size", "historical_clv"))


@query("f09_freq_trend", f"SELECT customer_id, {r('freq_trend')} FROM trend_tr", "trend_tr")
def _(ctx):
    return rounded(_customers(ctx).select("customer_id", "freq_trend"))


@query("f10_gap_variance", f"SELECT customer_id, {r('gap_variance')} FROM gaps_tr", "gaps_tr")
def _(ctx):
    return rounded(_customers(ctx).select("customer_id", "gap_variance"))


@query("f10_gap_variance_events", f"""
  SELECT user_id AS customer_id, {r('coalesce(var_pop(gap), 0) AS gap_variance', 'count(*) AS frequency')}
  FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000.0::DOUBLE AS gap FROM events)
  GROUP BY 1""")
def _(ctx):
    """Sub-day gaps: event times with several events per customer and day."""
    ev = ctx.table("events")
    last = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    tx = ev.select(
        last.alias("cutoff"), F.col("user_id").alias("customer_id"), F.col("event_id").cast("string").alias("invoice"),
        F.col("ts").alias("invoice_date"), F.lit("A").alias("stock_code"), F.lit(1.0).alias("quantity"), F.lit(1.0).alias("line_total"),
        F.lit("x").alias("country"), F.lit(False).alias("is_return"), F.lit(False).alias("is_admin_code"), F.lit("other").alias("category"))
    c = X.customers(X.order_days(X.orders(tx, ctx.settings), ctx.settings), ctx.settings)
    return rounded(c.select("customer_id", "gap_variance", "frequency"))


@query("f11_seasonal_concentration", f"SELECT customer_id, {r('seasonal_concentration')} FROM season_tr", "season_tr")
def _(ctx):
    return rounded(_customers(ctx).select("customer_id", "seasonal_concentration"))


@query("f12_return_rate", f"SELECT customer_id, {r('return_rate')} FROM net_tr JOIN rfm_tr USING (customer_id)", "net_tr", "rfm_tr")
def _(ctx):
    return rounded(_customers(ctx).select("customer_id", "return_rate"))


@query("f13_median_price", f"SELECT stock_code, {r('median_price')} FROM medians_tr", "medians_tr")
def _(ctx):
    return rounded(X.median_prices(_sub(ctx)).select("stock_code", "median_price"))


@query("f14_discount_sensitivity", f"""
  SELECT customer_id, {r('coalesce(discount_sensitivity, 0) AS discount_sensitivity')} FROM rfm_tr LEFT JOIN discount_tr USING (customer_id)""",
       "rfm_tr", "discount_tr")
def _(ctx):
    sub = _sub(ctx)
    lines = X.discounted_spend(sub, materialise(X.median_prices(sub), "median-prices"), ctx.settings)
    return rounded(X.customers(X.order_days(X.orders(lines, ctx.settings, X.customers_fit(sub)), ctx.settings), ctx.settings).select("customer_id", "discount_sensitivity"))


@query("f15_product_popularity", f"SELECT stock_code, {r('popularity', digits=6)} FROM pop_tr", "pop_tr")
def _(ctx):
    return rounded(X.product_popularity(X.customer_products(_sub(ctx))).select("stock_code", "popularity"), 6)


@query("f16_average_popularity", f"SELECT customer_id, {r('avg_product_popularity', digits=6)} FROM avgpop_sc", "avgpop_sc")
def _(ctx):
    sub = X.point_in_time(ctx.clean, [ctx.cutoffs[1]])
    return rounded(X.average_popularity(X.customer_products(sub), ctx.popularity, shared=True)
                   .select("customer_id", "avg_product_popularity"), 6)


@query("f17_category_affinity", f"""
  SELECT customer_id, {r(*[f'coalesce({a}, 0) AS {a}' for a in AFF])} FROM rfm_tr LEFT JOIN affinity_tr USING (customer_id)""",
       "rfm_tr", "affinity_tr")
def _(ctx):
    return rounded(_customers(ctx).select("customer_id", *AFF))


FEATS = f"customer_id, country, first_purchase, last_purchase, {r(*PLAIN, *AFF)}"


@query("f18_customer_features", f"SELECT {FEATS} FROM feats_tr", "feats_tr")
def _(ctx):
    return rounded(X.customer_features(ctx.clean, [ctx.cutoffs[0]], ctx.settings)
                   .select("customer_id", "country", "first_purchase", "last_purchase", *PLAIN, *AFF))


@query("f19_train_and_scoring_snapshots", f"""
  SELECT 'train' AS snapshot, {FEATS}, churn::BIGINT AS churn, {r('clv_target')}, next_category FROM feats_tr JOIN labels_tr USING (customer_id)
  UNION ALL SELECT 'scoring', {FEATS}, NULL, NULL, NULL FROM feats_sc""", "feats_tr", "labels_tr", "feats_sc")
def _(ctx):
    train, scoring, _pop = X.train_and_scoring(ctx.clean, ctx.settings)
    base = ["customer_id", "country", "first_purchase", "last_purchase", *PLAIN, *AFF]
    a = train.select(F.lit("train").alias("snapshot"), *base, "churn", "clv_target", "next_category")
    b = scoring.select(F.lit("scoring").alias("snapshot"), *base)
    return rounded(a.unionByName(b, allowMissingColumns=True))


block("moments", "SELECT train AS cutoff FROM cuts UNION ALL SELECT scoring FROM cuts UNION ALL SELECT train - INTERVAL 365 DAY FROM cuts", "cuts")


@query("f19_many_cutoffs", f"""
  SELECT cutoff, {n('count(*) AS customers')}, {r('sum(frequency) AS orders', 'sum(total_spend) AS spend', 'avg(recency_days) AS recency', digits=2)} FROM (
    SELECT cutoff, customer_id, count(DISTINCT invoice) AS frequency, greatest(sum(line_total), 0) AS total_spend,
           floor(epoch(cutoff - max(invoice_date)) / 86400) AS recency_days
    FROM clean JOIN moments ON invoice_date < cutoff WHERE use_for_customer_model AND NOT is_return GROUP BY cutoff, customer_id) GROUP BY 1""", "clean", "moments")
def _(ctx):
    from datetime import timedelta
    train, scoring = ctx.cutoffs
    f = X.customer_features(ctx.clean, [train, scoring, train - timedelta(days=365)], ctx.settings)
    return rounded(f.groupBy("cutoff").agg(F.count(F.lit(1)).alias("customers"), F.sum("frequency").alias("orders"),
                                           F.sum("total_spend").alias("spend"), F.avg("recency_days").alias("recency")), 2)


block("seqcat", """
  SELECT customer_id, invoice, category FROM (
    SELECT customer_id, invoice, category, row_number() OVER (PARTITION BY customer_id, invoice ORDER BY sum(line_total) DESC, category) AS rn
    FROM sales_tr GROUP BY customer_id, invoice, category) WHERE rn = 1""", "sales_tr")
block("steps", """
  SELECT o.customer_id, order_date, cutoff, category, order_value,
         row_number() OVER (PARTITION BY o.customer_id ORDER BY order_date DESC, o.invoice DESC) AS back,
         (epoch_us(order_date) - epoch_us(lag(order_date) OVER (PARTITION BY o.customer_id ORDER BY order_date, o.invoice))) / 86400000000.0::DOUBLE AS gap
  FROM orders_tr o JOIN seqcat s ON o.customer_id = s.customer_id AND o.invoice = s.invoice""", "orders_tr", "seqcat")
IDX = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATS, 1)) + f" ELSE {len(CATS) + 1} END"


@query("f20_order_steps", f"""
  SELECT customer_id, {n('back', f'{IDX} AS cat_idx')}, {r('ln(1 + greatest(order_value, 0)) / 10 AS amt', 'ln(1 + greatest(coalesce(gap, 0), 0)) / 6 AS gap',
  'ln(1 + (epoch_us(cutoff) - epoch_us(order_date)) / 86400000000.0::DOUBLE) / 6 AS days_since')} FROM steps WHERE back <= 20""", "steps")
def _(ctx):
    return rounded(S.order_steps(ctx.clean, ctx.cutoffs[0], ctx.settings))


@query("f20_sequences", f"""
  SELECT customer_id, 21::BIGINT AS n_steps, {n('count(*) FILTER (back <= 20) AS n_events')}, {r('sum(ln(1 + greatest(order_value, 0)) / 10) FILTER (back <= 20) AS amt_sum')}
  FROM steps GROUP BY 1""", "steps")
def _(ctx):
    seq = S.sequences(ctx.clean, ctx.cutoffs[0], ctx.settings)
    add = lambda f: F.aggregate("steps", F.lit(0.0), lambda a, s: a + s[f])
    return rounded(seq.select("customer_id", F.size("steps").alias("n_steps"), add("is_event").cast("long").alias("n_events"), add("amt").alias("amt_sum")))


# ------------------------------------------------------------------ labels
@query("l01_l03_labels", f"SELECT customer_id, {n('churn')}, {r('clv_target')}, next_category FROM labels_tr", "labels_tr")
def _(ctx):
    base = _customers(ctx)
    return rounded(X.with_labels(base, ctx.clean, [ctx.cutoffs[0]], ctx.settings).select("customer_id", "churn", "clv_target", "next_category"))


# ------------------------------------------------------------------ encoding
@query("e01_country_levels", f"SELECT country, {n('count(*) AS n')} FROM rfm_tr GROUP BY 1 ORDER BY n DESC, country LIMIT 5", "rfm_tr")
def _(ctx):
    return E.country_ranking(ctx.train, ctx.settings)


block("levels", "SELECT country, row_number() OVER (ORDER BY count(*) DESC, country) AS rk FROM rfm_tr GROUP BY 1 QUALIFY rk <= 5", "rfm_tr")


@query("e02_one_hot", f"""
  SELECT customer_id, {r('coalesce(rk = 1, false)::INT AS reference', 'coalesce(rk = 2, false)::INT AS second', 'coalesce(rk = 5, false)::INT AS fifth',
  '(rk IS NULL)::INT AS other')} FROM rfm_sc r LEFT JOIN levels l ON r.country = l.country""", "rfm_sc", "levels")
def _(ctx):
    levels = E.country_levels(ctx.train, ctx.settings)
    flags = E.country_flags(levels)
    total = sum(flags.values(), F.lit(0.0))
    return rounded(ctx.scoring.select("customer_id", (F.lit(1.0) - total).alias("reference"), flags[f"country_{levels[1]}"].alias("second"),
                                      flags[f"country_{levels[4]}"].alias("fifth"), flags["country_Other"].alias("other")))


@query("e03_ecdf_lookup", f"SELECT customer_id, {r('p_rec AS ecdf_recency_days', 'p_freq AS ecdf_frequency', 'p_spend AS ecdf_total_spend')} FROM eng_sc", "eng_sc")
def _(ctx):
    return rounded(E.with_ecdf(ctx.scoring, ctx.train).select("customer_id", "ecdf_recency_days", "ecdf_frequency", "ecdf_total_spend"))


@query("e04_engagement", f"""
  SELECT customer_id, {r('engagement_score')} FROM snap_tr UNION ALL SELECT -customer_id, {r('engagement_score')} FROM snap_sc""", "snap_tr", "snap_sc")
def _(ctx):
    a, b = ctx.train.drop("engagement_score"), ctx.scoring.drop("engagement_score")
    both = E.fill_engagement(a, ctx.train).select("customer_id", "engagement_score").unionByName(
        E.fill_engagement(b, ctx.train).select((-F.col("customer_id")).alias("customer_id"), "engagement_score"))
    return rounded(both)


@query("e05_model_matrix")
def _(ctx):
    levels = E.country_levels(ctx.train, ctx.settings)
    cols = E.model_columns(levels, ctx.settings)
    return rounded(E.model_matrix(ctx.scoring, levels, ctx.settings).select("customer_id", *cols))


E05_COLS = list(DEFAULTS.feature_columns)


@query("e05_matrix_cells", " UNION ALL ".join(
    [f"SELECT customer_id, '{c}' AS feature, {r(f'coalesce({c}, 0) AS value')} FROM snap_sc" for c in E05_COLS]
    + [f"SELECT customer_id, 'country ' || {k} AS feature, {r(f'coalesce(rk = {k}, false)::INT AS value')} FROM snap_sc s LEFT JOIN levels l ON s.country = l.country" for k in range(2, 6)]
    + [f"SELECT customer_id, 'country other' AS feature, {r('(rk IS NULL)::INT AS value')} FROM snap_sc s LEFT JOIN levels l ON s.country = l.country"]), "snap_sc", "levels")
def _(ctx):
    levels = E.country_levels(ctx.train, ctx.settings)
    names = {c: c for c in E05_COLS} | {f"country_{c}": f"country {i}" for i, c in enumerate(levels[1:-1], 2)} | {"country_Other": "country other"}
    matrix = E.model_matrix(ctx.scoring, levels, ctx.settings)
    cells = F.array(*[F.struct(F.lit(shown).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c, shown in names.items()])
    return rounded(matrix.select("customer_id", F.explode(cells).alias("c")).select("customer_id", "c.feature", "c.value"))


VIF_COLS = ["recency_days", "frequency", "total_spend", "avg_basket_size", "return_rate"]


block("vif_corr", "SELECT " + ", ".join(f"corr({a}, {b}) AS c_{i}_{j}" for i, a in enumerate(VIF_COLS) for j, b in enumerate(VIF_COLS)) + " FROM snap_tr", "snap_tr")


def determinant(size: int, skip: int | None = None) -> str:
    """SQL of the determinant of the correlations c_i_j, without one row and column: the sum over permutations."""
    left = [i for i in range(size) if i != skip]
    terms = []
    for order in itertools.permutations(range(len(left))):
        odd = sum(a > b for i, a in enumerate(order) for b in order[i + 1:]) % 2
        terms.append(("-" if odd else "+") + " * ".join(f"c_{left[i]}_{left[j]}" for i, j in enumerate(order)))
    return "(" + " ".join(terms) + ")"


@query("e06_vif", " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'{determinant(len(VIF_COLS), i)} / {determinant(len(VIF_COLS))} AS vif')} FROM vif_corr"
                                     for i, c in enumerate(VIF_COLS)), "vif_corr")
def _(ctx):
    out = E.vif(ctx.train, VIF_COLS)
    return rounded(ctx.spark.createDataFrame([(c, float(v)) for c, v in out.items()], "feature string, vif double"))


@query("e07_vif_pruning")
def _(ctx):
    levels = E.country_levels(ctx.train, ctx.settings)
    matrix = E.model_matrix(ctx.train, levels, ctx.settings)
    _kept, history = E.prune_by_vif(matrix, E.model_columns(levels, ctx.settings), ctx.settings.vif_threshold, ctx.settings.vif_protected)
    return rounded(ctx.spark.createDataFrame(history, "feature string, vif double, status string"))


CORR = ["recency_days", "frequency", "total_spend", "return_rate", "gap_variance", "churn", "clv_target"]


@query("e08_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b}) AS corr')} FROM snap_tr JOIN labels_tr USING (customer_id)"
    for i, a in enumerate(CORR) for b in CORR[i:]), "snap_tr", "labels_tr")
def _(ctx):
    return rounded(E.correlation_long(ctx.train, CORR))


DESC = ["recency_days", "frequency", "total_spend", "gap_variance", "return_rate"]


@query("e09_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {n('count(*) AS n')}, {r(f'avg({c}) AS mean', f'stddev_samp({c}) AS std', f'min({c}) AS lowest', f'quantile_cont({c}, 0.25) AS q1', f'quantile_cont({c}, 0.5) AS median', f'quantile_cont({c}, 0.75) AS q3', f'max({c}) AS highest', digits=3)} FROM feats_tr"
    for c in DESC), "feats_tr")
def _(ctx):
    return rounded(E.describe_long(ctx.train, DESC), 3)


@query("e10_value_tiers", """
  SELECT customer_id, CASE greatest(ceil((rk - 1) * 3 / (n - 1)), 1) WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS value_tier
  FROM (SELECT customer_id, row_number() OVER (ORDER BY round(historical_clv, 2), customer_id)::DOUBLE AS rk, count(*) OVER () AS n FROM feats_sc)""", "feats_sc")
def _(ctx):
    return E.value_tiers(ctx.scoring.withColumn("historical_clv", F.round("historical_clv", 2))).select("customer_id", "value_tier")


block("bin_rows", "SELECT frequency, churn FROM feats_tr JOIN labels_tr USING (customer_id)", "feats_tr", "labels_tr")
block("bin_edges", "SELECT list_sort(list_distinct(quantile_cont(frequency, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS edges FROM bin_rows", "bin_rows")
block("binned", "SELECT greatest(len(list_filter(edges, lambda x: x < frequency)), 1) AS bin, churn, edges FROM bin_rows, bin_edges", "bin_edges")


@query("e11_quantile_bins", f"""
  SELECT {n('bin')}, {r('min(edges[bin]) AS low', 'max(edges[bin + 1]) AS high')}, {n('count(*) AS n')}, {r('avg(churn) AS mean_target')}
  FROM binned GROUP BY bin""", "binned")
def _(ctx):
    return rounded(E.quantile_bins(ctx.train, "frequency", "churn"))


@query("e12_medians", " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'median({c}) AS median')} FROM snap_tr" for c in [*BASE_FEATURES, *AFF]), "snap_tr")
def _(ctx):
    return rounded(E.medians(ctx.train, ctx.settings.feature_columns))


@query("e13_histogram", f"""
  SELECT {n('least(floor((v - lo) / ((hi - lo) / 40)), 39) AS bin', 'count(*) AS n')} FROM (
    SELECT ln(1 + avg_basket_size) AS v, min(ln(1 + avg_basket_size)) OVER () AS lo, max(ln(1 + avg_basket_size)) OVER () AS hi FROM feats_tr) GROUP BY 1""", "feats_tr")
def _(ctx):
    return rounded(E.histogram(ctx.train, "avg_basket_size", 40, log=True).select("bin", "n"))

