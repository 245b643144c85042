"""Sources, sinks, cleaning and validation."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from patronage.config import DEFAULTS
from patronage.functions.expressions import category_of, hash_unit, tidy_text
from patronage.operators import clean as C
from patronage.operators import validate as V
from patronage.session import materialise, shared_folder
from patronage.sources import invoices, runlog, sinks
from registry.base import n, query, r, rounded
from registry.sqlbase import TIDY, category_case, unit_hash

EIGHT = "invoice, stock_code, description, quantity, invoice_date, unit_price, customer_id, country"


def scratch(ctx, name: str) -> str:
    return f"{shared_folder(ctx.spark).rstrip('/')}/patronage/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources
@query("s01_csv_scan", f"SELECT {EIGHT} FROM raw", "raw")
def _(ctx):
    path = scratch(ctx, "csv")
    ctx.raw.write.mode("overwrite").option("header", True).option("compression", "gzip").option("quoteAll", True).option("escape", '"') \
        .option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return invoices.standardise_columns(invoices.read_csv(ctx.spark, path))


@query("s02_standardise_columns", """
  SELECT l_orderkey::VARCHAR AS invoice, upper('p' || l_partkey::VARCHAR || 'a') AS stock_code, l_returnflag AS description,
         CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_quantity END AS quantity,
         CASE WHEN l_orderkey % 70 = 0 THEN NULL ELSE l_shipdate END AS invoice_date,
         CASE WHEN l_orderkey % 90 = 0 THEN NULL ELSE l_extendedprice END AS unit_price,
         CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_suppkey END AS customer_id, l_linestatus AS country
  FROM lineitem""")
def _(ctx):
    bad = lambda c, m: F.when(F.col("l_orderkey") % m == 0, F.lit("n/a")).otherwise(F.col(c).cast("string"))
    source = ctx.table("lineitem").select(
        F.concat(F.lit("  "), F.col("l_orderkey").cast("string"), F.lit(" ")).alias("Invoice No"),
        F.concat(F.lit(" p"), F.col("l_partkey").cast("string"), F.lit("a")).alias("StockCode"),
        F.col("l_returnflag").alias("Description"), bad("l_quantity", 50).alias("Quantity"),
        bad("l_shipdate", 70).alias("InvoiceDate"), bad("l_extendedprice", 90).alias("Price"),
        F.lit("999").alias("Unit_Price"),
        F.when(F.col("l_suppkey") % 10 == 0, "").otherwise(F.concat(F.col("l_suppkey").cast("string"), F.lit(".0"))).alias("Customer ID"),
        F.concat(F.col("l_linestatus"), F.lit("  ")).alias("COUNTRY"), F.lit("x").alias("comment"))
    return invoices.standardise_columns(source)


@query("s03_combine_sources", f"SELECT {EIGHT} FROM raw", "raw")
def _(ctx):
    raw = ctx.raw
    early = raw.where(F.year("invoice_date") < 1998).withColumnRenamed("unit_price", "Price")
    late = raw.where(F.year("invoice_date") >= 1998).withColumnRenamed("customer_id", "Customer ID")
    return invoices.combine_sources([early, late])


# ------------------------------------------------------------------ sinks
@query("s04_export_leaderboard", f"""
  SELECT customer_id, country, {r('churn_probability * historical_clv AS at_risk_value')} FROM scored_sc
  ORDER BY churn_probability * historical_clv DESC, customer_id LIMIT 50""", "scored_sc")
def _(ctx):
    path = scratch(ctx, "leaderboard")
    board = rounded(ctx.scored.select("customer_id", "country", (F.col("churn_probability") * F.col("historical_clv")).alias("at_risk_value"))
                    .orderBy(F.col("at_risk_value").desc(), "customer_id").limit(50))
    sinks.export_csv(board, path)
    return ctx.spark.read.schema(board.schema).option("header", True).csv(path)


@query("s05_clean_table_round_trip", f"""
  SELECT date_trunc('month', invoice_date)::DATE AS invoice_month, {n('count(*) AS rows', 'count(*) FILTER (is_return) AS returns')},
         {r('sum(line_total) AS revenue', digits=2)} FROM clean GROUP BY 1""", "clean")
def _(ctx):
    path = scratch(ctx, "clean-by-month")
    sinks.write_clean(ctx.clean, path)
    back = sinks.read_clean(ctx.spark, path, ctx.clean.schema)
    return rounded(back.groupBy("invoice_month").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_return").alias("returns"), F.sum("line_total").alias("revenue")), 2)


@query("s06_snapshot_tables", f"""
  SELECT 'train' AS snapshot, {n('count(*) AS customers')}, {r('sum(total_spend) AS spend', digits=2)} FROM snap_tr
  UNION ALL SELECT 'scoring', count(*)::BIGINT, {r('sum(total_spend) AS spend', digits=2)} FROM snap_sc""", "snap_tr", "snap_sc")
def _(ctx):
    path = scratch(ctx, "snapshots")
    sinks.write_snapshots(ctx.train, ctx.scoring, path)
    parts = [sinks.read_snapshot(ctx.spark, path, s).agg(F.count(F.lit(1)).alias("customers"), F.sum("total_spend").alias("spend"))
             .select(F.lit(s).alias("snapshot"), "customers", "spend") for s in ("train", "scoring")]
    return rounded(parts[0].unionByName(parts[1]), 2)


@query("s07_run_log", f"""
  SELECT country AS model, 'rows' AS metric, {r('count(*) AS value')} FROM clean GROUP BY 1
  UNION ALL SELECT country, 'revenue', round(sum(line_total), 2) + 0.0::DOUBLE FROM clean GROUP BY 1
  UNION ALL SELECT country, 'note', NULL FROM clean GROUP BY 1""", "clean")
def _(ctx):
    path = scratch(ctx, "run-log")
    facts = ctx.clean.groupBy("country").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("line_total"), 2).alias("revenue"))
    for run in ("a", "b"):
        runlog.append_frame(facts.select(
            F.lit(run).alias("run_id"), F.lit("2001-01-01T00:00:00").alias("timestamp"), F.lit("facts").alias("task"),
            F.col("country").alias("model"), F.lit("all").alias("split"),
            F.create_map(F.lit("k"), F.lit("v")).alias("params"), F.lit(0.5).alias("train_time_sec"),
            F.create_map(F.lit("rows"), F.col("rows").cast("string"), F.lit("revenue"), F.col("revenue").cast("decimal(30,2)").cast("string"),
                         F.lit("note"), F.lit("text")).alias("metrics")), path)
    return rounded(runlog.flat(runlog.read(ctx.spark, path, "b")).select("model", "metric", "value"))


@query("s08_reload_tables", f"""
  SELECT 'customers' AS table_name, {n('count(*) AS rows')} FROM snap_sc UNION ALL
  SELECT 'lines', (SELECT count(*) FROM clean WHERE use_for_customer_model AND customer_id IN (SELECT customer_id FROM snap_sc))::BIGINT""",
       "snap_sc", "clean")
def _(ctx):
    path = scratch(ctx, "tables")
    tables = {"customers": sinks.publish_customers(ctx.scoring, ctx.settings.feature_columns),
              "lines": sinks.publish_lines(ctx.clean, ctx.scoring)}
    for _again in range(2):  # reloading twice must not add rows
        sinks.replace_all(tables, path)
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows")
             for t, df in zip(tables, sinks.read_published(ctx.spark, path, *tables))]
    return parts[0].unionByName(parts[1])


@query("s09_upsert", f"""
  SELECT customer_id, {r('CASE WHEN customer_id % 7 = 0 THEN 0.9 ELSE churn_probability END AS churn_probability')},
         (CASE WHEN customer_id % 7 = 0 THEN 3 ELSE 1 END)::BIGINT AS version FROM scored_sc
  UNION ALL SELECT -customer_id - 1, 0.9::DOUBLE, 3::BIGINT FROM scored_sc WHERE customer_id % 7 = 0""", "scored_sc")
def _(ctx):
    target = ctx.scored.select("customer_id", "churn_probability", F.lit(1).cast("long").alias("version"))
    changed = target.where("customer_id % 7 = 0")
    keys = changed.unionByName(changed.withColumn("customer_id", -F.col("customer_id") - 1))
    updates = keys.withColumn("version", F.explode(F.array(F.lit(2).cast("long"), F.lit(3).cast("long")))) \
        .withColumn("churn_probability", F.when(F.col("version") == 3, 0.9).otherwise(0.1))
    return rounded(sinks.upsert(target, updates, version="version"))


@query("s10_publish_lines", f"""
  SELECT invoice, stock_code, substr(description, 1, 255) AS description, category, invoice_date,
         {r('quantity', 'unit_price', 'line_total')}, is_return, customer_id, country
  FROM clean WHERE use_for_customer_model AND customer_id IN (SELECT customer_id FROM feats_sc)""", "clean", "feats_sc")
def _(ctx):
    return rounded(sinks.publish_lines(ctx.clean, ctx.scoring))


@query("s11_publish_customers")
def _(ctx):
    return sinks.publish_customers(ctx.scoring, ctx.settings.feature_columns)


@query("s11_features_in_json", f"""
  SELECT customer_id, country, {r(*[f'coalesce({c}, 0) AS {c}' for c in DEFAULTS.feature_columns])} FROM snap_sc""", "snap_sc")
def _(ctx):
    """The published JSON column, read back."""
    published = sinks.publish_customers(ctx.scoring, ctx.settings.feature_columns)
    found = F.from_json("features_json", "map<string,double>")
    return rounded(published.select("customer_id", "country", *[F.coalesce(F.try_element_at(found, F.lit(c)), F.lit(0.0)).alias(c) for c in DEFAULTS.feature_columns]))


@query("s12_parameterised_read", f"""
  SELECT country, {n('count(*) AS lines')}, {r('sum(line_total) AS revenue', digits=2)} FROM clean
  WHERE invoice_date >= TIMESTAMP '1999-01-01' AND quantity >= 10 GROUP BY country""", "clean")
def _(ctx):
    return rounded(sinks.read_sql(
        ctx.spark, """SELECT country, count(*) AS lines, sum(line_total) AS revenue FROM clean_lines
                      WHERE invoice_date >= CAST(:since AS TIMESTAMP_NTZ) AND quantity >= :least GROUP BY country""",
        {"since": "1999-01-01", "least": 10}, {"clean_lines": ctx.clean}), 2)


# ------------------------------------------------------------------ cleaning
def _holed(ctx):
    """Raw lines with some nulls in the three columns that must be present."""
    return ctx.table("lineitem").select(
        F.col("l_orderkey").alias("invoice"), F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_orderkey") % 13 != 0, F.col("l_shipdate")).alias("invoice_date"),
        F.when(F.col("l_orderkey") % 17 != 0, F.col("l_extendedprice")).alias("unit_price"))


@query("c01_drop_incomplete", """
  SELECT l_orderkey AS invoice, l_quantity AS quantity, l_shipdate AS invoice_date, l_extendedprice AS unit_price
  FROM lineitem WHERE l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 AND l_orderkey % 17 <> 0""")
def _(ctx):
    return C.drop_incomplete(_holed(ctx))


@query("c02_exact_duplicates", f"SELECT {EIGHT} FROM dist", "dist")
def _(ctx):
    return C.drop_exact_duplicates(C.drop_incomplete(ctx.raw))


@query("c02_duplicate_counts", f"""
  SELECT {n('(SELECT count(*) FROM raw) AS rows_in', '(SELECT count(*) FROM complete_rows) AS rows_complete',
            '(SELECT count(*) FROM complete_rows) - (SELECT count(*) FROM dist) AS exact_duplicates_removed')}""", "raw", "complete_rows", "dist")
def _(ctx):
    return C.duplicate_counts(ctx.raw)


@query("c03_c06_row_flags", f"""
  SELECT invoice, stock_code, quantity, unit_price, customer_id IS NOT NULL AS has_customer_id,
         upper(invoice) LIKE 'C%' OR quantity < 0 AS is_return, unit_price <= 0 AS is_price_adjustment,
         stock_code = 'POST' AS is_admin_code FROM dist""", "dist")
def _(ctx):
    return C.flag_rows(ctx.distinct, ctx.settings).select(
        "invoice", "stock_code", "quantity", "unit_price", "has_customer_id", "is_return", "is_price_adjustment", "is_admin_code")


@query("c07_tukey_fences", f"SELECT {r('q_lo', 'q_hi', 'p_lo', 'p_hi')} FROM fences", "fences")
def _(ctx):
    return rounded(C.tukey_fences(ctx.distinct, ctx.settings.iqr_multiplier))


OUT = "invoice, stock_code, customer_id, quantity, unit_price, is_outlier, is_entry_error, is_bulk_outlier"


def _outliers(ctx, k):
    settings = ctx.settings.with_(iqr_multiplier=k)
    fences = C.Fences.of(C.tukey_fences(ctx.distinct, k))
    return C.flag_outliers(C.flag_rows(ctx.distinct, settings), fences, settings).select(*OUT.split(", "))


@query("c08_c10_outlier_flags", f"SELECT {OUT} FROM outliers", "outliers")
def _(ctx):
    return _outliers(ctx, 3.0)


@query("c08_c10_outlier_flags_narrow", f"SELECT {OUT} FROM outliers_narrow", "outliers_narrow")
def _(ctx):
    return _outliers(ctx, 0.1)


@query("c09_reversal_pairs", "SELECT rc AS customer_id, rs AS stock_code, rq AS abs_quantity FROM reversed_narrow", "reversed_narrow")
def _(ctx):
    fences = C.Fences.of(C.tukey_fences(ctx.distinct, 0.1))
    return C.reversed_keys(ctx.distinct, fences)


@query("c11_tidy_text", f"SELECT invoice, stock_code, {TIDY} AS text FROM raw", "raw")
def _(ctx):
    return ctx.raw.select("invoice", "stock_code", tidy_text(F.col("description")).alias("text"))


@query("c12_description_lookup", "SELECT stock_code, std_description FROM products", "products")
def _(ctx):
    return C.description_lookup(ctx.distinct)


@query("c12_description_lookup_typos", f"""
  SELECT stock_code, arg_max(txt, (n, -rk)) AS std_description FROM (
    SELECT stock_code, txt, sum(n) AS n, row_number() OVER (PARTITION BY stock_code ORDER BY txt) AS rk
    FROM (SELECT stock_code, CASE txt WHEN 'RED PLATE' THEN 'CRIMSON PLATE' WHEN 'BLUE BOLT' THEN 'AZURE BOLT' ELSE txt END AS txt, n FROM votes)
    GROUP BY stock_code, txt) GROUP BY stock_code""", "votes")
def _(ctx):
    return C.description_lookup(ctx.distinct, {"red plate": "crimson plate", "blue bolt": "azure bolt"})


@query("c13_standard_descriptions", f"SELECT invoice, stock_code, quantity, description FROM clean", "clean")
def _(ctx):
    return C.with_products(ctx.distinct, C.product_table(ctx.distinct, ctx.settings), ctx.settings) \
        .select("invoice", "stock_code", "quantity", "description")


MORE_WORDS = {"fasteners": ["BOLT", "ROD"], "drives": ["GEAR", "WIDGET"], **DEFAULTS.category_words, "tools": ["ANVIL", "GIZMO"]}


@query("c14_categories", f"SELECT p_partkey, {category_case('p_name', MORE_WORDS)} AS category FROM part")
def _(ctx):
    return ctx.table("part").select("p_partkey", category_of(F.col("p_name"), MORE_WORDS).alias("category"))


@query("c14_product_categories", "SELECT stock_code, std_description, category FROM products", "products")
def _(ctx):
    return C.product_table(ctx.distinct, ctx.settings)


CLEAN_SELECT = ", ".join(c if c not in ("quantity", "unit_price", "line_total") else r(c) for c in C.CLEAN_COLUMNS)


@query("c15_c17_clean_transactions", f"SELECT {CLEAN_SELECT} FROM clean", "clean")
def _(ctx):
    return rounded(C.clean_transactions(ctx.raw, ctx.settings))


@query("c18_cleaning_report", f"""
  SELECT {n('count(*) AS rows_out', 'count(*) FILTER (NOT has_customer_id) AS rows_missing_customer_id',
            'count(*) FILTER (is_return) AS return_lines', 'count(*) FILTER (is_price_adjustment) AS price_adjustment_lines',
            'count(*) FILTER (is_admin_code) AS admin_code_lines', 'count(*) FILTER (is_outlier) AS n_outliers',
            'count(*) FILTER (is_entry_error) AS n_entry_errors', 'count(*) FILTER (is_bulk_outlier) AS n_bulk_outliers',
            'count(*) FILTER (use_for_customer_model) AS rows_used_for_customer_model',
            'count(DISTINCT customer_id) AS unique_customers')} FROM clean""", "clean")
def _(ctx):
    return C.cleaning_counts(ctx.clean)


# ------------------------------------------------------------------ validation
@query("v03_v06_transaction_profile", f"""
  SELECT {n('count(*) AS rows')}, {r('avg((customer_id IS NULL)::INT) AS null_rate_customer_id', 'avg((description IS NULL)::INT) AS null_rate_description',
  'avg((invoice_date IS NULL)::INT) AS null_rate_invoice_date', 'avg((quantity IS NULL)::INT) AS null_rate_quantity',
  'avg((unit_price IS NULL)::INT) AS null_rate_unit_price')}, min(invoice_date) AS date_min, max(invoice_date) AS date_max,
  {r('avg((unit_price <= 0)::INT) AS nonpositive_price_rate')} FROM raw""", "raw")
def _(ctx):
    V.validate_transactions(ctx.raw, ctx.settings)
    return rounded(V.transaction_profile(ctx.raw, ctx.settings))


def _spoiled(ctx):
    """Training snapshot with planted faults, chosen by a hash of the customer."""
    u = hash_unit(F.col("customer_id"), "fault")
    fault = lambda low, high, value, c: F.when((u >= low) & (u < high), F.lit(value)).otherwise(F.col(c))
    return ctx.train.withColumns({
        "recency_days": fault(0.00, 0.05, -3.0, "recency_days"), "frequency": fault(0.05, 0.10, 0.0, "frequency"),
        "return_rate": fault(0.10, 0.15, 1.5, "return_rate"), "gap_variance": fault(0.15, 0.20, float("inf"), "gap_variance"),
        "avg_spend": fault(0.20, 0.25, None, "avg_spend"), "country": fault(0.25, 0.30, "", "country"),
        "affinity_lighting": fault(0.30, 0.35, 0.9, "affinity_lighting"),
        "affinity_bath_beauty": fault(0.28, 0.33, 1.5, "affinity_bath_beauty")})


SPOIL = f"""(SELECT *, u >= 0 AND u < 0.05 AS f1, u >= 0.05 AND u < 0.10 AS f2, u >= 0.10 AND u < 0.15 AS f3, u >= 0.15 AND u < 0.20 AS f4,
   u >= 0.20 AND u < 0.25 AS f5, u >= 0.25 AND u < 0.30 AS f6, u >= 0.30 AND u < 0.35 AS f7, u >= 0.28 AND u < 0.33 AS f8
   FROM (SELECT *, {unit_hash('customer_id', 'fault')} AS u FROM feats_tr))"""


@query("v07_v10_feature_profile", f"""
  SELECT {n('count(*) AS rows', 'count(*) FILTER (f4) AS not_finite_gap_variance', 'count(*) FILTER (f5) AS not_finite_avg_spend',
            'count(*) FILTER (f1) AS negative_recency', 'count(*) FILTER (f2) AS no_orders', 'count(*) FILTER (f3) AS return_rate_outside',
            'count(DISTINCT customer_id) FILTER (customer_id % 50 = 0) AS duplicate_customers')}
  FROM (SELECT * FROM {SPOIL} UNION ALL SELECT * FROM {SPOIL} WHERE customer_id % 50 = 0)""", "feats_tr")
def _(ctx):
    bad = _spoiled(ctx)
    return V.feature_profile(bad.unionByName(bad.where("customer_id % 50 = 0")), ["gap_variance", "avg_spend"])


@query("v10_duplicate_customers", f"SELECT customer_id, {n('count(*) AS n')} FROM clean WHERE customer_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1", "clean")
def _(ctx):
    return V.duplicate_customers(ctx.clean.where("customer_id IS NOT NULL"))


@query("v11_record_rules", f"""
  SELECT customer_id, {n('f1::INT + f2::INT + f3::INT + f5::INT + f6::INT + (f8 OR (f7 AND NOT f8 AND 0.9 + rest > 1.000001))::INT AS n_errors')}
  FROM (SELECT *, affinity_kitchen_dining + affinity_jewelry_accessories AS rest FROM {SPOIL})""", "feats_tr")
def _(ctx):
    return V.record_errors(_spoiled(ctx)).select("customer_id", F.size("errors").cast("long").alias("n_errors"))


@query("v11_quarantine", f"""
  SELECT error, {n('count(*) AS n')} FROM (SELECT unnest(list_filter([
    CASE WHEN f1 THEN 'recency_days is below 0' END,
    CASE WHEN f2 THEN 'frequency is below 1' END,
    CASE WHEN f3 THEN 'return_rate is above 1' END,
    CASE WHEN f5 THEN 'avg_spend is not given' END,
    CASE WHEN f6 THEN 'country is blank' END,
    CASE WHEN f8 THEN 'category_affinity holds a share outside 0 to 1' END,
    CASE WHEN f7 AND NOT f8 AND 0.9 + affinity_kitchen_dining + affinity_jewelry_accessories > 1.000001
         THEN 'category_affinity adds up to more than 1' END], lambda x: x IS NOT NULL)) AS error FROM {SPOIL}) GROUP BY 1""", "feats_tr")
def _(ctx):
    return V.error_summary(_spoiled(ctx))


@query("v12_batch_report", f"""
  SELECT {n('count(*) AS n_rows', 'count(*) FILTER (NOT bad) AS n_scored', 'count(*) FILTER (bad) AS n_failed')}
  FROM (SELECT f1 OR f2 OR f3 OR f5 OR f6 OR f8 OR (f7 AND 0.9 + affinity_kitchen_dining + affinity_jewelry_accessories > 1.000001) AS bad FROM {SPOIL})""",
       "feats_tr")
def _(ctx):
    return V.batch_report(_spoiled(ctx))


@query("v12_error_rows", f"""
  SELECT file_row::BIGINT AS file_row, customer_id, n_errors::BIGINT AS n_errors FROM (
    SELECT customer_id, row_number() OVER (ORDER BY customer_id) + 1 AS file_row,
           f1::INT + f2::INT + f3::INT + f5::INT + f6::INT + (f8 OR (f7 AND NOT f8 AND 0.9 + rest > 1.000001))::INT AS n_errors
    FROM (SELECT *, affinity_kitchen_dining + affinity_jewelry_accessories AS rest FROM {{SPOIL}}))
  WHERE n_errors > 0""".replace("{SPOIL}", SPOIL), "feats_tr")
def _(ctx):
    """Lines of a customer file that are rejected, by their number in the file."""
    path = scratch(ctx, "records")
    plain = [f.name for f in _spoiled(ctx).schema if f.dataType.simpleString() in ("string", "double", "bigint", "int")]
    _spoiled(ctx).select(*plain).coalesce(1).sortWithinPartitions("customer_id").write.option("header", True).csv(path)
    read = ctx.spark.read.option("header", True).csv(path)
    rows = materialise(invoices.with_file_rows(read), "numbered-records")
    ids = rows.select(F.col("file_row").alias("_row"), F.col("customer_id").cast("long").alias("customer_id"))
    return V.error_rows(rows).join(ids, F.col("file_row") == F.col("_row")).select("file_row", "customer_id", F.size("errors").cast("long").alias("n_errors"))
