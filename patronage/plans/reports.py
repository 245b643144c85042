"""Reporting and serving queries over the published tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEADERBOARD_COLUMNS = ["customer_id", "country", "segment_label", "risk_tier", "churn_probability", "historical_clv",
                       "at_risk_value", "recency_days", "recommended_categories"]


# ---------------------------------------------------------------- scored customers
def scored_view(customers: DataFrame, predictions: DataFrame, segments: DataFrame) -> DataFrame:
    return customers.join(predictions, "customer_id").join(segments, "customer_id")


def filtered(view: DataFrame, segments: Sequence[str] = (), countries: Sequence[str] = (), tiers: Sequence[str] = ()) -> DataFrame:
    """Optional multi-value filters; an empty list does not filter."""
    out = view
    for column, wanted in (("segment_label", segments), ("country", countries), ("value_tier", tiers)):
        if wanted:
            out = out.where(F.col(column).isin(list(wanted)))
    return out


def key_figures(view: DataFrame) -> DataFrame:
    high = F.col("risk_tier") == "High"
    return view.agg(F.count(F.lit(1)).alias("customers"), F.count_if(high).alias("high_risk"),
                    F.coalesce(F.sum(F.when(high, F.col("at_risk_value"))), F.lit(0.0)).alias("revenue_at_risk"),
                    F.count_if("is_anomaly").alias("anomalies"))


def segment_summary(view: DataFrame) -> DataFrame:
    mean = lambda c, a: F.avg(c).alias(a)
    return view.groupBy("segment_label").agg(
        F.count("customer_id").alias("customers"), mean("recency_days", "avg_recency_days"), mean("frequency", "avg_orders"),
        mean("historical_clv", "avg_net_revenue"), mean("churn_probability", "avg_churn_risk"))


def leaderboard(view: DataFrame, n: int = 50) -> DataFrame:
    return (view.orderBy(F.col("at_risk_value").desc(), "customer_id").limit(n)
            .select(*[c for c in LEADERBOARD_COLUMNS if c in view.columns]))


# ---------------------------------------------------------------- revenue over time
def monthly_revenue(lines: DataFrame, *series: str) -> DataFrame:
    """(series.., month, revenue, last_date) for months that have rows."""
    month = F.date_trunc("month", F.col("invoice_date")).cast("timestamp_ntz").alias("month")
    return lines.groupBy(*series, month).agg(F.sum("line_total").alias("revenue"), F.max("invoice_date").alias("last_date"))


def fill_months(monthly: DataFrame, *series: str) -> DataFrame:
    """Months without rows between the first and the last month of a series appear with 0."""
    span = monthly.groupBy(*series).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    every = span.select(*series, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return (every.join(monthly, [*series, "month"], "left")
            .select(*series, "month", F.coalesce("revenue", F.lit(0.0)).alias("revenue")))


def drop_partial_last_month(monthly: DataFrame, *series: str) -> DataFrame:
    """Drop the last month of a series when its data stop more than two days before the month ends."""
    by = Window.partitionBy(*series) if series else Window.partitionBy(F.lit(1))  # one row per month: bounded
    is_last = F.col("month") == F.max("month").over(by)
    partial = F.to_date("last_date") < F.date_sub(F.last_day("month"), 2)
    return monthly.withColumn("_drop", is_last & partial).where(~F.col("_drop")).drop("_drop")


def forecast(monthly: DataFrame, horizon: int = 3, *series: str) -> DataFrame:
    """(series.., month, revenue, method) for the next months of every series at once.

    From 24 months on: the same month last year times the growth of the last twelve months over
    the twelve before. Else a least-squares line, not below 0.
    """
    keys = list(series)
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # one row per month: bounded
    rows = (monthly.withColumn("_x", F.row_number().over(by.orderBy("month")) - 1)
            .withColumn("_back", F.row_number().over(by.orderBy(F.col("month").desc()))))
    last12 = F.array(*[F.max(F.when(F.col("_back") == 12 - i, F.col("revenue"))) for i in range(12)])
    folded = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max("month").alias("_last"), last12.alias("_year"),
        F.sum(F.when(F.col("_back") <= 12, F.col("revenue"))).alias("_now"),
        F.sum(F.when(F.col("_back").between(13, 24), F.col("revenue"))).alias("_then"),
        F.regr_slope(F.col("revenue"), F.col("_x").cast("double")).alias("_slope"),
        F.regr_intercept(F.col("revenue"), F.col("_x").cast("double")).alias("_intercept"),
        F.max(F.when(F.col("_back") == 1, F.col("revenue"))).alias("_latest"))
    ahead = folded.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    seasonal = F.col("_n") >= 24
    growth = F.col("_now") / F.greatest(F.col("_then"), F.lit(1e-9))
    one = F.col("_n") == 1
    slope = F.when(one, F.lit(0.0)).otherwise(F.col("_slope"))
    base = F.when(one, F.col("_latest")).otherwise(F.col("_intercept"))
    value = F.when(seasonal, F.element_at("_year", F.col("_i") % 12 + 1) * growth).otherwise(
        F.greatest(slope * (F.col("_n") + F.col("_i")) + base, F.lit(0.0)))
    return ahead.select(
        *keys, F.add_months(F.col("_last").cast("date"), F.col("_i") + 1).cast("timestamp_ntz").alias("month"), value.alias("revenue"),
        F.when(seasonal, "seasonal-naive x YoY growth").otherwise("linear trend").alias("method"))


# ---------------------------------------------------------------- exploration
FLAGS = ["has_customer_id", "is_return", "is_price_adjustment", "is_admin_code", "is_entry_error", "is_bulk_outlier"]


def flag_rates(lines: DataFrame) -> DataFrame:
    """One row: percent of lines per flag."""
    return lines.agg(*[(100 * F.avg(F.col(f).cast("double"))).alias(f) for f in FLAGS])


def sales_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("use_for_customer_model") & ~F.col("is_return"))


def orders_by_calendar_month(lines: DataFrame) -> DataFrame:
    """(month, orders): distinct invoices per calendar month, all years together."""
    pairs = sales_lines(lines).select(F.month("invoice_date").alias("month"), "invoice").distinct()
    return pairs.groupBy("month").agg(F.count(F.lit(1)).alias("orders"))


def revenue_by(lines: DataFrame, column: str, n: int | None = None) -> DataFrame:
    out = sales_lines(lines).groupBy(column).agg(F.sum("line_total").alias("revenue"))
    return out if n is None else out.orderBy(F.col("revenue").desc(), column).limit(n)


def mean_category_shares(snapshot: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(category, mean_share)."""
    row = snapshot.agg(*[F.avg(c).alias(c) for c in columns])
    items = F.array(*[F.struct(F.lit(c.removeprefix("affinity_")).alias("category"), F.col(c).alias("mean_share")) for c in columns])
    return row.select(F.explode(items).alias("s")).select("s.*")


def differing_rows(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Rows in only one of two snapshots (doubles compared at some digits), as often as they are there more often: empty when
    they agree. One sum over both, so each snapshot is computed once."""
    shape = lambda d: d.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])
    both = shape(a).withColumn("_surplus", F.lit(1)).unionByName(shape(b).withColumn("_surplus", F.lit(-1)))
    left = both.groupBy(*a.columns).agg(F.sum("_surplus").alias("_surplus")).where("_surplus <> 0")
    side = F.when(F.col("_surplus") > 0, "first").otherwise("second")
    return left.select(*a.columns, F.explode(F.array_repeat(side, F.abs("_surplus").cast("int"))).alias("side"))
