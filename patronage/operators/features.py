"""Point-in-time customer features and horizon labels.

All keys carry ``cutoff``, so one pass serves several cutoffs. Lines are shuffled once by
customer; where a customer has too many lines for one task, by (cutoff, customer, invoice) with
partial sums before the shuffle, then by day and by customer. Orders are folded to days and days to
customers, so no window ever holds more of one customer than one day of orders or one row per day,
however many orders the customer has.
"""
from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.config import DEFAULTS, Settings
from patronage.functions.expressions import days_between, micros_between, whole_days_between
from patronage.functions.ordering import exact_quantiles, largest_group
from patronage.session import materialise

KEY = ["cutoff", "customer_id"]
#: Lines of one customer that one task may take.
CUSTOMER_LINES = 500_000


def cutoffs(lines: DataFrame, settings: Settings = DEFAULTS) -> tuple[datetime, datetime]:
    """(training cutoff, scoring cutoff): the day after the last line, and that less the churn horizon."""
    last = lines.agg(F.max("invoice_date").alias("last")).first()["last"]
    scoring = datetime(last.year, last.month, last.day) + timedelta(days=1)
    return scoring - timedelta(days=settings.churn_horizon_days), scoring


def _stamp(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _month_bound(df: DataFrame, moment: datetime, upper: bool) -> Column:
    """Predicate on the partition column that the date predicate implies, so that folders are pruned."""
    if "invoice_month" not in df.columns:
        return F.lit(True)
    month = F.lit(moment.strftime("%Y-%m-01")).cast("date")
    return F.col("invoice_month") <= month if upper else F.col("invoice_month") >= month


def point_in_time(tx: DataFrame, moments: Sequence[datetime]) -> DataFrame:
    """Customer-model lines strictly before each cutoff, once per cutoff they belong to."""
    latest = max(moments)
    usable = tx.where(F.col("use_for_customer_model") & (F.col("invoice_date") < _stamp(latest))
                      & _month_bound(tx, latest, True))
    if len(moments) == 1:
        return usable.withColumn("cutoff", _stamp(latest))
    each = F.filter(F.array(*[_stamp(m) for m in sorted(moments)]), lambda c: F.col("invoice_date") < c)
    return usable.withColumn("cutoff", F.explode(each))


def horizon_lines(tx: DataFrame, moments: Sequence[datetime], days: int) -> DataFrame:
    """Non-return customer-model lines in [cutoff, cutoff + days), once per cutoff they belong to."""
    first, last = min(moments), max(moments) + timedelta(days=days)
    usable = tx.where(F.col("use_for_customer_model") & ~F.col("is_return")
                      & (F.col("invoice_date") >= _stamp(first)) & (F.col("invoice_date") < _stamp(last))
                      & _month_bound(tx, first, False) & _month_bound(tx, last, True))
    each = F.filter(
        F.array(*[F.struct(_stamp(m).alias("from"), _stamp(m + timedelta(days=days)).alias("to"))
                  for m in sorted(moments)]),
        lambda c: (F.col("invoice_date") >= c["from"]) & (F.col("invoice_date") < c["to"]))
    return usable.withColumn("_w", F.explode(each)).withColumn("cutoff", F.col("_w.from")).drop("_w")


def product_sales(sub: DataFrame) -> DataFrame:
    return sub.where(~F.col("is_return") & ~F.col("is_admin_code"))


# ---------------------------------------------------------------- product side
def median_prices(sub: DataFrame) -> DataFrame:
    """(cutoff, stock_code, median_price) of product sales. A SKU with very many prices stays spread."""
    return exact_quantiles(product_sales(sub).select("cutoff", "stock_code", "unit_price"), "unit_price",
                           {"median_price": 0.5}, by=["cutoff", "stock_code"])


def customer_products(sub: DataFrame) -> DataFrame:
    """Distinct (cutoff, customer, SKU) of product sales."""
    return product_sales(sub).select(*KEY, "stock_code").distinct()


def written_pairs(sub: DataFrame) -> DataFrame:
    """``customer_products`` as a table, for the map and the averages to read."""
    return materialise(customer_products(sub), "customer-products", compact=True)


def product_popularity(pairs: DataFrame) -> DataFrame:
    """(cutoff, stock_code, popularity): share of buyers who bought the SKU."""
    buyers = pairs.groupBy("cutoff").agg(F.count_distinct("customer_id").alias("_buyers"))
    per_sku = pairs.groupBy("cutoff", "stock_code").agg(F.count(F.lit(1)).alias("_n"))
    return per_sku.join(buyers, "cutoff").select(
        "cutoff", "stock_code", (F.col("_n") / F.greatest(F.col("_buyers"), F.lit(1))).alias("popularity"))


def average_popularity(pairs: DataFrame, popularity: DataFrame, shared: bool = False) -> DataFrame:
    """(cutoff, customer, avg_product_popularity); a SKU missing from the map counts 0.

    ``shared``: the map was fitted elsewhere (training) and holds for every cutoff.
    """
    dim = popularity.select(F.col("stock_code").alias("_sku"), "popularity",
                            *([] if shared else [F.col("cutoff").alias("_cut")]))
    cond = F.col("stock_code") == F.col("_sku")
    if not shared:
        cond = cond & (F.col("cutoff") == F.col("_cut"))
    return (pairs.join(dim, cond, "left").groupBy(*KEY)
            .agg(F.avg(F.coalesce("popularity", F.lit(0.0))).alias("avg_product_popularity")))


# ---------------------------------------------------------------- orders, days, customers
# Aggregation buffers hold numbers and time stamps only, so that all levels are hash aggregations.
# The country travels as its place in the alphabet and gets its name back at the end: the country of an
# order is the last by name of its sale lines, that of a customer is the one of the latest order (by
# date, then invoice) that has one.
def country_names(sub: DataFrame) -> DataFrame:
    """(_country_name, _code): distinct countries, numbered by name. As many rows as there are countries."""
    names = sub.where(F.col("country").isNotNull()).select(F.col("country").alias("_country_name")).distinct()
    return names.withColumn("_code", F.row_number().over(Window.orderBy("_country_name")))


def with_country_code(sub: DataFrame, names: DataFrame) -> DataFrame:
    return sub.join(names, F.col("country") == F.col("_country_name"), "left").withColumnRenamed("_code", "country_code").drop("_country_name")


def discounted_spend(sub: DataFrame, medians: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Lines plus ``disc_spend``: amount of product lines priced below (1 - threshold) times the SKU median."""
    dim = medians.select(F.col("cutoff").alias("_cut"), F.col("stock_code").alias("_sku"), "median_price")
    product = ~F.col("is_return") & ~F.col("is_admin_code")
    cheap = F.col("unit_price") < F.lit(1 - settings.discount_threshold) * F.col("median_price")
    return (sub.join(dim, (F.col("cutoff") == F.col("_cut")) & (F.col("stock_code") == F.col("_sku")), "left")
            .withColumn("disc_spend", F.when(product & F.coalesce(cheap, F.lit(False)), F.col("line_total")).otherwise(0.0))
            .drop("_cut", "_sku", "median_price"))


def customers_fit(sub: DataFrame) -> bool:
    """No customer has more than CUSTOMER_LINES lines, so that one task can take all lines of a customer."""
    return largest_group(sub, "customer_id") <= CUSTOMER_LINES


def orders(sub: DataFrame, settings: Settings = DEFAULTS, together: bool = False) -> DataFrame:
    """One row per (cutoff, customer, invoice). ``order_date`` is null for invoices without a sale.

    ``together`` (where ``customers_fit``): the lines of a customer go to one task, and orders, days and customers are
    folded there after this one shuffle. Otherwise each of the three levels has its own.
    """
    if together:
        sub = sub.repartition("customer_id")
    sale = ~F.col("is_return")
    product = sale & ~F.col("is_admin_code")
    amount = F.col("line_total")
    spend = [F.sum(F.when(product & (F.col("category") == c), amount)).alias(f"_spend_{c}") for c in settings.categories]
    disc = F.sum("disc_spend") if "disc_spend" in sub.columns else F.sum(F.lit(0.0))
    return sub.groupBy(*KEY, "invoice").agg(
        F.max(F.when(sale, F.col("invoice_date"))).alias("order_date"),
        F.max("invoice_date").alias("_last_line"),
        F.sum(F.when(sale, amount)).alias("order_value"),
        F.sum(F.when(sale, F.col("quantity"))).alias("units"),
        (F.max(F.when(sale, F.col("country_code"))) if "country_code" in sub.columns else F.lit(None).cast("int")).alias("country_code"),
        F.sum(amount).alias("_net"),
        F.count(F.lit(1)).alias("_lines"),
        F.count_if(F.col("is_return")).alias("_returns"),
        F.sum(F.when(product, amount)).alias("_product_spend"),
        disc.alias("_disc_spend"), *spend)


def _sums(settings: Settings) -> list[str]:
    return ["_net", "_lines", "_returns", "_product_spend", "_disc_spend"] + [f"_spend_{c}" for c in settings.categories]


def order_days(order_rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per (cutoff, customer, calendar day) with what the customer level needs.

    ``_gap_squares`` holds the squared gaps between orders of the same day; the gaps between days
    are added when days are folded.
    """
    is_order = F.col("order_date").isNotNull()
    age_bin = F.least(F.greatest(
        F.floor(whole_days_between(F.col("order_date"), F.col("cutoff")) / settings.trend_bin_days), F.lit(0)),
        F.lit(settings.trend_window_bins - 1)).cast("long")
    day = F.to_date(F.coalesce("order_date", "_last_line"))
    within = Window.partitionBy(*KEY, "_day").orderBy(F.col("order_date").asc_nulls_last(), "invoice")
    gap = days_between(F.lag("order_date").over(within), F.col("order_date"))
    whole_day = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = order_rows.withColumn("_day", day).withColumns({
        "_gap": gap, "_bin": F.when(is_order, age_bin), "_day_country": F.last("country_code", ignorenulls=True).over(whole_day)})
    return rows.groupBy(*KEY, "_day").agg(
        F.min("order_date").alias("_first"), F.max("order_date").alias("_last"),
        F.count_if(is_order).alias("_orders"),
        F.sum("order_value").alias("_value"), F.sum("units").alias("_units"),
        F.max("_day_country").alias("country_code"),
        F.sum(F.lit(settings.trend_window_bins - 1) - F.col("_bin")).alias("_age_sum"), F.max("_bin").alias("_oldest"),
        F.sum(F.col("_gap") * F.col("_gap")).alias("_gap_squares"),
        *[F.sum(c).alias(c) for c in _sums(settings)])


def customers(days: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Fold days to customers with at least one sale order. Popularity and engagement come later."""
    before = Window.partitionBy(*KEY).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    gap = days_between(F.last("_last", ignorenulls=True).over(before), F.col("_first"))
    n_month = lambda m: F.sum(F.when(F.month("_day") == m, F.col("_orders")).otherwise(0))
    folded = days.withColumn("_gap", gap).groupBy(*KEY).agg(
        F.min("_first").alias("first_purchase"), F.max("_last").alias("last_purchase"),
        F.sum("_orders").alias("_freq"), F.sum("_value").alias("_value"), F.sum("_units").alias("_units"),
        F.max_by("country_code", F.when(F.col("country_code").isNotNull(), F.col("_last"))).alias("country_code"), F.sum("_age_sum").alias("_age_sum"), F.max("_oldest").alias("_oldest"),
        (F.coalesce(F.sum("_gap_squares"), F.lit(0.0))
         + F.coalesce(F.sum(F.col("_gap") * F.col("_gap")), F.lit(0.0))).alias("_gap_squares"),
        *[n_month(m).alias(f"_m{m}") for m in range(1, 13)],
        *[F.sum(c).alias(c) for c in _sums(settings)]).where(F.col("_freq") > 0)
    freq = F.col("_freq").cast("double")
    spend = F.greatest(F.col("_value"), F.lit(0.0))
    bins = F.col("_oldest") + 1
    half = (settings.trend_window_bins - 1) - F.col("_oldest") / F.lit(2.0)
    slope = (F.col("_age_sum") - half * freq) / (bins * (bins * bins - 1) / F.lit(12.0))
    gaps = F.col("_freq") - 1
    mean_gap = days_between(F.col("first_purchase"), F.col("last_purchase")) / gaps
    squares = sum((F.col(f"_m{m}") * F.col(f"_m{m}") for m in range(1, 13)), F.lit(0))
    share = lambda c: F.when(F.col("_product_spend") > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col("_product_spend")
                             ).otherwise(F.lit(0.0))
    return folded.select(
        *KEY, "country_code", "first_purchase", "last_purchase",
        whole_days_between(F.col("last_purchase"), F.col("cutoff")).cast("double").alias("recency_days"),
        freq.alias("frequency"), spend.alias("total_spend"), (spend / freq).alias("avg_spend"),
        F.greatest(F.col("_net"), F.lit(0.0)).alias("historical_clv"),
        (F.col("_units") / freq).alias("avg_basket_size"),
        F.when(F.col("_oldest") > 0, slope).otherwise(F.lit(0.0)).alias("freq_trend"),
        F.when(gaps > 0, F.greatest(F.col("_gap_squares") / gaps - mean_gap * mean_gap, F.lit(0.0))
               ).otherwise(F.lit(0.0)).alias("gap_variance"),
        (squares / (freq * freq)).alias("seasonal_concentration"),
        (F.col("_returns") / F.col("_lines")).alias("return_rate"),
        F.least(F.greatest(share("_disc_spend"), F.lit(0.0)), F.lit(1.0)).alias("discount_sensitivity"),
        *[share(f"_spend_{c}").alias(f"affinity_{c}") for c in settings.categories])


def with_country(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Country names for the codes."""
    return (rows.join(names, F.col("country_code") == F.col("_code"), "left")
            .withColumn("country", F.coalesce("_country_name", F.lit("nan"))).drop("country_code", "_country_name", "_code"))


def customer_base(tx: DataFrame, moments: Sequence[datetime], settings: Settings = DEFAULTS,
                  sub: DataFrame | None = None) -> DataFrame:
    """All features but popularity and engagement.

    SKU medians and country names are written first: with the size of these tables known, Spark
    sends them to all tasks while they are small, and joins by shuffle when they are not.
    """
    sub = point_in_time(tx, moments) if sub is None else sub
    names = materialise(country_names(sub), "countries")
    lines = discounted_spend(with_country_code(sub, names), materialise(median_prices(sub), "median-prices"), settings)
    return with_country(customers(order_days(orders(lines, settings, customers_fit(sub)), settings), settings), names)


def customer_features(tx: DataFrame, moments: Sequence[datetime], settings: Settings = DEFAULTS,
                      popularity: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Feature snapshot, one row per (cutoff, customer). ``engagement_score`` stays null until encoding.

    ``popularity``: map fitted on the training snapshot; by default each cutoff fits its own. ``pairs``: written
    ``customer_products`` of the same moments, where there are some.
    """
    sub = point_in_time(tx, moments)
    base = customer_base(tx, moments, settings, sub)
    own = popularity is None
    if pairs is None:
        pairs = written_pairs(sub) if own else customer_products(sub)
    if own:
        popularity = materialise(product_popularity(pairs), "popularity")
    pop = average_popularity(pairs, popularity, shared=not own)
    out = base.join(pop, KEY, "left").withColumn(
        "avg_product_popularity", F.coalesce("avg_product_popularity", F.lit(0.0))
    ).withColumn("engagement_score", F.lit(None).cast("double"))
    return out.select(*KEY, "country", "first_purchase", "last_purchase", *settings.feature_columns)


# ---------------------------------------------------------------- labels
def labels(tx: DataFrame, moments: Sequence[datetime], settings: Settings = DEFAULTS) -> DataFrame:
    """(cutoff, customer_id, bought, clv_target, next_category) of customers who buy in a horizon.

    One aggregation with partial sums: category spends are conditional sums, the largest (then
    alphabetically first) is picked from them.
    """
    longest = max(settings.churn_horizon_days, settings.clv_horizon_days)
    win = horizon_lines(tx, moments, longest)
    age = micros_between(F.col("cutoff"), F.col("invoice_date"))
    in_churn = age < F.lit(settings.churn_horizon_days * 86400 * 10**6)
    in_clv = age < F.lit(settings.clv_horizon_days * 86400 * 10**6)
    cats = sorted([*settings.categories, "other"])
    amount = F.col("line_total")
    sums = [F.sum(F.when(in_churn & ~F.col("is_admin_code") & (F.col("category") == c), amount)).alias(f"_c_{c}")
            for c in cats]
    folded = win.groupBy(*KEY).agg(
        F.max(in_churn.cast("int")).alias("bought"), F.sum(F.when(in_clv, amount)).alias("clv_target"), *sums)
    best = F.array_max(F.array_compact(F.array(*[
        F.when(F.col(f"_c_{c}").isNotNull(),
               F.struct(F.col(f"_c_{c}").alias("spend"), F.lit(-i).alias("order"), F.lit(c).alias("category")))
        for i, c in enumerate(cats)])))
    return folded.select(*KEY, "bought", F.coalesce("clv_target", F.lit(0.0)).alias("clv_target"),
                         best["category"].alias("next_category"))


def with_labels(features: DataFrame, tx: DataFrame, moments: Sequence[datetime], settings: Settings = DEFAULTS) -> DataFrame:
    """Left join of features and labels: no purchase in the horizon means churn 1, target 0, no category."""
    return (features.join(labels(tx, moments, settings), KEY, "left")
            .withColumn("churn", F.when(F.col("bought") == 1, 0).otherwise(1))
            .withColumn("clv_target", F.coalesce("clv_target", F.lit(0.0)))
            .drop("bought"))


def train_and_scoring(tx: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training snapshot with labels, scoring snapshot, popularity map of the training snapshot)."""
    train_at, score_at = cutoffs(tx, settings)
    pairs = written_pairs(point_in_time(tx, [train_at]))
    popularity = materialise(product_popularity(pairs), "popularity")
    train = with_labels(customer_features(tx, [train_at], settings, popularity=popularity, pairs=pairs), tx, [train_at], settings)
    scoring = customer_features(tx, [score_at], settings, popularity=popularity)
    return train, scoring, popularity


__all__ = [
    "KEY", "cutoffs", "point_in_time", "horizon_lines", "median_prices", "customer_products", "written_pairs", "product_popularity",
    "average_popularity", "discounted_spend", "customers_fit", "orders", "order_days", "customers", "country_names", "with_country_code", "with_country",
    "customer_base", "customer_features", "labels",
    "with_labels", "train_and_scoring",
]
