"""Cleaning of invoice lines: flags, outliers, reversals, descriptions, categories."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.config import DEFAULTS, Settings
from patronage.functions.expressions import category_of, tidy_text
from patronage.functions.ordering import exact_quantiles
from patronage.session import materialise

CLEAN_COLUMNS = [
    "invoice", "stock_code", "description", "quantity", "invoice_date", "unit_price", "customer_id", "country",
    "has_customer_id", "is_return", "is_price_adjustment", "is_admin_code", "is_outlier", "is_entry_error",
    "is_bulk_outlier", "category", "line_total", "use_for_customer_model",
]


# ---------------------------------------------------------------- row-wise rules (also used on streams)
def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["invoice_date", "quantity", "unit_price"])


#: What the lines of one order have in common.
ORDER_COLUMNS = ["invoice", "customer_id", "invoice_date"]


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct row (nulls equal). The lines of an order go to one task in one shuffle, and stay side by side: they
    compress well, and later sums per order are mostly made before their shuffle."""
    together = [c for c in ORDER_COLUMNS if c in df.columns]
    return (df.repartition(*together) if together else df).distinct()


def is_return() -> Column:
    return F.coalesce(F.upper("invoice").startswith("C"), F.lit(False)) | F.coalesce(F.col("quantity") < 0, F.lit(False))


def is_price_adjustment() -> Column:
    return F.coalesce(F.col("unit_price") <= 0, F.lit(False))


def is_admin_code(pattern: str) -> Column:
    return F.coalesce(F.col("stock_code").rlike("(?i)" + pattern), F.lit(False))


def flag_rows(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Flags that need only the row itself."""
    return df.withColumns({
        "has_customer_id": F.col("customer_id").isNotNull(),
        "is_return": is_return(),
        "is_price_adjustment": is_price_adjustment(),
        "is_admin_code": is_admin_code(settings.admin_code_pattern),
    })


# ---------------------------------------------------------------- outliers
@dataclass(frozen=True)
class Fences:
    """Upper fences as columns: scalar subqueries in a batch plan, or saved numbers on a stream."""
    quantity: Column
    price: Column

    @staticmethod
    def of(fences: DataFrame) -> "Fences":
        return Fences(fences.select("q_hi").scalar(), fences.select("p_hi").scalar())

    @staticmethod
    def saved(q_hi: float, p_hi: float) -> "Fences":
        return Fences(F.lit(float(q_hi)), F.lit(float(p_hi)))


def tukey_fences(df: DataFrame, k: float) -> DataFrame:
    """One row (q_lo, q_hi, p_lo, p_hi): fences of abs(quantity) and unit_price over rows with a real price.

    ``df`` is the table without exact duplicates. Both columns go through one exact quantile pass.
    """
    long = df.where(F.col("unit_price") > 0).select(F.explode(F.array(
        F.struct(F.lit("q").alias("metric"), F.abs("quantity").cast("double").alias("value")),
        F.struct(F.lit("p").alias("metric"), F.col("unit_price").cast("double").alias("value")))).alias("s")).select("s.*")
    q = exact_quantiles(long, "value", {"q1": 0.25, "q3": 0.75}, by=["metric"])
    spread = (F.col("q3") - F.col("q1")) * F.lit(float(k))
    edges = {"lo": F.col("q1") - spread, "hi": F.col("q3") + spread}
    return q.agg(*[F.max(F.when(F.col("metric") == m, edge)).alias(f"{m}_{side}")
                   for m in ("q", "p") for side, edge in edges.items()])


def quantity_outlier(fences: Fences) -> Column:
    return ~is_price_adjustment() & (F.abs("quantity") > fences.quantity)


def price_outlier(fences: Fences) -> Column:
    return ~is_price_adjustment() & (F.col("unit_price") > fences.price)


def reversed_keys(df: DataFrame, fences: Fences) -> DataFrame:
    """(customer, SKU, abs quantity) groups of quantity outliers that hold both signs."""
    candidates = df.where(quantity_outlier(fences) & F.col("customer_id").isNotNull())
    return (candidates.groupBy("customer_id", "stock_code", F.abs("quantity").alias("abs_quantity"))
            .agg(F.min(F.signum("quantity")).alias("lowest"), F.max(F.signum("quantity")).alias("highest"))
            .where((F.col("lowest") < 0) & (F.col("highest") > 0))
            .select("customer_id", "stock_code", "abs_quantity"))


def flag_outliers(df: DataFrame, fences: Fences, settings: Settings = DEFAULTS) -> DataFrame:
    """Outlier, entry-error and bulk flags.

    Only quantity outliers can be reversed entries. Those few rows take the branch with the key
    lookup; all other rows pass by it, so the full table is not shuffled for the lookup. The two
    branches are disjoint and together hold every row once.
    """
    outlier = F.coalesce(quantity_outlier(fences), F.lit(False))
    known = F.col("customer_id").isNotNull()
    huge = outlier & (F.abs("quantity") >= settings.entry_error_abs_quantity)
    keys = materialise(reversed_keys(df, fences), "reversed-keys").select(
        F.col("customer_id").alias("_k1"), F.col("stock_code").alias("_k2"), F.col("abs_quantity").alias("_k3"),
        F.lit(True).alias("_paired"))
    candidates = df.where(outlier & known)
    checked = (candidates.join(keys, (F.col("customer_id") == F.col("_k1")) & (F.col("stock_code") == F.col("_k2"))
                               & (F.abs("quantity") == F.col("_k3")), "left")
               .select(*df.columns, F.coalesce("_paired", F.lit(False)).alias("_paired")))
    others = df.where(~(outlier & known)).withColumn("_paired", F.lit(False))
    return (checked.unionByName(others)
            .withColumn("is_outlier", outlier | F.coalesce(price_outlier(fences), F.lit(False)))
            .withColumn("is_entry_error", F.col("_paired") | huge)
            .withColumn("is_bulk_outlier", F.col("is_outlier") & ~F.col("is_entry_error"))
            .drop("_paired"))


# ---------------------------------------------------------------- descriptions and categories
def voted_text(typos: dict[str, str]) -> Column:
    text = tidy_text(F.col("description"))
    if not typos:
        return text
    pairs = [F.lit(x) for wrong, right in typos.items() for x in (wrong.upper(), right.upper())]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), text)


def description_lookup(df: DataFrame, typos: dict[str, str] | None = None) -> DataFrame:
    """SKU -> most frequent description; alphabetical on ties. Two partial aggregations, no window over a SKU."""
    votes = (df.select("stock_code", voted_text(typos or {}).alias("text"))
             .where(F.col("stock_code").isNotNull() & F.col("text").isNotNull())
             .groupBy("stock_code", "text").agg(F.count(F.lit(1)).alias("n")))
    return votes.groupBy("stock_code").agg(
        F.min_by("text", F.struct(-F.col("n"), F.col("text"))).alias("std_description"))


def product_table(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """SKU, canonical description, category: the patterns run once per SKU, not once per line."""
    return description_lookup(df, settings.description_typos).withColumn(
        "category", category_of(F.col("std_description"), settings.category_words))


def with_products(df: DataFrame, products: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Replace descriptions by the canonical one and add the category. Spark picks the join by size."""
    dim = products.select(F.col("stock_code").alias("_sku"), "std_description", F.col("category").alias("_category"))
    own = tidy_text(F.col("description"))
    return (df.join(dim, F.col("stock_code") == F.col("_sku"), "left")
            .withColumn("description", F.coalesce("std_description", own))
            .withColumn("category", F.coalesce("_category", category_of(F.col("description"), settings.category_words)))
            .drop("_sku", "std_description", "_category"))


def derived_amounts(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "line_total": F.col("quantity") * F.col("unit_price"),
        "use_for_customer_model": F.col("has_customer_id") & ~F.col("is_price_adjustment") & ~F.col("is_entry_error"),
    })


# ---------------------------------------------------------------- the chain
def clean_distinct(distinct: DataFrame, settings: Settings = DEFAULTS, fences: Fences | None = None,
                   products: DataFrame | None = None) -> DataFrame:
    """Everything after duplicate removal. ``fences`` and ``products`` may come from saved tables."""
    fences = fences or fitted_fences(distinct, settings)
    if products is None:  # written first: its size is known when the join with all lines is planned
        products = materialise(product_table(distinct, settings), "products")
    flagged = flag_outliers(flag_rows(distinct, settings), fences, settings)
    return derived_amounts(with_products(flagged, products, settings)).select(*CLEAN_COLUMNS)


def fitted_fences(distinct: DataFrame, settings: Settings = DEFAULTS) -> Fences:
    """Fences as numbers: one row reaches the driver."""
    row = tukey_fences(distinct, settings.iqr_multiplier).first()
    return Fences.saved(row["q_hi"], row["p_hi"])


def clean_transactions(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Full cleaning chain on standardised lines.

    The table without duplicates has four readers (fences, product votes, reversal keys, the chain
    itself), so it is written once instead of being shuffled four times.
    """
    distinct = materialise(drop_exact_duplicates(drop_incomplete(raw)), "distinct-lines", compact=True)
    return clean_distinct(distinct, settings)


def cleaning_counts(clean: DataFrame) -> DataFrame:
    """Counts of the cleaning report in one pass; one row."""
    count_if = lambda c: F.count_if(c).cast("long")
    return clean.agg(
        F.count(F.lit(1)).alias("rows_out"),
        count_if(~F.col("has_customer_id")).alias("rows_missing_customer_id"),
        count_if(F.col("is_return")).alias("return_lines"),
        count_if(F.col("is_price_adjustment")).alias("price_adjustment_lines"),
        count_if(F.col("is_admin_code")).alias("admin_code_lines"),
        count_if(F.col("is_outlier")).alias("n_outliers"),
        count_if(F.col("is_entry_error")).alias("n_entry_errors"),
        count_if(F.col("is_bulk_outlier")).alias("n_bulk_outliers"),
        count_if(F.col("use_for_customer_model")).alias("rows_used_for_customer_model"),
        F.count_distinct("customer_id").alias("unique_customers"))


def duplicate_counts(raw: DataFrame) -> DataFrame:
    """(rows_in, rows_complete, exact_duplicates_removed) from one shuffle of folded copies."""
    complete = (F.col("invoice_date").isNotNull() & F.col("quantity").isNotNull() & F.col("unit_price").isNotNull())
    copies = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_complete", complete)
    return copies.agg(
        F.sum("_copies").alias("rows_in"),
        F.sum(F.when(F.col("_complete"), F.col("_copies")).otherwise(0)).alias("rows_complete"),
        F.sum(F.when(F.col("_complete"), F.col("_copies") - 1).otherwise(0)).alias("exact_duplicates_removed"))
