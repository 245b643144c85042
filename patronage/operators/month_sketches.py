"""Fences, null rates and counts from one small row a month, so that a report reads only the months that are new.

Each month keeps exact counts and sums, a KLL quantile sketch of the quantities and prices that the fences are made
of, and a HyperLogLog sketch of its customers. Sketches of months merge to those of all lines. The exact forms
(``tukey_fences``, ``transaction_profile``, ``cleaning_counts``) stay the default; these are for tables where even one
pass over all months is too much.

Error bounds: the rank of a quantile is off by at most RANK_ERROR of the rows (KLL with K = 1024, 99 % confidence),
the number of customers by about DISTINCT_ERROR (one standard deviation at 2^14 registers). Counts are exact.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.config import DEFAULTS, Settings

K, REGISTERS = 1024, 14
RANK_ERROR, DISTINCT_ERROR = 0.003, 0.0082
FLAGS = ["is_return", "is_price_adjustment", "is_admin_code"]


def month_of(date: Column) -> Column:
    return F.date_trunc("month", date).cast("date")


def sketched(lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row a month (null: lines without a date): rows, nulls, sums and sketches. One aggregation, folded before its shuffle.

    Flags that the lines don't carry count null; without any priced line there are no fences.
    """
    priced = F.col("unit_price") > 0
    nulls = [F.sum(F.col(c).isNull().cast("long")).alias(f"nulls_{c}") for c in settings.max_null_rate]
    flags = [(F.count_if(F.col(c)) if c in lines.columns else F.lit(None)).cast("long").alias(f"n_{c}") for c in FLAGS]
    return lines.groupBy(month_of(F.col("invoice_date")).alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), *nulls, *flags, F.min("invoice_date").alias("date_min"), F.max("invoice_date").alias("date_max"),
        F.count_if(F.coalesce(F.col("unit_price") <= 0, F.lit(False))).alias("nonpositive_prices"),
        F.count_if(F.coalesce(priced, F.lit(False))).alias("n_priced"),
        F.kll_sketch_agg_double(F.when(priced, F.abs("quantity").cast("double")), F.lit(K)).alias("quantities"),
        F.kll_sketch_agg_double(F.when(priced, F.col("unit_price").cast("double")), F.lit(K)).alias("prices"),
        F.hll_sketch_agg("customer_id", F.lit(REGISTERS)).alias("customers"))


def refresh(lines: DataFrame, path: str, settings: Settings = DEFAULTS) -> list[str]:
    """Bring the stored sketches up to date; returns the months that were read.

    Months that are not stored are read, and the last stored one, which may have grown. ``lines`` is partitioned by
    ``invoice_month``, so nothing else is scanned. Each month is a folder that is replaced as a whole.
    """
    spark = lines.sparkSession
    there = [str(r["invoice_month"]) for r in lines.select("invoice_month").where("invoice_month IS NOT NULL").distinct().collect()]  # months
    stored = stored_months(spark, path)
    open_months = sorted(m for m in there if m not in stored or m == max(stored))
    for month in open_months:
        one = sketched(lines.where(F.col("invoice_month") == F.lit(month).cast("date")), settings)
        one.write.mode("overwrite").parquet(f"{path}/stored_month={month}")
    return open_months


def stored_months(spark: SparkSession, path: str) -> set[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return set()
    done = [s.getPath() for s in fs.listStatus(folder)]
    inside = spark._jvm.org.apache.hadoop.fs.Path
    return {p.getName().split("=")[1] for p in done if p.getName().startswith("stored_month=") and fs.exists(inside(p, "_SUCCESS"))}


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("stored_month")


def fences(sketches: DataFrame, k: float) -> DataFrame:
    """One row (q_lo, q_hi, p_lo, p_hi), as tukey_fences() up to the rank error."""
    merged = sketches.agg(F.kll_merge_agg_double("quantities").alias("q"), F.kll_merge_agg_double("prices").alias("p"), F.sum("n_priced").alias("n"))
    at = lambda c, share: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(c, F.lit(share)))
    edges = []
    for m in ("q", "p"):
        q1, q3 = at(m, 0.25), at(m, 0.75)
        edges += [(q1 - (q3 - q1) * k).alias(f"{m}_lo"), (q3 + (q3 - q1) * k).alias(f"{m}_hi")]
    return merged.select(*edges)


def profile(sketches: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row, as transaction_profile(), exact; and the cleaning report's counts, ``unique_customers`` approximate."""
    rows = F.sum("rows")
    return sketches.agg(
        rows.alias("rows"), *[(F.sum(f"nulls_{c}") / rows).alias(f"null_rate_{c}") for c in settings.max_null_rate],
        F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"), (F.sum("nonpositive_prices") / rows).alias("nonpositive_price_rate"),
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in FLAGS], F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("unique_customers"))
