"""Invoice lines derived from the order tables (lineitem, orders, part, customer, nation).

Adds what the tables hold none of: exact duplicates, reversed entry errors, customers that order from a second country. One scan of
lineitem; the extra rows come from an explode, not from further scans.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Standard eight columns, one row per invoice line."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    # orders meet their customers before the lines do: where no side is small, lines are shuffled for orders and parts only
    placed = (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
              .join(nations, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_custkey", "c_nationkey", "n_nationkey"))
    joined = (lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(parts, F.col("l_partkey") == F.col("p_partkey")))
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    key = F.col("l_orderkey").cast("string")
    lower = (F.col("l_orderkey") + F.col("l_linenumber")) % 25 == 0
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / F.lit(100.0)
    base = joined.select(
        F.when(returned, F.concat(F.lit("C"), key)).otherwise(key).alias("invoice"),
        F.when(F.col("l_partkey") % 50 == 0, F.lit("POST"))
         .otherwise(F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"))).alias("stock_code"),
        F.when(lower, F.concat(F.lower("p_name"), F.lit("  "))).otherwise(F.upper("p_name")).alias("description"),
        F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        (F.col("o_orderdate") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), (F.col("l_orderkey") % 36000 + 28800).cast("decimal(18,6)"))
         ).alias("invoice_date"),
        F.when((F.col("l_orderkey") + F.col("l_partkey")) % 400 == 0, F.lit(0.0)).otherwise(cents).alias("unit_price"),
        F.when(F.col("o_custkey") % 6 != 5, F.col("o_custkey")).alias("customer_id"),
        F.when(F.col("l_orderkey") % 11 == 3, F.lit("FRANCE")).otherwise(F.col("n_name")).alias("country"),
        key.alias("_key"),
        (F.col("l_orderkey") % 101 == 0).alias("_twice"),
        ((F.col("l_orderkey") % 97 == 0) & (F.col("l_linenumber") == 1)).alias("_error"))
    # row kinds: 0 as it is, 1 exact copy, 2 entry error, 3 its reversal
    kinds = lambda *k: F.lit(list(k)).cast("array<int>")
    kind = (F.when(F.col("_twice") & F.col("_error"), kinds(0, 1, 2, 3)).when(F.col("_twice"), kinds(0, 1))
            .when(F.col("_error"), kinds(0, 2, 3)).otherwise(kinds(0)))
    k = F.col("_kind")
    return base.withColumn("_kind", F.explode(kind)).select(
        F.when(k < 2, F.col("invoice")).when(k == 2, F.col("_key")).otherwise(F.concat(F.lit("C"), F.col("_key"))).alias("invoice"),
        "stock_code", "description",
        F.when(k < 2, F.col("quantity")).when(k == 2, 60000.0).otherwise(-60000.0).alias("quantity"),
        "invoice_date", "unit_price", "customer_id", "country")
