"""Purchase sequences: the last orders of each customer as an array, padded on the left."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.config import DEFAULTS, Settings
from patronage.functions.expressions import days_between
from patronage.operators.features import point_in_time


def category_index(settings: Settings = DEFAULTS) -> dict[str, int]:
    """Index 0 is padding, rules follow in order, ``other`` is last."""
    return {c: i for i, c in enumerate([*settings.categories, "other"], start=1)}


def order_steps(tx: DataFrame, cutoff: datetime, settings: Settings = DEFAULTS) -> DataFrame:
    """Last orders in long form: (customer_id, back, amt, gap, cat_idx, days_since); back = 1 is the latest.

    The dominant category comes from conditional sums of the order, so orders take one shuffle.
    The rank limit is applied before the shuffle by customer as well (at most one row more than
    the sequence length per customer and input partition), so a customer with very many orders
    does not fill one task.
    """
    sales = point_in_time(tx, [cutoff]).where(~F.col("is_return"))
    index = category_index(settings)
    known = F.when(F.col("category").isin(list(index)), F.col("category")).otherwise("other")
    named = sales.withColumn("_cat", known)
    ordered = sorted(index)
    sums = [F.sum(F.when(F.col("_cat") == c, F.col("line_total"))).alias(f"_c_{c}") for c in ordered]
    per_order = named.groupBy("customer_id", "cutoff", "invoice").agg(
        F.max("invoice_date").alias("order_date"), F.sum("line_total").alias("value"), *sums)
    best = F.array_max(F.array_compact(F.array(*[
        F.when(F.col(f"_c_{c}").isNotNull(), F.struct(F.col(f"_c_{c}").alias("spend"), F.lit(-i).alias("order"),
                                                     F.lit(index[c]).alias("cat_idx")))
        for i, c in enumerate(ordered)])))
    slim = per_order.select("customer_id", "cutoff", "invoice", "order_date", "value", best["cat_idx"].alias("cat_idx"))
    newest = Window.partitionBy("customer_id").orderBy(F.col("order_date").desc(), F.col("invoice").desc())
    kept = slim.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= settings.sequence_max_len + 1)
    earlier = F.lead("order_date").over(newest)
    gap = F.coalesce(days_between(earlier, F.col("order_date")), F.lit(0.0))
    squash = lambda v, by: F.log1p(F.greatest(v, F.lit(0.0))) / F.lit(by)
    return (kept.withColumn("_gap", gap).where(F.col("back") <= settings.sequence_max_len)
            .select("customer_id", "back", squash(F.col("value"), 10.0).alias("amt"), squash(F.col("_gap"), 6.0).alias("gap"),
                    "cat_idx", squash(days_between(F.col("order_date"), F.col("cutoff")), 6.0).alias("days_since")))


def sequences(tx: DataFrame, cutoff: datetime, settings: Settings = DEFAULTS) -> DataFrame:
    """(customer_id, steps): array of sequence_max_len + 1 structs (amt, gap, is_event, cat_idx).

    Short histories are padded on the left with zeros; the last step marks the cutoff and holds
    the time since the latest order.
    """
    size = settings.sequence_max_len
    step = lambda a, g, e, c: F.struct(a.alias("amt"), g.alias("gap"), e.alias("is_event"), c.alias("cat_idx"))
    zero = F.lit(0.0)
    item = F.struct((-F.col("back")).alias("pos"), F.col("amt"), F.col("gap"), F.col("cat_idx").cast("int").alias("cat_idx"))
    grouped = order_steps(tx, cutoff, settings).groupBy("customer_id").agg(
        F.array_sort(F.collect_list(item)).alias("_items"),
        F.max(F.when(F.col("back") == 1, F.col("days_since"))).alias("_since"))
    events = F.transform("_items", lambda s: step(s["amt"], s["gap"], F.lit(1.0), s["cat_idx"]))
    pad = F.array_repeat(step(zero, zero, zero, F.lit(0)), F.lit(size) - F.size("_items"))
    end = F.array(step(zero, F.col("_since"), zero, F.lit(0)))
    return grouped.select("customer_id", F.concat(pad, events, end).alias("steps"))
