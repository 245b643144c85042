"""Global order without a one-task sort.

A running total, rank or quantile over a whole column needs an order over all rows. Rows are first aggregated to
distinct values and written. Up to ONE_TASK distinct values are put in order at once; more are range-partitioned, with
boundaries that Spark draws from the values themselves, so values that lie close together spread as well as any
others. Range partitions are numbered as they are written; their totals (one row each) get a running sum, and the fine
order is made inside each. No window spans more than one range partition or the list of partition totals.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.session import materialise

#: Distinct values, of all groups together, that are put in order without range partitions; rows of a small group.
ONE_TASK = 200_000


def _known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def in_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` written in ``order``, with ``_part`` (number of the range partition) and ``_at`` (place, rising with the order)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "in-order")
    return placed.withColumn("_part", F.shiftright("_at", 33))


def _same(names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in names:
        cond = cond & (F.col(c) == F.col(f"_k_{c}"))
    return cond


def largest_group(df: DataFrame, by: str) -> int:
    """Rows of the largest group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def _inside_groups(df: DataFrame, order: Column, sums: Sequence[str], by: Sequence[str], prefix: str) -> DataFrame:
    """Running sums and totals by one window a group; for groups of bounded size."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = (Window.unboundedPreceding, 0)
    return df.select(*df.columns, *[F.sum(s).over(group.orderBy(order).rowsBetween(*upto)).alias(f"{prefix}{s}") for s in sums],
                     *[F.sum(s).over(group).alias(f"_all_{s}") for s in sums])


def _with_sums(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str], descending: bool, prefix: str) -> DataFrame:
    """``df`` (written, one row per (by, value)) with running sums up to and with each row, and ``_all_<s>`` of the group."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    upto = (Window.unboundedPreceding, 0)
    if df.count() <= ONE_TASK:
        return _inside_groups(df, order, sums, by, prefix)
    placed = in_ranges(df, [*by, order])
    per_part = placed.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row per range partition
    offsets = per_part.select(
        *[F.col(c).alias(f"_k_{c}") for c in [*by, "_part"]],
        *[(F.sum(f"_t_{s}").over(across.orderBy("_part")) - F.col(f"_t_{s}")).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(across).alias(f"_all_{s}") for s in sums])
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(*upto)
    return placed.join(offsets, _same([*by, "_part"])).select(
        *df.columns, *[(F.col(f"_before_{s}") + F.sum(s).over(inside)).alias(f"{prefix}{s}") for s in sums], *[f"_all_{s}" for s in sums])


def running_totals(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (),
                   descending: bool = False) -> DataFrame:
    """Add ``cum_<s>``: sum of ``s`` over rows whose value comes no later than the row's value.

    ``df`` must hold one row per (by, value). Ascending by default. Rows without value or group are left out.
    """
    by = list(by)
    held = materialise(_known(df, [*by, value]), "distinct-values")
    return _with_sums(held, value, sums, by, descending, "cum_").select(*df.columns, *[f"cum_{s}" for s in sums])


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group: columns ``by`` plus the keys of ``probs``.

    Rows are reduced to (group, value, count) with map-side partial sums, so a value with a third of all rows is one row.
    Where no value of the last group column has over ONE_TASK rows, which a pass over that column tells, its rows go to one
    task as they are, in the only shuffle. (By that column alone: another may be a constant, which Spark takes out of keys.)
    """
    by = list(by)
    rows = _known(df, by).select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = lambda found: found.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    if by and largest_group(rows, by[-1]) <= ONE_TASK:
        ranked = _inside_groups(counted(rows.repartition(by[-1])), F.col("_v").asc(), ["_n"], by, "_end")
    else:
        ranked = _with_sums(materialise(counted(rows), "distinct-values"), "_v", ["_n"], by, False, "_end")
    ranked = ranked.withColumn("_start", F.col("_end_n") - F.col("_n"))
    size = F.col("_all__n") - 1
    picks = []
    for k, p in probs.items():
        for side, rank in (("lo", F.floor(F.lit(float(p)) * size)), ("hi", F.ceil(F.lit(float(p)) * size))):
            here = (rank.cast("long") >= F.col("_start")) & (rank.cast("long") < F.col("_end_n"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}_{k}"))
    picked = ranked.groupBy(*by).agg(*picks, F.max("_all__n").alias("_all__n"))
    out = []
    for k, p in probs.items():
        spot = F.lit(float(p)) * size
        low, high = F.col(f"_lo_{k}"), F.col(f"_hi_{k}")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(k))
    return picked.select(*by, *out)


def share_at_or_below(reference: DataFrame, queries: DataFrame, value: str = "value",
                      by: Sequence[str] = ()) -> DataFrame:
    """Empirical distribution function of ``reference`` at every distinct value of ``queries``.

    Returns (by, value, share): the share of reference rows with a value <= the query value.
    """
    by = list(by)
    ref = reference.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    asked = queries.groupBy(*by, value).agg(F.lit(0).cast("long").alias("_n"))
    points = ref.unionByName(asked).groupBy(*by, value).agg(F.sum("_n").alias("_n"))
    cum = running_totals(points, value, ["_n"], by)
    total = ref.groupBy(*by).agg(F.sum("_n").alias("_total"))
    if by:
        out = cum.join(total, by)
    else:
        out = cum.withColumn("_total", total.select("_total").scalar())
    return out.select(*by, value, (F.col("cum__n") / F.col("_total")).alias("share"))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, avg_rank) for each distinct value: mean of the 1-based ranks its rows share."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_totals(counts, value, ["_n"])
    return cum.select(value, (F.col("cum__n") - (F.col("_n") - 1) / F.lit(2.0)).alias("avg_rank"))


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """1-based place of every row in ``order`` inside its group; rows that tie in all of it are told apart arbitrarily.

    Rows are numbered as they are written in order, and shifted by the totals of the range partitions before: no
    window over rows at all, however many rows a group has.
    """
    by = list(by)
    placed = in_ranges(df, [*by, *order])
    runs = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    across = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part")
    runs = runs.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_part"]], (F.sum("_rows").over(across) - F.col("_rows") - F.col("_first") + 1).alias("_shift"))
    cond = F.col("_part") == F.col("_k__part")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return placed.join(runs, cond).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def global_row_number(df: DataFrame, value: str, tie: str, name: str = "row_number") -> DataFrame:
    """1-based position of every row in the order (value, tie); rows without a value are left out."""
    return positions(_known(df, [value]), [value, tie], name=name)


def hash_sample(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """The n rows with the smallest hash of their key: a seeded sample that does not depend on row order."""
    mark = F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(mark, key).limit(n)
