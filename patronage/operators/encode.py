"""Encoding, ranking and column statistics of customer snapshots."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.config import DEFAULTS, Settings
from patronage.fixed_values import VALUE_TIERS
from patronage.functions.ordering import exact_quantiles, global_row_number, in_ranges, share_at_or_below
from patronage.session import materialise

ENGAGEMENT_METRICS = ["recency_days", "frequency", "total_spend"]


# ---------------------------------------------------------------- countries
def country_ranking(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(country, n) of the most frequent levels, alphabetical on ties."""
    return (df.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "country").limit(settings.top_countries))


def country_levels(df: DataFrame, settings: Settings = DEFAULTS) -> list[str]:
    """Ordered levels for the one-hot columns; the first is the reference level. At most top_countries rows reach the driver."""
    return [r["country"] for r in country_ranking(df, settings).collect()] + ["Other"]


def country_flags(levels: Sequence[str]) -> dict[str, Column]:
    """One-hot columns for all but the reference level; unseen countries count as Other."""
    grouped = F.when(F.col("country").isin(list(levels)), F.col("country")).otherwise("Other")
    return {f"country_{level}": F.coalesce((grouped == level).cast("double"), F.lit(0.0)) for level in levels[1:]}


# ---------------------------------------------------------------- engagement
def _ecdf_key(metric: str) -> Column:
    """Values are compared at six decimals: sums of the same amounts in another order count as equal."""
    return F.round(F.col(metric).cast("double"), 6)


def _long(rows: DataFrame) -> DataFrame:
    """(metric, value) of the engagement metrics."""
    return rows.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), _ecdf_key(m).alias("value")) for m in ENGAGEMENT_METRICS])).alias("s")).select("s.*")


def ecdf_table(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """(metric, value, share): share of reference rows at or below each value that occurs in ``rows``."""
    return share_at_or_below(_long(reference), _long(rows), by=["metric"])


def with_ecdf(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Add ``ecdf_<metric>`` for the three engagement metrics.

    The lookup has one row per distinct value and is written with one folder per metric. So the
    planner knows the size of each: the short ones (days, orders) go to all tasks, and only a long
    one (spend) costs a shuffle, where adaptive execution splits the partition of a value that a
    large share of customers has in common.
    """
    table = materialise(ecdf_table(rows, reference), "ecdf", partition_by="metric")
    return _with_shares(rows, table)


def ecdf_steps(reference: DataFrame) -> DataFrame:
    """(metric, value, share, part) at every distinct value of the reference: fitted once, looked up later.

    ``part`` numbers range partitions of the steps, drawn from the values themselves, so each holds about as many.
    """
    table = ecdf_table(reference, reference)
    return in_ranges(table, ["metric", "value"]).select("metric", "value", "share", F.col("_part").alias("part"))


def step_lookup(asked: DataFrame, steps: DataFrame) -> DataFrame:
    """(metric, value, share) of asked values: the share of the largest step at or below, 0 below all.

    Only steps of the parts that are asked for are put in order, each part on its own; all others count by the largest
    share of their part.
    """
    heads = steps.groupBy("metric", "part").agg(F.min("value").alias("value"), F.max("share").alias("_top"))
    ahead = Window.partitionBy("metric").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    before = heads.withColumn("_before", F.max("_top").over(ahead)).select("metric", "part", "_before")
    upto = lambda *by: Window.partitionBy(*by).orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    marked = asked.select("metric", "value", F.lit(None).cast("long").alias("part"), F.lit(True).alias("_asked")).unionByName(
        heads.select("metric", "value", F.col("part").cast("long").alias("part"), F.lit(False).alias("_asked")))
    placed = marked.withColumn("part", F.max("part").over(upto("metric"))).where("_asked")  # the batch and one row a part
    spots = placed.select("metric", "part").distinct()
    points = placed.withColumn("share", F.lit(None).cast("double")).unionByName(
        steps.join(spots, ["metric", "part"], "left_semi").select("metric", "value", F.col("part").cast("long").alias("part"), F.lit(False).alias("_asked"), "share"))
    inside = points.withColumn("_inside", F.max("share").over(upto("metric", "part"))).where("_asked")
    return inside.join(before, ["metric", "part"], "left").select("metric", "value", F.coalesce("_inside", "_before", F.lit(0.0)).alias("share"))


def _with_shares(rows: DataFrame, table: DataFrame) -> DataFrame:
    out = rows
    for m in ENGAGEMENT_METRICS:
        side = table.where(F.col("metric") == m).select(F.col("value").alias("_v"), F.col("share").alias(f"ecdf_{m}"))
        out = out.join(side, _ecdf_key(m) == F.col("_v"), "left").drop("_v")
    return out


def _filled(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    columns = rows.columns if "engagement_score" in rows.columns else [*rows.columns, "engagement_score"]
    given = F.col("engagement_score") if "engagement_score" in rows.columns else F.lit(None).cast("double")
    return ranked.withColumn("engagement_score", F.coalesce(given, engagement())).select(*columns)


def fill_from_steps(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """``fill_engagement`` from a saved ``ecdf_steps`` table, for small batches of rows against a large reference."""
    asked = _long(rows).distinct()
    return _filled(rows, _with_shares(rows, materialise(step_lookup(asked, steps), "ecdf-batch", partition_by="metric")))


def engagement() -> Column:
    inverse_recency = F.lit(1.0) - F.col("ecdf_recency_days")
    return F.lit(100.0) * (inverse_recency + F.col("ecdf_frequency") + F.col("ecdf_total_spend")) / F.lit(3.0)


def fill_engagement(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Fill ``engagement_score`` where it is missing; the column order stays."""
    return _filled(rows, with_ecdf(rows, reference))


# ---------------------------------------------------------------- model matrix
def model_columns(levels: Sequence[str], settings: Settings = DEFAULTS) -> list[str]:
    return settings.feature_columns + [f"country_{c}" for c in levels[1:]]


def model_matrix(df: DataFrame, levels: Sequence[str], settings: Settings = DEFAULTS,
                 keep: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Doubles in fixed order next to the ``keep`` columns; missing affinity columns and null shares count 0."""
    def number(c: str) -> Column:
        if c not in df.columns:
            return F.lit(0.0)
        v = F.col(c).try_cast("double")
        return F.coalesce(v, F.lit(0.0)) if c.startswith("affinity_") else v

    numeric = [number(c).alias(c) for c in settings.feature_columns]
    flags = [c.alias(n) for n, c in country_flags(levels).items()]
    return df.select(*[F.col(k) for k in keep if k not in settings.feature_columns], *numeric, *flags)


def assemble(matrix: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="error").transform(matrix)


# ---------------------------------------------------------------- correlation and VIF
def moment_row(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, population covariance, n) of d columns in one pass; a sum and a count of each pair of columns reach the driver.

    The sums are taken around a rough centre, so that large means do not cost digits. A batch of rows is one matrix product: an
    aggregate for each of the d(d+1)/2 pairs would be too many for generated code. Nulls leave out the pairs that they are in.
    """
    cols, d = list(columns), len(columns)
    centre = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    rough = np.array([float(centre[c] or 0.0) for c in cols])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs = np.zeros((d + 1, d + 1)), np.zeros((d + 1, d + 1))
        for batch in batches:
            there = np.ones((batch.num_rows, d + 1))
            x = np.ones((batch.num_rows, d + 1))
            for i in range(d):
                there[:, i + 1] = batch.column(i).is_valid().to_numpy(zero_copy_only=False)
                x[:, i + 1] = batch.column(i).fill_null(rough[i]).to_numpy(zero_copy_only=False) - rough[i]
            pairs += there.T @ there
            if np.isfinite(x).all():
                total += x.T @ x
            else:  # nothing but the nulls may be left out
                both = there.astype(bool)
                total += np.array([[(x[:, i] * x[:, j])[both[:, i] & both[:, j]].sum() for j in range(d + 1)] for i in range(d + 1)])
        if pairs[0, 0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange((d + 1) ** 2), pa.int32()), pa.array(total.ravel()), pa.array(pairs.ravel())], names=["pair", "total", "n"])

    found = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).mapInArrow(sums, "pair int, total double, n double")
    total, pairs = np.zeros((d + 1) ** 2), np.zeros((d + 1) ** 2)
    for r in found.groupBy("pair").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # (d + 1)^2 rows
        total[r["pair"]], pairs[r["pair"]] = r["total"], r["n"]
    if not pairs.all():
        raise ValueError("two columns without a row that has both")
    mean = (total / pairs).reshape(d + 1, d + 1)
    shift = mean[0, 1:]
    return rough + shift, mean[1:, 1:] - np.outer(shift, shift), int(pairs[0])


def correlation_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for each pair of columns in one pass."""
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def vif_from_covariance(cov: np.ndarray) -> np.ndarray:
    """Variance inflation factors: diagonal of the inverse correlation matrix; infinite if singular."""
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    out = np.empty(len(sd))
    for i in range(len(sd)):
        rest = [j for j in range(len(sd)) if j != i]
        if not rest:
            out[i] = 1.0
            continue
        r = corr[np.ix_(rest, [i])]
        weights = np.linalg.lstsq(corr[np.ix_(rest, rest)], r, rcond=None)[0]
        left = 1.0 - float((r.T @ weights)[0, 0])
        out[i] = 1.0 / left if left > 1e-12 else np.inf
    return out


def vif(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    _, cov, _ = moment_row(df, columns)
    return dict(zip(columns, vif_from_covariance(cov)))


def prune_by_vif(df: DataFrame, columns: Sequence[str], threshold: float, protected: Sequence[str],
                 skip_prefix: str = "country_") -> tuple[list[str], list[tuple[str, float, str]]]:
    """Drop the largest unprotected VIF until all are at or below the threshold. One Spark pass in total.

    Returns (kept columns in order, rows of (feature, vif, status)).
    """
    checked = [c for c in columns if not c.startswith(skip_prefix)]
    _, cov, _ = moment_row(df, checked)
    place = {c: i for i, c in enumerate(checked)}
    live, dropped = list(checked), []
    while True:
        varying = [c for c in live if cov[place[c], place[c]] > 1e-18]
        at = [place[c] for c in varying]
        values = np.minimum(vif_from_covariance(cov[np.ix_(at, at)]), 1e12)
        scores = dict(zip(varying, values))
        open_to_drop = {c: v for c, v in scores.items() if c not in protected}
        if not open_to_drop or max(open_to_drop.values()) <= threshold:
            break
        worst = max(open_to_drop, key=lambda c: open_to_drop[c])
        dropped.append((worst, float(open_to_drop[worst]), "dropped"))
        live.remove(worst)
    kept = [c for c in columns if c in live or c.startswith(skip_prefix)]
    return kept, [(c, float(v), "kept") for c, v in scores.items()] + dropped


def vif_report(train: DataFrame, settings: Settings = DEFAULTS) -> list[tuple[str, float, str]]:
    """Rows (feature, vif, kept or dropped) of the pruning that training makes."""
    levels = country_levels(train, settings)
    return prune_by_vif(model_matrix(train, levels, settings), model_columns(levels, settings), settings.vif_threshold, settings.vif_protected)[1]


# ---------------------------------------------------------------- column statistics
def describe_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n, mean, std, lowest, q1, median, q3, highest); quantiles are exact and distributed."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(entries).alias("s")).select("s.*")
    basic = long.groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"))
    quantiles = exact_quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=["feature"])
    return basic.join(quantiles, "feature").select("feature", "n", "mean", "std", "lowest", "q1", "median", "q3", "highest")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median) in long form."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(entries).alias("s")).select("s.*")
    return exact_quantiles(long, "value", {"median": 0.5}, by=["feature"])


def value_tiers(df: DataFrame, value: str = "historical_clv", key: str = "customer_id",
                tiers: Sequence[str] = tuple(VALUE_TIERS)) -> DataFrame:
    """Equal-count tiers on the first-come rank of the value (ties by key)."""
    k = len(tiers)
    ranked = global_row_number(df, value, key, "_rank")
    size = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    spot = (F.col("_rank") - 1) * k
    bin_ = F.when(F.col("_rank") == 1, F.lit(1)).otherwise(F.ceil(spot / (size - 1)).cast("int"))
    names = F.array(*[F.lit(t) for t in tiers])
    return ranked.withColumn("value_tier", F.element_at(names, bin_.cast("int"))).drop("_rank")


def quantile_bins(df: DataFrame, value: str, target: str, bins: int = 5) -> DataFrame:
    """(bin, low, high, n, mean_target): right-closed quantile bins, first edge included, equal edges dropped."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, value, probs).select(
        F.array_sort(F.array_distinct(F.array(*probs))).alias("edges"))
    edge_array = edges.select("edges").scalar()
    v = F.col(value).cast("double")
    inside = df.where(v.isNotNull()).select(v.alias("_v"), F.col(target).cast("double").alias("_t"), edge_array.alias("_e"))
    spot = F.greatest(F.size(F.filter("_e", lambda e: e < F.col("_v"))), F.lit(1))
    return (inside.withColumn("bin", spot).groupBy("bin").agg(
        F.min(F.element_at("_e", F.col("bin"))).alias("low"), F.max(F.element_at("_e", F.col("bin") + 1)).alias("high"),
        F.count(F.lit(1)).alias("n"), F.avg("_t").alias("mean_target")))


def histogram(df: DataFrame, value: str, bins: int = 40, log: bool = False) -> DataFrame:
    """(bin, low, n): equal-width bins between the extremes, last edge included, optional log1p. Empty bins are left out."""
    v = F.log1p(F.col(value)) if log else F.col(value).cast("double")
    data = df.where(F.col(value).isNotNull()).select(v.alias("_v"))
    span = data.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("s")).select("s").scalar()
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    width = (hi - lo) / F.lit(float(bins))
    spot = F.least(F.floor(F.coalesce(F.try_divide(F.col("_v") - lo, width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return (data.withColumn("_s", span).withColumn("bin", spot).withColumn("low", lo + F.col("bin") * width)
            .groupBy("bin").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n")))
