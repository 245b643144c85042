"""Customer segmentation: preparation, clustering searches, quality, names, profiles, assignments."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.config import DEFAULTS, Settings
from patronage.fixed_values import SEGMENT_FEATURES, SEGMENT_LOG_FEATURES, SEGMENT_PROFILE_COLUMNS
from patronage.operators.encode import value_tiers
from patronage.operators.many_starts import Clusters, kmeans_starts, mixtures, silhouettes
from patronage.operators.neighbours import by_blocks, density_clusters, neighbour_distance
from patronage.session import materialise

#: Clusters that are compared inside one expression.
FEW_CLUSTERS = 512


# ---------------------------------------------------------------- standardising
@dataclass(frozen=True)
class Standardiser:
    """Means and population deviations of some columns; applying it is a projection."""
    columns: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    log_columns: frozenset[str] = frozenset()

    @staticmethod
    def _value(column: str, log: frozenset[str]) -> Column:
        v = F.col(column).cast("double")
        return F.log1p(F.greatest(v, F.lit(0.0))) if column in log else v

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], log_columns: Sequence[str] = ()) -> "Standardiser":
        log = frozenset(log_columns)
        row = df.agg(*[f(cls._value(c, log)).alias(f"{n}{i}") for i, c in enumerate(columns)
                       for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        sd = [float(row[f"s{i}"] or 0.0) for i in range(len(columns))]
        return cls(tuple(columns), tuple(float(row[f"m{i}"] or 0.0) for i in range(len(columns))),
                   tuple(s if s > 0 else 1.0 for s in sd), log)

    def values(self) -> list[Column]:
        return [(self._value(c, self.log_columns) - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.columns, self.means, self.deviations)]

    def vector(self, df: DataFrame, name: str = "z") -> DataFrame:
        temp = [f"_z{i}" for i in range(len(self.columns))]
        wide = df.withColumns(dict(zip(temp, self.values())))
        return VectorAssembler(inputCols=temp, outputCol=name).transform(wide).drop(*temp)


def prepare(df: DataFrame) -> tuple[DataFrame, Standardiser]:
    """Add the standardised vector ``z`` of the segmentation features."""
    scaler = Standardiser.fit(df, SEGMENT_FEATURES, SEGMENT_LOG_FEATURES)
    return scaler.vector(df), scaler


# ---------------------------------------------------------------- clustering searches
def silhouette(df: DataFrame, cluster: str, vector: str = "z") -> float | None:
    """Mean silhouette in the squared-Euclidean form, linear in the rows; noise (negative) left out."""
    data = df.where(F.col(cluster) >= 0)
    if data.select(cluster).distinct().limit(2).count() < 2:
        return None
    return float(ClusteringEvaluator(featuresCol=vector, predictionCol=cluster).evaluate(data.withColumn(cluster, F.col(cluster).cast("int"))))


def kmeans_search(vectors: DataFrame, settings: Settings = DEFAULTS):
    """Best clusters by silhouette over k; per k the restart with the least cost. Returns (clusters, rows of (k, cost, silhouette)).

    All starts are moved on together. ``vectors`` is read once a round: hand in a persisted or written table.
    """
    starts = kmeans_starts(vectors, range(settings.k_min, settings.k_max + 1), settings.kmeans_restarts, settings.seed)
    least = [min((s for s in starts if s.k == k), key=lambda s: (s.cost, s.restart)) for k in sorted({s.k for s in starts})]
    scores = silhouettes(vectors, [s.centres for s in least])
    best = max(range(len(least)), key=lambda i: (-1.0 if scores[i] is None else scores[i], -least[i].k))
    return Clusters(least[best].centres), [(s.k, s.cost, score) for s, score in zip(least, scores)]


def mixture_search(vectors: DataFrame, settings: Settings = DEFAULTS):
    """Gaussian mixture with full covariance, least BIC. Returns (model, rows of (k, bic)). All sizes are fitted together."""
    n = vectors.count()
    found = mixtures(vectors, range(settings.k_min, settings.k_max + 1), settings.seed)
    bics = [-2.0 * m.log_likelihood + m.free() * math.log(n) for m in found]
    best = min(range(len(found)), key=lambda i: bics[i])
    return found[best], [(len(m.weights), float(b)) for m, b in zip(found, bics)]


def hierarchy(vectors: DataFrame, leaves: int = 30, seed: int = 42):
    """Divisive hierarchy over all rows."""
    return BisectingKMeans(k=leaves, seed=seed, featuresCol="z", predictionCol="leaf").fit(vectors)


def principal_axes(vectors: DataFrame, k: int = 2):
    """PCA model and frame with ``pca_x`` and ``pca_y``."""
    model = PCA(k=k, inputCol="z", outputCol="_pca").fit(vectors)
    axes = vector_to_array("_pca")
    return model, model.transform(vectors).withColumn("pca_x", axes[0]).withColumn("pca_y", axes[1]).drop("_pca")


# ---------------------------------------------------------------- quality
def davies_bouldin(df: DataFrame, cluster: str, dims: Sequence[str]) -> DataFrame:
    """One row (davies_bouldin); null with fewer than two clusters, noise (negative) left out.

    Rows go through two aggregations with partial sums. Clusters are compared in one expression while they are few, and
    in pairs of bounded blocks, each handing on one number a cluster, when they are many.
    """
    data = df.where(F.col(cluster) >= 0).select(F.col(cluster).alias("_c"), F.array(*[F.col(d).cast("double") for d in dims]).alias("_v"))
    centres = data.groupBy("_c").agg(F.array(*[F.avg(F.col("_v")[i]) for i in range(len(dims))]).alias("_m"))
    distance = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    spread = (data.join(centres, "_c").groupBy("_c").agg(F.avg(distance(F.col("_v"), F.col("_m"))).alias("_s"), F.first("_m").alias("_m")))
    spread = materialise(spread, "cluster-spreads")
    if spread.count() > FEW_CLUSTERS:
        return _davies_bouldin_of_many(spread)
    clusters = spread.agg(F.collect_list(F.struct("_c", "_s", "_m")).alias("all"))
    ratio = lambda x, y: F.try_divide(x["_s"] + y["_s"], distance(x["_m"], y["_m"]))
    worst = F.transform("all", lambda x: F.array_max(F.transform(F.filter("all", lambda y: y["_c"] != x["_c"]), lambda y: ratio(x, y))))
    mean = F.aggregate(worst, F.lit(0.0), lambda a, v: a + v) / F.size("all")
    return clusters.select(F.when(F.size("all") >= 2, mean).alias("davies_bouldin"))


def _davies_bouldin_of_many(spread: DataFrame, block: int = 1024) -> DataFrame:
    rows = spread.select(F.col("_c").cast("long").alias("id"), F.concat(F.array("_s"), "_m").alias("x"), F.lit(0).cast("long").alias("cell"))

    def worst(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(qs["x"].to_numpy()), np.stack(ps["x"].to_numpy())
        away = np.sqrt(np.maximum((a[:, 1:] ** 2).sum(1)[:, None] - 2 * a[:, 1:] @ b[:, 1:].T + (b[:, 1:] ** 2).sum(1)[None, :], 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (a[:, :1] + b[:, 0][None, :]) / away
        ratio[(qs["id"].to_numpy()[:, None] == ps["id"].to_numpy()[None, :]) | (away == 0)] = -np.inf
        return pd.DataFrame({"id": qs["id"].to_numpy(), "ratio": ratio.max(1)})

    pairs = by_blocks(rows, rows, worst, "id long, ratio double", block)
    return pairs.groupBy("id").agg(F.max("ratio").alias("_worst")).agg(F.avg("_worst").alias("davies_bouldin"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (adjusted_rand) from the contingency table of two labelings."""
    pairs = lambda n: n * (n - 1) / F.lit(2.0)
    cell = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = lambda d: d.agg(F.sum(pairs(F.col("n"))).alias("v"), F.sum("n").alias("n"))
    by = lambda c: total(cell.groupBy(c).agg(F.sum("n").alias("n")))
    s = total(cell).select("v", "n", by("a").select("v").scalar().alias("va"), by("b").select("v").scalar().alias("vb"))
    expected = F.try_divide(F.col("va") * F.col("vb"), pairs(F.col("n")))
    most = (F.col("va") + F.col("vb")) / 2
    return s.select(F.when(most == expected, F.lit(1.0)).otherwise(
        F.try_divide(F.col("v") - expected, most - expected)).alias("adjusted_rand"))


# ---------------------------------------------------------------- names and profiles
NAMING_COLUMNS = ["recency_days", "frequency", "total_spend", "return_rate", "seasonal_concentration"]


def segment_name(z: Mapping[str, Column]) -> Column:
    spend, recency, frequency, season = (z[c] for c in ("total_spend", "recency_days", "frequency", "seasonal_concentration"))
    # fixed values: names and cut-offs on cluster z-scores
    return (F.when((spend > 0.5) & (recency > 0.3), "Lapsed High-Value")
            .when(spend > 0.5, "Loyal High-Value")
            .when(season > 0.7, "Seasonal Gift Shopper")
            .when((frequency > 0.3) & (spend < 0), "High-Frequency Low-Value")
            .when(recency > 0.3, "At-Risk / Lapsing")
            .when((recency < -0.3) & (frequency < 0), "Recent Occasional Buyer")
            .otherwise("Steady Mid-Value"))


def label_segments(df: DataFrame, segment: str) -> DataFrame:
    """(segment, segment_label): names from z-scores of cluster means across clusters.

    Several clusters of one name get the suffixes (A), (B), ..; the last one keeps the bare name.
    The windows run over one row per cluster.
    """
    means = df.groupBy(segment).agg(*[F.avg(c).alias(c) for c in NAMING_COLUMNS])
    every = Window.partitionBy(F.lit(1))

    def z(c: str) -> Column:
        sd = F.stddev_pop(c).over(every)
        return (F.col(c) - F.avg(c).over(every)) / F.when(sd > 0, sd).otherwise(F.lit(1.0))

    scored = means.select(segment, *[z(c).alias(c) for c in NAMING_COLUMNS])
    named = scored.select(segment, segment_name({c: F.col(c) for c in NAMING_COLUMNS}).alias("_name"))
    same = Window.partitionBy("_name")
    place, count = F.row_number().over(same.orderBy(segment)), F.count(F.lit(1)).over(same)
    numbered = named.withColumns({"_place": place, "_count": count})
    suffix = F.concat(F.col("_name"), F.lit(" ("), F.chr(F.lit(64) + F.col("_place")), F.lit(")"))
    return numbered.select(segment, F.when(F.col("_place") < F.col("_count"), suffix).otherwise(F.col("_name")).alias("segment_label"))


def profile_segments(df: DataFrame, segment: str, label: str = "segment_label") -> DataFrame:
    """Size, share and rounded means per segment."""
    total = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    sizes = df.groupBy(segment, label).agg(
        F.count(F.lit(1)).alias("customers"), *[F.bround(F.avg(c), 3).alias(c) for c in SEGMENT_PROFILE_COLUMNS])
    return sizes.withColumn("share_pct", F.bround(100 * F.col("customers") / total, 1))


def add_churn_to_profile(profile: DataFrame, segments: DataFrame, scores: DataFrame, segment: str) -> DataFrame:
    """Profile plus mean churn probability and percent of high-risk customers."""
    joined = segments.select("customer_id", F.col(segment).alias("_segment")).join(scores, "customer_id")
    risk = joined.groupBy("_segment").agg(
        F.bround(F.avg("churn_probability"), 3).alias("mean_churn_probability"),
        F.bround(100 * F.avg((F.col("risk_tier") == "High").cast("double")), 3).alias("high_risk_pct"))
    return profile.join(risk, F.col(segment) == F.col("_segment"), "left").drop("_segment")


# ---------------------------------------------------------------- whole run
def density_secondary(vectors: DataFrame) -> tuple[DataFrame, dict]:
    """(vectors with ``secondary_cluster`` from density, noise -1; metrics): reach from the 2d-th neighbour, least size 2d."""
    points = materialise(vectors.select(F.col("customer_id").alias("id"), vector_to_array("z").alias("x")), "density-vectors")
    k = 2 * len(SEGMENT_FEATURES)
    eps = neighbour_distance(points, k)
    found = materialise(density_clusters(points, eps, k), "density-clusters")
    facts = found.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.avg((F.col("cluster") < 0).cast("double")).alias("noise")).first()
    named = found.select(F.col("id").alias("customer_id"), F.col("cluster").alias("secondary_cluster"))
    return vectors.join(named, "customer_id"), {"eps": eps, "n_clusters": facts["clusters"], "noise_fraction": facts["noise"]}


def cluster_quality(df: DataFrame, cluster: str, vector: str = "z") -> dict[str, float | None]:
    """Silhouette and Davies-Bouldin index; noise left out, null with fewer than two clusters."""
    x, d = vector_to_array(vector), len(SEGMENT_FEATURES)
    wide = df.select(F.col(cluster), *[x[i].alias(f"_d{i}") for i in range(d)])
    return {"silhouette": silhouette(df, cluster, vector), "davies_bouldin": davies_bouldin(wide, cluster, [f"_d{i}" for i in range(d)]).first()[0]}


def segment_customers(snapshot: DataFrame, settings: Settings = DEFAULTS, secondary: str = "mixture", quality: bool = True):
    """Assignments, profiles and metrics of one segmentation run.

    ``secondary``: ``mixture`` or ``density``, the second clustering that the first one is compared with.
    """
    vectors, _scaler = prepare(snapshot)
    vectors = vectors.persist()
    try:
        model, curve = kmeans_search(vectors, settings)
        assigned = model.transform(vectors)
        metrics: dict = {"kmeans": curve, "k": model.getK(), "secondary_algorithm": secondary}
        if secondary == "density":
            assigned, metrics["density"] = density_secondary(assigned)
        else:
            mixture, metrics["mixture"] = mixture_search(vectors, settings)
            assigned = mixture.transform(assigned, name="secondary_cluster")
        assigned = materialise(assigned, "segmented")
        if quality:
            metrics["kmeans_quality"], metrics["secondary_quality"] = (cluster_quality(assigned, c) for c in ("segment", "secondary_cluster"))
            metrics["adjusted_rand"] = adjusted_rand(assigned, "segment", "secondary_cluster").first()[0]
        pca, assigned = principal_axes(assigned)
        metrics["explained_variance"] = [float(v) for v in pca.explainedVariance]
        names = label_segments(assigned, "segment")
        named = value_tiers(assigned.join(F.broadcast(names), "segment"))  # one row per cluster, k_max at most
        assignments = named.select("customer_id", F.col("segment").alias("kmeans_segment"), "segment_label", "secondary_cluster",
                                   "value_tier", "pca_x", "pca_y")
        return assignments, profile_segments(named, "segment"), metrics
    finally:
        vectors.unpersist()
