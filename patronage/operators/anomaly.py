"""Anomaly scores on spending patterns: linear reconstruction, Mahalanobis distance, isolation trees."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.config import DEFAULTS, Settings
from patronage.fixed_values import ANOMALY_FEATURES
from patronage.functions.ordering import exact_quantiles
from patronage.operators.encode import moment_row
from patronage.operators.segment import Standardiser
from patronage.session import materialise


def _z_columns(scaler: Standardiser) -> dict[str, Column]:
    return {f"_z{i}": v for i, v in enumerate(scaler.values())}


def _dot(weights: np.ndarray, columns: Sequence[Column]) -> Column:
    total: Column = F.lit(0.0)
    for w, c in zip(weights, columns):
        total = total + F.lit(float(w)) * c
    return total


@dataclass(frozen=True)
class ReconstructionModel:
    """Projection on the leading axes; the score is the mean of squared residuals in units of their training variance."""
    scaler: Standardiser
    projection: np.ndarray
    residual_variance: tuple[float, ...]
    threshold: float = float("inf")

    def _residuals(self) -> dict[str, Column]:
        z = [F.col(f"_z{i}") for i in range(len(self.scaler.columns))]
        gap = self.projection - np.eye(len(z))
        return {f"_r{j}": _dot(gap[:, j], z) for j in range(len(z))}

    def with_residuals(self, df: DataFrame) -> DataFrame:
        """Add scaled values and residuals as columns of their own, so that later expressions stay short."""
        return df.withColumns(_z_columns(self.scaler)).withColumns(self._residuals())

    def score(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """Add the score and ``is_anomaly``. Expressions only, no shuffle."""
        total: Column = F.lit(0.0)
        for j, v in enumerate(self.residual_variance):
            total = total + F.col(f"_r{j}") * F.col(f"_r{j}") / F.lit(v)
        out = self.with_residuals(df).withColumn(name, total / F.lit(float(len(self.scaler.columns))))
        return out.select(*df.columns, name, (F.col(name) > F.lit(self.threshold)).alias("is_anomaly"))


def fit_reconstruction(train: DataFrame, settings: Settings = DEFAULTS, axes: int = 4,
                       columns: Sequence[str] = tuple(ANOMALY_FEATURES)) -> ReconstructionModel:
    """Three passes over the training rows: scaling, covariance, residual variances; then the exact percentile."""
    scaler = Standardiser.fit(train, columns, columns)
    z = train.select(*[v.alias(n) for n, v in _z_columns(scaler).items()])
    _, cov, _ = moment_row(z, z.columns)
    _, vectors = np.linalg.eigh(cov)
    lead = vectors[:, ::-1][:, :axes]
    plain = ReconstructionModel(scaler, lead @ lead.T, tuple(1.0 for _ in columns))
    row = z.withColumns(plain._residuals()).agg(*[F.var_pop(f"_r{i}").alias(f"v{i}") for i in range(len(columns))]).first()
    fitted = ReconstructionModel(scaler, plain.projection, tuple(max(float(row[f"v{i}"]), 1e-6) for i in range(len(columns))))
    scores = materialise(fitted.score(train).select("anomaly_score"), "anomaly-scores")
    cut = exact_quantiles(scores, "anomaly_score", {"cut": settings.anomaly_percentile}).first()["cut"]
    return ReconstructionModel(scaler, fitted.projection, fitted.residual_variance, float(cut))


@dataclass(frozen=True)
class MahalanobisModel:
    scaler: Standardiser
    centre: np.ndarray
    inverse: np.ndarray

    def score(self, df: DataFrame, name: str = "mahalanobis") -> DataFrame:
        z = _z_columns(self.scaler)
        cen = [F.col(f"_z{i}") - F.lit(float(m)) for i, m in enumerate(self.centre)]
        total: Column = F.lit(0.0)
        for i, c in enumerate(cen):
            total = total + c * _dot(self.inverse[i], cen)
        return df.withColumns(z).withColumn(name, total).drop(*z)


def fit_mahalanobis(train: DataFrame, columns: Sequence[str] = tuple(ANOMALY_FEATURES), ridge: float = 1e-6) -> MahalanobisModel:
    scaler = Standardiser.fit(train, columns, columns)
    z = train.select(*[v.alias(n) for n, v in _z_columns(scaler).items()])
    means, cov, n = moment_row(z, z.columns)
    sample = cov * n / max(n - 1, 1)
    return MahalanobisModel(scaler, means, np.linalg.inv(sample + ridge * np.eye(len(means))))


# ---------------------------------------------------------------- isolation trees
def _path_norm(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    c = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, c))


def _grow(points: np.ndarray, rng: np.random.Generator, depth: int, limit: int, rows: list[tuple]) -> int:
    me = len(rows)
    rows.append(None)
    spread = np.flatnonzero(points.max(0) > points.min(0)) if len(points) else np.array([], dtype=int)
    if depth >= limit or len(points) <= 1 or len(spread) == 0:
        rows[me] = (-1, 0.0, -1, -1, len(points))
        return me
    axis = int(rng.choice(spread))
    cut = float(rng.uniform(points[:, axis].min(), points[:, axis].max()))
    left = points[:, axis] < cut
    a = _grow(points[left], rng, depth + 1, limit, rows)
    b = _grow(points[~left], rng, depth + 1, limit, rows)
    rows[me] = (axis, cut, a, b, len(points))
    return me


@dataclass(frozen=True)
class IsolationModel:
    scaler: Standardiser
    trees: list[np.ndarray]
    sample: int

    def score(self, df: DataFrame, name: str = "isolation") -> DataFrame:
        """Higher is more isolated. The trees (at most trees x 2 x sample nodes) travel as one broadcast variable."""
        shared = df.sparkSession.sparkContext.broadcast((self.trees, float(_path_norm(self.sample))))

        @F.pandas_udf("double")
        def isolation(batch: pd.Series) -> pd.Series:
            trees, norm = shared.value
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            total = np.zeros(len(x))
            for t in trees:
                at, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
                while True:
                    inner = np.flatnonzero(t[at, 0] >= 0)
                    if not len(inner):
                        break
                    node = t[at[inner]]
                    left = x[inner, node[:, 0].astype(int)] < node[:, 1]
                    at[inner] = np.where(left, node[:, 2], node[:, 3]).astype(int)
                    depth[inner] += 1
                total += depth + _path_norm(t[at, 4])
            return pd.Series(np.power(2.0, -total / len(trees) / norm) if len(x) else [])

        return df.withColumn(name, isolation(F.array(*self.scaler.values())))


def fit_isolation(train: DataFrame, key: str = "customer_id", trees: int = 100, sample: int = 256, seed: int = 42,
                  columns: Sequence[str] = tuple(ANOMALY_FEATURES)) -> IsolationModel:
    """One tree per group of at most ``sample`` rows; rows are drawn per tree by a hash of the key."""
    scaler = Standardiser.fit(train, columns, columns)
    n = train.count()
    size = min(sample, n)
    share = min(1.0, 2.0 * size / max(n, 1))  # about twice the sample passes, the rank below keeps exactly ``size``
    draw = lambda t: F.shiftrightunsigned(F.xxhash64(F.col(key), t, F.lit(seed)), 1)
    picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) <= F.lit(min(int(share * 2.0**63), 2**63 - 1)))
    rows = train.select(key, F.array(*scaler.values()).alias("x"), F.explode(picks).alias("tree")).withColumn("_draw", draw(F.col("tree")))
    first = Window.partitionBy("tree").orderBy("_draw", key)
    drawn = rows.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= size).select("tree", key, "x")
    limit = int(np.ceil(np.log2(max(size, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        nodes: list[tuple] = []
        tree = int(pdf["tree"].iloc[0])
        _grow(np.stack(pdf["x"].to_numpy()), np.random.default_rng([seed, tree]), 0, limit, nodes)
        return pd.DataFrame({"tree": tree, "nodes": [[list(map(float, r)) for r in nodes]]})

    built = drawn.groupBy("tree").applyInPandas(build, "tree int, nodes array<array<double>>").collect()
    return IsolationModel(scaler, [np.array(r["nodes"]) for r in sorted(built, key=lambda r: r["tree"])], size)
