"""Tables that several registered queries share.

They are the boundaries of the batch flow: distinct lines, clean lines, snapshots. Each is built
from the given tables on first use and written to the shared folder, as the batch flow does; a
later query of the same application reads it back.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.config import DEFAULTS
from patronage.functions.expressions import hash_unit
from patronage.operators import clean as C
from patronage.operators import encode as E
from patronage.operators import features as X
from patronage.session import materialise
from patronage.sources.retail_view import raw_lines, table
from datetime import datetime

RETAIL = DEFAULTS.with_(expected_date_min=datetime(1995, 1, 1), expected_date_max=datetime(2001, 12, 31))

_CONTEXTS: dict[tuple[str, str], "Context"] = {}


class Context:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.settings = spark, folder, RETAIL

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def raw(self) -> DataFrame:
        return raw_lines(self.spark, self.folder)

    @cached_property
    def distinct(self) -> DataFrame:
        return materialise(C.drop_exact_duplicates(C.drop_incomplete(self.raw)), "distinct-lines", compact=True)

    @cached_property
    def fences(self) -> C.Fences:
        return C.fitted_fences(self.distinct, self.settings)

    @cached_property
    def clean(self) -> DataFrame:
        return materialise(C.clean_distinct(self.distinct, self.settings, self.fences), "clean-lines", compact=True)

    @cached_property
    def cutoffs(self) -> tuple[datetime, datetime]:
        return X.cutoffs(self.clean, self.settings)

    @cached_property
    def train(self) -> DataFrame:
        """Training snapshot with labels, engagement score filled."""
        at = [self.cutoffs[0]]
        features = X.customer_features(self.clean, at, self.settings, popularity=self.popularity, pairs=self.pairs)
        base = materialise(X.with_labels(features, self.clean, at, self.settings),
                           "train-base", *X.KEY)
        return materialise(E.fill_engagement(base, base), "train-snapshot", *X.KEY)

    @cached_property
    def pairs(self) -> DataFrame:
        return X.written_pairs(X.point_in_time(self.clean, [self.cutoffs[0]]))

    @cached_property
    def popularity(self) -> DataFrame:
        return materialise(X.product_popularity(self.pairs), "popularity")

    @cached_property
    def scoring(self) -> DataFrame:
        base = X.customer_features(self.clean, [self.cutoffs[1]], self.settings, popularity=self.popularity)
        return materialise(E.fill_engagement(materialise(base, "scoring-base", *X.KEY), self.train), "scoring-snapshot", *X.KEY)

    # stand-in scores: a hash of the customer, so that operators on given scores have an SQL check
    @property
    def scored_train(self) -> DataFrame:
        unit = lambda s: hash_unit(F.col("customer_id"), s)
        return self.train.select(
            "customer_id", F.col("churn").alias("y"), F.col("clv_target").alias("target"), "next_category",
            (F.floor(unit("score") * 500) / F.lit(500.0)).alias("p"),
            F.round(F.greatest(F.col("clv_target") * (F.lit(0.5) + unit("clv")), F.lit(0.0)) + 10 * unit("noise"), 4).alias("prediction"))

    @property
    def scored(self) -> DataFrame:
        unit = lambda s: hash_unit(F.col("customer_id"), s)
        return (self.scoring.withColumn("churn_probability", F.floor(unit("score") * 500) / F.lit(500.0))
                .withColumn("segment_id", F.floor(unit("segment") * 5).cast("int"))
                .withColumn("is_anomaly", unit("anomaly") > 0.95))


def context(spark: SparkSession, folder: str) -> Context:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, folder)
    return _CONTEXTS[key]
