"""All registered queries."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from registry import data_queries, feature_queries, model_queries, quality_queries, report_queries  # noqa: F401
from registry.base import ORACLES, QUERIES
from registry.context import context


def _bind(fn) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fn(context(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(fn) for name, fn in QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
