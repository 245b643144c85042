"""Means and covariances of many columns in one pass."""
from __future__ import annotations

import numpy as np
import pytest

from patronage.operators import encode as E


def test_moments_equal_plain_ones_without_an_aggregate_a_pair(spark, monkeypatch):
    """Without the matrix product 12 columns are 78 aggregates of products, 25 are 325."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 12)) @ rng.normal(size=(12, 12)) + 1e6
    names = [f"c {i}" for i in range(12)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"`{n}` double" for n in names)).repartition(3)
    asked, agg = [], type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: (asked.append(len(a)), agg(self, *a))[1])
    means, cov, n = E.moment_row(df, names)
    assert n == 500 and max(asked) <= 12
    assert means == pytest.approx(x.mean(0), rel=1e-12)
    assert cov == pytest.approx(np.cov(x.T, bias=True), rel=1e-9, abs=1e-9)


def test_moments_leave_out_nulls_by_pair_and_keep_what_is_not_a_number(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 7.0), (4.0, 8.0, None), (None, 1.0, float("nan"))]
    means, cov, n = E.moment_row(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert n == 4
    assert means[:2] == pytest.approx([7 / 3, 11 / 3]) and np.isnan(means[2])
    assert cov[0, 0] == pytest.approx(np.var([1, 2, 4])) and cov[1, 1] == pytest.approx(np.var([2, 8, 1]))
    ca, cb = 7 / 3, 11 / 3  # products around the means of each column
    assert cov[0, 1] == pytest.approx(np.mean([(1 - ca) * (2 - cb), (4 - ca) * (8 - cb)]))
    with pytest.raises((TypeError, ValueError)):
        E.moment_row(spark.createDataFrame([(1.0, None)], "a double, b double"), ["a", "b"])
