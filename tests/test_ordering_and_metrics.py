from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronage.config import DEFAULTS
from patronage.functions import ordering as O
from patronage.operators import encode as E
from patronage.operators import evaluate as M
from patronage.plans import reports as Q


def heavy_values(n=3000, seed=3):
    """A third of the rows share one value; negatives, zeros and tiny numbers occur."""
    rng = random.Random(seed)
    return [0.25 if i % 3 == 0 else rng.choice([0.0, -1.5, rng.gauss(0, 100), rng.random() * 1e-9, float(rng.randrange(20))]) for i in range(n)]


def test_quantiles_by_group(spark):
    v = heavy_values()
    df = spark.createDataFrame([(i % 4, x) for i, x in enumerate(v)] + [(0, None)], "g int, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.777, "e": 1.0}
    got = {r["g"]: r for r in O.exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g in range(4):
        want = np.quantile([x for i, x in enumerate(v) if i % 4 == g], list(probs.values()))
        assert [got[g][k] for k in probs] == pytest.approx(list(want), rel=1e-12, abs=1e-15)
    whole = O.exact_quantiles(df, "v", probs).first()
    assert [whole[k] for k in probs] == pytest.approx(list(np.quantile(v, list(probs.values()))), rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("down", [False, True])
def test_running_totals(spark, down):
    v = sorted(set(heavy_values()))
    df = spark.createDataFrame([(x, i % 5) for i, x in enumerate(v)], "v double, n int")
    got = {r["v"]: r["cum_n"] for r in O.running_totals(df, "v", ["n"], descending=down).collect()}
    pairs = [(x, i % 5) for i, x in enumerate(v)]
    total = 0
    for x, n in (reversed(pairs) if down else pairs):
        total += n
        assert got[x] == total


def test_ranks(spark):
    v = heavy_values()
    df = spark.createDataFrame(list(enumerate(v)), "id long, v double")
    want = pd.Series(v).rank(method="average")
    got = {r["v"]: r["avg_rank"] for r in O.average_ranks(df, "v").collect()}
    assert all(got[x] == w for x, w in zip(v, want))
    rows = {r["id"]: r["row_number"] for r in O.global_row_number(df, "v", "id").collect()}
    assert [i for i, _ in sorted(rows.items(), key=lambda kv: kv[1])] == [i for i, _ in sorted(enumerate(v), key=lambda p: (p[1], p[0]))]


def test_share_at_or_below(spark):
    ref, ask = [1.0, 1.0, 2.0, 5.0], [0.5, 1.0, 3.0, 9.0]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "value double")
    got = {r["value"]: r["share"] for r in O.share_at_or_below(frame(ref), frame(ask)).collect()}
    assert [got[x] for x in ask] == [0.0, 0.5, 0.75, 1.0]


def scores(n=2000):
    rng = np.random.default_rng(0)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.round(np.clip(y * 0.3 + rng.random(n) * 0.7, 0, 1), 2)
    return y, p


def test_auc_and_threshold_against_brute_force(spark):
    y, p = scores()
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double").persist()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())
    assert M.roc_auc(df, "y", "p").first()["roc_auc"] == pytest.approx(auc, rel=1e-12)
    best = None
    for t in np.unique(p):
        tp, fp, fn = ((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum(), ((p < t) & (y == 1)).sum()
        f1, recall = 2 * tp / (2 * tp + fp + fn), tp / (tp + fn)
        if recall >= 0.7 and (best is None or f1 > best[0]):
            best = (f1, t)
    row = M.best_threshold(df, "y", "p", 0.7).first()
    assert row["threshold"] == best[1] and row["f1"] == pytest.approx(best[0])
    c = M.confusion(df, "y", "p", row["threshold"]).first()
    assert c["recall"] >= 0.7 and c["tp"] + c["fn"] == y.sum() and c["f1"] == pytest.approx(best[0])
    none = M.best_threshold(df, "y", "p", 1.5).first()  # recall out of reach: best F1 of all
    assert none["f1"] >= row["f1"]


def test_splits_and_folds_are_stratified_to_the_row_and_stable(spark):
    df = spark.range(2013).withColumn("y", F.when(F.col("id") % 10 < 3, 1).when(F.col("id") % 671 != 5, 0))
    got = M.stratified_parts(df, "y", "id").persist()
    n = {(r["s"], r["y"]): r["count"] for r in got.groupBy(F.col("split").alias("s"), "y").count().collect()}
    for y in (0, 1, None):
        size = sum(v for k, v in n.items() if k[1] == y)
        assert abs(n[("train", y)] - 0.7 * size) <= 0.5 and abs(n[("train", y)] + n.get(("val", y), 0) - 0.85 * size) <= 0.5
    for y in (0, 1):
        folds = [r["count"] for r in got.where(f"split = 'train' AND y = {y}").groupBy("fold").count().collect()]
        assert len(folds) == DEFAULTS.cv_folds and max(folds) - min(folds) <= 1
    again = M.stratified_parts(df.repartition(5), "y", "id").select("id", F.col("split").alias("s"), F.col("fold").alias("f"))
    assert got.join(again, "id").where("split <> s OR fold <> f").isEmpty()
    other = M.stratified_parts(df, "y", "id", DEFAULTS.with_(seed=1)).select("id", F.col("split").alias("s"))
    assert not got.join(other, "id").where("split <> s").isEmpty()


def test_close_values_spread_over_range_partitions(spark, monkeypatch):
    """A million scores in [0.999, 1): no range partition holds much more than its share."""
    monkeypatch.setattr(O, "ONE_TASK", 1000)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        df = spark.range(1_000_000).select((F.lit(0.999) + F.col("id") / 1e9).alias("p"), (F.col("id") % 2).cast("int").alias("y"))
        sizes = [r["count"] for r in O.in_ranges(df, ["p"]).groupBy("_part").count().collect()]
        assert len(sizes) >= 8 and max(sizes) < 3 * 1_000_000 / len(sizes)
        assert M.roc_auc(df, "y", "p").first()["roc_auc"] == pytest.approx(0.5, abs=1e-5)
        top = O.exact_quantiles(df, "p", {"q": 0.25}).first()["q"]
        assert top == pytest.approx(0.999 + 0.25 * 999_999 / 1e9, rel=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(params=[1_000_000, 20])
def one_task(request, monkeypatch):
    monkeypatch.setattr(O, "ONE_TASK", request.param)


def test_order_is_the_same_with_and_without_range_partitions(spark, one_task):
    test_quantiles_by_group(spark)
    test_running_totals(spark, False)
    test_running_totals(spark, True)
    test_ranks(spark)
    test_share_at_or_below(spark)
    test_auc_and_threshold_against_brute_force(spark)



def test_forecast_cases(spark):
    months = pd.date_range("2010-01-01", periods=25, freq="MS")
    rows = [(m.to_pydatetime(), float(v), (m + pd.offsets.MonthEnd(0)).to_pydatetime()) for m, v in zip(months, np.linspace(100, 200, 25))]
    schema = "month timestamp_ntz, revenue double, last_date timestamp_ntz"
    full = spark.createDataFrame(rows, schema)
    fc = Q.forecast(Q.drop_partial_last_month(full), 3).orderBy("month").collect()
    rev = np.linspace(100, 200, 25)
    assert [r["revenue"] for r in fc] == pytest.approx([rev[13 + i] * rev[-12:].sum() / rev[-24:-12].sum() for i in range(3)])
    assert "seasonal" in fc[0]["method"] and fc[0]["month"] == pd.Timestamp("2012-02-01").to_pydatetime()
    short = Q.forecast(spark.createDataFrame(rows[:10], schema), 2).orderBy("month").collect()
    assert short[0]["method"] == "linear trend" and short[0]["revenue"] == pytest.approx(rev[10])
    one = Q.forecast(spark.createDataFrame(rows[:1], schema), 2).collect()
    assert [r["revenue"] for r in one] == [100.0, 100.0]
    falling = spark.createDataFrame([(m, 100.0 - 30 * i, d) for i, (m, _v, d) in enumerate(rows[:4])], schema)
    assert min(r["revenue"] for r in Q.forecast(falling, 3).collect()) == 0.0
    partial = spark.createDataFrame(rows[:-1] + [(rows[-1][0], 5.0, rows[-1][0] + pd.Timedelta(days=5))], schema)
    assert Q.drop_partial_last_month(partial).count() == 24


def test_step_lookup_over_parts_drawn_from_the_values(spark):
    """Close values, values below and above all steps, and steps met exactly: as a plain search."""
    rng = np.random.default_rng(8)
    ref = {"recency_days": 0.999 + rng.random(4000) / 1e6, "frequency": rng.integers(1, 30, 4000).astype(float), "total_spend": rng.normal(0, 100, 4000)}
    train = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(*ref.values())], "recency_days double, frequency double, total_spend double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few steps are one part
    try:
        steps = E.ecdf_steps(train.repartition(6)).persist()
        steps.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert steps.select("part").distinct().count() > 3
    asked = [(m, float(v)) for m, values in ref.items() for v in [*rng.choice(values, 40), values.min() - 1, values.max() + 1, *(rng.choice(values, 20) + 1e-7)]]
    got = E.step_lookup(spark.createDataFrame(sorted(set((m, round(v, 6)) for m, v in asked)), "metric string, value double"), steps).collect()
    assert len(got) == len(set((m, round(v, 6)) for m, v in asked))
    for r in got:
        assert r["share"] == pytest.approx((np.round(ref[r["metric"]], 6) <= r["value"] + 1e-12).mean(), abs=1e-12)


def test_quantiles_of_small_groups_take_one_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(f"g{i % 13}", float(i * 37 % 101) if i % 10 else None) for i in range(1500)], "g string, v double").withColumn("one", F.lit(1))
    small = O.exact_quantiles(df, "v", {"q1": 0.25, "q2": 0.5}, ["one", "g"])
    assert small._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r["g"]: (r["q1"], r["q2"]) for r in small.collect()}
    monkeypatch.setattr(O, "ONE_TASK", 5)
    assert got == {r["g"]: (r["q1"], r["q2"]) for r in O.exact_quantiles(df, "v", {"q1": 0.25, "q2": 0.5}, ["one", "g"]).collect()}
