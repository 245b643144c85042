"""The stream's key store against a plain set: nothing lost, nothing twice, few segments after many batches."""
from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from patronage.streaming import keystore as S


def batch(spark, numbers):
    df = spark.createDataFrame([(int(n),) for n in numbers], "n long")
    return df.select("n", F.concat(F.lit("2011-0"), (F.col("n") % 3 + 1).cast("string")).alias("invoice_month"), F.md5(F.col("n").cast("string")).alias("_key"))


def test_many_batches_store_each_key_once_in_few_segments(spark, tmp_path):
    store, seen, rng = S.KeyStore(spark, str(tmp_path / "keys"), fanin=3), set(), random.Random(4)
    for b in range(20):
        numbers = {rng.randrange(120) for _ in range(15)}
        new = store.unseen(batch(spark, numbers), b).persist()
        assert {r["n"] for r in new.collect()} == numbers - seen
        store.add(new, b)
        if b % 7 == 3:  # the batch runs again: it doesn't see its own keys, and replaces them
            again = store.unseen(batch(spark, numbers), b).persist()
            assert {r["n"] for r in again.collect()} == numbers - seen
            store.add(again, b)
        seen |= numbers
        segments = store.segments()
        assert len(segments) <= 2 * 3 + 1  # at most fanin - 1 a tier and the batch's own
    held = store._keys(store.segments())
    assert held.count() == held.distinct().count() == len(seen)
    assert sum(s.size for s in store.segments()) == 20


def test_filters_never_miss_and_seldom_err(spark, tmp_path):
    store = S.KeyStore(spark, str(tmp_path / "keys"))
    store.add(batch(spark, range(3000)), 0)
    filters = spark.read.parquet(f"{store.segments()[0].path}/filters")
    asked = batch(spark, range(9000)).join(filters.withColumnRenamed("invoice_month", "m"), F.col("invoice_month") == F.col("m"))
    held = {r["n"] for r in asked.where(S._may_hold(F.col("_key"), F.col("bits"), F.col("marks"))).collect()}
    assert held >= set(range(3000)) and len(held) < 3000 + 0.01 * 6000
    assert {r["n"] for r in store.unseen(batch(spark, range(2990, 3010)), 1).collect()} == set(range(3000, 3010))


def test_a_broken_merge_is_not_read(spark, tmp_path):
    store = S.KeyStore(spark, str(tmp_path / "keys"), fanin=4)
    for b in range(3):
        store.add(batch(spark, range(10 * b, 10 * b + 10)), b)
    half = tmp_path / "keys" / "seg-0-2" / "keys"
    half.mkdir(parents=True)  # keys without filters: a merge that did not end
    assert [(s.first, s.last) for s in store.segments()] == [(0, 0), (1, 1), (2, 2)]
    assert store.unseen(batch(spark, range(25, 35)), 3).count() == 5


def test_filters_travel_once_a_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ASKED_KEYS", 100)
    store = S.KeyStore(spark, str(tmp_path / "keys"))
    store.add(batch(spark, range(3000)), 0)
    filters = spark.read.parquet(f"{store.segments()[0].path}/filters")
    found = S._maybe_held(batch(spark, range(9000)).select("invoice_month", "_key"), filters)  # 30 parts a bucket
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    held = {r["_key"] for r in found.collect()}
    stored = {r["_key"] for r in batch(spark, range(3000)).collect()}
    assert held >= stored and len(held) < 3000 + 0.01 * 6000
