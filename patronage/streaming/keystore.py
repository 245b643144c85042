"""Keys that a stream has stored: segments that are merged in tiers, each with membership filters.

A micro-batch writes one small segment. FANIN segments of a tier are merged into one of the next, so a lookup reads at
most FANIN - 1 segments a tier, however many batches there were. Keys lie in folders by month, and every (segment,
month, bucket) has a Bloom filter of FILTER_BITS bits a key: a lookup first asks the filters of the months of its own
keys, and reads stored keys only for those that some filter may hold. A wrong "maybe" costs a read, never a key.

A batch that runs again replaces its own segment and does not see it; merges take earlier batches only. A merge counts
once its folder is complete; until the merged segments are gone, the wider one stands for them.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.session import materialise

FANIN = 16
FILTER_BITS, FILTER_HASHES = 12, 6
#: Keys that one filter row holds, about.
BUCKET_KEYS = 50_000
#: Keys that meet a filter at once, about.
ASKED_KEYS = 200_000


@dataclass(frozen=True)
class Segment:
    first: int  # batches it holds
    last: int
    path: str

    @property
    def size(self) -> int:
        return self.last - self.first + 1


def _places(digest: pd.Series, bits: int) -> np.ndarray:
    """FILTER_HASHES x keys: bit places of digests (16 bytes), from two halves of each."""
    halves = np.frombuffer(b"".join(digest), ">u8").astype(np.uint64).reshape(-1, 2)
    a, b = halves[:, 0], halves[:, 1] | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(FILTER_HASHES)]).astype(np.int64)


class KeyStore:
    """Distinct keys (md5 in hex) by month, under one folder."""

    def __init__(self, spark: SparkSession, folder: str, fanin: int = FANIN) -> None:
        self.spark, self.folder, self.fanin = spark, folder.rstrip("/"), fanin
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ segments
    def segments(self, before: int | None = None) -> list[Segment]:
        """Complete segments of batches below ``before``, widest first; those inside a wider one left out."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = []
        for status in self._fs.listStatus(self._path(self.folder)):
            name = re.fullmatch(r"seg-(\d+)-(\d+)", status.getPath().getName())
            path = f"{self.folder}/{status.getPath().getName()}"
            if name and self._fs.exists(self._path(f"{path}/filters/_SUCCESS")):
                found.append(Segment(int(name[1]), int(name[2]), path))
        out: list[Segment] = []
        for s in sorted(found, key=lambda s: (-s.size, s.first)):
            if not any(w.first <= s.first and s.last <= w.last for w in out) and (before is None or s.last < before):
                out.append(s)
        return out

    def _write(self, keys: DataFrame, segment: Segment) -> None:
        """Keys, then their filters: a segment counts once the filters are complete."""
        keys.write.mode("overwrite").option("compression", "zstd").partitionBy("invoice_month").parquet(f"{segment.path}/keys")
        back = self._keys([segment])
        sizes = back.groupBy("invoice_month").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET_KEYS)).cast("int").alias("buckets")).withColumnRenamed("invoice_month", "_month")
        dealt = back.join(sizes, F.col("invoice_month") == F.col("_month")).withColumn("bucket", F.pmod(F.xxhash64("_key"), F.col("buckets")).cast("int"))

        def filters(rows: pd.DataFrame) -> pd.DataFrame:
            bits = max(64, FILTER_BITS * len(rows))
            marks = np.zeros(bits, dtype=bool)
            marks[_places(rows["digest"], bits).ravel()] = True
            return pd.DataFrame({"invoice_month": rows["invoice_month"].iloc[:1], "bucket": rows["bucket"].iloc[:1], "buckets": rows["buckets"].iloc[:1],
                                 "bits": [bits], "marks": [np.packbits(marks).tobytes()]})

        made = dealt.select("invoice_month", "bucket", "buckets", F.unhex("_key").alias("digest")).groupBy("invoice_month", "bucket").applyInPandas(
            filters, "invoice_month string, bucket int, buckets int, bits long, marks binary")
        made.write.mode("overwrite").parquet(f"{segment.path}/filters")

    def _keys(self, segments: list[Segment]) -> DataFrame:
        schema = "_key string, invoice_month string"
        parts = [self.spark.read.schema(schema).parquet(f"{s.path}/keys") for s in segments]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # ------------------------------------------------------------ use
    def unseen(self, arrived: DataFrame, batch_id: int) -> DataFrame:
        """Rows of ``arrived`` (invoice_month, _key and others) whose key no earlier batch has stored."""
        segments = self.segments(batch_id)
        if not segments:
            return arrived
        months = [r["invoice_month"] for r in arrived.select("invoice_month").distinct().collect()]  # months of one batch
        maybe = None
        for s in segments:
            filters = self.spark.read.parquet(f"{s.path}/filters").where(F.col("invoice_month").isin(months))
            hit = _maybe_held(arrived.select("invoice_month", "_key"), filters)
            maybe = hit if maybe is None else maybe.unionByName(hit)
        maybe = maybe.distinct().persist()
        try:
            if maybe.isEmpty():
                return arrived
            stored = self._keys(segments).where(F.col("invoice_month").isin(months))
            known = materialise(stored.join(maybe, ["invoice_month", "_key"], "left_semi").select("invoice_month", "_key").distinct(), "known-keys")
            return arrived.join(known, ["invoice_month", "_key"], "left_anti")
        finally:
            maybe.unpersist()

    def add(self, keys: DataFrame, batch_id: int) -> None:
        """Store the keys of a batch; what earlier batches left is merged first where a tier is full."""
        self.merge(batch_id)
        self._write(keys.select("_key", "invoice_month"), Segment(batch_id, batch_id, f"{self.folder}/seg-{batch_id}-{batch_id}"))

    def merge(self, before: int) -> None:
        """Merge full tiers of batches below ``before`` and delete what wider segments hold."""
        size = 1
        while True:
            tier = sorted((s for s in self.segments(before) if size <= s.size < size * self.fanin), key=lambda s: s.first)
            if len(tier) < self.fanin:
                if not any(s.size >= size * self.fanin for s in self.segments(before)):
                    break
                size *= self.fanin
                continue
            wide = Segment(tier[0].first, tier[-1].last, f"{self.folder}/seg-{tier[0].first}-{tier[-1].last}")
            self._write(self._keys(tier).distinct(), wide)
            for s in tier:
                self._fs.delete(self._path(s.path), True)
            size *= self.fanin


def _marked(key: pd.Series, bits: int, marks: bytes) -> np.ndarray:
    places, held = _places(key.map(bytes.fromhex), bits), np.frombuffer(marks, np.uint8)
    return ((held[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(0)


def _may_hold(key, bits, marks):
    """Column form of the test, for a few keys: every row carries its filter."""
    @F.pandas_udf("boolean")
    def test(key: pd.Series, bits: pd.Series, marks: pd.Series) -> pd.Series:
        out = np.zeros(len(key), dtype=bool)
        for held in marks.unique():
            mine = (marks == held).to_numpy()
            out[mine] = _marked(key[mine], int(bits[mine].iloc[0]), held)
        return pd.Series(out)
    return test(key, bits, marks)


def _maybe_held(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """(invoice_month, _key) of ``keys`` that the filters of one segment may hold.

    Keys and their filter meet as a group, so a filter is sent once a group and not once a key. A bucket that very many keys ask
    is dealt out in parts of about ASKED_KEYS keys, each with a copy of the filter.
    """
    place = ["invoice_month", "bucket"]
    counts = filters.groupBy("invoice_month").agg(F.max("buckets").alias("_n"))
    asked = keys.join(counts, "invoice_month").withColumn("bucket", F.pmod(F.xxhash64("_key"), F.col("_n")).cast("int")).drop("_n")
    parts = asked.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKED_KEYS)).cast("int").alias("parts"))
    parts = materialise(parts, "asked-buckets")
    dealt = asked.join(parts, place).withColumn("part", F.pmod(F.xxhash64("_key", F.lit("part")), F.col("parts")).cast("int"))
    copies = filters.join(parts, place).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def test(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return pd.DataFrame({"invoice_month": [], "_key": []}, dtype=object)
        return asking.loc[_marked(asking["_key"], int(held["bits"].iloc[0]), held["marks"].iloc[0]), ["invoice_month", "_key"]]

    group = [*place, "part"]
    left = dealt.select(*group, "_key").groupBy(*group)
    right = copies.select(*group, "bits", "marks").groupBy(*group)
    return left.cogroup(right).applyInPandas(test, "invoice_month string, _key string")
