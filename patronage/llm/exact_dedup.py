"""Exact duplicates by a cuckoo-filter index over digests of normalised texts.

A digest is the SHA-256 of the text after each run of white space became one space. Every task keeps a
cuckoo filter whose slots also hold the stored keys: a fingerprint hit is verified against the key in that
bucket, an overflow doubles the table from the stored keys, and live digests can be deleted.

Two passes: each task first folds its own rows (a text that a third of all rows share leaves one row per
task), then digests are hash-partitioned and the same index folds what the tasks found.

Exactly one row of each group of equal texts stays: of the rows with the smallest doc_id (none: of all rows), the one
whose text as given has the smaller digest; of rows that are equal in all that, any one.

Defined results: null text counts as empty, and comes before an empty one where rows tie; a null doc_id never wins over
a number; an empty table gives no rows; further columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import map_rows
from patronage.session import materialise

SLOTS = 4
MAX_KICKS = 200
ENTRY = "digest binary, keep_id long, group_size long"


class CuckooIndex:
    """Cuckoo filter with the keys of its fingerprints: insert, find, delete, resize."""

    def __init__(self, buckets: int = 256) -> None:
        self.resizes = 0
        self._clear(1 << max(2, (buckets - 1).bit_length()))

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[list[tuple[bytes, list]]] = [[] for _ in range(buckets)]
        self.size = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, key: bytes) -> list | None:
        """The entry of a live key; a fingerprint hit counts only if the stored key is the same."""
        mark, first, second = self._places(key)
        for place in (first, second):
            if mark in self.marks[place]:
                for stored, entry in self.content[place]:
                    if stored == key:
                        return entry
        return None

    def insert(self, key: bytes, entry: list) -> None:
        """Add a key that isn't live yet. An overflow doubles the table; keys that share a fingerprint and both
        buckets with too many others gain nothing by that and go over the slot limit of their bucket."""
        left = self._place(key, entry)
        if left is not None and 2 * self.size > SLOTS * (self.mask + 1):
            everything = [*self.items(), left]
            self._clear(2 * (self.mask + 1))
            self.resizes += 1
            for k, e in everything:
                left = self._place(k, e)
                if left is not None:
                    self._put(self._places(left[0])[1], *left)
        elif left is not None:
            self._put(self._places(left[0])[1], *left)

    def _put(self, place: int, key: bytes, entry: list) -> None:
        self.marks[place].append(self._places(key)[0])
        self.content[place].append((key, entry))
        self.size += 1

    def _place(self, key: bytes, entry: list) -> tuple[bytes, list] | None:
        mark, first, second = self._places(key)
        for place in (first, second):
            if len(self.marks[place]) < SLOTS:
                self._put(place, key, entry)
                return None
        place = second
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            old_mark, old = self.marks[place][slot], self.content[place][slot]
            self.marks[place][slot], self.content[place][slot] = mark, (key, entry)
            mark, (key, entry) = old_mark, old
            place = self._other(place, mark)
            if len(self.marks[place]) < SLOTS:
                self._put(place, key, entry)
                return None
        return key, entry

    def delete(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        for place in (first, second):
            for slot, (stored, _) in enumerate(self.content[place]):
                if stored == key:
                    del self.marks[place][slot], self.content[place][slot]
                    self.size -= 1
                    return True
        return False

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.content:
            yield from bucket


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, digest) of every row, and further columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), *more)


def _fold(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    index = CuckooIndex()
    for batch in batches:
        for key, keep, n in zip(batch["digest"], batch["keep_id"], batch["group_size"]):
            entry = index.find(key)
            if entry is None:
                index.insert(key, [keep, n])
            else:
                entry[1] += n
                if keep is not None and (entry[0] is None or keep < entry[0]):
                    entry[0] = keep
    yield from _written(index)


def _written(index: CuckooIndex, rows: int = 50_000) -> Iterator[dict[str, list]]:
    out: dict[str, list] = {"digest": [], "keep_id": [], "group_size": []}
    for key, (keep, n) in index.items():
        out["digest"].append(key)
        out["keep_id"].append(keep)
        out["group_size"].append(n)
        if len(out["digest"]) >= rows:
            yield out
            out = {"digest": [], "keep_id": [], "group_size": []}
    yield out


def live_index(rows: DataFrame) -> DataFrame:
    """One row per live digest (digest, keep_id = smallest doc_id, group_size) from rows of (doc_id, digest)."""
    ones = rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    by_task = map_rows(ones, ENTRY, _fold)
    return map_rows(by_task.repartition("digest"), ENTRY, _fold)


def updated_index(index: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """A live index after digests were withdrawn (rows of ``deleted``: digest) and rows were added (doc_id, digest).

    Deletions come first. A digest that isn't live may be deleted: nothing happens.
    """
    parts = [index.select("digest", "keep_id", "group_size", F.lit(0).alias("step"))]
    if deleted is not None:
        parts.append(deleted.select("digest").distinct().select(
            "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(1).alias("step")))
    if added is not None:
        parts.append(live_index(added).select("digest", "keep_id", "group_size", F.lit(2).alias("step")))
    moves = parts[0]
    for p in parts[1:]:
        moves = moves.unionByName(p)

    def apply(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        live = CuckooIndex()
        for batch in batches:
            for key, keep, n, step in zip(batch["digest"], batch["keep_id"], batch["group_size"], batch["step"]):
                if step == 1:
                    live.delete(key)
                    continue
                entry = live.find(key)
                if entry is None:
                    live.insert(key, [keep, n])
                else:
                    entry[1] += n
                    entry[0] = min((x for x in (entry[0], keep) if x is not None), default=None)
        yield from _written(live)

    return map_rows(moves.repartition("digest").sortWithinPartitions("step"), ENTRY, apply)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 — one row per document, dropped ones too."""
    raw = F.when(F.col("text").isNotNull(), F.unhex(F.sha2("text", 256)))
    rows = materialise(digests(docs, raw.alias("raw")), "digests")
    index = live_index(rows).withColumnRenamed("digest", "_digest")
    found = rows.join(index, F.col("digest") == F.col("_digest")).select("doc_id", "digest", "raw", "keep_id", "group_size")
    # rows that share the doc_id that stays are few unless ids repeat: they alone are told apart
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    found = materialise(found.withColumn("stays", stays).withColumn("row", F.monotonically_increasing_id()), "digest-groups")
    many = found.where("stays").groupBy("digest").agg(F.min(F.struct("raw", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = many.select(F.col("digest").alias("_digest"), F.col("first.row").alias("_row"))
    return found.join(many, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & F.coalesce(F.col("row") == F.col("_row"), F.lit(True))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
