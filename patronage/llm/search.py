"""Ranked lexical search with hashed max-sketches.

Every document folds the impacts of its terms (the part of the score that the document decides) into a few
coordinatewise maxima: a term has one coordinate in each of ROWS hash rows, and a coordinate keeps the largest impact
that fell on it. The smaller of a term's coordinates is never less than its impact, so batched look-ups of all
queries against a block of sketches give upper bounds of all scores. Each query then rescores documents exactly in
the order of falling bounds, until no bound reaches its threshold, the score of its k-th best document so far.

Documents never move: a task makes the sketches of its rows block by block, carries the thresholds from block to
block and hands on at most k rows a query; these meet in two steps of top-k. Queries are broadcast in blocks of at
most BLOCK_CHARS characters of items, one block after the other.

Defined results: a null or termless text has no rank and doesn't count; an item without terms has no rows; documents
without doc_id rank behind all others of their score; repeated rows are documents of their own; items are told by
item_id and text (rows that repeat both are one item); an empty table on either side gives no rows; further columns
are not read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.llm.common import map_rows
from patronage.session import materialise

K = 10
WIDTH = 2048
ROWS = 2
#: Characters of items that one broadcast takes; terms and documents that one block of documents takes, at most; cells of one
#: look-up, and of the bounds of a block.
BLOCK_CHARS = 4_000_000
BLOCK_TERMS, BLOCK_DOCS = 400_000, 2048
CELLS = 4_000_000
STEP = 16
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Postings:
    """Terms of a block of documents: one row for each (document, term)."""
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    length: np.ndarray  # terms of each document, with repeats
    names: pa.Array


def postings(tokens: list[list[bytes]]) -> Postings:
    length = np.array([len(t) for t in tokens], dtype=np.int64)
    coded = pa.array([x for t in tokens for x in t], type=pa.binary()).dictionary_encode()
    names = coded.dictionary
    key = np.repeat(np.arange(len(tokens)), length) * max(1, len(names)) + coded.indices.to_numpy().astype(np.int64)
    key, tf = np.unique(key, return_counts=True)
    return Postings(key // max(1, len(names)), key % max(1, len(names)), tf.astype(np.int64), length, names)


def blocks(batches: Iterator[dict[str, list]], most: int = BLOCK_TERMS, most_docs: int = BLOCK_DOCS) -> Iterator[tuple[list, Postings]]:
    """(doc_ids, postings) of documents with terms, about ``most`` terms and at most ``most_docs`` documents at a time."""
    ids, held, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"]):
            found = terms(text)
            if not found:
                continue
            ids.append(doc)
            held.append(found)
            size += len(found)
            if size >= most or len(ids) >= most_docs:
                yield ids, postings(held)
                ids, held, size = [], [], 0
    if held:
        yield ids, postings(held)


@dataclass
class Queries:
    """A block of items: their distinct terms, and for each item its terms with repeat counts."""
    names: pa.Array
    start: np.ndarray
    term: np.ndarray
    count: np.ndarray
    item: np.ndarray  # of each (item, term)


def compiled(texts: list[str | None]) -> Queries:
    counted = [Counter(terms(t)) for t in texts]
    names = sorted(set().union(*counted)) if counted else []
    at = {name: i for i, name in enumerate(names)}
    item = np.array([i for i, c in enumerate(counted) for _ in c], dtype=np.int64)
    return Queries(pa.array(names, type=pa.binary()), np.searchsorted(item, np.arange(len(counted))),
                   np.array([at[x] for c in counted for x in c], dtype=np.int64), np.array([n for c in counted for n in c.values()], dtype=np.int64), item)


def asked_of(found: Postings, queries: Queries) -> np.ndarray:
    """Number of the query term that each term of a block is, or -1."""
    return pc.fill_null(pc.index_in(found.names, value_set=queries.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def coordinates(names: pa.Array, width: int = WIDTH) -> np.ndarray:
    """ROWS x names: the coordinate of each term in each hash row."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(x) for x in names.to_pylist()), dtype=np.uint64, count=len(names))
    return np.stack([((hashes >> np.uint64(32 * r)) & np.uint64(0xFFFFFFFF)).astype(np.int64) % width for r in range(ROWS)])


def impacts(tf: np.ndarray, length: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """What a term that occurs tf times in a document of that length adds to a score, for each unit of its weight."""
    m = 100 - 75 + (75 * length * total_docs) // total_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def sketches(found: Postings, impact: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """documents x ROWS x width: the largest impact on each coordinate."""
    out = np.zeros((len(found.length), ROWS, width), dtype=np.int64 if len(impact) and impact.max() >= 1 << 31 else np.int32)
    for row, at in enumerate(coordinates(found.names, width)):
        np.maximum.at(out, (found.doc, row, at[found.term]), impact)
    return out


def upper_bounds(sketch: np.ndarray, at: np.ndarray, queries: Queries, weight: np.ndarray) -> np.ndarray:
    """documents x items: no score is above its bound."""
    out = np.empty((len(sketch), len(queries.start)), dtype=np.int64)
    step = max(1, CELLS // max(1, len(queries.term)))
    for a in range(0, len(sketch), step):
        least = sketch[a:a + step, 0][:, at[0]]
        for row in range(1, ROWS):
            np.minimum(least, sketch[a:a + step, row][:, at[row]], out=least)
        out[a:a + step] = np.add.reduceat(least[:, queries.term] * (queries.count * weight[queries.term]), queries.start, axis=1)
    return out


class Best:
    """The k best (score, document) of each item so far, ties by doc_id; ``least``: the k-th score of each item."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.items = k, items
        self.item, self.score, self.doc, self.none = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.least = np.zeros(items, dtype=np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        there = score > 0
        item, score, doc, none = (np.concatenate([a, b[there]]) for a, b in ((self.item, item), (self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score, item))
        item, score, doc, none = item[order], score[order], doc[order], none[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.k
        self.item, self.score, self.doc, self.none = item[kept], score[kept], doc[kept], none[kept]
        full = place == self.k - 1
        self.least[item[full]] = score[full]


class Scorer:
    """Exact scores of (document, item) pairs of a block."""

    def __init__(self, found: Postings, impact: np.ndarray, queries: Queries, weight: np.ndarray) -> None:
        self.queries, self.weighted = queries, queries.count * weight[queries.term]
        self.wide = max(1, len(queries.names))
        asked = asked_of(found, queries)[found.term]
        hit = asked >= 0
        key = found.doc[hit] * self.wide + asked[hit]
        order = np.argsort(key)
        self.key, self.impact = key[order], impact[hit][order]
        self.end = np.append(queries.start[1:], len(queries.term))

    def __call__(self, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
        if not len(doc) or not len(self.key):
            return np.zeros(len(doc), dtype=np.int64)
        size = self.end[item] - self.queries.start[item]
        first = np.cumsum(size) - size
        flat = np.repeat(self.queries.start[item] - first, size) + np.arange(size.sum())
        key = np.repeat(doc, size) * self.wide + self.queries.term[flat]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.add.reduceat(np.where(self.key[at] == key, self.impact[at], 0) * self.weighted[flat], first)


def rescored(bound: np.ndarray, score: Scorer, doc_id: np.ndarray, none: np.ndarray, best: Best, step: int = STEP) -> int:
    """Exact scores in the order of falling bounds until no bound reaches its item's threshold; the number of pairs looked at."""
    order = np.argsort(-bound, axis=0, kind="stable")
    open_items, looked = np.arange(best.items), 0
    for a in range(0, len(bound), step):
        rows = order[a:a + step, open_items]
        most = bound[rows, open_items]
        near = (most > 0) & (most >= best.least[open_items])  # an equal score with a smaller doc_id still counts
        place, column = np.nonzero(near)
        doc, item = rows[place, column], open_items[column]
        best.add(item, score(doc, item), doc_id[doc], none[doc])
        looked += len(doc)
        open_items = open_items[near[-1]]  # bounds fall: where the last one was too small, all others are
        if not len(open_items):
            break
    return looked


def statistics(docs: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all documents, documents that hold each query term)."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held = np.zeros(len(shared.value.names) + 2, dtype=np.int64)
        for ids, found in blocks(batches):
            asked = asked_of(found, shared.value)[found.term]
            held[:-2] += np.bincount(asked[asked >= 0], minlength=len(held) - 2)
            held[-2] += len(ids)
            held[-1] += found.length.sum()
        there = np.flatnonzero(held)
        yield {"term": there, "n": held[there]}

    total = np.zeros(len(queries.names) + 2, dtype=np.int64)
    rows = map_rows(docs, "term long, n long", count).groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row per query term
    total[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    shared.unpersist()
    return int(total[-2]), int(total[-1]), total[:-2]


def weights(holders: np.ndarray, total_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * total_docs + 2) / (2 * holders + 1))).astype(np.int64)


def _top(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of_block(docs: DataFrame, queries: Queries, k: int = K, width: int = WIDTH) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of every item of the block."""
    total_docs, total_terms, holders = statistics(docs, queries)
    weight = weights(holders, total_docs)
    shared = docs.sparkSession.sparkContext.broadcast((queries, weight, coordinates(queries.names, width)))

    def search(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        queries, weight, at = shared.value
        best = Best(len(queries.start), k)
        for ids, found in blocks(batches, most_docs=max(1, min(BLOCK_DOCS, 2 * CELLS // len(queries.start)))):
            impact = impacts(found.tf, found.length[found.doc], total_docs, total_terms)
            bound = upper_bounds(sketches(found, impact, width), at, queries, weight)
            none = np.array([i is None for i in ids], dtype=np.int64)
            rescored(bound, Scorer(found, impact, queries, weight), np.array([i or 0 for i in ids], dtype=np.int64), none, best)
        yield {"item": best.item, "doc_id": pa.array(best.doc, mask=best.none.astype(bool)), "score": best.score}

    found = map_rows(docs, "item int, doc_id long, score long", search)
    part = F.pmod(F.spark_partition_id(), F.lit(64))  # two steps, so that no task takes the rows of all tasks of an item
    return _top(_top(found.withColumn("_part", part), k, "item", "_part"), k, "item").select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: for every item its k best documents with a score above zero."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    asked = materialise(asked, "search-items")
    chars = asked.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    count = max(1, -(-chars // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    out = None
    for number in range(count):
        held = [(r["item_id"], r["text"]) for r in asked.where(block == number).collect() if terms(r["text"])]  # bounded by block_chars
        if not held:
            continue
        found = best_of_block(rows, compiled([t for _, t in held]), k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(held)], "_item int, item_id long")
        found = found.join(names, F.col("item") == F.col("_item")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = materialise(found, "search-block") if count > 1 else found
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


ORACLE = r"""
WITH doc_terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
item_terms AS (
  SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, docs),
impacts AS (
  SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) AS impact
  FROM tf JOIN sizes USING (row), totals),
asked AS (SELECT item_id, text, term, count(*) AS times FROM item_terms GROUP BY ALL),
scores AS (
  SELECT item_id, text, row, doc_id, sum(times * w * impact)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, text, row, doc_id),
ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks WHERE rank <= 10
"""
