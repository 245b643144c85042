"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of whole texts in a bounded, seeded sample (about ``docs_per_language`` rows of each
label); Spark sums the counts per (label, bucket). The log-probability matrix (labels x buckets) is
broadcast; its size is bounded by MATRIX_BYTES, since more labels take fewer buckets. Scoring turns the texts
of a batch into a sparse matrix (bucket indices and row offsets) and sums gathered log-probabilities.

Defined results: a text that is null or holds no letter gets ``und`` and score 0; without any training row
every text gets ``und``; equal scores go to the first label in order; repeated rows are scored each; further
columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import map_rows

UNKNOWN = "und"
ORDERS = (1, 2, 3)
DOCS_PER_LANGUAGE = 1000
MATRIX_BYTES = 32 << 20
MAX_LABELS = 4096
BITS = 16
BLOCK = 1 << 17
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


@dataclass
class LanguageModel:
    labels: list[str]
    log_prob: np.ndarray  # labels x buckets
    log_prior: np.ndarray
    bits: int
    orders: tuple[int, ...] = ORDERS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def buckets(text: str, bits: int, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Bucket of every character n-gram of a text, lower-cased, in blocks of bounded size."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    widest, shift = max(orders), np.uint64(64 - bits)
    for start in range(0, len(codes), BLOCK):
        part = codes[start:start + BLOCK + widest - 1].astype(np.uint64)
        inside = min(BLOCK, len(codes) - start)
        grams = part + np.uint64(1)
        for order in range(1, widest + 1):
            if order > 1:
                grams = grams[:-1] * _STEP + part[order - 1:]
            if order in orders and len(grams):
                yield (((grams[:inside] + np.uint64(order)) * _MULTIPLY) >> shift).astype(np.int64)


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, orders: tuple[int, ...] = ORDERS, smoothing: float = 0.5,
          seed: int = 42) -> LanguageModel:
    """Fit on rows (doc_id, text, lang) that aren't held out; rows without text or label don't count."""
    usable = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels in lang: not languages")
    if not sizes:
        return LanguageModel([], np.zeros((0, 2), "float32"), np.zeros(0), 1, orders)
    bits = BITS
    while bits > 8 and (4 << bits) * len(sizes) > MATRIX_BYTES:
        bits -= 1
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, docs_per_language / n)) for k, n in sizes.items()], "_lang string, _share double")
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = usable.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(unit < F.col("_share")).select("text", "lang")
    labels = sorted(sizes)

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, label in zip(batch["text"], batch["lang"]):
                mine = found.setdefault(label, np.zeros(1 << bits, np.int64))
                for part in buckets(text, bits, orders):
                    mine += np.bincount(part, minlength=1 << bits)
        for label, mine in found.items():
            there = np.flatnonzero(mine)
            yield {"lang": [label] * len(there), "bucket": there, "n": mine[there]}

    counts = (map_rows(sample, "lang string, bucket int, n long", count).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toArrow()
    table = np.zeros((len(labels), 1 << bits))
    row = {k: i for i, k in enumerate(labels)}
    at = np.array([row[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)
    table[at, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    table += smoothing
    log_prob = np.log(table / table.sum(1, keepdims=True)).astype("float32")
    prior = np.log(np.array([sizes[k] for k in labels], dtype=float) / sum(sizes.values()))
    return LanguageModel(labels, log_prob, prior, bits, orders)


def log_scores(texts: list[str], model: LanguageModel) -> np.ndarray:
    """Joint log-probability of each text and label: sparse rows of bucket indices times the matrix, in bounded blocks."""
    out = np.tile(model.log_prior, (len(texts), 1))
    indices, rows, size = [], [], 0

    def flush() -> None:
        if not indices:
            return
        flat = np.concatenate(indices)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in indices])[:-1]])
        for k, line in enumerate(model.log_prob):
            np.add.at(out[:, k], rows, np.add.reduceat(line[flat], starts, dtype=np.float64))
        indices.clear()
        rows.clear()

    for i, text in enumerate(texts):
        for part in buckets(text, model.bits, model.orders):
            indices.append(part)
            rows.append(i)
            size += len(part)
        if size >= 1 << 20:
            flush()
            size = 0
    flush()
    return out


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def best(texts: list[str | None], model: LanguageModel) -> tuple[list[str], list[float]]:
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    lettered = [i for i, t in enumerate(texts) if t and model.labels and has_letter(t)]
    if lettered:
        joint = log_scores([texts[i] for i in lettered], model)
        top = joint.argmax(1)
        share = 1.0 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
        for i, k, s in zip(lettered, top, share):
            labels[i], scores[i] = model.labels[k], float(min(1.0, s))
    return labels, scores


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text is an input of a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            labels, scores = best(batch["text"], shared.value)
            yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": labels, "score": scores}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(rows, "doc_id long, held_out boolean, lang_pred string, score double", score)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """The documents whose language is identified with at least ``min_score``; all columns as given.

    The prediction is a column function of the text alone, so no join by id is needed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def identified(texts: pd.Series) -> pd.Series:
        labels, scores = best(texts.tolist(), shared.value)
        return pd.Series([k != UNKNOWN and s >= min_score for k, s in zip(labels, scores)])

    return docs.where(identified(F.col("text")))
