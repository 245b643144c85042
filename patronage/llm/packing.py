"""Token ids packed into fixed-length sequences: best-fit decreasing with a segment tree over free capacity.

Texts are encoded with a public byte-pair vocabulary (a rank file; its path is a parameter) and closed with an
end token. A document longer than a sequence is split without loss: full pieces, then the rest. Every task packs
shards of at most SHARD_TOKENS tokens on its own, so nothing is shuffled and memory is bounded; within a shard,
pieces go by falling length into the sequence with the least room that still holds them, found by a segment
tree over capacities.

A row is a sequence: ids and position ids as little-endian matrix rows of ``seq_len`` (padded with the end
token; positions restart at 0 for each piece), cumulative piece lengths, and for each piece its document and
its number within the document.

Defined results: null text counts as empty and gives the end token alone; a null doc_id is kept; repeated rows
are packed each; an empty table gives no rows; further columns are not read.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import map_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is split before the merges: goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 64 << 20
SEQ_LEN = 2048
SHARD_TOKENS = 4 << 20
SCHEMA = ("shard int, sequence int, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
          "doc_ids array<long>, pieces array<int>")


class Encoder:
    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        self.dtype = "<u2" if self.end < 1 << 16 else "<u4"

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text and the end token."""
        ids = self.encoding.encode_to_numpy(text or "", disallowed_special=())
        return np.append(ids, np.uint32(self.end)).astype(self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode([int(i) for i in ids if i != self.end])


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


class CapacityTree:
    """How many open sequences have each free capacity; finds the least capacity that holds a length."""

    def __init__(self, most: int) -> None:
        self.base = 1 << (most + 1).bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        i = self.base + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, sequence) of the tightest fit, removed from the tree."""
        i = self.base + length
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.base
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items by number in each sequence. Equal lengths keep their order."""
    tree, out = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fit = tree.take(lengths[i])
        if fit is None:
            room, at = capacity, len(out)
            out.append([])
        else:
            room, at = fit
        out[at].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], at)
    return out


def _shard(number: int, first: int, held: list[tuple], seq_len: int, end: int, dtype: str) -> dict[str, list]:
    """Rows of one shard; held: (doc_id, piece, ids)."""
    plan = best_fit_decreasing([len(ids) for _, _, ids in held], seq_len)
    matrix = np.full((len(plan), seq_len), end, dtype)
    places = np.zeros((len(plan), seq_len), "<u2" if seq_len <= 1 << 16 else "<u4")
    out: dict[str, list] = {k: [] for k in ("shard", "sequence", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "pieces")}
    ramp = np.arange(seq_len)
    for row, items in enumerate(plan):
        ends, upto = [0], 0
        for i in items:
            ids = held[i][2]
            matrix[row, upto:upto + len(ids)] = ids
            places[row, upto:upto + len(ids)] = ramp[:len(ids)]
            upto += len(ids)
            ends.append(upto)
        for k, v in (("shard", number), ("sequence", first + row), ("n_tokens", upto), ("input_ids", matrix[row].tobytes()), ("position_ids", places[row].tobytes()),
                     ("cu_seqlens", ends), ("doc_ids", [held[i][0] for i in items]), ("pieces", [held[i][1] for i in items])):
            out[k].append(v)
    return out


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, seq_len: int = SEQ_LEN, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per packed sequence, see above. ``shard`` is the task, ``sequence`` counts within it."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file(docs.sparkSession, vocabulary))

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        encoder = _encoder(shared.value, pattern)
        task, first, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder.encode(text)
                for piece, start in enumerate(range(0, len(ids), seq_len)):
                    part = ids[start:start + seq_len]
                    held.append((doc_id, piece, part))
                    size += len(part)
                    if size >= shard_tokens:
                        yield (rows := _shard(task, first, held, seq_len, encoder.end, encoder.dtype))
                        first, held, size = first + len(rows["shard"]), [], 0
        if held:
            yield _shard(task, first, held, seq_len, encoder.end, encoder.dtype)

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SCHEMA, work)


def rank_file(spark: SparkSession, path: str) -> bytes:
    """The vocabulary, read by Spark so that any store will do; its size is checked before it is broadcast."""
    found = spark.read.format("binaryFile").load(path).select("length", "content").where(F.col("length") <= MAX_VOCABULARY_BYTES).first()
    if found is None:
        raise ValueError(f"{path} is over {MAX_VOCABULARY_BYTES} bytes: no vocabulary")
    return bytes(found["content"])


def documents_of(rows: list, dtype: str = "<u2") -> dict:
    """Ids of each document from rows of ``packed``: the way back."""
    parts: dict = {}
    for row in rows:
        ids = np.frombuffer(row["input_ids"], dtype)
        for k, (doc_id, piece) in enumerate(zip(row["doc_ids"], row["pieces"])):
            parts.setdefault(doc_id, {})[piece] = ids[row["cu_seqlens"][k]:row["cu_seqlens"][k + 1]]
    return {doc_id: np.concatenate([p[i] for i in sorted(p)]) for doc_id, p in parts.items()}
