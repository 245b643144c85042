"""Repeated byte strings across all documents, by prefix doubling over sampled positions.

A string of ``length`` bytes that starts at two places is found by ranks: equal strings share a rank, and the
rank of a string of twice the size is made from the pair of ranks of its halves (or of two overlapping parts).
Positions whose pair is unique leave; the others are ranked again over a longer string, up to the threshold.

* Inside a task, numpy doubles ranks (64-bit names) at offsets 1, 2, 4 ... for every position.
* Sorting pairs of *all* positions between tasks would write over twenty times the input. So Spark ranks one
  position per run of windows: of all seeds (SEED bytes) inside a window, the one with the smallest name. Equal
  windows pick the same seed at the same place, so a window whose seed is unique is unique.
* Rounds between tasks, each a grouping by rank pairs in which unique ones drop out: seeds; whole runs of
  windows; the part that BLOCK neighbouring windows share (unique: none of them repeats) and the part that they
  cover (repeated: all of them do); single windows, by the pair of ranks at offset 0 and at the rest.

Every round takes one row of a group further, so a group of copies costs what its different rows cost. Texts
are joined twice, by document, with the list of places that the document itself made.

Defined results: null text counts as empty; texts shorter than ``length`` lose nothing; rows that repeat a
doc_id and text are two documents, so all their windows repeat; null doc_ids are kept; an empty table gives no
rows; further columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import map_rows
from patronage.session import materialise, release

LENGTH = 400
SEED = 64
BLOCK = 16
#: Bytes of one text that are ranked at once in a task.
CHUNK = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NAMES = (np.arange(1, 257, dtype=np.uint64) * _B) ^ ((np.arange(1, 257, dtype=np.uint64) * _A) >> np.uint64(31))
DOC = ["doc_id", "mark"]


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = first * _A
    out ^= second + _B
    out *= _B
    out ^= out >> np.uint64(29)
    return out


def ranks(data: bytes, size: int) -> np.ndarray:
    """Name of the ``size`` bytes (a power of two) at each position, by doubling."""
    names, have = _NAMES[np.frombuffer(data, np.uint8)], 1
    while have < size:
        names, have = _pair(names[:-have], names[have:]), 2 * have
    return names


def _leftmost_least(names: np.ndarray, width: int) -> np.ndarray:
    """Index of the least name, the leftmost of equals, in every window of ``width`` names."""
    least, at, have = names, np.arange(len(names)), 1
    while have < width:
        step = min(have, width - have)
        n = len(least) - step
        later = least[step:] < least[:n]
        at = np.where(later, at[step:], at[:n])
        least = np.where(later, least[step:], least[:n])
        have += step
    return at


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def runs_of(data: bytes, length: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(at, back, ahead, name): runs of windows that share their seed; windows start at at - back ... at - ahead."""
    width = length - seed + 1
    for start in range(0, len(data) - length + 1, CHUNK):
        part = data[start:start + CHUNK + length - 1]
        names = ranks(part, seed)
        at = _leftmost_least(names, width)
        cut = np.flatnonzero(np.diff(at)) + 1
        low = np.concatenate([[0], cut])
        high = np.concatenate([cut, [len(at)]]) - 1
        yield start + at[low], at[low] - low, at[low] - high, names[at[low]].view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def sampled_runs(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """doc_id, mark, at, back, ahead, seed, span_a, span_b of every run of windows."""
    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("id", "null", "mark", "at", "back", "ahead", "seed")}
            digests: list[bytes] = []
            for doc_id, mark, text in zip(batch["doc_id"], batch["mark"], batch["text"]):
                data = text.encode()
                if len(data) < length:
                    continue
                for at, back, ahead, name in runs_of(data, length, seed):
                    for k, v in (("id", doc_id or 0), ("null", doc_id is None), ("mark", mark)):
                        cols[k].append(np.full(len(at), v))
                    for k, v in (("at", at), ("back", back), ("ahead", ahead), ("seed", name)):
                        cols[k].append(v)
                    digests += [_digest(data[a:b]) for a, b in zip((at - back).tolist(), (at - ahead + length).tolist())]
                if len(digests) > 100_000:
                    yield packed(cols, digests)
                    cols, digests = {k: [] for k in cols}, []
            if digests:
                yield packed(cols, digests)

    def packed(cols: dict[str, list], digests: list[bytes]) -> dict[str, list]:
        flat = {k: np.concatenate(v) for k, v in cols.items()}
        a, b = _halves(digests)
        return {"doc_id": pa.array(flat["id"].astype(np.int64), mask=flat["null"].astype(bool)), "mark": flat["mark"].astype(np.int64),
                "at": flat["at"].astype(np.int32), "back": flat["back"].astype(np.int16), "ahead": flat["ahead"].astype(np.int16),
                "seed": flat["seed"], "span_a": a, "span_b": b}

    return map_rows(texts, "doc_id long, mark long, at int, back short, ahead short, seed long, span_a long, span_b long", work)


def _renamed(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in df.columns if c not in keys])


def _on(*keys: str):
    cond = F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}"))
    for k in keys[1:]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return cond


def _grouped(rows: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """One row per rank: how many places have it, and one of them."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("places"), *[F.first(c).alias(c) for c in carry])


def repeated_places(docs: DataFrame, length: int = LENGTH, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(doc_id, mark, start, end): byte ranges covered by strings of ``length`` bytes that start at two places or more."""
    texts = _texts(docs)
    sampled = materialise(sampled_runs(texts, length, seed), "runs")

    # round 1: seeds
    twice = sampled.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    runs = materialise(sampled.join(_renamed(twice, "seed"), _on("seed")).select(*sampled.columns), "runs-again")
    release(sampled)

    # round 2: runs of windows, whole
    whole = ["seed", "back", "ahead", "span_a", "span_b"]
    ranked_runs = materialise(_grouped(runs, whole, [*DOC, "at"]), "run-ranks")
    found = [runs.join(_renamed(ranked_runs.where("places > 1").select(*whole), *whole), _on(*whole)).select(
        *DOC, (F.col("at") - F.col("back")).alias("start"), (F.col("at") - F.col("ahead") + length).alias("end"))]
    left = ranked_runs.where("places = 1").select("seed").distinct()
    ranked = ranked_runs.join(_renamed(left, "seed"), _on("seed")).select(*DOC, "at", "back", "ahead", (F.col("places") == 1).alias("open"))
    spans = materialise(_spans(texts, ranked, length), "spans")

    # round 3: blocks of neighbouring windows
    blocks = materialise(_blocks(spans, length, block), "blocks")
    inner, outer = ["block", "core_a", "core_b"], ["block", "core_a", "core_b", "first", "last", "cover_a", "cover_b"]
    kinds = materialise(_grouped(blocks, outer, [*DOC, "at", "back", "open"]), "block-ranks")
    found.append(blocks.where("open").join(_renamed(kinds.where("places > 1").select(*outer), *outer), _on(*outer)).select(
        *DOC, (F.col("at") - F.col("last")).alias("start"), (F.col("at") - F.col("first") + length).alias("end")))
    mixed = kinds.groupBy(*inner).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("places") == 1) & F.col("open")).alias("some")).where("n > 1 AND some")
    rest = kinds.join(_renamed(mixed.select(*inner), *inner), _on(*inner)).select(
        *DOC, "at", "back", "first", "last", (F.col("open") & (F.col("places") == 1)).alias("open"))

    # round 4: single windows
    windows = materialise(_windows(spans, rest, length), "windows")
    pair = ["rank_a", "rank_b"]
    again = windows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*pair)
    found.append(windows.where("open").join(_renamed(again, *pair), _on(*pair)).select(
        *DOC, "start", (F.col("start") + length).alias("end")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    places = materialise(out, "repeated-places")
    release(runs, ranked_runs, spans, blocks, kinds, windows)
    return places


def _spans(texts: DataFrame, ranked: DataFrame, length: int) -> DataFrame:
    """The bytes of each run that goes on: one join with the texts, by document."""
    places = ranked.groupBy(*DOC).agg(F.collect_list(F.struct("at", "back", "ahead", "open")).alias("places"))
    joined = texts.join(_renamed(places, *DOC), _on(*DOC)).select(*texts.columns, "places")

    def cut(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "mark", "at", "back", "ahead", "open", "data")}
            for doc_id, mark, text, places in zip(batch["doc_id"], batch["mark"], batch["text"], batch["places"]):
                data = text.encode()
                for p in places:
                    for k, v in (("doc_id", doc_id), ("mark", mark), ("at", p["at"]), ("back", p["back"]), ("ahead", p["ahead"]), ("open", p["open"]),
                                 ("data", data[p["at"] - p["back"]:p["at"] - p["ahead"] + length])):
                        out[k].append(v)
                if len(out["at"]) > 20_000:
                    yield out
                    out = {k: [] for k in out}
            yield out

    return map_rows(joined, "doc_id long, mark long, at int, back short, ahead short, open boolean, data binary", cut)


def _blocks(spans: DataFrame, length: int, block: int) -> DataFrame:
    """Windows by distance from the seed, in aligned blocks: names of what a block's windows share and cover."""
    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "mark", "at", "back", "open", "block", "first", "last")}
            cores, covers = [], []
            for doc_id, mark, at, back, ahead, open_, data in zip(*[batch[k] for k in ("doc_id", "mark", "at", "back", "ahead", "open", "data")]):
                for k in range(ahead // block, back // block + 1):
                    first, last = max(ahead, k * block), min(back, k * block + block - 1)
                    cores.append(_digest(data[back - k * block:back - k * block - block + 1 + length]))
                    covers.append(_digest(data[back - last:back - first + length]))
                    for name, v in (("doc_id", doc_id), ("mark", mark), ("at", at), ("back", back), ("open", open_), ("block", k), ("first", first), ("last", last)):
                        out[name].append(v)
                if len(cores) > 50_000:
                    yield finished(out, cores, covers)
                    out, cores, covers = {k: [] for k in out}, [], []
            if cores:
                yield finished(out, cores, covers)

    def finished(out: dict[str, list], cores: list[bytes], covers: list[bytes]) -> dict[str, list]:
        core_a, core_b = _halves(cores)
        cover_a, cover_b = _halves(covers)
        return out | {"core_a": core_a, "core_b": core_b, "cover_a": cover_a, "cover_b": cover_b}

    return map_rows(spans, "doc_id long, mark long, at int, back short, open boolean, block short, first short, last short, "
                           "core_a long, core_b long, cover_a long, cover_b long", work)


def _windows(spans: DataFrame, rest: DataFrame, length: int) -> DataFrame:
    """Rank pair of every window that is still open, and of the windows it may equal."""
    half = 1 << (length.bit_length() - 1)
    run = [*DOC, "at", "back"]
    asked = rest.groupBy(*run).agg(F.collect_list(F.struct("first", "last", "open")).alias("asked"))
    joined = spans.select(*run, "data").join(_renamed(asked, *run), _on(*run)).select(*run, "data", "asked")

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("doc_id", "mark", "start", "open", "rank_a", "rank_b")}
            for doc_id, mark, at, back, data, asked in zip(*[batch[k] for k in (*run, "data", "asked")]):
                names = ranks(data, half).view(np.int64)
                for a in asked:
                    here = np.arange(back - a["last"], back - a["first"] + 1)
                    n = len(here)
                    cols["doc_id"] += [doc_id] * n
                    cols["mark"] += [mark] * n
                    cols["open"] += [a["open"]] * n
                    cols["start"] += (at - back + here).tolist()
                    cols["rank_a"] += names[here].tolist()
                    cols["rank_b"] += names[here + length - half].tolist()
                if len(cols["open"]) > 100_000:
                    yield cols
                    cols = {k: [] for k in cols}
            yield cols

    return map_rows(joined, "doc_id long, mark long, start int, open boolean, rank_a long, rank_b long", work)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (list of start, end in bytes), text, n_chars — one row per document.

    ``text`` is what remains, without the parts of characters that a cut leaves over; the digest is of the exact bytes.
    """
    places = repeated_places(docs, length, seed)
    lists = places.groupBy(*DOC).agg(F.collect_set(F.struct("start", "end")).alias("places"))
    joined = _texts(docs).join(_renamed(lists, *DOC), _on(*DOC), "left").select(*DOC, "text", "places")

    def cut(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "text", "n_chars")}
            for doc_id, text, places in zip(batch["doc_id"], batch["text"], batch["places"]):
                data = memoryview(text.encode())
                gone = merged([(p["start"], p["end"]) for p in places or []])
                kept = b"".join(data[a:b] for a, b in zip([0, *[b for _, b in gone]], [*[a for a, _ in gone], len(data)]))
                rest = kept.decode("utf-8", "ignore") if gone else text
                for k, v in (("doc_id", doc_id), ("n_bytes", len(data)), ("n_removed", sum(b - a for a, b in gone)), ("n_spans", len(gone)),
                             ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("removed", [{"start": a, "end": b} for a, b in gone]), ("text", rest), ("n_chars", len(rest))):
                    out[k].append(v)
            yield out

    return map_rows(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>, text string, n_chars long", cut)
