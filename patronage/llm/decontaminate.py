"""Benchmark decontamination: q-gram lemma filter in diagonal bands, then banded alignment.

A benchmark item (lower-cased, white space to one space) is one region, or overlapping regions of REGION characters
if it is longer: a document is contaminated by any one of them, so long fragments of an item count too. A region of m characters that occurs in a document with at most e edits shares at least m - q + 1 - q e q-grams
with it, all on diagonals that span at most e. Shared q-grams are counted in overlapping bands of diagonals; a
band with enough of them is verified by an alignment that stays inside the band.

The q-gram index is broadcast in blocks of at most BLOCK_CHARS characters of items; every block is one map over
the documents, so there is no join and nothing is shuffled but matches. One block is the common case.

Items under MIN_CHARS characters after normalising are too short for that and are looked for as they are, at word
boundaries, with one automaton over all of them.

Defined results: null and empty texts match nothing; items that are empty after normalising aren't looked for; an item given twice is reported under each of its ids; a null doc_id is
reported as it is; repeated rows are scanned each; an empty benchmark matches nothing; further columns are not
read. Long texts are scanned in overlapping pieces.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import map_rows

Q = 8
EDIT_SHARE = 0.1
MIN_CHARS = 20
REGION = 160
BLOCK_CHARS = 4_000_000
PIECE = 1 << 18
#: Shared q-grams that are counted at a time.
ROWS = 1 << 21
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FILTER_BITS = 22


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def q_grams(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit name of the q characters at each position."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    names, have = codes.astype(np.uint64), 1
    while have < q:  # names of two strings make the name of the longer one; the last two overlap
        step = min(have, q - have)
        longer = names[:-step] * _B
        longer += names[step:]
        longer *= _A
        longer ^= longer >> np.uint64(29)
        names, have = longer, have + step
    return names


@dataclass
class RegionIndex:
    """Regions of benchmark items with their q-grams in order."""
    q: int
    item: list  # item_id of each region
    text: list[str]
    length: np.ndarray
    edits: np.ndarray
    needed: np.ndarray
    names: np.ndarray  # distinct, sorted
    first: np.ndarray  # where the rows of each name begin, and the end
    region: np.ndarray
    place: np.ndarray
    there: np.ndarray  # filter by the top bits of a name
    short: dict[str, list[int]] | None = None  # short items: their rows in ``item``

    def automaton(self) -> ahocorasick.Automaton:
        """Of the short items; made once a process."""
        if not hasattr(self, "_made"):
            self._made = ahocorasick.Automaton()
            for text, rows in self.short.items():
                self._made.add_word(text, (len(text), rows))
            self._made.make_automaton()
        return self._made


def regions_of(text: str, region: int) -> list[str]:
    if len(text) <= region:
        return [text]
    step = region // 2
    starts = list(range(0, len(text) - region, step)) + [len(text) - region]
    return [text[s:s + region] for s in starts]


def index_of(items: list[tuple], q: int = Q, edit_share: float = EDIT_SHARE, min_chars: int = MIN_CHARS, region: int = REGION) -> RegionIndex:
    ids, texts, few = [], [], {}
    for item_id, raw in items:
        text = normalised(raw)
        if 0 < len(text) < max(min_chars, q):
            few.setdefault(text, []).append(item_id)
        elif text:
            for r in regions_of(text, region):
                ids.append(item_id)
                texts.append(r)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    edits = np.minimum((length * edit_share).astype(np.int64), (length - q) // q)
    needed = length - q + 1 - q * edits
    grams = [q_grams(_codes(t), q) for t in texts]
    names = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(names, kind="stable")
    there = np.zeros(1 << FILTER_BITS, bool)
    there[names >> np.uint64(64 - FILTER_BITS)] = True
    distinct, first = np.unique(names[order], return_index=True)
    short, every = {}, list(ids)
    for text, owners in few.items():
        short[text] = list(range(len(every), len(every) + len(owners)))
        every += owners
    return RegionIndex(q, every, texts, length, edits, needed, distinct, np.append(first, len(names)), owner[order], place[order], there, short)


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(edits, end): best alignment of the whole pattern on diagonals low..high (text place minus pattern place)."""
    width, far = high - low + 1, len(pattern) + len(text) + 1
    ramp = np.arange(width)
    padded = np.full(len(pattern) + width, -1, np.int64)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low:b - low] = text[a:b]
    valid_low, skip = max(0, -low), np.full(width, far)
    row = np.where(ramp >= valid_low, 0, far)  # pattern place 0 at text place low + k
    for i, c in enumerate(pattern, 1):
        cross = row + (padded[i - 1:i - 1 + width] != c)
        skip[:-1] = row[1:] + 1
        row = np.minimum.accumulate(np.minimum(cross, skip) - ramp) + ramp
    ends = low + len(pattern) + ramp
    row = np.where((ends >= 0) & (ends <= len(text)), row, far)
    k = int(row.argmin())
    return int(row[k]), int(ends[k])


def matches(text: str | None, index: RegionIndex) -> list[tuple[int, int, int]]:
    """(region, edits, end in the normalised text), each region at most once per band of diagonals."""
    whole = normalised(text)
    if not whole or not index.item:
        return []
    out = exact_short(whole, index) if index.short else []
    if len(whole) < index.q or not index.text:
        return out
    overlap = int(index.length.max() + 2 * index.edits.max() + index.q)
    for start in range(0, len(whole), PIECE):
        piece = whole[start:start + PIECE + overlap]
        out += [(r, e, start + end) for r, e, end in _in_piece(piece, index)]
    return out


def exact_short(whole: str, index: RegionIndex) -> list[tuple[int, int, int]]:
    """Short items that stand in a normalised text between word boundaries."""
    out = []
    for last, (size, rows) in index.automaton().iter(whole):
        a, b = last + 1 - size, last + 1
        if _parted(whole, a) and _parted(whole, b):
            out += [(r, 0, b) for r in rows]
    return out


def _parted(text: str, at: int) -> bool:
    """No word goes on over this place."""
    return at == 0 or at == len(text) or not (text[at - 1].isalnum() and text[at].isalnum())


def _bands(at: np.ndarray, spot: np.ndarray, index: RegionIndex) -> tuple[np.ndarray, np.ndarray]:
    """(region and band, place in the region) of each shared q-gram, once for each of the bands it lies in."""
    low = index.first[spot]
    many = index.first[spot + 1] - low
    row = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    region, place = index.region[row], index.place[row]
    diagonal = np.repeat(at, many) - place
    edits = index.edits[region]
    size = edits + 1
    band = diagonal // size
    # band b holds diagonals b * size ... b * size + 2 * edits: every span of e + 1 diagonals lies in one
    also = diagonal - band * size < edits
    key = np.concatenate([region * (1 << 40) + band + (1 << 39), region[also] * (1 << 40) + band[also] - 1 + (1 << 39)])
    return key, np.concatenate([place, place[also]])


def _in_piece(text: str, index: RegionIndex) -> list[tuple[int, int, int]]:
    codes = _codes(text)
    names = q_grams(codes, index.q)
    at = np.flatnonzero(index.there[names >> np.uint64(64 - FILTER_BITS)])
    if len(at) < index.needed.min():
        return []
    names = names[at]
    spot = np.searchsorted(index.names, names)
    hit = index.names[np.minimum(spot, len(index.names) - 1)] == names
    at, spot = at[hit], spot[hit]
    if not len(at):
        return []
    many = index.first[spot + 1] - index.first[spot]
    # q-grams that many items share: in slices of about ROWS rows, counted twice, so that memory stays bounded
    slices = np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(many) // ROWS)) + 1)
    counted = [np.unique(_bands(at[s], spot[s], index)[0], return_counts=True) for s in slices]
    kept, of = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    kept = kept[np.bincount(of, np.concatenate([n for _, n in counted])) >= index.needed[kept >> 40]]
    if not len(kept):
        return []
    # what repeats itself shares a place of the region many times: only different places count
    pairs = []
    for s in slices:
        key, place = _bands(at[s], spot[s], index)
        mine = np.isin(key, kept)
        pairs.append(np.unique(np.stack([key[mine], place[mine]]), axis=1))
    kept, counts = np.unique(np.unique(np.concatenate(pairs, axis=1), axis=1)[0], return_counts=True)
    kept = kept[counts >= index.needed[kept >> 40]]
    out = []
    for r, b in zip((kept >> 40).tolist(), ((kept & ((1 << 40) - 1)) - (1 << 39)).tolist()):
        e, m = int(index.edits[r]), int(index.length[r])
        first, last = b * (e + 1), b * (e + 1) + 2 * e
        exact = text.find(index.text[r], max(0, first), max(0, last + m))
        if exact >= 0:
            out.append((r, 0, exact + m))
            continue
        cost, end = banded(_codes(index.text[r]).astype(np.int64), codes.astype(np.int64), first - e, last + e)
        if cost <= e:
            out.append((r, cost, end))
    return out


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size, each collected for a broadcast."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for i in range(parts):
        yield [tuple(r) for r in rows.where(part == i).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits (fewest of a region), n_places, end (in the normalised text, of the best place): a row per document and item."""
    spark, found = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for items in _blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(index_of(items, q, edit_share))

        def work(batches: Iterator[dict[str, list]], shared=shared) -> Iterator[dict[str, list]]:
            index = shared.value
            for batch in batches:
                out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "edits", "n_places", "end")}
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    best: dict = {}
                    for r, edits, end in set(matches(text, index)):
                        best.setdefault(index.item[r], set()).add((edits, end))
                    for item, places in best.items():
                        edits, end = min(places)
                        for k, v in (("doc_id", doc_id), ("item_id", item), ("edits", edits), ("n_places", len(places)), ("end", end)):
                            out[k].append(v)
                yield out

        part = map_rows(rows, "doc_id long, item_id long, edits int, n_places int, end long", work)
        found = part if found is None else found.unionByName(part)
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no benchmark item is found; all columns as given, nothing is shuffled."""
    out = docs
    for items in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index_of(items, q, edit_share))

        out = out.where(_clean_under(shared)(F.col("text")))
    return out


def _clean_under(shared):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not matches(t, shared.value) for t in texts])

    return clean
