"""SimHash near-duplicates: word-shingle fingerprints, linked within a bit radius by exact tiled comparison.

Distinct fingerprints are compared in tiles: numpy exclusive-or and bit counts of one tile against another.
Tiles are cut from the order of population counts, and a pair of tiles whose counts differ by more than the
radius is skipped. To keep tiles few at any size, fingerprints first meet in bands: with radius r the 64 bits
fall into r + 1 bands, and two fingerprints within r bits agree in at least one band, so comparing inside
bands loses no link. A band value with very many fingerprints is dealt over tasks as pairs of tile groups.
A task hands on a spanning forest of the links it found, never all pairs; components of the forests are the
components of all links.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any
other; with fewer words than a shingle the whole sequence is the only shingle; repeated rows share a
fingerprint and hence a component; a component without any doc_id has a null component_id; further columns
are not read.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import map_rows
from patronage.operators.neighbours import components
from patronage.session import materialise

SEED = 42
TILE = 2048
#: Fingerprints of one band value that one task takes whole; more are dealt out as pairs of tile groups of this size.
GROUP = 8192
BLOCK = 1 << 16
#: Proposed partners of a text in one comparison that are handed on as pairs; texts with more are compared where they meet.
NEAREST = 64
#: Texts, and shingles in all, of a size class that one task takes whole where shingle sets themselves meet.
CROWD, VOLUME = 2048, 1 << 21
#: Fingerprints of 64 bits that near copies are told by.
PRINTS = ("print", "second", "third", "fourth")
#: Most bits in which near copies differ: in the first two fingerprints, in all four, and how many more in the shortest texts.
FIRST, RADIUS, SHORT = 48, 72, 10


def _hashes(tokens: list[bytes], words: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text, in blocks of bounded size; the whole sequence if it is shorter than a shingle."""
    for start in range(0, max(1, len(tokens) - words + 1), BLOCK):
        part = tokens[start:start + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*[part[i:] for i in range(words)])) if len(part) >= words else [b" ".join(part)]
        yield np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64)


def _majority(ones: np.ndarray, n: int) -> int:
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return int(np.bitwise_or.reduce(np.where(2 * ones > n, weights, np.uint64(0))))


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in _hashes(tokens, words, seed):
        ones += bit_totals(hashes)
        n += len(hashes)
    return _majority(ones, n)


def set_prints(tokens: list[bytes], words: int = 5, seed: int = SEED) -> list[int]:
    """Fingerprints of the set of shingles, one for each of PRINTS; from the second on from the same hashes, mixed again."""
    if not tokens:
        return [0] * len(PRINTS)
    hashes = np.unique(np.concatenate(list(_hashes(tokens, words, seed))))
    out = [_print(hashes)]
    for i in range(1, len(PRINTS)):
        mixed = hashes + np.uint64(0x9E3779B97F4A7C15 * (i - 1) % (1 << 64))
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_print(mixed ^ (mixed >> np.uint64(31))))
    return out


def _print(hashes: np.ndarray) -> int:
    return _majority(sum(bit_totals(hashes[i:i + BLOCK]) for i in range(0, len(hashes), BLOCK)), len(hashes))


def bit_totals(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(0, dtype=np.int64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, print): fingerprint of every row as a signed long."""
    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "print": [_signed(fingerprint(t, words)) for t in batch["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, print long", work)


def tile_links(left: np.ndarray, right: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs of ``left`` and ``right`` at most ``radius`` bits apart, tile against tile."""
    order_l, order_r = np.argsort(np.bitwise_count(left), kind="stable"), np.argsort(np.bitwise_count(right), kind="stable")
    pop_l, pop_r = np.bitwise_count(left)[order_l].astype(int), np.bitwise_count(right)[order_r].astype(int)
    found_l, found_r = [], []
    for a in range(0, len(left), tile):
        rows = order_l[a:a + tile]
        low, high = pop_l[a], pop_l[min(a + tile, len(left)) - 1]
        for b in range(0, len(right), tile):
            if pop_r[b] > high + radius or pop_r[min(b + tile, len(right)) - 1] < low - radius:
                continue
            cols = order_r[b:b + tile]
            near = np.bitwise_count(left[rows][:, None] ^ right[cols][None, :]) <= radius
            i, j = np.nonzero(near)
            found_l.append(rows[i])
            found_r.append(cols[j])
    if not found_l:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(found_l), np.concatenate(found_r)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the given links connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = np.arange(len(nodes))
    i, j = flat[:len(a)], flat[len(a):]
    while True:
        least = np.minimum(low[i], low[j])
        after = low.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        np.minimum.at(after, low[i], least)
        np.minimum.at(after, low[j], least)
        after = after[after]
        if (after == low).all():
            break
        low = after
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def _band_masks(radius: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def links(prints: DataFrame, radius: int, group: int = GROUP) -> DataFrame:
    """(a, b): forest edges over distinct fingerprints (column ``print``) at most ``radius`` bits apart."""
    banded = prints.select("print", F.posexplode(F.array(*[
        F.shiftrightunsigned("print", lo).bitwiseAND(F.lit((1 << width) - 1)) for lo, width in _band_masks(radius)])).alias("band", "value"))
    sizes = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select(F.col("band").alias("_b"), F.col("value").alias("_v"), F.ceil(F.col("n") / group).cast("int").alias("parts"))
    met = banded.join(sizes, (F.col("band") == F.col("_b")) & (F.col("value") == F.col("_v"))).select("print", "band", "value", "parts")
    # a fingerprint of group g meets groups h: its row goes to every unordered pair {g, h}
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    pairs = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "print", "band", "value", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "own")

    def compare(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held: list[tuple] = []
        key = None
        sent_a, sent_b = [], []
        for batch in batches:
            for k, p, own in zip(zip(batch["band"], batch["value"], batch["g"], batch["h"]), batch["print"], batch["own"]):
                if k != key:
                    _close(key, held, radius, sent_a, sent_b)
                    key, held = k, []
                held.append((p, own))
            if sum(map(len, sent_a)) > 100_000:
                yield {"a": np.concatenate(sent_a), "b": np.concatenate(sent_b)}
                sent_a, sent_b = [], []
        _close(key, held, radius, sent_a, sent_b)
        if sent_a:
            yield {"a": np.concatenate(sent_a), "b": np.concatenate(sent_b)}

    dealt = pairs.repartition("band", "value", "g", "h").sortWithinPartitions("band", "value", "g", "h")
    return map_rows(dealt, "a long, b long", compare)


def _close(key: tuple | None, held: list[tuple], radius: int, sent_a: list, sent_b: list) -> None:
    """Compare the fingerprints of one (band, value, g, h)."""
    if len(held) < 2:
        return
    values, own = np.array([p for p, _ in held], dtype=np.int64), np.array([o for _, o in held])
    _, _, g, h = key
    if g == h:
        left = right = values
    else:
        left, right = values[own == g], values[own == h]
    i, j = tile_links(left.view(np.uint64), right.view(np.uint64), radius)
    a, b = left[i], right[j]
    if len(a):
        a, b = forest(a[a != b], b[a != b])
    if len(a):
        sent_a.append(a)
        sent_b.append(b)


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    rows = materialise(fingerprints(docs, words), "prints")
    distinct = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "distinct-prints")
    edges = materialise(links(distinct, radius).distinct(), "print-links")
    linked = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    groups = components(materialise(linked, "linked-prints"), edges)
    named = distinct.join(groups, F.col("print") == F.col("id"), "left").select(
        "print", "doc_id", F.coalesce("component", "print").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("component", "_component")
    lookup = named.join(least, F.col("component") == F.col("_component")).select(F.col("print").alias("_print"), "component_id")
    return rows.join(lookup, F.col("print") == F.col("_print")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies: fingerprints find candidates, shingle sets confirm them
def shingle_hashes(tokens: list[bytes], words: int, seed: int = SEED) -> list[int]:
    """Distinct hashes of the word shingles, as signed longs."""
    if not tokens:
        return []
    shingles = map(b" ".join, zip(*[tokens[i:] for i in range(words)])) if len(tokens) >= words else [b" ".join(tokens)]
    return [_signed(x) for x in {xxhash.xxh64_intdigest(s, seed) for s in shingles}]


def _nodes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, node, PRINTS, n): key names the text, node its lower-cased words, n counts its different shingles."""
    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            tokens = [(t or "").encode().lower().split() for t in batch["text"]]
            prints = zip(*[set_prints(t, words) for t in tokens])
            yield {"doc_id": batch["doc_id"], "key": batch["key"], "node": [_signed(xxhash.xxh64_intdigest(b" ".join(t), SEED)) for t in tokens],
                   **{name: list(map(_signed, p)) for name, p in zip(PRINTS, prints)},
                   "n": [len({b" ".join(t[i:i + words]) for i in range(max(1, len(t) - words + 1))}) if t else 0 for t in tokens]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("key"), "text"), f"doc_id long, key long, node long, {', '.join(f'{p} long' for p in PRINTS)}, n long", work)


def _text_key() -> Column:
    """Digest of a text; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _row_order(doc_id: str = "doc_id") -> Column:
    """Order of documents: by doc_id, those without one last, then by text."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("key").alias("key"))


def _meetings(nodes: DataFrame, similarity: float, group: int, volume: int) -> DataFrame:
    """Every node once in each comparison (k, kind, g, h) that it takes part in, with its side.

    Sets of which one is less than ``similarity`` of the other in size can't be that similar. So nodes are
    compared inside a size class (a step of 1 / similarity) and with the next class; classes are dealt out as
    pairs of groups of about ``group`` nodes and ``volume`` shingles at most.
    """
    step = float(np.log(1.0 / similarity))
    size_class = F.floor(F.ln(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(step)).cast("int")
    placed = nodes.withColumn("k", size_class)
    # as many rows as size classes: the logarithm of the longest text
    share = F.greatest(F.count(F.lit(1)) / F.lit(group), F.sum("n") / F.lit(volume), F.lit(1.0))
    classes = placed.groupBy("k").agg(F.ceil(share).cast("int").alias("parts"))
    around = classes.select(F.col("k").alias("_k"), "parts").join(
        classes.select((F.col("k") - 1).alias("_k"), F.col("parts").alias("above")), "_k", "left").join(
        classes.select((F.col("k") + 1).alias("_k"), F.col("parts").alias("below")), "_k", "left").fillna(0, ["above", "below"])
    rows = placed.join(around, F.col("k") == F.col("_k")).withColumn("g", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    upto = lambda c: F.filter(F.sequence(F.lit(0), F.greatest(F.col(c), F.lit(1)) - 1), lambda h: h < F.col(c))
    met = lambda k, kind, g, h, side: F.struct(k.alias("k"), F.lit(kind).alias("kind"), g.alias("g"), h.alias("h"), side.alias("side"))
    g = F.col("g")
    meetings = F.concat(
        F.transform(upto("parts"), lambda h: met(F.col("k"), 0, F.least(g, h), F.greatest(g, h), g)),
        F.transform(upto("above"), lambda h: met(F.col("k"), 1, g, h, F.lit(0))),
        F.transform(upto("below"), lambda h: met(F.col("k") - 1, 1, h, g, F.lit(1))))
    return rows.select(*nodes.columns, F.explode(meetings).alias("m")).select(*nodes.columns, "m.*")


def _compared(met: DataFrame, columns: list[str], compare: Callable[[tuple | None, list[tuple]], Iterator[dict[str, list]]]) -> DataFrame:
    """(a, b): what ``compare`` finds among the rows of each comparison."""
    key = ["k", "kind", "g", "h"]

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        at, held = None, []
        for batch in batches:
            if "shingles" in batch:
                batch["shingles"] = [np.array(x, dtype=np.int64) for x in batch["shingles"]]
            for where, row in zip(zip(*[batch[c] for c in key]), zip(*[batch[c] for c in columns])):
                if where != at:
                    yield from compare(at, held)
                    at, held = where, []
                held.append(row)
        yield from compare(at, held)

    return map_rows(met.repartition(*key).sortWithinPartitions(*key), "a long, b long", work)


def _candidates(nodes: DataFrame, radius: int, similarity: float, group: int) -> DataFrame:
    """(a, b): all pairs of nodes at most ``radius`` bits apart, but for pairs of two crowded nodes; a = b names a crowded node.

    A node is crowded if it has over NEAREST partners in a comparison; its pairs are handed on by their other ends, where
    these aren't crowded, so that no node hands on over NEAREST pairs and a mark.
    """
    columns = ["node", "n", *PRINTS]
    met = _meetings(nodes.select(*columns), similarity, group, 1 << 62)
    return _compared(met, [*columns, "side"], lambda at, held: _nearest(at, held, radius, similarity))


def _crowd_links(crowded: DataFrame, radius: int, similarity: float, group: int = CROWD) -> DataFrame:
    """(a, b): links that connect what all links between crowded nodes connect, by their shingle sets."""
    columns = ["node", "n", *PRINTS, "shingles"]
    met = _meetings(crowded.select(*columns), similarity, group, VOLUME)
    return _compared(met, [*columns, "side"], lambda at, held: _confirmed(at, held, radius, similarity))


def _sides(at: tuple, side: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    """(whether a group is compared with itself, rows of the left, rows of the right)."""
    _, kind, g, h = at
    if kind == 0 and g == h:
        return True, np.arange(len(side)), np.arange(len(side))
    return False, np.flatnonzero(side == (0 if kind else g)), np.flatnonzero(side == (1 if kind else h))


def _nearest(at: tuple | None, held: list[tuple], radius: int, similarity: float, tile: int = TILE) -> Iterator[dict[str, list]]:
    if len(held) < 2:
        return
    node, n, *prints, side = (np.array(x, dtype=np.int64) for x in zip(*held))
    whole, left, right = _sides(at, side)
    one, two, *more = (p.view(np.uint64) for p in prints)
    reach = min(radius + SHORT, FIRST)
    pops = np.bitwise_count(one).astype(int)
    left, right = left[np.argsort(pops[left], kind="stable")], right[np.argsort(pops[right], kind="stable")]
    hits, partners = [], np.zeros(len(node), int)
    for a in range(0, len(left), tile):
        rows = left[a:a + tile]
        for b in range(a if whole else 0, len(right), tile):
            cols = right[b:b + tile]
            if pops[cols[0]] > pops[rows[-1]] + reach or pops[cols[-1]] < pops[rows[0]] - reach:
                continue
            apart = np.bitwise_count(one[rows][:, None] ^ one[cols][None, :])
            apart += np.bitwise_count(two[rows][:, None] ^ two[cols][None, :])
            i, j = np.nonzero(apart <= reach)
            d = apart[i, j].astype(int)
            once = i < j if whole and a == b else np.ones(len(i), bool)
            i, j, d = rows[i[once]], cols[j[once]], d[once]
            d += sum(np.bitwise_count(p[i] ^ p[j]).astype(int) for p in more)
            fit = (d <= _most_bits(n[i], n[j], radius, similarity)) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
            i, j, d = i[fit], j[fit], d[fit]
            if not len(i):
                continue
            partners += np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
            hits += [_closest(i, j, d, NEAREST), _closest(j, i, d, NEAREST)]
    if hits:
        x, y, _ = _closest(*map(np.concatenate, zip(*hits)), NEAREST)
        open_end = partners[x] <= NEAREST  # pairs of two crowded nodes are decided where these meet; any other pair is in the list of its open end
        x, y = x[open_end], y[open_end]
        crowded = node[partners > NEAREST]
        yield {"a": np.concatenate([node[x], crowded]), "b": np.concatenate([node[y], crowded])}


def _most_bits(n: np.ndarray, m: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Most differing bits of sets of n and m shingles: sets too small to be that similar and different have equal prints."""
    least = np.minimum(n, m)
    return np.where(least < (similarity - 1e-12) * (least + 1), 0, np.where(least < 5, radius + SHORT, radius))


def _closest(x: np.ndarray, y: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each x the ``most`` pairs with the least distance."""
    order = np.lexsort((y, d, x))
    x, y, d = x[order], y[order], d[order]
    first = np.searchsorted(x, x, "left")
    keep = np.arange(len(x)) - first < most
    return x[keep], y[keep], d[keep]


def _confirmed(at: tuple | None, held: list[tuple], radius: int, similarity: float) -> Iterator[dict[str, list]]:
    """Every pair within the radius is decided by the shingle sets, unless links found before connect it."""
    if len(held) < 2:
        return
    *columns, sets, side = zip(*held)
    node, n, *prints = (np.array(x, dtype=np.int64) for x in columns)
    whole, left, right = _sides(at, np.array(side))
    prints = np.array(prints).view(np.uint64)
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    there = np.zeros(len(names), bool)
    label = np.arange(len(node))
    sent_a, sent_b = [], []
    for place, x in enumerate(left):
        y = right[place + 1:] if whole else right
        y = y[label[y] != label[x]]
        y = y[(np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])) & (size[y] > 0)]
        d = np.bitwise_count(prints[:, [x]] ^ prints[:, y]).astype(int)
        y = y[(d[:2].sum(0) <= FIRST) & (d.sum(0) <= _most_bits(n[x], n[y], radius, similarity))]
        if not len(y):
            continue
        own = flat[start[x]:start[x] + size[x]]
        there[own] = True
        ends = np.cumsum(size[y])
        at_y = np.repeat(start[y] - (ends - size[y]), size[y]) + np.arange(ends[-1])
        common = np.add.reduceat(there[flat[at_y]].astype(int), ends - size[y])
        there[own] = False
        y = y[common >= (similarity - 1e-12) * (size[x] + size[y] - common)]
        joined, first = np.unique(label[y], return_index=True)
        label[np.isin(label, joined)] = label[x]
        sent_a += [node[x]] * len(first)
        sent_b += node[y[first]].tolist()
    if sent_a:
        yield {"a": sent_a, "b": sent_b}


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, group: int = 4 * GROUP) -> DataFrame:
    """doc_id, component_id: groups of documents linked by a Jaccard similarity of their word shingles.

    SimHash proposes pairs up to ``radius`` of 256 bits apart (four fingerprints of the same shingles, the first two at
    most FIRST apart). With independent hashes a pair at 0.8 differs in a bit with a probability of 0.11 to 0.161, by the
    sizes of the sets, and of 0.188 for 4 against 5 shingles; the limits are set from the tails of these binomials, so
    that each misses less than one such pair in a million. Unrelated texts differ in 128 bits, so that hardly any pair
    is proposed in vain. The shingle sets of proposed pairs confirm them. Other similarities need another radius.
    In large groups (both texts with over NEAREST partners) the shingle sets themselves meet, so that no proposed pair
    is left out and none is written. Texts with equal words are one node from the start. A component without any
    doc_id has a null component_id.
    """
    rows = _copy_groups(docs, words, similarity, radius, group)
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("component", "_component")
    return rows.join(least, F.col("component") == F.col("_component")).select("doc_id", "component_id")


def _copy_groups(docs: DataFrame, words: int, similarity: float, radius: int, group: int) -> DataFrame:
    """(doc_id, key, component) of every row."""
    rows = materialise(_nodes(docs, words), "copy-nodes")
    nodes = materialise(rows.groupBy("node").agg(*[F.first(p).alias(p) for p in PRINTS], F.first("n").alias("n"), F.min(_row_order()).alias("row")), "copy-distinct")
    pair = F.array_sort(F.array("a", "b"))
    found = materialise(_candidates(nodes, radius, similarity, group).select(
        pair[0].alias("a"), pair[1].alias("b")).distinct(), "copy-candidates")
    proposed, crowded = found.where("a != b"), found.where("a = b").select(F.col("a").alias("_node"))
    ends = found.select(F.col("a").alias("_node")).unionByName(found.select(F.col("b").alias("_node"))).distinct()
    wanted = nodes.join(ends, F.col("node") == F.col("_node"), "left_semi").select(F.col("row.id").alias("_doc"), F.col("row.key").alias("_key"), "node")

    def sets(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {"node": [], "shingles": []}
            for node, text in zip(batch["node"], batch["text"]):
                tokens = (text or "").encode().lower().split()
                if _signed(xxhash.xxh64_intdigest(b" ".join(tokens), SEED)) == node:  # else another text with the same key
                    out["node"].append(node)
                    out["shingles"].append(shingle_hashes(tokens, words))
            yield out

    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("key"), "text").join(wanted, same).select("node", "text")
    held = materialise(map_rows(texts, "node long, shingles array<long>", sets).dropDuplicates(["node"]), "copy-shingles")
    both = (proposed.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(held.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    edges = materialise(both.where(common >= F.lit(similarity - 1e-12) * (F.size("x") + F.size("y") - common)).select("a", "b"), "copy-links")
    if not crowded.isEmpty():
        crowd = nodes.join(crowded, F.col("node") == F.col("_node"), "left_semi").join(held, "node")
        edges = materialise(edges.unionByName(_crowd_links(crowd, radius, similarity)), "copy-crowd-links")
    linked = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    groups = components(materialise(linked, "copy-linked"), edges)
    named = nodes.join(groups, F.col("node") == F.col("id"), "left").select(F.col("node").alias("_node"), F.coalesce("component", "node").alias("component"))
    return rows.join(named, F.col("node") == F.col("_node")).select("doc_id", "key", "component")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest doc_id; all columns as given.

    Rows with one doc_id and one text are one document given twice: one of them stays. Rows with one doc_id and
    different texts, or without a doc_id, are documents of their own; a row without doc_id stays only where no row
    of its group has one. Of equal doc_ids the text with the smaller digest stays.
    """
    groups = materialise(_copy_groups(docs, words, similarity, RADIUS, 4 * GROUP), "copy-groups")
    first = groups.groupBy("component").agg(F.min(_row_order()).alias("row")).select(F.col("row.id").alias("_stay"), F.col("row.key").alias("_text"))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("_stay")) & (_text_key() == F.col("_text"))
    first = materialise(first, "copy-first")
    out = docs.join(first, mine, "left_semi")
    counted = groups.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_twice"), F.col("key").alias("_again"))
    repeated = materialise(counted.join(first, F.col("_twice").eqNullSafe(F.col("_stay")) & (F.col("_again") == F.col("_text")), "left_semi"), "repeated-rows")
    if repeated.isEmpty():
        return out
    again = F.col("doc_id").cast("long").eqNullSafe(F.col("_twice")) & (_text_key() == F.col("_again"))
    once = out.join(repeated, again, "left_semi").withColumn("_text_key", _text_key()).dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")
    return out.join(repeated, again, "left_anti").unionByName(once)
