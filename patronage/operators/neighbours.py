"""Exact nearest neighbours, votes, oversampling and density clusters on vector tables.

Points are put in cells that are cut at medians until each holds a bounded number. A query first looks into
its own cell, which bounds how far its neighbours can be, and then only into cells whose boxes come that near: it
walks down the tree of boxes by one equijoin a level, so no list of cells is ever held in one place. Cells of equal
points and cells that many queries visit are dealt out as pairs of bounded blocks. Where boxes exclude little (many
dimensions), all blocks of queries meet all blocks of points, in blocks as large as WIDE_BYTES allow. For many
dimensions there is also an approximate form by hash tables. Tables: (id long, x array<double>).

Inside a block pair one product of single-precision matrices bounds all distances from below, with its rounding
errors taken off; only pairs that pass the bound get their distance, in full precision.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.config import DEFAULTS, Settings
from patronage.functions.expressions import hash_unit
from patronage.functions.ordering import exact_quantiles, hash_sample
from patronage.session import materialise, release

BLOCK = 2048
#: Parts that a round cuts a cell into; points of a cell that the cuts are taken from.
FAN, SAMPLE = 64, 4096
#: Queries and points whose distances a task bounds at once; numbers that are held to make distances of pairs.
TILE, HELD = (256, 4096), 1 << 22
#: Bytes of coordinates in a block where all blocks meet; share of the cells in reach from which on they do; queries that this share is taken from.
WIDE_BYTES, MOST_CELLS, PROBES = 1 << 24, 0.25, 64


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for start in range(0, len(a), 256):  # keeps the difference cube small; exact zeros for equal vectors
        part = a[start:start + 256, None, :] - b[None, :, :]
        out[start:start + 256] = np.sqrt(np.einsum("ijk,ijk->ij", part, part))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def _of_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (a[i], b[j]), to the last bit those of ``_distances``."""
    out, step = np.empty(len(i)), max(1, HELD // a.shape[1])
    for start in range(0, len(i), step):
        part = (a[i[start:start + step]] - b[j[start:start + step]])[:, None, :]
        out[start:start + step] = np.sqrt(np.einsum("ijk,ijk->ij", part, part))[:, 0]
    return out


class _Bounds:
    """Bounds of the squared distances of all pairs, from one product of matrices in single precision.

    Coordinates are taken from the centre of ``b`` and scaled into [-1, 1], so nothing overflows. The product is off by
    less than ``slack`` times the squared lengths, which is taken off the lower bound.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        centre = b.mean(0)
        u, v = a - centre, b - centre
        size = max(np.abs(u).max(initial=0.0), np.abs(v).max(initial=0.0))
        if not np.isfinite(size * size):  # beyond what can be squared: every pair passes
            u, v, size = np.zeros_like(u), np.zeros_like(v), 1.0
        self.scale, self.slack = size or 1.0, (a.shape[1] + 16) * 2.4e-7
        u, v = u / self.scale, v / self.scale
        self.length, far = (u * u).sum(1), (v * v).sum(1)
        self.furthest = far.max(initial=0.0)
        self.u = np.column_stack([u, np.ones(len(u))]).astype(np.float32)
        self.v = np.ascontiguousarray(np.column_stack([-2 * v, far * (1 - self.slack)]).astype(np.float32).T)

    def passing(self, rows: slice, far: np.ndarray) -> np.ndarray:
        """What the product of a row with a point no farther than ``far`` is at most."""
        return (((far / self.scale) ** 2) * (1 + self.slack) - self.length[rows] * (1 - self.slack) + 1e-30).astype(np.float32)[:, None]

    def certain(self, rows: slice, far: np.ndarray) -> np.ndarray:
        """A product up to which a point is surely no farther than ``far``."""
        safe = ((far / self.scale) ** 2) * (1 - self.slack) - self.length[rows] * (1 - self.slack) - 2 * self.slack * (self.length[rows] + self.furthest)
        return (safe - 1e-30).astype(np.float32)[:, None]


def _places(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the marks, row by row; np.nonzero takes ten times as long where marks are few."""
    return np.divmod(np.flatnonzero(marks), marks.shape[1])


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """``_distances(a, b) <= eps``; only pairs that the bounds leave open get a distance."""
    fine_a, fine_b = np.isfinite(a).all(1), np.isfinite(b).all(1)
    out = np.zeros((len(a), len(b)), dtype=bool)
    x, y = a[fine_a], b[fine_b]
    if not len(x) or not len(y):
        return out
    bounds, near = _Bounds(x, y), np.empty((len(x), len(y)), dtype=bool)
    for start in range(0, len(x), TILE[0]):
        rows = slice(start, min(start + TILE[0], len(x)))
        far = np.full(rows.stop - start, eps)
        product = bounds.u[rows] @ bounds.v
        near[rows] = product <= bounds.certain(rows, far)
        i, j = _places((product <= bounds.passing(rows, far)) & ~near[rows])
        near[rows][i, j] = _of_pairs(x, y, i + start, j) <= eps
    if near.shape == out.shape:
        return near
    out[np.ix_(fine_a, fine_b)] = near
    return out


# ---------------------------------------------------------------- tree of cells
@dataclass
class CellTree:
    """Points in cells of bounded size, and how to get to a cell from the root (cell 0); child i of a cell c is FAN * c + 1 + i."""
    placed: DataFrame  # id, x, cell, depth
    cuts: list[DataFrame]  # of each round: cell, cuts (the subtree that deals its points out)
    children: list[DataFrame]  # of each depth: parent, children (cell, lo, hi, leaf)
    boxes: DataFrame | None = None  # of the cells: cell, depth, lo, hi


def _subtree(x: np.ndarray, levels: int) -> bytes | None:
    """Medians of the widest coordinate, ``levels`` deep, as (coordinate, cut) in heap order; None where all points are equal."""
    axis, cut = np.zeros((1 << levels) - 1, np.int32), np.full((1 << levels) - 1, np.inf)
    if (x.max(0) == x.min(0)).all():
        return None
    held = {0: x}
    for node in range(len(cut)):
        part = held.pop(node)
        width = part.max(0) - part.min(0) if len(part) else np.zeros(x.shape[1])
        if width.max(initial=0) > 0:
            axis[node] = int(width.argmax())
            values = part[:, axis[node]]
            middle = float(np.median(values))
            cut[node] = middle if (values > middle).any() else float(values[values < values.max()].max())
        goes = part[:, axis[node]] > cut[node]
        if 2 * node + 2 < len(cut):
            held[2 * node + 1], held[2 * node + 2] = part[~goes], part[goes]
    return axis.tobytes() + cut.tobytes()


def _dealt(x: np.ndarray, cuts: bytes) -> np.ndarray:
    n = len(cuts) // 12
    axis, cut = np.frombuffer(cuts[:4 * n], np.int32), np.frombuffer(cuts[4 * n:])
    node = np.zeros(len(x), dtype=np.int64)
    while node.min(initial=n) < n:
        node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] > cut[node])
    return node - n


def _deal(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (id, x, cell, depth) one round further down, where their cell was cut."""
    @F.pandas_udf("long")
    def child(x: pd.Series, cell: pd.Series, cuts: pd.Series) -> pd.Series:
        out = cell.to_numpy().copy()
        for c in pd.unique(cell[cuts.notna()]):
            mine = ((cell == c) & cuts.notna()).to_numpy()
            out[mine] = FAN * c + 1 + _dealt(_matrix(x[mine]), cuts[mine].iloc[0])
        return pd.Series(out)

    joined = rows.join(cuts.select(F.col("cell").alias("_cell"), "cuts"), F.col("cell") == F.col("_cell"), "left")
    return joined.select("id", "x", child("x", "cell", "cuts").alias("cell"), (F.col("depth") + F.col("cuts").isNotNull().cast("int")).alias("depth"))


def cell_tree(points: DataFrame, block: int = BLOCK, seed: int = 42) -> CellTree:
    """Cut cells until each holds at most ``block`` points, or equal ones. A round cuts a cell into FAN parts by a sample of its points."""
    placed = materialise(points.select(F.col("id").cast("long").alias("id"), "x").withColumns({"cell": F.lit(0).cast("long"), "depth": F.lit(0)}), "cells")
    levels, cuts, stuck = FAN.bit_length() - 1, [], None

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows["x"])
        depth = int(np.clip(np.ceil(np.log2(rows["n"].iloc[0] / block)) + 1, 1, levels))  # a little deeper than even halves ask for
        return pd.DataFrame({"cell": rows["cell"].iloc[:1], "cuts": [_subtree(x, depth)]})

    while True:
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        if stuck is not None:
            sizes = sizes.join(stuck, "cell", "left_anti")
        large = materialise(sizes, "large-cells")
        if large.isEmpty():
            break
        sample = placed.join(large, "cell").where(hash_unit(F.col("id"), f"cells-{seed}-{len(cuts)}") < F.lit(float(SAMPLE)) / F.col("n"))
        found = materialise(sample.select("cell", "n", "x").groupBy("cell").applyInPandas(cut, "cell long, cuts binary"), "cell-cuts")
        same = large.select("cell").join(found.where("cuts IS NOT NULL"), "cell", "left_anti").select("cell")  # equal points: cut into chunks later
        stuck = materialise(same if stuck is None else stuck.unionByName(same), "stuck-cells")
        cuts.append(found.where("cuts IS NOT NULL"))
        before, placed = placed, materialise(_deal(placed, cuts[-1]), "cells")
        release(before)
    return CellTree(placed, cuts, *(_children(placed, len(cuts)) if cuts else ([],)))


def _children(placed: DataFrame, rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """Boxes of all cells, grouped by their parents, from the bottom up; and those of the leaves."""
    width = len(placed.select("x").first()["x"])
    box = lambda low, high: [F.array(*[F.min(low[i]) for i in range(width)]).alias("lo"), F.array(*[F.max(high[i]) for i in range(width)]).alias("hi")]
    x = F.col("x")
    nodes = placed.groupBy("cell", "depth").agg(*box(x, x)).withColumn("leaf", F.lit(True))
    nodes = materialise(nodes, "cell-boxes")
    out, level = [], nodes.where(F.col("depth") == rounds)
    for depth in range(rounds, 0, -1):
        parent = F.expr(f"(cell - 1) div {FAN}").alias("parent")
        grouped = materialise(level.select(parent, F.struct("cell", "lo", "hi", "leaf").alias("c")).groupBy("parent").agg(F.collect_list("c").alias("children")), "cell-children")
        out.append(grouped)
        lo, hi = F.transform("children", lambda c: c["lo"]), F.transform("children", lambda c: c["hi"])
        at = lambda i: lambda v: v[i]
        edges = lambda table, best: F.array(*[best(F.transform(table, at(i))) for i in range(width)])
        inner = grouped.select(F.col("parent").alias("cell"), F.lit(depth - 1).alias("depth"), edges(lo, F.array_min).alias("lo"), edges(hi, F.array_max).alias("hi"), F.lit(False).alias("leaf"))
        level = inner.unionByName(nodes.where(F.col("depth") == depth - 1).select(*inner.columns))
    return out[::-1], nodes


def _home(queries: DataFrame, tree: CellTree) -> DataFrame:
    """(id, x, cell): the cell that a query would be put in."""
    at = queries.select("id", "x").withColumns({"cell": F.lit(0).cast("long"), "depth": F.lit(0)})
    for cuts in tree.cuts:
        at = _deal(at, cuts)
    return at.select("id", "x", "cell")


def _away(lo: Column, hi: Column) -> Column:
    """Distance of ``x`` to a box."""
    gap = F.zip_with(F.zip_with("x", lo, lambda v, low: low - v), F.zip_with("x", hi, lambda v, high: v - high), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v))


def _visits(queries: DataFrame, tree: CellTree, *also: str) -> DataFrame:
    """(id, x, cell) and ``also``: queries (id, x, reach) once for each cell whose box comes within their reach; one join a level."""
    own = ["id", "x", *also]
    at = queries.select(*own, "reach", F.lit(0).cast("long").alias("cell"))
    if not tree.children:
        return at.select(*own, "cell")
    out = None
    for children in tree.children:
        near = F.filter("children", lambda c: _away(c["lo"], c["hi"]) <= F.col("reach") * (1 + 1e-12) + 1e-12)
        steps = at.join(children, F.col("cell") == F.col("parent")).select(*own, "reach", F.explode(F.transform(near, lambda c: F.struct(c["cell"].alias("cell"), c["leaf"].alias("leaf")))).alias("c"))
        steps = materialise(steps.select(*own, "reach", "c.cell", "c.leaf"), "cell-visits")
        done = steps.where("leaf").select(*own, "cell")
        out = done if out is None else out.unionByName(done)
        at = steps.where("NOT leaf").select(*own, "reach", "cell")
    return out


def by_blocks(visits: DataFrame, placed: DataFrame, work, schema: str, block: int = BLOCK) -> DataFrame:
    """Run ``work(query frame, point frame) -> frame`` on every (block of queries, chunk of points) that share a cell.

    A cell with many queries or (equal) points is dealt out as pairs of bounded blocks and chunks.
    """
    share = lambda name: F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.lit(1)).cast("int").alias(name)
    sizes = placed.groupBy("cell").agg(share("chunks")).join(visits.groupBy("cell").agg(share("parts")), "cell")
    sizes = materialise(sizes.withColumnRenamed("cell", "_cell"), "cell-sizes")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    on = F.col("cell") == F.col("_cell")
    visits = visits.select(*[F.col(c).alias(c) for c in visits.columns])  # own columns: both sides may come from one table
    q = visits.join(sizes, on).withColumn("part", mine("parts")).withColumn("chunk", others("chunks")).drop("_cell", "chunks", "parts")
    p = placed.join(sizes, on).withColumn("chunk", mine("chunks")).withColumn("part", others("parts")).drop("_cell", "chunks", "parts")
    keys, columns = ["cell", "chunk", "part"], [c.split()[0] for c in schema.split(", ")]

    def both(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ps):
            return pd.DataFrame({c: [] for c in columns})
        return work(qs.sort_values("id"), ps.sort_values("id"))

    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(both, schema)


# ---------------------------------------------------------------- nearest neighbours
def _top(k: int, exclude_self: bool):
    """Work for by_blocks(): the k nearest points of each query, smaller id on ties; queries may bring a ``reach`` that bounds them."""
    def top(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        a, b = _matrix(qs["x"]), _matrix(ps["x"])
        fine_a, fine_b = np.isfinite(a).all(1), np.isfinite(b).all(1)  # others are at no finite distance
        a, b, asked, ids = a[fine_a], b[fine_b], qs["id"].to_numpy()[fine_a], ps["id"].to_numpy()[fine_b]
        far = qs["reach"].to_numpy(dtype=float)[fine_a] if "reach" in qs else np.full(len(a), np.inf)
        found = [_least(a, b, asked, ids, far, k, exclude_self)] if len(a) and len(b) else []
        return pd.DataFrame(np.concatenate(found) if found else np.zeros(0, _FOUND))
    return top


_FOUND = np.dtype([("id", "i8"), ("neighbour", "i8"), ("distance", "f8")])


def _least(a: np.ndarray, b: np.ndarray, asked: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int, exclude_self: bool) -> np.ndarray:
    bounds, out = _Bounds(a, b), []
    for start in range(0, len(a), TILE[0]):
        rows = slice(start, min(start + TILE[0], len(a)))
        limit = far[rows].copy()
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))  # row, distance, point
        left, wide = 0, TILE[1] // 8  # the first tiles are narrow: they bound the distances for the others
        while left < len(b):
            product = bounds.u[rows] @ bounds.v[:, left:left + wide]
            loose, some = np.flatnonzero(np.isinf(limit)), k + int(exclude_self)
            if len(loose) and product.shape[1] > some:  # exact distances of k points bound the k-th
                pick = np.argpartition(product[loose], some - 1, axis=1)[:, :some] + left
                d = _of_pairs(a, b, np.repeat(loose + start, some), pick.ravel()).reshape(pick.shape)
                if exclude_self:
                    d[asked[loose + start][:, None] == ids[pick]] = np.inf
                limit[loose] = np.partition(d, k - 1, axis=1)[:, k - 1]
            i, j = _places(product <= bounds.passing(rows, limit))
            d = _of_pairs(a, b, i + start, j + left)
            keep = np.isfinite(d) & (d <= limit[i] * (1 + 1e-12))
            if exclude_self:
                keep &= asked[i + start] != ids[j + left]
            best = tuple(np.concatenate([old, new[keep]]) for old, new in zip(best, (i, d, j + left)))
            order = np.lexsort((ids[best[2]], best[1], best[0]))
            best = tuple(v[order] for v in best)
            first = np.searchsorted(best[0], best[0])
            best = tuple(v[np.arange(len(order)) - first < k] for v in best)
            sizes = np.bincount(best[0], minlength=len(limit))
            full = np.flatnonzero(sizes == k)
            limit[full] = np.minimum(limit[full], best[1][np.cumsum(sizes)[full] - 1])
            left, wide = left + wide, min(2 * wide, TILE[1])
        made = np.empty(len(best[0]), _FOUND)
        made["id"], made["neighbour"], made["distance"] = asked[best[0] + start], ids[best[2]], best[1]
        out.append(made)
    return np.concatenate(out)


_PAIRS = "id long, neighbour long, distance double"


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "distance")


def nearest(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, block: int = BLOCK, tree: CellTree | None = None) -> DataFrame:
    """(id, rank, neighbour, distance): the k nearest points of every query, exact, smaller id on ties.

    The k-th distance inside a query's own cell bounds its reach; then only cells within reach are looked at. Where
    these are a good part of all cells, blocks of queries meet blocks of points: the fewer the blocks, the less is sent.
    """
    tree = tree or cell_tree(points, block)
    asked = queries.select(F.col("id").cast("long").alias("id"), "x")
    held = tree.placed.select("id", "x", "cell")
    if not tree.cuts:
        return _ranked(by_blocks(asked.withColumn("cell", F.lit(0).cast("long")), held, _top(k, exclude_self), _PAIRS, block), k)
    first = by_blocks(_home(asked, tree), held, _top(k, exclude_self), _PAIRS, block)
    reach = _ranked(first, k).where(F.col("rank") == k).select(F.col("id").alias("_id"), F.col("distance").alias("_far"))
    bounded = materialise(asked.join(reach, F.col("id") == F.col("_id"), "left").select("id", "x", F.coalesce("_far", F.lit(float("inf"))).alias("reach")), "reaches")
    if _cells_in_reach(bounded, tree) > MOST_CELLS:
        return _ranked(by_blocks(bounded.withColumn("cell", F.lit(0).cast("long")), held.withColumn("cell", F.lit(0).cast("long")),
                                 _top(k, exclude_self), _PAIRS, _wide(held, block)), k)
    return _ranked(by_blocks(_visits(bounded, tree), held, _top(k, exclude_self), _PAIRS, block), k)


def _cells_in_reach(bounded: DataFrame, tree: CellTree) -> float:
    """Share of the cells that are within reach, taken from PROBES queries."""
    probes = hash_sample(bounded, "id", PROBES, 42)
    found = F.broadcast(probes).crossJoin(tree.boxes).agg(F.avg((_away(F.col("lo"), F.col("hi")) <= F.col("reach")).cast("double"))).first()[0]
    return float(found or 0.0)


def _wide(points: DataFrame, block: int) -> int:
    """Points of a block where all blocks meet: an eighth of them, so that tasks are many, as far as the bytes allow."""
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    return max(block, min(-(-facts["n"] // 8), WIDE_BYTES // (8 * max(1, facts["width"] or 1))))


def hashed_cells(rows: DataFrame, planes: np.ndarray, offsets: np.ndarray, tables: int) -> DataFrame:
    """(id, x, cell): every row once in each hash table; a cell is a table and the signs of a row's projections."""
    bits = planes.shape[1] // tables

    @F.pandas_udf("array<long>")
    def cells(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        sign = (_matrix(x) @ planes > offsets).reshape(len(x), tables, bits)
        code = (sign * (1 << np.arange(bits))).sum(2) + (np.arange(tables) << 40)
        return pd.Series(list(code.astype(np.int64)))

    return rows.select(F.col("id").cast("long").alias("id"), "x", F.explode(cells("x")).alias("cell"))


def approximate_nearest(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, tables: int = 12, bucket: int = 512, seed: int = 42,
                        block: int = BLOCK) -> DataFrame:
    """(id, rank, neighbour, distance): nearest points among those that share a bucket in one of ``tables`` hash tables, by exact distance.

    For vectors of many dimensions, where boxes exclude nothing. Buckets are the signs of random projections, cut at the
    medians of a bounded sample, as many as give about ``bucket`` points each; larger ones are dealt out in bounded
    blocks, none is cut short. Recall is stated in the README and held by a test.
    """
    n = points.count()
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / bucket))))
    if not bits:
        return nearest(queries, points, k, exclude_self, block)
    sample = np.array([r["x"] for r in hash_sample(points, "id", SAMPLE, seed).collect()], dtype=float)
    planes = np.random.default_rng(seed).normal(size=(sample.shape[1], tables * bits))
    offsets = np.median(sample @ planes, axis=0)
    held = materialise(hashed_cells(points, planes, offsets, tables), "hashed-points")
    asked = materialise(hashed_cells(queries, planes, offsets, tables), "hashed-queries")
    pairs = by_blocks(asked, held, _top(k, exclude_self), _PAIRS, block)
    return _ranked(pairs.groupBy("id", "neighbour").agg(F.min("distance").alias("distance")), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (id, neighbour) that were found."""
    hit = exact.select("id", "neighbour").join(found.select("id", "neighbour"), ["id", "neighbour"], "left_semi")
    return hit.count() / max(1, exact.count())


def vote(neighbours: DataFrame, labels: DataFrame, weights: str = "uniform") -> DataFrame:
    """(id, label, share): weighted share of each label among a query's neighbours. ``labels``: (id, label).

    With ``distance`` the weight is 1 / distance; neighbours at distance 0 then count alone.
    """
    named = neighbours.join(labels.select(F.col("id").alias("neighbour"), "label"), "neighbour")
    if weights == "uniform":
        w = F.lit(1.0)
    else:
        zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("id"))  # k rows per query
        named = named.withColumn("_zero", zero)
        w = F.when(F.col("_zero") == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    summed = named.withColumn("_w", w).groupBy("id", "label").agg(F.sum("_w").alias("_w"))
    total = F.sum("_w").over(Window.partitionBy("id"))
    return summed.select("id", "label", (F.col("_w") / total).alias("share"))


# ---------------------------------------------------------------- oversampling
def oversample(rows: DataFrame, settings: Settings = DEFAULTS, k: int = 5) -> DataFrame:
    """Synthetic rows (id, x, label) for the rarer of two classes, on the lines between neighbours.

    ``rows``: (id, x, label), and ``also``: arrays that are not compared, but drawn along on the same lines. The number
    of rows brings the classes level; where it is no multiple of the minority size, a hash decides which rows get one
    more. A class of one row has no neighbours and is left alone.
    """
    also = [c for c in rows.columns if c == "also"]
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if len(counts) != 2:
        raise ValueError("oversampling needs exactly two classes")
    minor = min(counts, key=lambda c: counts[c])
    need = abs(max(counts.values()) - counts[minor]) / counts[minor]
    small = rows.where(F.col("label") == minor).select("id", "x", *also)
    near = nearest(small, small, k, exclude_self=True)
    whole, rest = int(need), need - int(need)
    copies = F.lit(whole) + F.when(hash_unit(F.col("id"), f"extra-{settings.seed}") < rest, 1).otherwise(0)
    width = min(k, counts[minor] - 1)
    drawn = (small.withColumn("_copies", copies).where("_copies > 0")
             .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
             .withColumn("_tag", F.concat_ws("#", "id", "copy"))
             .withColumn("rank", (F.floor(hash_unit(F.col("_tag"), f"pick-{settings.seed}") * width) + 1).cast("int"))
             .withColumn("gap", hash_unit(F.col("_tag"), f"gap-{settings.seed}")))
    ends = small.select(F.col("id").alias("neighbour"), *[F.col(c).alias(f"_{c}") for c in ("x", *also)])
    partner = near.join(ends, "neighbour").select("id", "rank", *[f"_{c}" for c in ("x", *also)])
    line = lambda c: F.zip_with(c, f"_{c}", lambda a, b: a + F.col("gap") * (b - a)).alias(c)
    return drawn.join(partner, ["id", "rank"]).select("id", "copy", *[line(c) for c in ("x", *also)], F.lit(minor).alias("label"))


# ---------------------------------------------------------------- density clusters
def _links(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    """One edge per id: to the smallest id it reaches in the graph 'within reach' between two lists of ids."""
    (i, j), (n, m) = _places(near), _places(near.T)  # links by left id, and by right id
    low_left, low_right = left.copy(), right.copy()
    if len(i):
        rows, from_row = np.unique(i, return_index=True)
        columns, from_column = np.unique(n, return_index=True)
        while True:
            a = np.minimum(low_left[rows], np.minimum.reduceat(low_right[j], from_row))
            changed, low_left[rows] = (a != low_left[rows]).any(), a
            b = np.minimum(low_right[columns], np.minimum.reduceat(low_left[m], from_column))
            if not changed and (b == low_right[columns]).all():
                break
            low_right[columns] = b
    edges = pd.DataFrame({"a": np.concatenate([left, right]), "b": np.concatenate([low_left, low_right])})
    return edges[edges["a"] != edges["b"]].drop_duplicates().astype("int64")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable. Smallest-label rounds with pointer jumps; every round is a written table."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = held = materialise(nodes.select("id", F.col("id").alias("component")), "components")
    while True:
        heard = (both.join(labels, F.col("a") == F.col("id")).groupBy("b").agg(F.min("component").alias("_m")))
        lower = labels.join(heard, F.col("id") == F.col("b"), "left").select(
            "id", F.col("component").alias("_old"), F.least("component", F.coalesce("_m", F.col("component"))).alias("_new"))
        lower = materialise(lower, "components-low")
        jump = lower.select(F.col("id").alias("_at"), F.col("_new").alias("_jump"))
        after = materialise(lower.join(jump, F.col("_new") == F.col("_at"), "left").select(
            "id", F.least("_new", F.coalesce("_jump", F.col("_new"))).alias("component"), "_old"), "components")
        release(lower, held)
        held = after
        changed = not after.where(F.col("component") != F.col("_old")).isEmpty()
        labels = after.select("id", "component")
        if not changed:
            release(both)
            return labels


def neighbour_distance(points: DataFrame, k: int, share: float = 0.9) -> float:
    """Quantile of the distance to the k-th nearest point (a point is its own first neighbour)."""
    far = nearest(points, points, k).where(F.col("rank") == k)
    return float(exact_quantiles(far, "distance", {"q": share}).first()["q"])


def density_clusters(points: DataFrame, eps: float, min_points: int, block: int = BLOCK) -> DataFrame:
    """(id, cluster): DBSCAN. Cluster = smallest core id of the cluster, -1 = noise.

    Passes over (block, chunk) pairs: neighbour counts, first in the own cell and elsewhere only for points that found
    too few there; links between core points, each pair of cells from one side; border points (which join the cluster
    with the smallest id in reach).
    """
    points = materialise(points.select(F.col("id").cast("long").alias("id"), "x"), "density-points")
    tree = cell_tree(points, block)
    placed = tree.placed.select("id", "x", "cell")
    reach = F.lit(float(eps))

    def count(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        near = _within(_matrix(qs["x"]), _matrix(ps["x"]), eps)
        return pd.DataFrame({"id": qs["id"].to_numpy(), "n": near.sum(1).astype("int64")})

    def counted(visits: DataFrame) -> DataFrame:
        return by_blocks(visits, placed, count, "id long, n long", block).groupBy("id").agg(F.sum("n").alias("n"))

    enough = F.col("n") >= min_points
    settled = materialise(counted(placed).where(enough).select("id"), "density-settled")
    open_visits = materialise(_visits(points.join(settled, "id", "left_anti").select("id", "x", reach.alias("reach")), tree), "density-open")
    core = materialise(settled.unionByName(counted(open_visits).where(enough).select("id")), "density-core")
    core_placed = placed.join(core, "id", "left_semi")

    def link(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        near = _within(_matrix(qs["x"]), _matrix(ps["x"]), eps)
        return _links(near, qs["id"].to_numpy(), ps["id"].to_numpy())

    one_side = _visits(core_placed.select("id", "x", reach.alias("reach"), F.col("cell").alias("home")), tree, "home").where("cell >= home").drop("home")
    edges = by_blocks(materialise(one_side, "density-visits"), core_placed, link, "a long, b long", block)
    clusters = components(core, edges)

    def border(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        near = _within(_matrix(qs["x"]), _matrix(ps["x"]), eps)
        low = np.where(near, ps["component"].to_numpy()[None, :], np.iinfo("int64").max).min(1)
        found = low < np.iinfo("int64").max
        return pd.DataFrame({"id": qs["id"].to_numpy()[found], "component": low[found]})

    joined = core_placed.join(clusters, "id")
    touched = by_blocks(open_visits.join(core, "id", "left_anti"), joined, border, "id long, component long", block).groupBy("id").agg(F.min("component").alias("component"))
    named = clusters.unionByName(touched)
    return points.select("id").join(named, "id", "left").select("id", F.coalesce("component", F.lit(-1)).alias("cluster"))
