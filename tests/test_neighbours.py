from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronage.functions.expressions import hash_unit
from patronage.operators import neighbours as N


def cloud(n=300, seed=0):
    """Blobs of different density, copies (a third of all rows are one point), stragglers."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.3, (n // 3, 3)), np.tile([[5.0, 5.0, 5.0]], (n // 3, 1)), rng.uniform(-10, 10, (n - 2 * (n // 3), 3))])
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def dist(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


@pytest.mark.parametrize("skip_self", [False, True])
def test_nearest_equals_brute_force(spark, skip_self):
    x = cloud()
    df = frame(spark, x)
    got = {}
    for r in N.nearest(df, df, 4, exclude_self=skip_self, block=32).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["neighbour"], r["distance"])
    d = dist(x, x)
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if not (skip_self and j == i))[:4]
        assert [got[i][k + 1][0] for k in range(4)] == [j for _, j in order]
        assert [got[i][k + 1][1] for k in range(4)] == pytest.approx([v for v, _ in order], abs=1e-12)


def test_fewer_points_than_k(spark):
    x = cloud(9)
    assert N.nearest(frame(spark, x), frame(spark, x[:2]), 5).count() == 18


def test_votes(spark):
    near = spark.createDataFrame([(1, 1, 10, 0.0), (1, 2, 11, 1.0), (2, 1, 10, 1.0), (2, 2, 11, 4.0)], "id long, rank int, neighbour long, distance double")
    labels = spark.createDataFrame([(10, "a"), (11, "b")], "id long, label string")
    shares = {(r["id"], r["label"]): r["share"] for r in N.vote(near, labels, "distance").collect()}
    assert shares == {(1, "a"): 1.0, (1, "b"): 0.0, (2, "a"): pytest.approx(0.8), (2, "b"): pytest.approx(0.2)}
    assert {r["share"] for r in N.vote(near, labels).collect()} == {0.5}


def test_oversampling(spark):
    x = cloud(120, 4)
    df = frame(spark, x).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    new = N.oversample(df, k=3).collect()
    assert len(new) == 60 and {r["label"] for r in new} == {1}
    small = x[::4]
    for r in new:
        a = x[r["id"]]
        near = small[np.argsort(dist(a[None], small)[0])[1:5]]
        span = np.abs(near - a).max(0) + 1e-9
        assert (np.abs(np.array(r["x"]) - a) <= span).all()
    assert [r["x"] for r in sorted(new, key=lambda r: (r["id"], r["copy"]))] == \
        [r["x"] for r in N.oversample(df.repartition(7), k=3).orderBy("id", "copy").collect()]


def brute_density(x, eps, need):
    near = dist(x, x) <= eps
    core = near.sum(1) >= need
    label = {i: i for i in range(len(x)) if core[i]}
    changed = True
    while changed:
        changed = False
        for i in label:
            low = min(label[j] for j in label if near[i, j])
            if low < label[i]:
                label[i], changed = low, True
    out = {}
    for i in range(len(x)):
        touching = [label[j] for j in label if near[i, j]]
        out[i] = label[i] if core[i] else (min(touching) if touching else -1)
    return out


def test_density_clusters_equal_brute_force(spark):
    x = cloud(240, 2)
    got = {r["id"]: r["cluster"] for r in N.density_clusters(frame(spark, x), 0.4, 6, block=24).collect()}
    want = brute_density(x, 0.4, 6)
    assert got == want and -1 in set(want.values()) and len(set(want.values())) >= 3


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60)
    edges = spark.range(59).where("id % 20 <> 19").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["id"]: r["component"] for r in N.components(nodes, edges).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)}


def test_cells_are_bounded_and_looked_at_points_stay_few_when_points_grow(spark):
    """Ten times the points: a query looks at about as many."""
    looked = []
    for n in (3000, 30000):
        df = spark.range(n).select("id", F.array(*[hash_unit(F.col("id"), s) for s in "ab"]).alias("x"))
        tree = N.cell_tree(df, block=64)
        sizes = tree.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        assert sizes.agg(F.max("n")).first()[0] <= 64 and sizes.agg(F.sum("n")).first()[0] == n
        some = df.where(F.pmod("id", F.lit(n // 500)) == 0)
        near = N.nearest(some, df, 5, block=64, tree=tree).where("rank = 5")
        reach = some.join(near.select("id", F.col("distance").alias("reach")), "id")
        visits = N._visits(reach, tree).join(sizes, "cell").groupBy("id").agg(F.sum("n").alias("points"))
        looked.append(visits.agg(F.avg("points")).first()[0])
    assert looked[1] < 1.5 * looked[0] and looked[1] < 400


def test_approximate_neighbours_reach_their_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    exact = N.nearest(v, v, 10, exclude_self=True).persist()
    found = N.approximate_nearest(v, v, 10, exclude_self=True).persist()
    assert N.recall(found, exact) >= 0.95
    true = {(r["id"], r["neighbour"]): r["distance"] for r in exact.collect()}
    assert all(true[k] == pytest.approx(r["distance"]) for r in found.collect() if (k := (r["id"], r["neighbour"])) in true)
    assert N.recall(N.approximate_nearest(v, v, 10, exclude_self=True, bucket=128, tables=16), exact) >= 0.9


def test_a_bucket_of_equal_points_is_not_cut_short(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 1000, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(*[hash_unit(F.col("id"), s) for s in "ab"])).alias("x"))
    got = N.approximate_nearest(df.where("id < 20"), df, 3, bucket=64, block=100)
    assert {(r["id"], r["neighbour"], r["distance"]) for r in got.collect()} == {(i, j, 0.0) for i in range(20) for j in range(3)}


def odd_points(width):
    """Ties, far stragglers, numbers that single precision can't hold, rows without a distance."""
    rng = np.random.default_rng(width)
    x = np.concatenate([np.round(rng.normal(size=(500, width)), 1), rng.normal(size=(300, width)) * 1e-3 + 1e4, np.zeros((20, width))])
    x[3], x[5, 0], x[6, 0] = x[3] * 1e12, np.nan, np.inf
    return x


@pytest.mark.parametrize("width", [1, 7, 64])
def test_bounded_blocks_hold_the_distances_of_all_pairs(width):
    x = odd_points(width)
    ids = np.arange(len(x)) // 2
    rows = pd.DataFrame({"id": ids, "x": list(x)})
    with np.errstate(invalid="ignore"):
        d = N._distances(x, x)
    for reach in (0.0, 0.3, float(np.nanquantile(np.where(np.isfinite(d), d, np.nan), 0.2))):
        assert (N._within(x, x, reach) == (d <= reach)).all()
    d[ids[:, None] == ids[None, :]] = np.inf
    got = N._top(4, True)(rows, rows)
    want = [(ids[i], ids[j], d[i, j]) for i in range(len(x)) for j in np.lexsort((ids, d[i]))[:4] if np.isfinite(d[i, j])]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)


def test_blocks_get_a_distance_for_few_pairs(monkeypatch):
    """A block of 2,000 queries and 4,000 points: distances are made for under 5 % of the pairs."""
    made, of_pairs = [], N._of_pairs
    monkeypatch.setattr(N, "_of_pairs", lambda a, b, i, j: made.append(len(i)) or of_pairs(a, b, i, j))
    x = np.random.default_rng(1).normal(size=(4000, 64))
    rows = pd.DataFrame({"id": np.arange(4000), "x": list(x)})
    N._top(5, True)(rows[:2000], rows)
    assert sum(made) < 0.05 * 2000 * 4000


def test_where_boxes_exclude_little_rows_go_to_few_blocks(spark):
    """64 dimensions: every cell is in reach. Blocks are an eighth of the points, not one a cell, and the result is exact."""
    x = np.random.default_rng(2).normal(size=(1600, 64))
    df = frame(spark, x)
    tree = N.cell_tree(df, block=32)
    assert N._cells_in_reach(df.withColumn("reach", F.lit(12.0)), tree) > N.MOST_CELLS and N._wide(df, 32) == 200
    got = {(r["id"], r["rank"]): r["neighbour"] for r in N.nearest(df, df, 3, exclude_self=True, block=32).collect()}
    order = np.argsort(dist(x, x) + np.diag([np.inf] * len(x)), axis=1)[:, :3]
    assert got == {(i, k + 1): order[i, k] for i in range(len(x)) for k in range(3)}
