"""Propagation schedules, bounds, splits, readers and models written out plainly; golden runs where the data sets are at hand."""

import math
import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import clustering, density, grid, metrics, neighbours, ordering
from pointloom.operators.points import with_slot
from pointloom.plans import components, owners
from pointloom.sources import arff


def point_table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, coords array<double>")


@pytest.fixture(scope="module")
def ring():
    """Labels 1..n of a random ring graph, with (slot, stride) both ways."""
    rng = random.Random(3)
    n = 41
    pairs = {(i, j) for i, j in ((rng.randrange(n), rng.randrange(n)) for _ in range(60)) if i != j}
    return n, sorted({(i, (j - i) % n) for i, j in pairs} | {(j, (i - j) % n) for i, j in pairs})


@pytest.mark.parametrize("group", [None, 1, 6])
def test_chained_passes(spark, ring, group):
    n, near = ring
    want, by = list(range(1, n + 1)), set(near)
    size = group or n // 2
    starts = list(range(1, n // 2 + 1, size))
    for _ in range(2):
        for forward, firsts in ((True, starts), (False, starts[::-1])):
            for a in firsts:
                strides = range(a, min(a + size, n // 2 + 1))
                if forward:
                    want = [max([want[i], *(want[(i + k) % n] for k in strides if (i, k) in by)]) for i in range(n)]
                else:
                    want = [max([want[i], *(want[(i - k) % n] for k in strides if 2 * k < n and ((i - k) % n, k) in by)]) for i in range(n)]
    labels = spark.createDataFrame([(i, i + 1) for i in range(n)], "slot long, label long")
    got = components.propagate_passes(labels, spark.createDataFrame(near, "slot long, stride long"), n, rounds=2, group=group)
    assert [r["label"] for r in got.orderBy("slot").collect()] == want


def test_sequential_sweeps_and_doubling(ring):
    n, near = ring
    by, want = set(near), list(range(1, n + 1))
    for _ in range(math.ceil(math.log2(n))):
        for k in range(1, n // 2 + 1):
            want = [max(want[i], want[(i + k) % n]) if (i, k) in by else want[i] for i in range(n)]
            if 2 * k < n:
                want = [max(want[i], want[(i - k) % n]) if ((i - k) % n, k) in by else want[i] for i in range(n)]
    assert components.sweep_labels(np.arange(1, n + 1), near).tolist() == want
    twice = list(range(1, n + 1))
    for r in range(math.ceil(math.log2(n))):
        k = 1 << r
        twice = [max(twice[i], twice[(i + k) % n]) if (i, k) in by else twice[i] for i in range(n)]
    assert components.sweep_labels(np.arange(1, n + 1), near, doubling=True).tolist() == twice
    with pytest.raises(ValueError):
        components.sweep_labels(np.arange(components.SWEPT + 1), [])


def test_components_of_awkward_graphs(spark):
    """Long paths in random order, cliques, stars and loops, over many tasks."""
    rng = random.Random(8)
    names = rng.sample(range(10**6), 900)
    edges = [(names[i], names[i + 1]) for i in range(299)]
    edges += [(names[300], names[i]) for i in range(301, 500)]
    edges += [(names[i], names[j]) for i in range(500, 520) for j in range(500, 520)]
    edges += [(names[i], names[i]) for i in range(600, 610)]
    rng.shuffle(edges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for part in (names[:300], names[300:500], names[500:520]):
        want |= dict.fromkeys(part, min(part))
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("z, eps, want", [([0.0] * 10, 0.1, 5), ([0.0] * 6 + [0.5] * 4, 0.1, 5), ([0.0] * 3 + [1.0] * 9, 0.0, 6), ([2.0], 1.0, 1), ([], 1.0, 1), ([0.0, 1.0, 2.0, 3.0, 9.0, 20.0], 1.0, 1)])
def test_window_bound_counts_positions(spark, z, eps, want):
    df = spark.createDataFrame(list(enumerate(z)), "id long, z double")
    assert ordering.kmax_window(df, eps).first()[0] == want


def test_owners_without_points(spark):
    empty = point_table(spark, []).withColumn("true_label", F.lit(1))
    assert owners.run([empty, empty], 0.5, 2).count() == 0
    one = point_table(spark, [(0, 0), (0, 0.1), (0.1, 0), (5, 5)]).withColumn("true_label", F.lit(1))
    out = owners.run([one, empty], 0.5, 2).collect()
    assert [r["cluster"] for r in out] == [1, 1, 1, -1] and {r["owner_id"] for r in out} == {0}


def test_block_lookup(spark):
    packed = spark.createDataFrame([(0, 1, 0, 5), (0, 1, 1, 6), (1, 1, 0, 7)], "owner_id int, cell_id long, block_idx int, global_id long")
    wanted = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (1, 9, 0)], "owner_id int, cell_id long, block_idx int")
    assert sorted(r["global_id"] for r in owners.block_lookup(packed, wanted).collect()) == [6, 7]


def test_random_split_is_even(spark):
    df = spark.range(101)
    rows = ordering.split_random(df, 4, seed=5).collect()
    by = {k: sorted(r["owner_local_idx"] for r in rows if r["owner_id"] == k) for k in range(4)}
    assert [len(v) for v in by.values()] == [26, 25, 25, 25] and all(v == list(range(len(v))) for v in by.values())
    assert {(r["id"], r["owner_id"]) for r in ordering.split_random(df, 4, seed=6).collect()} != {(r["id"], r["owner_id"]) for r in rows}


def test_ball_gap_bound():
    rng = np.random.default_rng(0)
    near = rng.normal(0, 0.1, (20, 2))
    apart = np.concatenate([near, near + 100])
    # splits of 41, 20 and fewer rows span 40 (1 round the ring), 19, ... slots; of 40 rows in two far groups, only the groups count
    assert ordering.ball_gap_kmax(rng.normal(0, 1, (41, 2)), 5.0) == 19 and ordering.ball_gap_kmax(apart, 0.5) == 19
    assert ordering.ball_gap_kmax(np.zeros((7, 2)), 0.1) == 2 and ordering.ball_gap_kmax(np.zeros((2, 2)), 0.1) == 1


def test_axis_counts_and_margins():
    assert grid.axis_counts([0, 0], [1.0, 0.1], 0.4) == [3, 1] and grid.axis_counts([0, 0], [1.1, 0.1], 0.4, "round") == [3, 1]
    assert neighbours.squared_margin("cs", 2, 15) == 2.0**-15 * 1.05 * 2 and neighbours.squared_margin("cm", 2) == 0.05


def test_bandwidth_and_one_class(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.3, (120, 2)), [[9.0, 9.0], [-9.0, 3.0]]])
    points = point_table(spark, x.tolist())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    k = int(len(x) * 0.3)
    assert math.isclose(clustering.estimate_bandwidth(points), float(np.sort(d, 1)[:, k - 1].mean()), rel_tol=1e-9)
    out = {r["id"]: r["cluster"] for r in clustering.one_class(points, gamma=0.5, nu=0.1).collect()}
    outside = [i for i, c in out.items() if c == -1]
    assert {120, 121} <= set(outside) and 2 <= len(outside) <= 0.1 * len(x) + 1
    assert clustering.estimate_bandwidth(points.limit(0)) == 0.0 and clustering.one_class(points.limit(0)).count() == 0


def test_named_attributes_anywhere(spark, tmp_path):
    path = tmp_path / "mixed.arff"
    path.write_text("% c\n@relation r\n@attribute colour {red,blue}\n@attribute x REAL\n@attribute 'a b' numeric\n@data\nred,1.5,2\nblue,?,3\n\n% end\n")
    assert [tuple(r) for r in arff.read_named(spark, str(path)).orderBy("id").collect()] == [(0, "red", 1.5, 2.0), (1, "blue", None, 3.0)]


def test_convergence_rounds(spark):
    points = point_table(spark, [(0.1 * i, 0.0) for i in range(12)])
    rows = {r["rounds"]: r["ari"] for r in density.convergence(points, 0.11, 2, [1, 12]).collect()}
    assert rows[12] == 1.0 and rows[1] < 1.0


def test_prepared_order_and_restore(spark):
    points = point_table(spark, [(3, 0), (1, 0), (2, 0), (9, 0)])
    ordered, k = ordering.prepare_order(points, 1.0)
    assert k == 1 and [r["id"] for r in ordered.orderBy("slot").collect()] in ([1, 2, 0, 3], [3, 0, 2, 1])
    slots = with_slot(points.select("id"), "id")
    assert sorted(tuple(r) for r in ordering.restore(slots, slots.select("slot", (F.col("slot") * 10).alias("v"))).collect()) == [(0, 0), (1, 10), (2, 20), (3, 30)]


#: Public point sets: eps, min_pts, clusters, noise, adjusted Rand index x 100 (fixed values of the exact algorithm).
GOLDEN = {
    "hepta": (1.0, 4, 7, 0, 100.0), "lsun": (0.5, 4, 3, 0, 100.0), "tetra": (0.43, 3, 4, 8, 97.25), "twodiamonds": (0.14, 6, 2, 1, 99.75),
    "target": (0.25, 4, 2, 12, 99.96), "twomoons": (0.28, 5, 2, 0, 100.0), "longsquare": (1.15, 6, 6, 35, 95.02),
}


@pytest.mark.skipif("POINT_SETS" not in os.environ, reason="POINT_SETS names no folder of the public ARFF point sets")
@pytest.mark.parametrize("name", GOLDEN)
def test_golden_runs(spark, name):
    eps, min_pts, clusters, noise, ari = GOLDEN[name]
    points = arff.read(spark, str(Path(os.environ["POINT_SETS"]) / f"{name}.arff"))
    found = density.dbscan(points, eps, min_pts, normalize="global", tie="first")
    assert tuple(metrics.cluster_count(found).first()) == (clusters, noise)
    assert round(100 * metrics.adjusted_rand(found, "true_label", "cluster").first()[0], 2) == ari
