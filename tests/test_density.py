"""Density clustering against a plain Python version, tie rules, invariances and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from pointloom.operators import density, neighbours, points
from pointloom.plans import owners


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(rows)], "id long, coords array<double>, true_label int")


def plain(rows, eps, min_pts, closed=True):
    """Degrees, clusters by least core, and each point's set of neighbouring clusters."""
    n = len(rows)
    near = lambda a, b: (d := sum((x - y) ** 2 for x, y in zip(a, b))) <= eps * eps if closed else sum((x - y) ** 2 for x, y in zip(a, b)) < eps * eps
    adj = [[j for j in range(n) if j != i and near(rows[i], rows[j])] for i in range(n)]
    core = [len(a) + 1 >= min_pts for a in adj]
    label, k = [-1] * n, 0
    for i in range(n):
        if core[i] and label[i] < 0:
            k += 1
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0 and core[j]:
                    label[j] = k
                    todo += adj[j]
    first = [label[i] if core[i] else min([label[j] for j in adj[i] if core[j]], default=-1) for i in range(n)]
    return [len(a) + 1 for a in adj], core, first


def clusters(df):
    return [r["cluster"] for r in df.orderBy("id").collect()]


def test_textbook_points(spark):
    rows = list(zip((1, 1.2, 0.8, 3.7, 3.9, 3.6, 10), (1.1, 0.8, 1, 4, 3.9, 4.1, 10)))
    assert clusters(density.dbscan_textbook(table(spark, rows), 0.5, 2)) == [1, 1, 1, 2, 2, 2, -1]


def test_notebook_points(spark):
    rows = [(1, 1), (1.5, 1.2), (2, 1.1), (4, 1.5), (4.5, 1.7), (7, 3), (7.5, 3.1), (8, 3.2)]
    assert clusters(density.dbscan(table(spark, rows), 1.0, 2)) == [1, 1, 1, 2, 2, 3, 3, 3]


@pytest.mark.parametrize("method", ["grid", "band", "cross"])
def test_against_plain(spark, method):
    rng = random.Random(5)
    rows = [(rng.gauss(c, 0.3), rng.gauss(-c, 0.3), rng.random()) for c in (0, 2, 4) for _ in range(25)] + [(rng.uniform(-2, 6), rng.uniform(-6, 2), 0) for _ in range(15)]
    degree, core, first = plain(rows, 0.45, 4)
    got = density.dbscan(table(spark, rows), 0.45, 4, method=method).orderBy("id").collect()
    assert [r["n_neighbors"] for r in got] == degree
    assert [r["is_core"] for r in got] == core
    assert [r["cluster"] for r in got] == first


def test_tie_rules(spark):
    # a border point (id 4) between two groups, a neighbour of one core of each
    rows = [(0, 0), (0, 0.1), (0.1, 0), (0.05, 0.05), (1.05, 0), (2, 0), (2, 0.4), (2.1, 0), (2.05, 0.05)]
    p = table(spark, rows)
    assert neighbours.join_cross(p, 1.0, 2).where("src = 4 or dst = 4").count() == 2
    by = {t: clusters(density.dbscan(p, 1.0, 4, tie=t))[4] for t in density.TIES}
    assert by == {"first": 1, "min": 1, "max": 2, "stride": 2, "overwrite": 2}


def test_boundary_distance_is_an_edge_only_when_closed(spark):
    p = table(spark, [(0, 0), (0.5, 0)])
    for method in ("grid", "band", "cross"):
        assert neighbours.eps_join(p, 0.5, method).count() == 1
        assert neighbours.eps_join(p, 0.5, method, closed=False).count() == 0


def test_degenerate_tables(spark):
    one = density.dbscan(table(spark, [(3, 3)]), 0.1, 2, normalize="global").collect()[0]
    assert (one["cluster"], one["role"], one["n_neighbors"]) == (-1, "noise", 1)
    same = density.dbscan(table(spark, [(2, 2)] * 5), 0.1, 5, normalize="global")
    assert clusters(same) == [1] * 5
    assert density.dbscan(table(spark, [(1, 1)]).limit(0), 0.1, 2).count() == 0
    broken = spark.createDataFrame([(0, [1.0, 1.0]), (1, None), (2, [1.0, None])], "id long, coords array<double>")
    assert [r["id"] for r in density.dbscan(broken, 0.1, 1).collect()] == [0]


def test_bounded_rounds_leave_long_chains_in_parts(spark):
    chain = table(spark, [(k, 0) for k in range(12)])
    exact = set(clusters(density.dbscan(chain, 1.0, 2)))
    parts = set(clusters(density.dbscan(chain, 1.0, 2, max_rounds=2)))
    assert exact == {1} and len(parts) > 1


def test_owner_split_changes_nothing(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(c, 0.2), rng.gauss(c, 0.2)) for c in (0, 3) for _ in range(20)]
    whole = clusters(density.dbscan(table(spark, rows), 0.5, 3))
    p = table(spark, rows)
    parts = [p.where(F.col("id") % 3 == k) for k in range(3)]
    out = owners.run(parts, 0.5, 3, show=[0]).collect()
    got = {r["owner_local_idx"]: r for r in out}
    pairs = {(whole[i], got[i]["cluster"]) for i in range(len(rows))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all((got[i]["coords"] is not None) == (i % 3 == 0) for i in range(len(rows)))


def test_fuzzy_and_sweep(spark):
    rng = random.Random(3)
    p = table(spark, [(rng.gauss(0, 0.1), rng.gauss(0, 0.1)) for _ in range(20)] + [(5, 5)])
    assert clusters(density.fuzzy_dbscan(p, 0.5, 3))[:20] == [1] * 20
    assert clusters(density.fn_dbscan(p, 0.5, 3))[20] == -1
    assert [(r["clusters"], r["noise"]) for r in density.sweep(p, [0.5], [3]).collect()] == [(1, 1)]


def test_normalisation_invariance(spark):
    rng = random.Random(9)
    rows = [(rng.random(), rng.random()) for _ in range(40)]
    moved = [(x * 7 + 3, y * 7 + 3) for x, y in rows]
    a = clusters(density.dbscan(table(spark, rows), 0.15, 3, normalize="global"))
    b = clusters(density.dbscan(table(spark, moved), 0.15 * 7, 3, normalize="global"))
    assert a == b
    assert points.scale_of(table(spark, [(2, 2)])) == (2.0, 1.0)
