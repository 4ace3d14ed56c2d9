"""Grids, orders, metrics, clusterings, approximations and files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import approx, minimax
from pointloom.operators import clustering, grid, metrics, ordering
from pointloom.sources import arff, files, generators
from pointloom.streaming import assign


def test_grid_centres_and_strides(spark):
    got = [r["centre"] for r in grid.centres(spark, [0.0, 0.0], [1.0, 1.0], 0.5).orderBy("cell_id").collect()]
    assert got == [[0.25, 0.25], [0.25, 0.75], [0.75, 0.25], [0.75, 0.75]]
    assert grid.first_axis_fastest([9, 9]) == [1, 9] and grid.first_axis_fastest([9, 9, 9]) == [1, 9, 81]
    cell = grid.cell_index(F.array(F.lit(0.5), F.lit(1.0)), [0.0, 0.0], [1.0, 1.0], 0.5)
    low = grid.cell_index(F.array(F.lit(0.5), F.lit(1.0)), [0.0, 0.0], [1.0, 1.0], 0.5, "lower")
    out = grid.cell_index(F.array(F.lit(1.5), F.lit(1.0)), [0.0, 0.0], [1.0, 1.0], 0.5)
    assert list(spark.range(1).select(cell, low, out).first()) == [[1, 1], [0, 1], None]


def test_core_counts(spark):
    for n, least in ((16, 3), (32, 5), (64, 60)):
        rows = generators.counts(spark, n, n).collect()
        assert all(1 <= r["n_neighbors"] <= n for r in rows) and least <= n


def test_gap_labels(spark):
    rows = [(i, 187.5592) for i in range(96)] + [(96 + i, 187.4796) for i in range(2)] + [(98, 150.0), (99, 0.2)]
    df = spark.createDataFrame(rows, "id long, label double")
    got = {r["id"]: (r["grp"], r["cluster"]) for r in ordering.gap_groups(df, "label", 1.9, 212).collect()}
    assert {got[i] for i in range(98)} == {(2, 188)} and got[98] == (1, 150) and got[99] == (None, -1)


def test_orders(spark):
    pts = spark.createDataFrame([(i, [float(i % 5), float(i)]) for i in range(20)], "id long, coords array<double>")
    assert [r["id"] for r in ordering.pca_order(pts).orderBy("slot").collect()] == list(range(20))
    x = np.random.default_rng(0).random((33, 2))
    order = ordering.ball_order(x)
    assert sorted(order) == list(range(33)) and 1 <= ordering.ball_kmax(x, order, 0.2) <= 16
    split = ordering.split_contiguous(pts, 3).groupBy("owner_id").count().orderBy("owner_id").collect()
    assert [r["count"] for r in split] == [6, 6, 8]


def test_metrics(spark):
    df = spark.createDataFrame([(i, i // 5, i // 5) for i in range(20)], "id long, a int, b int")
    assert metrics.adjusted_rand(df, "a", "b").first()[0] == 1.0
    mapping = metrics.majority_mapping(df.withColumn("b", F.lit(0)), "b", "a").collect()
    assert [tuple(r) for r in mapping] == [(0, 0, 5)]
    pts = spark.createDataFrame([(0, [0.0], 1), (1, [1.0], 1), (2, [10.0], 2)], "id long, coords array<double>, cluster int")
    a, b = 1 - 1 / 10, 1 - 1 / 9
    assert metrics.silhouette(pts).first()[0] == pytest.approx((a + b + 0) / 3)
    assert metrics.silhouette(pts.where("cluster = 1")).first()[0] is None


def test_kmeans_and_mean_shift(spark):
    rows = [(1, 1), (1, 2), (2, 1), (2, 2), (5, 5), (6, 5)]
    pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(rows)], "id long, coords array<double>")
    got, centres = clustering.kmeans(pts, [[1, 2], [2, 2]])
    # hand trace: {0,1} | {2,3,4,5} -> (1,1.5) | (3.75,3.25) -> {0,1,2,3} | {4,5}
    assert [r["cluster"] for r in got.orderBy("id").collect()] == [0, 0, 0, 0, 1, 1] and centres == [[1.5, 1.5], [5.5, 5.0]]
    labels, modes = clustering.mean_shift(pts, 2.0)
    assert modes.count() == 2 and [r["cluster"] for r in labels.orderBy("id").collect()] == [0, 0, 0, 0, 1, 1]
    assert clustering.inertia(got, 2).first()[0] == pytest.approx(2.5)


def test_approximations(spark):
    x = spark.createDataFrame([(float(v),) for v in np.linspace(0.1, 0.9, 9)], "x double")
    row = x.select(
        F.max(F.abs(approx.inverse(F.col("x")) * F.col("x") - 1)), F.max(F.abs(approx.square_root(F.col("x"), 8) - F.sqrt("x"))),
        F.max(F.abs(approx.cubic_sign(F.col("x"), 14) - 1)), F.max(F.abs(approx.step_function(-F.col("x"), 0.1))),
        F.max(F.abs(approx.scaled_inverse(F.col("x"), 2.0) - 1 / F.col("x"))),
    ).first()
    assert all(v < 1e-2 for v in row)
    pick = spark.range(1).select(approx.argmax_one_hot(F.array(F.lit(0.9), F.lit(0.5)), 4), approx.compare(F.lit(0.9), F.lit(0.6)), approx.maximum(F.lit(0.2), F.lit(0.7), 9)).first()
    assert pick[0][0] > 0.99 and pick[1] > 0.99 and abs(pick[2] - 0.7) < 0.02


def test_minimax_chain(spark, tmp_path):
    chain = minimax.chain(6, [7, 7, 7])
    x = np.concatenate([np.linspace(2**-6, 1, 500), -np.linspace(2**-6, 1, 500)])
    assert np.abs(minimax.values(chain, x) - np.sign(x)).max() <= chain[-1]["error"] * 1.001
    minimax.save(chain, str(tmp_path / "p.json"))
    assert minimax.load(str(tmp_path / "p.json")) == chain
    assert files.read_polynomials(spark, str(tmp_path / "p.json")).count() == 3
    df = spark.createDataFrame([(float(v),) for v in x[:50]], "x double")
    got = [r[0] for r in df.select(approx.polynomial_chain(chain)("x")).collect()]
    assert np.allclose(got, minimax.values(chain, x[:50]))
    one = df.select(approx.odd_chebyshev(F.col("x"), chain[0]["coeffs"])).first()[0]
    assert one == pytest.approx(float(approx.odd_chebyshev_values(x[:1], chain[0]["coeffs"])[0]))
    assert 0 <= minimax.largest_margin(6, [7, 7], 0.3, 6) < 0.5
    assert (approx.precision(900, "neighbour"), approx.precision(900, "core")) == (18, 13)


def test_arff_round_trip(spark, tmp_path):
    text = "% head\n@RELATION t\n@ATTRIBUTE x REAL\n@attribute y REAL\n@attribute class {0,1}\n\n@DATA\n1.5,2\t0\n% note\n\n3,4,1\t\n7\n% end\n"
    (tmp_path / "a.arff").write_text(text)
    rows = arff.read(spark, str(tmp_path / "a.arff")).orderBy("id").collect()
    assert [(r["id"], r["coords"], r["true_label"]) for r in rows] == [(0, [1.5, 2.0], 0), (1, [3.0, 4.0], 1)]
    assert arff.attributes(spark, str(tmp_path / "a.arff"))[0] == ("x", "REAL")
    arff.write(arff.read(spark, str(tmp_path / "a.arff")), str(tmp_path / "out"))
    again = arff.read(spark, str(tmp_path / "out")).orderBy("id").collect()
    assert [r["coords"] for r in again] == [[1.5, 2.0], [3.0, 4.0]]
    (tmp_path / "b.arff").write_text("@data\n1,2,0\nx,2,0\n1,4,k\n")
    assert arff.read(spark, str(tmp_path / "b.arff"), strict=False).count() == 2
    assert [r["true_label"] for r in arff.read(spark, str(tmp_path / "b.arff"), strict=False, label_type="string").orderBy("id").collect()] == ["0", "k"]


def test_generators_and_sinks(spark, tmp_path):
    assert generators.mixed_density(spark).count() == 188 and generators.shapes(spark).count() == 620
    two = generators.two_groups(spark, 6).collect()
    assert all(0 <= c <= 1 for r in two for c in r["coords"])
    for f in (generators.moons, generators.circles):
        assert f(spark, 10).count() == 10
    assert generators.far_pairs(spark, 50, 0.1).where("abs(u - v) < 0.1").isEmpty()
    df = spark.createDataFrame([(0, 1.25), (1, 2.5)], "slot long, v double")
    files.write_vector(df, str(tmp_path / "v"), "v", "Total_Neighbors")
    back = files.read_csv(spark, str(tmp_path / "v"), {"n": ["Missing", "Total_Neighbors"]})
    assert [r["n"] for r in back.orderBy("Point_ID").collect()] == [1.25, 2.5]
    files.write_timings(spark, {"a": 1.5}, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "a: 1.500000"
    gap = files.differences(df.select(F.col("slot").alias("id"), "v"), df.select(F.col("slot").alias("id"), (F.col("v") + 1).alias("v")), ["v"])
    assert {r["diff_v"] for r in gap.collect()} == {1.0}


def test_stream_assignment(spark, tmp_path):
    cores = spark.createDataFrame([([0.0, 0.0], 1), ([5.0, 5.0], 2)], "coords array<double>, cluster int")
    new = spark.createDataFrame([(0, [0.1, 0.0]), (1, [5.0, 5.2]), (2, [9.0, 9.0])], "id long, coords array<double>")
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    run = assign.start(stream, cores, 0.5, 2, str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination(120)
    got = {r["id"]: r["cluster"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 1, 1: 2, 2: -1}


def test_steps():
    assert approx.steps_to_lift(1.0) == 0 and approx.steps_for(100) == math.ceil(math.log(100, 1.5)) + 1
