"""K-means and mean-shift as DataFrame loops; centres are driver-sized by definition (k, or modes)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators import neighbours as N
from pointloom.operators.points import squared_distance, valid
from pointloom.plans.components import least_members
from pointloom.storage import written


def nearest(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Points with cluster: the number of the nearest centre (ties: the first)."""
    options = [F.struct(squared_distance(F.col("coords"), F.array(*[F.lit(float(x)) for x in c]), len(c)).alias("d2"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]
    best = options[0] if len(options) == 1 else F.array_min(F.array(*options))
    return points.withColumn("cluster", best["cluster"])


def means(assigned: DataFrame, d: int) -> DataFrame:
    return assigned.groupBy("cluster").agg(*[F.avg(F.col("coords")[k]).alias(f"x{k + 1}") for k in range(d)], F.count("*").alias("points"))


def kmeans(points: DataFrame, centres: list[list[float]], iterations: int = 100, tolerance: float = 1e-8) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's algorithm from given centres until they stand still; an empty cluster keeps its centre."""
    points, d = valid(points), len(centres[0])
    centres = [list(map(float, c)) for c in centres]
    for _ in range(iterations):
        found = {r["cluster"]: [r[f"x{k + 1}"] for k in range(d)] for r in means(nearest(points, centres), d).collect()}  # k rows
        moved = [found.get(i, c) for i, c in enumerate(centres)]
        still = all(abs(a - b) <= tolerance + 1e-5 * abs(b) for x, y in zip(moved, centres, strict=True) for a, b in zip(x, y, strict=True))
        centres = moved
        if still:
            break
    return nearest(points, centres), centres


def kmeans_library(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Spark ML's K-means (k-means|| start)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = valid(points).withColumn("features", array_to_vector("coords"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).drop("features").withColumnRenamed("prediction", "cluster")


def inertia(assigned: DataFrame, d: int) -> DataFrame:
    """One row: the sum of squared distances to the clusters' means."""
    spread = assigned.groupBy("cluster").agg(*[(F.var_pop(F.col("coords")[k]) * F.count("*")).alias(f"v{k}") for k in range(d)])
    return spread.agg(F.sum(sum((F.col(f"v{k}") for k in range(1, d)), F.col("v0"))).alias("inertia"))


#: Points that a bandwidth estimate and a one-class machine are fitted on, at most: chosen by hash of the id.
FITTED = 2000


def _fitted(points: DataFrame, most: int) -> np.ndarray:
    rows = valid(points).orderBy(F.xxhash64("id"), "id").limit(most).select("coords").collect()
    return np.array([r["coords"] for r in rows], float)


def estimate_bandwidth(points: DataFrame, quantile: float = 0.3, most: int = FITTED) -> float:
    """The mean distance of points to the farthest of their nearest quantile (themselves counted), over at most ``most`` points; 0 for none."""
    x = _fitted(points, most)
    if not len(x):
        return 0.0
    k = max(1, int(len(x) * quantile))
    d2 = np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0)
    return float(np.sqrt(np.partition(d2, k - 1, axis=1)[:, k - 1]).mean())


def one_class(points: DataFrame, gamma: float = 1.0, nu: float = 0.1, most: int = FITTED, tolerance: float = 1e-6) -> DataFrame:
    """Points with cluster 0 inside and -1 outside a one-class support vector machine with a radial kernel.

    The dual problem (weights between 0 and 1 / (nu n), adding up to 1) is solved on at most ``most``
    points by moving weight along the pair that breaks optimality most; every point is then judged.
    """
    x = _fitted(points, most)
    if not len(x):
        return points.withColumn("cluster", F.lit(0))
    n = len(x)
    kernel = np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    most_weight = 1.0 / (nu * n)
    weight = np.zeros(n)
    full = int(nu * n)
    weight[:full] = most_weight
    if full < n:
        weight[full] = 1.0 - full * most_weight
    gradient = kernel @ weight
    for _ in range(200 * n):
        up, down = np.where(weight < most_weight - 1e-12, gradient, np.inf), np.where(weight > 1e-12, gradient, -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if down[j] - up[i] < tolerance:
            break
        step = min((gradient[j] - gradient[i]) / max(2 - 2 * kernel[i, j], 1e-12), most_weight - weight[i], weight[j])
        weight[i] += step
        weight[j] -= step
        gradient += step * (kernel[i] - kernel[j])
    free = (weight > 1e-9) & (weight < most_weight - 1e-9)
    offset = float(gradient[free].mean()) if free.any() else float((gradient[weight > 1e-9].max() + gradient[weight <= 1e-9].min(initial=np.inf)) / 2 if (weight <= 1e-9).any() else gradient.max())
    kept, its = x[weight > 1e-9], weight[weight > 1e-9]

    @F.pandas_udf("int")
    def judged(coords: pd.Series) -> pd.Series:
        q = np.stack(coords.to_list())
        value = np.concatenate([np.exp(-gamma * ((part[:, None, :] - kept[None, :, :]) ** 2).sum(-1)) @ its for part in np.array_split(q, max(1, len(q) // 500))])
        return pd.Series(np.where(value >= offset - 10 * tolerance, 0, -1).astype(np.int32))

    return valid(points).withColumn("cluster", judged("coords"))


def shift_once(seeds: DataFrame, points: DataFrame, bandwidth: float, d: int) -> DataFrame:
    """(id, coords, support): every seed at the mean of the points within the bandwidth; a seed without any stays."""
    side = bandwidth * (1 + N.SLACK)
    keys = [f"c{k}" for k in range(min(d, 3))]
    cell = [F.floor(F.col("coords")[k] / side).cast("long") for k in range(len(keys))]
    offsets = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"o{k}") for k, x in enumerate(o)]) for o in N.touching(len(keys))])
    a = seeds.select("id", F.col("coords").alias("p"), *[c.alias(k) for c, k in zip(cell, keys, strict=True)])
    b = points.select(F.col("coords").alias("q"), *[c.alias(k) for c, k in zip(cell, keys, strict=True)], F.explode(offsets).alias("o"))
    b = b.select("q", *[(F.col(k) + F.col(f"o.o{i}")).alias(k) for i, k in enumerate(keys)])
    near = a.join(b, keys).where(squared_distance(F.col("p"), F.col("q"), d) <= bandwidth * bandwidth)
    moved = near.groupBy("id").agg(F.array(*[F.avg(F.col("q")[k]) for k in range(d)]).alias("__to"), F.count("*").alias("support"))
    return seeds.select("id", "coords").join(moved, "id", "left").select("id", F.coalesce("__to", "coords").alias("coords"), F.coalesce("support", F.lit(0)).alias("support"))


def mean_shift(points: DataFrame, bandwidth: float, iterations: int = 300, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Flat-kernel mean-shift with every point as a seed: (points with cluster, modes).

    Seeds move until none moves more than tolerance x bandwidth; modes within a
    bandwidth of each other are connected, and the one with the most support (ties: the
    least id) stands for them; points go to the nearest mode.
    """
    points = valid(points)
    d = N.dimension(points)
    seeds = written(points.select("id", "coords"), "seeds")
    for _ in range(iterations):
        moved = written(shift_once(seeds, points, bandwidth, d), "seeds")
        step = moved.select("id", F.col("coords").alias("to")).join(seeds, "id").agg(F.max(squared_distance(F.col("to"), F.col("coords"), d))).first()[0] or 0.0
        seeds = moved
        if math.sqrt(step) <= tolerance * bandwidth:
            break
    rounded = seeds.withColumn("coords", F.transform("coords", lambda c: F.round(c, 9)))
    stops = written(rounded.groupBy("coords").agg(F.min("id").alias("id"), F.max("support").alias("support")), "stops")
    roots = least_members(stops.select("id"), N.join_grid(stops, bandwidth, d))
    modes = stops.join(roots, "id").groupBy("root").agg(F.max_by(F.struct("id", "coords", "support"), F.struct("support", -F.col("id"))).alias("m")).select("m.*")
    modes = written(modes, "modes")
    order = [r["coords"] for r in modes.orderBy(F.desc("support"), "id").collect()]  # one row a mode
    return (nearest(points, order) if order else points.withColumn("cluster", F.lit(0))), modes
