"""Seeded point tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blobs(spark: SparkSession, n: int, d: int = 2, centres: list[list[float]] | None = None, sigma: float = 0.4, seed: int = 0) -> DataFrame:
    """n points around centres in turn (three in [0, 10)^d by the seed unless given)."""
    if centres is None:
        import random

        rng = random.Random(seed)
        centres = [[rng.uniform(0, 10) for _ in range(d)] for _ in range(3)]
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    rows = spark.range(n).withColumn("true_label", (F.col("id") % len(centres)).cast("int"))
    noise = [F.randn(seed * 1000 + k) * sigma for k in range(len(centres[0]))]
    return rows.select("id", F.array(*[table[F.col("true_label")][k] + x for k, x in enumerate(noise)]).alias("coords"), "true_label")


def two_groups(spark: SparkSession, n: int, d: int = 2, seed: int = 42) -> DataFrame:
    """Half around 0.1, half around 0.9, sigma 0.01, within [0, 1]."""
    first = F.col("id") < n // 2
    coords = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(first, 0.1).otherwise(0.9) + F.randn(seed + k) * 0.01)) for k in range(d)]
    return spark.range(n).select("id", F.array(*coords).alias("coords"), F.when(first, 0).otherwise(1).alias("true_label"))


def mixed_density(spark: SparkSession, seed: int = 21) -> DataFrame:
    """Three Gaussians of different width, boundary points between them and uniform noise (label -1)."""
    parts = [(70, 0.25, 0.25, 0.03, 0), (45, 0.7, 0.3, 0.05, 1), (55, 0.5, 0.75, 0.04, 2), (6, 0.48, 0.28, 0.02, 3)]
    out = None
    for i, (n, x, y, s, label) in enumerate(parts):
        part = spark.range(n).select(F.array(x + F.randn(seed + 2 * i) * s, y + F.randn(seed + 2 * i + 1) * s).alias("coords"), F.lit(label).alias("true_label"))
        out = part if out is None else out.unionByName(part)
    noise = spark.range(12).select(F.array(F.rand(seed + 90), F.rand(seed + 91)).alias("coords"), F.lit(-1).alias("true_label"))
    return _numbered(out.unionByName(noise))


def disc(spark: SparkSession, n: int, x: float, y: float, rx: float, ry: float, label: int, seed: int) -> DataFrame:
    """Uniform points in an ellipse (radius times the square root of a uniform draw)."""
    rows = spark.range(n).select(F.sqrt(F.rand(seed)).alias("r"), (F.rand(seed + 1) * 2 * math.pi).alias("a"))
    return rows.select(F.array(x + rx * F.col("r") * F.cos("a"), y + ry * F.col("r") * F.sin("a")).alias("coords"), F.lit(label).alias("true_label"))


def shapes(spark: SparkSession, seed: int = 1) -> DataFrame:
    """Disc, ellipse, small disc and outliers."""
    out = disc(spark, 300, 0, 0, 3, 3, 0, seed).unionByName(disc(spark, 200, 8, 2, 4, 1, 1, seed + 10)).unionByName(disc(spark, 100, 4, 8, 1, 1, 2, seed + 20))
    outliers = spark.range(20).select(F.array(F.rand(seed + 30) * 24 - 8, F.rand(seed + 31) * 20 - 6).alias("coords"), F.lit(-1).alias("true_label"))
    return _numbered(out.unionByName(outliers))


def moons(spark: SparkSession, n: int, noise: float = 0.05, seed: int = 0) -> DataFrame:
    upper = F.col("id") < n // 2
    t = F.rand(seed) * math.pi
    rows = spark.range(n).select("id", upper.alias("u"), t.alias("t"))
    x = F.when(F.col("u"), F.cos("t")).otherwise(1 - F.cos("t")) + F.randn(seed + 1) * noise
    y = F.when(F.col("u"), F.sin("t")).otherwise(0.5 - F.sin("t")) + F.randn(seed + 2) * noise
    return rows.select("id", F.array(x, y).alias("coords"), F.when(F.col("u"), 0).otherwise(1).alias("true_label"))


def circles(spark: SparkSession, n: int, factor: float = 0.5, noise: float = 0.05, seed: int = 0) -> DataFrame:
    outer = F.col("id") < n // 2
    rows = spark.range(n).select("id", outer.alias("o"), (F.rand(seed) * 2 * math.pi).alias("t"))
    r = F.when(F.col("o"), 1.0).otherwise(factor)
    coords = F.array(r * F.cos("t") + F.randn(seed + 1) * noise, r * F.sin("t") + F.randn(seed + 2) * noise)
    return rows.select("id", coords.alias("coords"), F.when(F.col("o"), 0).otherwise(1).alias("true_label"))


def uniform(spark: SparkSession, n: int, low: float = -1.0, high: float = 1.0, seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", (F.lit(low) + F.rand(seed) * (high - low)).alias("value"))


def counts(spark: SparkSession, n: int, most: int, seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", (F.floor(F.rand(seed) * most) + 1).alias("n_neighbors"))


def far_pairs(spark: SparkSession, n: int, least: float, seed: int = 0) -> DataFrame:
    """Pairs (u, v) from a clipped normal whose difference is at least ``least``."""
    draw = lambda s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.randn(s) * 0.2))
    return spark.range(n).select("id", draw(seed).alias("u"), draw(seed + 1).alias("v")).where(F.abs(F.col("u") - F.col("v")) >= least)


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.monotonically_increasing_id())
