"""Cluster quality and error statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.neighbours import dimension
from pointloom.operators.points import squared_distance


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("points"))


def cluster_count(df: DataFrame, label: str = "cluster", noise: int = -1) -> DataFrame:
    return df.agg(F.countDistinct(F.when(F.col(label) != noise, F.col(label))).alias("clusters"), F.count(F.when(F.col(label) == noise, 1)).alias("noise"))


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.groupBy(true, predicted).agg(F.count("*").alias("points"))


def adjusted_rand(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row, ari: noise is a class like any other; one class on both sides, or fewer than two rows, gives 1."""
    two = lambda n: n * (n - 1) / 2
    table = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    cells = table.agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0.0)).alias("cells"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("all"))
    rows = table.groupBy("t").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0.0)).alias("rows"))
    cols = table.groupBy("p").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0.0)).alias("cols"))
    one = cells.crossJoin(rows).crossJoin(cols)  # one row each
    pairs = two(F.col("all"))
    expected = F.col("rows") * F.col("cols") / F.when(pairs == 0, 1.0).otherwise(pairs)
    most = (F.col("rows") + F.col("cols")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("cells") - expected) / F.when(most == expected, 1.0).otherwise(most - expected)).alias("ari"))


def silhouette(points: DataFrame, label: str = "cluster", exclude_noise: bool = True, noise: int = -1, d: int | None = None) -> DataFrame:
    """One row: silhouette (null under two clusters; a singleton counts 0) over Euclidean distances of all pairs.

    Every point meets every other: for tables that a cross join can hold.
    """
    rows = points.where(F.col(label) != noise) if exclude_noise else points
    d = d or dimension(rows)
    a = rows.select("id", F.col("coords").alias("p"), F.col(label).alias("mine"))
    b = rows.select(F.col("id").alias("other"), F.col("coords").alias("q"), F.col(label).alias("theirs"))
    sums = a.join(b, F.col("id") != F.col("other")).groupBy("id", "mine", "theirs").agg(F.avg(F.sqrt(squared_distance(F.col("p"), F.col("q"), d))).alias("mean"))
    per = sums.groupBy("id", "mine").agg(F.max(F.when(F.col("mine") == F.col("theirs"), F.col("mean"))).alias("a"), F.min(F.when(F.col("mine") != F.col("theirs"), F.col("mean"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.when(F.count("b") > 0, F.avg(F.when(F.col("b").isNotNull(), s))).alias("silhouette"))


def majority_mapping(df: DataFrame, predicted: str, true: str) -> DataFrame:
    """Each predicted class with its most frequent true class (ties: the smallest)."""
    counts = df.groupBy(predicted, true).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct(true, "n"), F.struct(F.col("n"), -F.col(true).cast("double"))).alias("__best")
    return counts.groupBy(predicted).agg(best).select(predicted, F.col(f"__best.{true}").alias("mapped"), F.col("__best.n").alias("points"))


def match_rate(df: DataFrame, a: str, b: str, order: str = "id", first: int = 50) -> DataFrame:
    """The share of equal labels among the first rows."""
    return df.orderBy(order).limit(first).agg(F.avg(F.when(F.col(a).eqNullSafe(F.col(b)), 1.0).otherwise(0.0)).alias("match_rate"))


def error_stats(df: DataFrame, error: Column, by: Column | None = None) -> DataFrame:
    """Rows, mean, deviation, median, 95th and 99th percentile and maximum of |error|, by bin if given."""
    rows = df.select(F.abs(error).alias("e"), *([by.alias("bin")] if by is not None else []))
    grouped = rows.groupBy("bin") if by is not None else rows.groupBy()
    return grouped.agg(
        F.count("*").alias("n"), F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"), F.percentile("e", 0.5).alias("median"), F.percentile("e", 0.95).alias("p95"),
        F.percentile("e", 0.99).alias("p99"), F.max("e").alias("max"),
    )


def magnitude_bin(x: Column, edges: list[float]) -> Column:
    """The number of the bin [edges[i], edges[i+1]) that |x| falls into; null outside."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        last = i == len(edges) - 2
        out = F.when((F.abs(x) >= lo) & ((F.abs(x) <= hi) if last else (F.abs(x) < hi)), i).otherwise(out)
    return out


def representative(df: DataFrame, group: str, label: str, n: int) -> DataFrame:
    """The median label of each group, rounded half to even and kept within 1..n."""
    middle = F.percentile(label, 0.5)
    return df.groupBy(group).agg(F.least(F.lit(n), F.greatest(F.lit(1), F.bround(middle).cast("long"))).alias("representative"))


def owner_cells(points: DataFrame, owner: str = "owner_id", cell: str = "cell_id") -> DataFrame:
    """Active cells and valid slots of each owner."""
    return points.groupBy(owner).agg(F.countDistinct(cell).alias("active_cells"), F.count("*").alias("valid_slots"))


def class_rank(df: DataFrame, label: str) -> DataFrame:
    """Dense colour keys of labels, by label."""
    labels = df.select(label).distinct()
    return df.join(labels.withColumn("colour", F.dense_rank().over(Window.orderBy(label)) - 1), label)
