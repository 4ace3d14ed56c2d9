"""Cells, blocks and slots: the spatial partitioning of point tables."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def axis_counts(lows: list[float], highs: list[float], side: float, rounding: str = "ceil") -> list[int]:
    """Cells along each axis (at least 1): as many as cover it (``ceil``), or the nearest number (``round``, halves to even)."""
    count = {"ceil": lambda x: math.ceil(x - 1e-12), "round": round}[rounding]
    return [max(1, count((hi - lo) / side)) for lo, hi in zip(lows, highs, strict=True)]


def centres(spark: SparkSession, lows: list[float], highs: list[float], side: float) -> DataFrame:
    """All cell centres: cell_id (row-major) and centre."""
    counts = axis_counts(lows, highs, side)
    total = math.prod(counts)
    cells = spark.range(total).withColumnRenamed("id", "cell_id")
    parts, left = [], F.col("cell_id")
    for k in range(len(counts)):
        stride = math.prod(counts[k + 1 :])
        parts.append(F.lit(lows[k]) + F.lit(side) * (F.floor(left / stride) + 0.5))
        left = left % stride
    return cells.withColumn("centre", F.array(*parts))


def normalized_centres(centre_table: DataFrame, lo: float, scale: float) -> DataFrame:
    """Centres moved as ``normalize_global`` moves points: by one range for all dimensions (a scale of 0 counts as 1)."""
    return centre_table.withColumn("centre", F.transform("centre", lambda c: (c - F.lit(lo)) / F.lit(scale or 1.0)))


def cell_index(coords: Column, lows: list[float], highs: list[float], side: float, boundary: str = "upper") -> Column:
    """The cell of a point as array<int>; null outside the domain.

    ``upper``: a point on a cell boundary belongs to the higher cell (the last cell is
    closed); ``lower``: to the lower one.
    """
    out = []
    for k, n in enumerate(axis_counts(lows, highs, side)):
        place = (coords[k] - lows[k]) / side
        cell = F.floor(place) if boundary == "upper" else F.ceil(place) - 1
        out.append(F.greatest(F.lit(0), F.least(F.lit(n - 1), cell)).cast("int"))
    inside = F.lit(True)
    for k in range(len(lows)):
        inside = inside & (coords[k] >= lows[k]) & (coords[k] <= highs[k])
    return F.when(inside, F.array(*out))


def flatten_row_major(index: Column, counts: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for k, n in enumerate(counts):
        out = out * n + index[k]
    return out


def first_axis_fastest(counts: list[int]) -> list[int]:
    """Strides of a flat number in which the first axis runs fastest."""
    return [math.prod(counts[:k]) for k in range(len(counts))]


def flatten_first_fastest(index: Column, counts: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for k, stride in enumerate(first_axis_fastest(counts)):
        out = out + index[k] * stride
    return out


def free_cells(points: DataFrame, side: float, dims: int) -> DataFrame:
    """Points with their unbounded cell numbers c0.. of the first ``dims`` coordinates."""
    return points.withColumns({f"c{k}": F.floor(F.col("coords")[k] / F.lit(side)).cast("long") for k in range(dims)})


def touching(dims: int, reach: int = 1) -> list[tuple[int, ...]]:
    """Offsets of all cells within a Chebyshev distance, the cell itself included."""
    return list(itertools.product(range(-reach, reach + 1), repeat=dims))


def exact_side(eps: float, d: int) -> tuple[float, int]:
    """The side at which points of one cell are always neighbours, and the reach that then finds all neighbours."""
    return eps / math.sqrt(d), math.ceil(math.sqrt(d))


def neighbour_cells(cells: DataFrame, counts: list[int], reach: int = 1) -> DataFrame:
    """(cell, neighbour) flat numbers of a bounded grid; ``cells`` has index (array<int>)."""
    offsets = F.array(*[F.array(*[F.lit(x) for x in o]) for o in touching(len(counts), reach)])
    pairs = cells.select("index", F.explode(offsets).alias("o"))
    near = F.array(*[F.col("index")[k] + F.col("o")[k] for k in range(len(counts))])
    inside = F.lit(True)
    for k, n in enumerate(counts):
        inside = inside & (near[k] >= 0) & (near[k] < n)
    return pairs.where(inside).select(flatten_row_major(F.col("index"), counts).alias("cell"), flatten_row_major(near, counts).alias("neighbour"))


def cell_adjacency(centre_table: DataFrame, query_radius: float, half_width: float, norm: str = "max") -> DataFrame:
    """(cell_id, other_id) of cells whose centres are within query_radius + half_width; ``max`` loses no neighbour, ``l2`` can."""
    a = centre_table.select("cell_id", "centre")
    b = centre_table.select(F.col("cell_id").alias("other_id"), F.col("centre").alias("other"))
    gaps = F.zip_with("centre", "other", lambda x, y: F.abs(x - y))
    reach = F.lit(query_radius + half_width + 1e-12)
    far = F.array_max(gaps) if norm == "max" else F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g))
    near = F.abs(F.col("centre")[0] - F.col("other")[0]) <= reach
    return a.join(b, near & (far <= reach)).select("cell_id", "other_id")


def cell_deltas(pairs: DataFrame) -> DataFrame:
    """The distinct differences of adjacent flat cell numbers."""
    return pairs.select((F.col("other_id") - F.col("cell_id")).alias("delta")).distinct()


def delta_mask(pairs: DataFrame, delta: int, cells: int, bucket: int) -> DataFrame:
    """(slot, mask) of every column-major slot: 1.0 where the slot's cell and the cell ``delta`` further are adjacent, else 0.0."""
    near = pairs.where(F.col("other_id") - F.col("cell_id") == delta).select(F.col("cell_id").alias("cell")).distinct().withColumn("mask", F.lit(1.0))
    slots = pairs.sparkSession.range(cells * bucket).select(F.col("id").alias("slot"), (F.col("id") % cells).alias("cell"))
    return slots.join(near, "cell", "left").select("slot", F.coalesce("mask", F.lit(0.0)).alias("mask"))


def blocks(points: DataFrame, bucket: int, owner: str = "owner_id", cell: str = "cell_id", order: str = "owner_local_idx", most_blocks: int | None = None) -> DataFrame:
    """block_idx and pos of every row in arrival order within owner and cell; rows past ``most_blocks`` blocks go, if it is given."""
    nth = F.row_number().over(Window.partitionBy(owner, cell).orderBy(order)) - 1
    out = points.withColumn("__n", nth).withColumns({"block_idx": F.floor(F.col("__n") / bucket).cast("int"), "pos": (F.col("__n") % bucket).cast("int")})
    return (out.where(F.col("block_idx") < most_blocks) if most_blocks else out).drop("__n")


def column_major(points: DataFrame, cells: int, bucket: int | None = None, owner: str = "owner_id", cell: str = "cell_id", order: str = "owner_local_idx") -> DataFrame:
    """slot = place in cell x number of cells + cell; without ``bucket`` nothing is dropped."""
    nth = F.row_number().over(Window.partitionBy(owner, cell).orderBy(order)) - 1
    out = points.withColumn("k_in_bucket", nth).withColumn("slot", F.col("k_in_bucket").cast("long") * cells + F.col(cell))
    return out.where(F.col("k_in_bucket") < bucket) if bucket else out


def global_slots(points: DataFrame, bucket: int, offsets: dict[int, int] | None = None, owner: str = "owner_id", cell: str = "cell_id", order: str = "owner_local_idx") -> DataFrame:
    """slot = cell x bucket + the owner's offset + place: where each owner's row stands in one common vector."""
    nth = F.row_number().over(Window.partitionBy(owner, cell).orderBy(order)) - 1
    offset = F.lit(0)
    for who, at in (offsets or {}).items():
        offset = F.when(F.col(owner) == who, at).otherwise(offset)
    return points.withColumn("slot", F.col(cell).cast("long") * bucket + offset + nth)


def base_eps(min_pts: int, n: int, d: int) -> float:
    """The cell side heuristic (min_pts / N)^(1/d)."""
    return (min_pts / max(1, n)) ** (1 / d)


def occupancy(points: DataFrame, cell: str = "cell_id") -> DataFrame:
    """The number of points of every occupied cell."""
    return points.groupBy(cell).agg(F.count("*").alias("points"))


def bucket_size(points: DataFrame, cell: str = "cell_id", safety: float = 1.0) -> int:
    """The largest occupancy times a safety factor: a bucket that drops nothing when safety is at least 1."""
    return math.ceil((occupancy(points, cell).agg(F.max("points")).first()[0] or 0) * safety)


def rounds_for(counts: list[int]) -> int:
    """Propagation rounds suggested by a grid: the longest axis, at least 3."""
    return max(3, *counts)
