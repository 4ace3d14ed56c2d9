"""Several owners' points clustered together: public grid, blocks, server view, results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators import density, grid
from pointloom.operators.ordering import global_index, remap_sequential
from pointloom.storage import written


def union(owners: list[DataFrame]) -> DataFrame:
    """Owners' tables as one, with owner_id and owner_local_idx (the row's id at its owner)."""
    tagged = [t.withColumn("owner_id", F.lit(i)).withColumnRenamed("id", "owner_local_idx") for i, t in enumerate(owners)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def negotiate(points: DataFrame) -> DataFrame:
    """One row: the least of the owners' minima and the largest of their maxima, and the number of points."""
    per = points.groupBy("owner_id").agg(F.min(F.array_min("coords")).alias("lo"), F.max(F.array_max("coords")).alias("hi"), F.count("*").alias("points"))
    return per.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("points").alias("points"))


def prepare(points: DataFrame, side: float, bucket: int | None = None) -> tuple[DataFrame, dict]:
    """Normalised points with cell_id, block_idx, pos and a global id, and the public parameters.

    Without ``bucket`` it is the largest occupancy, so that nothing is dropped.
    """
    lo, hi, d = points.agg(F.min(F.array_min("coords")), F.max(F.array_max("coords")), F.max(F.size("coords"))).first()
    if d is None:  # no owner has any point
        lo, hi, d = 0.0, 1.0, 1
    scale = float(hi - lo) or 1.0
    scaled = points.withColumn("coords", F.transform("coords", lambda c: (c - F.lit(float(lo))) / F.lit(scale)))
    lows, highs, step = [0.0] * d, [1.0] * d, side / scale
    counts = grid.axis_counts(lows, highs, step)
    cells = scaled.withColumn("cell_id", grid.flatten_row_major(grid.cell_index(F.col("coords"), lows, highs, step), counts))
    bucket = bucket or max(1, grid.bucket_size(cells.withColumn("__k", F.struct("owner_id", "cell_id")), "__k"))
    packed = global_index(grid.blocks(cells, bucket), "owner_id", "cell_id", "block_idx", "pos")
    return written(packed, "packed"), {"lo": float(lo), "scale": scale, "counts": counts, "bucket": bucket, "side": step, "d": d}


def block_lookup(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The packed rows of the blocks named by ``wanted`` (owner_id, cell_id, block_idx); unknown blocks have none."""
    return packed.join(wanted.select("owner_id", "cell_id", "block_idx").distinct(), ["owner_id", "cell_id", "block_idx"], "left_semi")


def client_view(packed: DataFrame) -> DataFrame:
    return packed.select("global_id", "owner_id", "owner_local_idx", "cell_id", "block_idx", "pos")


def server_view(packed: DataFrame) -> DataFrame:
    """What the computing side sees: no owner's row numbers."""
    return packed.select(F.col("global_id").alias("id"), "coords", "cell_id")


def cluster(packed: DataFrame, params: dict, eps: float, min_pts: float, tie: str = "min", **options) -> DataFrame:
    """Clusters by global id; eps in the owners' units."""
    return density.dbscan(server_view(packed), eps / params["scale"], min_pts, tie=tie, **options)


def reconstruct(packed: DataFrame, clustered: DataFrame, params: dict, show: list[int] | None = None, digits: int = 6) -> DataFrame:
    """Results by owner and row, clusters renumbered, coordinates in the owners' units: only of owners in ``show`` (None: all)."""
    back = F.transform("coords", lambda c: F.round(c * params["scale"] + params["lo"], digits))
    seen = F.lit(True) if show is None else F.col("owner_id").isin(show)
    rows = packed.select("global_id", "owner_id", "owner_local_idx", F.when(seen, back).alias("coords"))
    labels = clustered.select(F.col("id").alias("global_id"), "n_neighbors", "role", "cluster")
    out = remap_sequential(rows.join(labels, "global_id", "left"), "cluster")
    return out.select("owner_id", "owner_local_idx", "coords", "n_neighbors", "role", F.col("remapped").alias("cluster")).orderBy("owner_id", "owner_local_idx")


def run(owners: list[DataFrame], eps: float, min_pts: float, side: float | None = None, show: list[int] | None = None, **options) -> DataFrame:
    packed, params = prepare(union(owners), side or eps)
    return reconstruct(packed, cluster(packed, params, eps, min_pts, **options), params, show)
