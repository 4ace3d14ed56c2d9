"""Neighbour joins of points within a distance: by grid cells, by bands, or all pairs.

All give (src, dst, d2) with src < dst, once a pair; an edge needs d2 <= eps^2 + margin,
or < if not ``closed``. Grid and band joins are equi-joins on cells, which AQE may
split where cells are crowded; all pairs is for oracles and small tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.grid import touching
from pointloom.operators.points import squared_distance

#: Room for rounding in cell numbers, as a share of the cell side.
SLACK = 1e-9
#: Squared margins of the neighbour predicate by variant; alpha is the precision in bits.
MARGINS = ("exact", "mirror", "cs", "cm")


def squared_margin(variant: str, d: int, alpha: int = 15) -> float:
    return {"exact": 0.0, "mirror": 1e-4, "cs": 2.0**-alpha * 1.05 * d, "cm": 0.05}[variant]


def _near(d2: Column, eps: float, margin: float, closed: bool) -> Column:
    most = F.lit(eps * eps + margin)
    return d2 <= most if closed else d2 < most


def dimension(points: DataFrame) -> int:
    row = points.select(F.size("coords").alias("d")).first()
    return row["d"] if row else 1


def join_cross(points: DataFrame, eps: float, d: int | None = None, margin: float = 0.0, closed: bool = True) -> DataFrame:
    d = d or dimension(points)
    a = points.select(F.col("id").alias("src"), F.col("coords").alias("p"))
    b = points.select(F.col("id").alias("dst"), F.col("coords").alias("q"))
    d2 = squared_distance(F.col("p"), F.col("q"), d)
    return a.join(b, (F.col("src") < F.col("dst")) & _near(d2, eps, margin, closed)).select("src", "dst", d2.alias("d2"))


def join_grid(points: DataFrame, eps: float, d: int | None = None, margin: float = 0.0, closed: bool = True, grid_dims: int = 3) -> DataFrame:
    """Cells of side eps on up to ``grid_dims`` coordinates; one side visits the touching cells."""
    d = d or dimension(points)
    side = math.sqrt(eps * eps + margin) * (1 + SLACK) or 1.0
    dims = min(d, grid_dims)
    cell = [F.floor(F.col("coords")[k] / F.lit(side)).cast("long") for k in range(dims)]
    keys = [f"c{k}" for k in range(dims)]
    a = points.select(F.col("id").alias("src"), F.col("coords").alias("p"), *[c.alias(k) for c, k in zip(cell, keys, strict=True)])
    offsets = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"o{k}") for k, x in enumerate(o)]) for o in touching(dims)])
    b = points.select(F.col("id").alias("dst"), F.col("coords").alias("q"), *[c.alias(k) for c, k in zip(cell, keys, strict=True)], F.explode(offsets).alias("o"))
    b = b.select("dst", "q", *[(F.col(k) + F.col(f"o.o{i}")).alias(k) for i, k in enumerate(keys)])
    d2 = squared_distance(F.col("p"), F.col("q"), d)
    return a.join(b, keys).where((F.col("src") < F.col("dst")) & _near(d2, eps, margin, closed)).select("src", "dst", d2.alias("d2"))


def join_band(points: DataFrame, eps: float, z: Column | None = None, d: int | None = None, margin: float = 0.0, closed: bool = True) -> DataFrame:
    """Bands of a 1-Lipschitz projection ``z`` (default: the first coordinate): neighbours are at most eps apart in it."""
    d = d or dimension(points)
    reach = math.sqrt(eps * eps + margin) * (1 + SLACK) or 1.0
    z = F.col("coords")[0] if z is None else z
    a = points.select(F.col("id").alias("src"), F.col("coords").alias("p"), z.alias("za")).withColumn("band", F.floor(F.col("za") / reach))
    b = points.select(F.col("id").alias("dst"), F.col("coords").alias("q"), z.alias("zb")).withColumn("mid", F.floor(F.col("zb") / reach))
    b = b.select("dst", "q", "zb", F.explode(F.array(F.col("mid") - 1, F.col("mid"), F.col("mid") + 1)).alias("band"))
    d2 = squared_distance(F.col("p"), F.col("q"), d)
    near = (F.col("src") < F.col("dst")) & (F.abs(F.col("za") - F.col("zb")) <= reach) & _near(d2, eps, margin, closed)
    return a.join(b, "band").where(near).select("src", "dst", d2.alias("d2"))


def eps_join(points: DataFrame, eps: float, method: str = "grid", **options) -> DataFrame:
    return {"grid": join_grid, "band": join_band, "cross": join_cross}[method](points, eps, **options)


def join_same_cell_shortcut(points: DataFrame, eps: float, d: int | None = None) -> DataFrame:
    """Cells of side eps / sqrt(d): pairs of one cell need no predicate, others within ceil(sqrt(d)) cells do."""
    d = d or dimension(points)
    side, reach = eps / math.sqrt(d) * (1 - SLACK), math.ceil(math.sqrt(d)) + 1
    keys = [f"c{k}" for k in range(d)]
    cells = {k: F.floor(F.col("coords")[i] / F.lit(side)).cast("long") for i, k in enumerate(keys)}
    a = points.select(F.col("id").alias("src"), F.col("coords").alias("p"), *[c.alias(k) for k, c in cells.items()])
    offsets = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"o{k}") for k, x in enumerate(o)]) for o in touching(d, reach)])
    b = points.select(F.col("id").alias("dst"), F.col("coords").alias("q"), *[c.alias(k) for k, c in cells.items()], F.explode(offsets).alias("o"))
    same = F.lit(True)
    for i in range(d):
        same = same & (F.col(f"o.o{i}") == 0)
    b = b.select("dst", "q", same.alias("same_cell"), *[(F.col(k) + F.col(f"o.o{i}")).alias(k) for i, k in enumerate(keys)])
    d2 = squared_distance(F.col("p"), F.col("q"), d)
    near = F.when(F.col("same_cell"), True).otherwise(d2 <= F.lit(eps * eps))
    return a.join(b, keys).where((F.col("src") < F.col("dst")) & near).select("src", "dst", d2.alias("d2"), "same_cell")


def region(points: DataFrame, of: list[float], eps: float, closed: bool = True) -> DataFrame:
    """The points within eps of one point: a filter."""
    centre = F.array(*[F.lit(float(x)) for x in of])
    return points.where(_near(squared_distance(F.col("coords"), centre, len(of)), eps, 0.0, closed))


def region_of(points: DataFrame, id: int, eps: float, closed: bool = True) -> DataFrame:
    """The points within eps of the point with an id, that point included."""
    row = points.where(F.col("id") == id).select("coords").first()
    return region(points, list(row["coords"]), eps, closed) if row else points.limit(0)


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, d2) in both directions."""
    return edges.select("src", "dst", "d2").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d2"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted neighbour lists; a list is as long as its point's degree."""
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def strides(edges: DataFrame, slots: DataFrame, n: int) -> DataFrame:
    """Edges as (slot, stride): slot i and slot (i + stride) mod n are neighbours, both ways."""
    at = slots.select("id", "slot")
    rows = symmetric(edges).join(at.select(F.col("id").alias("src"), F.col("slot").alias("slot")), "src")
    rows = rows.join(at.select(F.col("id").alias("dst"), F.col("slot").alias("__other")), "dst")
    return rows.select("slot", F.pmod(F.col("__other") - F.col("slot"), F.lit(n)).alias("stride"))
