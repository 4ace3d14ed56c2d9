"""Point tables: normalisation, boxes, transposition, clipping, and class-size filters.

A point table has ``id`` (long), ``coords`` (array<double>) and optionally
``true_label``. Other columns pass through. Rows whose coords are null or hold a null
are not points: ``valid`` drops them, and nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.storage import written


def point_table(df: DataFrame, id: str, *coords: Column | str, label: str | None = None) -> DataFrame:
    """id, coords and (if named) true_label from columns of any table."""
    cols = [F.col(c) if isinstance(c, str) else c for c in coords]
    out = [F.col(id).cast("long").alias("id"), F.array(*[c.cast("double") for c in cols]).alias("coords")]
    return df.select(*out, *([F.col(label).cast("int").alias("true_label")] if label else []))


def valid(points: DataFrame) -> DataFrame:
    return points.where(F.col("coords").isNotNull() & ~F.exists("coords", lambda c: c.isNull() | F.isnan(c)))


def global_range(points: DataFrame) -> DataFrame:
    """One row: the least and the greatest coordinate of all dimensions together."""
    return points.agg(F.min(F.array_min("coords")).alias("lo"), F.max(F.array_max("coords")).alias("hi"))


def scale_of(points: DataFrame) -> tuple[float, float]:
    """(lo, scale) of the global range; a scale of 0 becomes 1. An empty table gives (0, 1)."""
    lo, hi = global_range(points).first()
    if lo is None:
        return 0.0, 1.0
    return float(lo), float(hi - lo) or 1.0


def normalize_global(points: DataFrame) -> DataFrame:
    """coords scaled by one range for all dimensions, so that balls stay round."""
    span = global_range(points)
    scale = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    both = points.crossJoin(F.broadcast(span))  # one row
    return both.withColumn("coords", F.transform("coords", lambda c: (c - F.col("lo")) / scale)).drop("lo", "hi")


def normalize_per_dimension(points: DataFrame, d: int) -> DataFrame:
    """Each dimension scaled by its own range; a constant dimension becomes 0."""
    span = points.agg(*[f(F.col("coords")[k]).alias(f"{n}{k}") for k in range(d) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [(F.col("coords")[k] - F.col(f"lo{k}")) / F.when(F.col(f"hi{k}") == F.col(f"lo{k}"), 1.0).otherwise(F.col(f"hi{k}") - F.col(f"lo{k}")) for k in range(d)]
    return points.crossJoin(F.broadcast(span)).withColumn("coords", F.array(*scaled)).select(*points.columns)


def denormalize(points: DataFrame, lo: float, scale: float, digits: int = 6) -> DataFrame:
    return points.withColumn("coords", F.transform("coords", lambda c: F.round(c * scale + lo, digits)))


def to_box(points: DataFrame, box: list[tuple[float, float]]) -> DataFrame:
    """Coordinates in [0, 1] moved into a box, one (low, high) per dimension."""
    return points.withColumn("coords", F.array(*[F.lit(a) + F.col("coords")[k] * F.lit(b - a) for k, (a, b) in enumerate(box)]))


def clip(points: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return points.withColumn("coords", F.transform("coords", lambda c: F.least(F.greatest(c, F.lit(low)), F.lit(high))))


def to_columns(points: DataFrame, d: int) -> DataFrame:
    """coords as columns x1..xd; a row with another number of coordinates is an error."""
    checked = F.when(F.size("coords") == d, F.col("coords")).otherwise(F.raise_error(F.lit(f"a point without {d} coordinates")).cast("array<double>"))
    rest = [c for c in points.columns if c != "coords"]
    return points.withColumn("coords", checked).select(*rest, *[F.col("coords")[k].alias(f"x{k + 1}") for k in range(d)])


def from_columns(df: DataFrame, d: int) -> DataFrame:
    rest = [c for c in df.columns if c not in {f"x{k + 1}" for k in range(d)}]
    return df.select(*rest, F.array(*[F.col(f"x{k + 1}").cast("double") for k in range(d)]).alias("coords"))


def squared_distance(a: Column, b: Column, d: int) -> Column:
    """The squared L2 distance, dimension by dimension in order (unrolled: stays in generated code)."""
    out = (a[0] - b[0]) * (a[0] - b[0])
    for k in range(1, d):
        out = out + (a[k] - b[k]) * (a[k] - b[k])
    return out


def small_classes_to_noise(points: DataFrame, least: int = 11, label: str = "true_label") -> DataFrame:
    """Labels of classes with fewer than ``least`` rows become -1."""
    sizes = points.groupBy(label).agg(F.count("*").alias("__n"))
    joined = points.join(sizes, points[label].eqNullSafe(sizes[label]), "left").drop(sizes[label])
    return joined.withColumn(label, F.when(F.col("__n") < least, -1).otherwise(F.col(label))).select(*points.columns)


def decode_noise(label: Column, band: float = 0.5) -> Column:
    """-1 where a label lies within the band around 0."""
    return F.when(F.abs(label) < band, F.lit(-1)).otherwise(label)


def decode_range(label: Column, n: int) -> Column:
    """Rounded (half to even) labels: at most 0 is noise (-1), at most n otherwise."""
    rounded = F.bround(label).cast("long")
    return F.when(rounded <= 0, F.lit(-1)).otherwise(F.least(rounded, F.lit(n)))


def rotate(df: DataFrame, k: int, n: int, slot: str = "slot", value: str = "value") -> DataFrame:
    """Circular shift: the row of slot i gets the value of slot (i + k) mod n."""
    source = df.select(F.pmod(F.col(slot) - k, F.lit(n)).cast("long").alias(slot), F.col(value).alias("rotated"))
    return df.join(source, slot, "left")


def running_total(df: DataFrame, value: str = "value") -> DataFrame:
    """Every row with the sum over all slots."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("total"))))


def interleaved(points: DataFrame, order: str = "id") -> DataFrame:
    """One row: all coordinates one after the other, in order (a driver-sized result)."""
    return points.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, "coords"))), lambda s: s.coords)).alias("flat"))


def with_slot(df: DataFrame, *order: Column | str, name: str = "slot", first: int = 0) -> DataFrame:
    """Global dense positions without one task for all rows: range partitions, then an offset each."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = written(sorted_rows.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "ranged")
    sizes = sorted_rows.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__low"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = sizes.select("__p", "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    joined = sorted_rows.join(F.broadcast(base), "__p")
    return joined.withColumn(name, F.col("__base") + F.col("__i") - F.col("__low") + first).drop("__p", "__i", "__low", "__base")


def running_sum(df: DataFrame, value: str, *order: Column | str, name: str = "running") -> DataFrame:
    """The sum of ``value`` up to and with each row, in order: per range partition, then the partitions' bases."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = written(sorted_rows.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "ranged")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = sorted_rows.groupBy("__p").agg(F.sum(value).alias("__v"))
    base = base.select("__p", F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__base"))
    here = F.sum(value).over(Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    return sorted_rows.withColumn("__here", here).join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + F.col("__here")).drop("__p", "__i", "__here", "__base")
