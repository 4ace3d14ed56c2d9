"""Orders, windows over them, label remaps, gap groups and owner splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.neighbours import dimension
from pointloom.operators.points import running_sum, with_slot
from pointloom.storage import written


def principal_axis(points: DataFrame, d: int | None = None) -> tuple[list[float], list[float]]:
    """(means, first principal direction); only d x d moments reach the driver. The largest component is positive."""
    d = d or dimension(points)
    c = [F.col("coords")[k] for k in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = points.agg(*[F.avg(x) for x in c], *[F.covar_pop(c[i], c[j]) for i, j in pairs]).first()
    if row[0] is None:
        return [0.0] * d, [1.0] + [0.0] * (d - 1)
    cov = np.zeros((d, d))
    for (i, j), v in zip(pairs, row[d:], strict=True):
        cov[i, j] = cov[j, i] = v
    axis = np.linalg.eigh(cov)[1][:, -1]
    axis = axis * (1 if axis[np.argmax(np.abs(axis))] > 0 else -1)
    return [float(x) for x in row[:d]], [float(x) for x in axis]


def projected(points: DataFrame, means: list[float], axis: list[float]) -> DataFrame:
    """Points with z, their place along an axis."""
    z = F.lit(0.0)
    for k, (m, a) in enumerate(zip(means, axis, strict=True)):
        z = z + (F.col("coords")[k] - F.lit(m)) * F.lit(a)
    return points.withColumn("z", z)


def pca_order(points: DataFrame) -> DataFrame:
    """Points with z and slot: their position along the first principal axis (ties: by id)."""
    return with_slot(projected(points, *principal_axis(points)), "z", "id")


def restore(slotted: DataFrame, values: DataFrame) -> DataFrame:
    """Values by slot back to ids."""
    return slotted.select("id", "slot").join(values, "slot").drop("slot")


def kmax_window(ordered: DataFrame, eps: float) -> DataFrame:
    """One row, k_max: the most later positions along z within eps of any row's, between 1 and N // 2 (1 for fewer than two rows).

    Rows of equal z stand at positions of their own, so the first of them sees the others.
    Positions come from running counts over range partitions: no band or tie is one task's.
    """
    counts = running_sum(ordered.groupBy("z").agg(F.count("*").alias("n")), "n", "z", name="upto")
    rows = counts.select(F.col("z").alias("at"), F.lit(0).alias("asks"), "n", F.lit(None).cast("long").alias("before"))
    asks = counts.select((F.col("z") + F.lit(float(eps))).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("n"), (F.col("upto") - F.col("n")).alias("before"))
    seen = running_sum(rows.unionByName(asks), "n", "at", "asks", name="seen")
    most = seen.agg(F.max(F.col("seen") - F.col("before") - 1).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    bound = F.least(F.greatest(F.col("most"), F.lit(1)), F.floor(F.col("n") / 2))
    return most.select(F.when(F.col("n") > 1, bound).otherwise(1).cast("long").alias("k_max"))


def prepare_order(points: DataFrame, eps: float) -> tuple[DataFrame, int]:
    """The ordered points and k_max."""
    ordered = written(pca_order(points), "ordered")
    return ordered, int(kmax_window(ordered, eps).first()[0])


def ball_order(points: np.ndarray) -> list[int]:
    """In-order positions of a ball tree that splits between two far points at the median (driver-sized input)."""
    out: list[int] = []
    todo: list[tuple[str, np.ndarray]] = [("split", np.arange(len(points)))]
    while todo:
        what, ids = todo.pop()
        if what == "emit" or len(ids) <= 1:
            out.extend(ids.tolist())
            continue
        x = points[ids]
        far = int(((x - x.mean(0)) ** 2).sum(1).argmax())
        pole = int(((x - x[far]) ** 2).sum(1).argmax())
        axis = x[pole] - x[far]
        ranked = ids[np.argsort(x @ axis, kind="stable")]
        half = len(ranked) // 2
        todo += [("split", ranked[half + 1 :]), ("emit", ranked[half : half + 1]), ("split", ranked[:half])]
    return out


def ball_kmax(points: np.ndarray, order: list[int], eps: float) -> int:
    """The largest distance in a ball order between two points within eps, at most N // 2 cyclically."""
    x, n, most = points[order], len(order), 1
    for k in range(1, n // 2 + 1):
        if (((x - np.roll(x, -k, 0)) ** 2).sum(1) <= eps * eps).any():
            most = k
    return most


def ball_gap_kmax(points: np.ndarray, eps: float) -> int:
    """The stride bound read off a ball order's splits: the span of the widest split whose two balls are less than eps apart.

    A split of n rows spans n - 1 slots, or the rest of the ring if that is less; at least 1,
    at most N // 2. Driver-sized input, like the order.
    """
    n, most = len(points), 0
    todo = [np.arange(n)]
    while todo:
        ids = todo.pop()
        if len(ids) < 2:
            continue
        x = points[ids]
        far = int(((x - x.mean(0)) ** 2).sum(1).argmax())
        axis = x[int(((x - x[far]) ** 2).sum(1).argmax())] - x[far]
        length = float(np.sqrt((axis**2).sum()))
        ranked = ids[np.argsort((x - x[far]) @ (axis / length), kind="stable")] if length >= 1e-12 else ids
        half = len(ranked) // 2
        sides = [ranked[:half], ranked[half + 1 :]]
        if all(map(len, sides)):
            centres = [points[s].mean(0) for s in sides]
            radii = [float(np.sqrt(((points[s] - c) ** 2).sum(1)).max()) for s, c in zip(sides, centres, strict=True)]
            if float(np.sqrt(((centres[0] - centres[1]) ** 2).sum())) - sum(radii) < eps:
                most = max(most, min(len(ids) - 1, n - len(ids) + 1))
        todo += sides
    return min(max(most, 1), n // 2)


def by_magnitude(df: DataFrame, column: str) -> DataFrame:
    """Rows ordered by |column|."""
    return df.orderBy(F.abs(F.col(column)))


def global_index(slots: DataFrame, *order: str) -> DataFrame:
    """Dense ids of rows in the given order, e.g. owner, cell, block, pos."""
    return with_slot(slots, *order, name="global_id")


def remap_sequential(df: DataFrame, label: str, noise: int = -1) -> DataFrame:
    """remapped: 1.. by ascending label; noise and null stay noise."""
    labels = df.where(F.col(label) != noise).select(label).distinct()
    ranks = with_slot(labels, label, name="remapped", first=1)
    return df.join(ranks, label, "left").withColumn("remapped", F.coalesce("remapped", F.lit(noise)).cast("long"))


def remap_by_appearance(df: DataFrame, label: str, order: str = "id", noise: int = -1) -> DataFrame:
    """remapped: 1.. by the first row of each label."""
    first = df.where(F.col(label) != noise).groupBy(label).agg(F.min(order).alias("__first"))
    ranks = with_slot(first, "__first", name="remapped", first=1).drop("__first")
    return df.join(ranks, label, "left").withColumn("remapped", F.coalesce("remapped", F.lit(noise)).cast("long"))


def gap_threshold(df: DataFrame, label: str, slot: str = "slot", band: float = 0.5) -> DataFrame:
    """One row, threshold: the largest live label over the largest live slot + 1."""
    live = df.where(F.abs(F.col(label)) >= band)
    return live.agg((F.max(label) / (F.max(slot) + 1)).alias("threshold"))


def gap_groups(df: DataFrame, label: str, threshold: float, n: int, band: float = 0.5) -> DataFrame:
    """Live labels in ascending order fall into one group until a gap exceeds the threshold.

    Adds ``grp`` (1.. in order; null for noise) and ``cluster``, the group's median label,
    rounded half to even within 1..n; labels within the band around 0 are noise (-1).
    """
    live = F.abs(F.col(label)) >= band
    values = df.where(live).select(label).distinct()
    ranked = with_slot(values, label, name="__at")
    before = ranked.select((F.col("__at") + 1).alias("__at"), F.col(label).alias("__before"))
    opens = F.when(F.col("__before").isNull() | (F.col(label) - F.col("__before") > threshold), 1).otherwise(0)
    groups = running_sum(ranked.join(before, "__at", "left").withColumn("__open", opens), "__open", label, name="grp")
    tagged = df.join(groups.select(label, "grp"), label, "left")
    middle = tagged.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.percentile(label, 0.5).alias("__m"))
    middle = middle.select("grp", F.least(F.lit(n), F.greatest(F.lit(1), F.bround("__m").cast("long"))).alias("cluster"))
    return tagged.join(middle, "grp", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)).cast("long"))


def split_contiguous(points: DataFrame, owners: int, order: str = "id") -> DataFrame:
    """owner_id and owner_local_idx: equal runs in order, the last owner takes the rest."""
    slotted = written(with_slot(points, order, name="__slot"), "slotted")
    chunk = max(1, slotted.count() // owners)
    owner = F.least(F.floor(F.col("__slot") / chunk), F.lit(owners - 1)).cast("int")
    return slotted.withColumn("owner_id", owner).withColumn("owner_local_idx", F.col("__slot") - F.col("owner_id") * chunk).drop("__slot")


def split_random(points: DataFrame, owners: int, seed: int = 0, order: str = "id") -> DataFrame:
    """owner_id and owner_local_idx: a seeded permutation cut into runs whose lengths differ by one at most, the longer ones first."""
    drawn = points.withColumn("__draw", F.md5(F.concat(F.lit(f"{seed}-"), F.col(order).cast("string"))))
    slotted = written(with_slot(drawn, "__draw", order, name="__slot"), "slotted").drop("__draw")
    size, more = divmod(slotted.count(), owners)
    longer = more * (size + 1)
    slot = F.col("__slot")
    owner = F.when(slot < longer, F.floor(slot / (size + 1))).otherwise(F.floor((slot - longer) / max(size, 1)) + more).cast("int")
    first = F.col("owner_id") * size + F.least(F.col("owner_id"), F.lit(more))
    return slotted.withColumn("owner_id", owner).withColumn("owner_local_idx", slot - first).drop("__slot")
