"""New points of a stream get the clusters of a fixed set of core points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.grid import touching
from pointloom.operators.neighbours import SLACK
from pointloom.operators.points import squared_distance


def assign(points: DataFrame, cores: DataFrame, eps: float, d: int) -> DataFrame:
    """Points (a batch) with cluster: that of the nearest core point within eps (ties: the lower cluster), else -1."""
    side = eps * (1 + SLACK)
    keys = [f"c{k}" for k in range(min(d, 3))]
    cell = [F.floor(F.col("coords")[k] / side).cast("long") for k in range(len(keys))]
    offsets = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"o{k}") for k, x in enumerate(o)]) for o in touching(len(keys))])
    a = points.select("id", F.col("coords").alias("p"), *[c.alias(k) for c, k in zip(cell, keys, strict=True)])
    b = cores.select(F.col("coords").alias("q"), "cluster", *[c.alias(k) for c, k in zip(cell, keys, strict=True)], F.explode(offsets).alias("o"))
    b = b.select("q", "cluster", *[(F.col(k) + F.col(f"o.o{i}")).alias(k) for i, k in enumerate(keys)])
    d2 = squared_distance(F.col("p"), F.col("q"), d)
    best = a.join(b, keys).where(d2 <= eps * eps).groupBy("id").agg(F.min_by("cluster", F.struct(d2, "cluster")).alias("cluster"))
    return points.join(best, "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def start(stream: DataFrame, cores: DataFrame, eps: float, d: int, out: str, checkpoint: str, once: bool = True):
    """Writes every micro-batch's assignments as a Parquet folder named by the batch, so a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        assign(batch, cores, eps, d).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
