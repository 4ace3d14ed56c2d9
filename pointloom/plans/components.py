"""Connected components and label propagation as DataFrame loops, written every round.

Components: every task joins the edges it has by union-find and passes on a forest, at most one
edge a node. The forests meet by their larger node, of which each task sent one
edge at most, so that no key is hot; parents are then replaced by their own parents. Edges
never grow in number, and where all of them meet in one task one round is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.storage import written

#: Edges a task holds before it reduces them to a forest.
HELD = 2_000_000
#: Slots that sequential sweeps take.
SWEPT = 20_000


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' components: roots hook to lesser neighbours, paths are halved, until no edge is left."""
    up = np.arange(n)
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, above := up[up]):
            up = above
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return up


def forest(edges: DataFrame, tag: bool = False) -> DataFrame:
    """(a, b) of each task's nodes that are not the least of their component there, with that least one; ``tag`` adds the task's number p."""

    def reduced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = local_roots(len(nodes), at[: len(a)], at[len(a) :])
        rest = np.flatnonzero(up != np.arange(len(nodes)))
        return nodes[rest], nodes[up[rest]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        held = 0
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held > HELD:
                one, two = reduced(np.concatenate(a), np.concatenate(b))
                a, b, held = [one], [two], len(one) // 2
        one, two = reduced(np.concatenate(a), np.concatenate(b))
        p = np.full(len(one), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), *([pa.array(p, pa.int64())] if tag else [])], ["a", "b", *(["p"] if tag else [])])

    return edges.select("a", "b").mapInArrow(apply, "a long, b long" + (", p long" if tag else ""))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a long, b long) that has another one as neighbour: root is the least node of its component."""
    near = forest(edges.where("a <> b"))
    while True:
        near = written(forest(near.repartition("a"), tag=True), "forest")
        first, last = near.agg(F.min("p"), F.max("p")).first()
        if first == last:
            break
        parents = written(near.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")), "parents")
        above = parents.select(F.col("a").alias("b"), F.col("b").alias("up"))
        raised = near.join(above, "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved"))
        near = written(raised, "raised")
        if near.where("moved").isEmpty() and parents.where("n > 1").isEmpty():
            break
    roots = near.select("b").distinct()
    return near.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def both_ways(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(src, dst) in both directions."""
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst")))


def least_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) of every node: the least id of its component under ``edges`` (src, dst)."""
    found = components(edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")))
    return nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def propagate_passes(labels: DataFrame, near: DataFrame, n: int, rounds: int = 1, k_max: int | None = None, group: int | None = None) -> DataFrame:
    """(slot, label) after rounds of a forward and a backward pass over strides 1 to ``k_max`` on a ring of n slots.

    ``near`` (slot, stride): slot i and (i + stride) mod n are neighbours (both ways, see
    ``neighbours.strides``). A pass takes groups of ``group`` strides (default: all) one after
    the other, backward in reverse order; each step sees the labels of the one before. Forward a slot takes the
    largest label of itself and the slots stride further; backward, of those stride before, where 2 stride < n.
    """
    k_max = min(k_max or n // 2, n // 2)
    near = written(near.where(F.col("stride").between(1, k_max)).select("slot", "stride", F.pmod(F.col("slot") + F.col("stride"), F.lit(n)).alias("other")).distinct(), "strides")
    back = near.where(2 * F.col("stride") < n).select(F.col("other").alias("slot"), "stride", F.col("slot").alias("other"))
    labels = written(labels.select("slot", "label"), "propagation")
    starts = range(1, k_max + 1, group or max(1, k_max))
    steps = [(near, a) for a in starts] + [(back, a) for a in reversed(starts)]
    for _ in range(rounds):
        for edges, a in steps:
            now = edges.where(F.col("stride").between(a, a + (group or k_max) - 1))
            offered = now.join(labels.select(F.col("slot").alias("other"), "label"), "other").groupBy("slot").agg(F.max("label").alias("offered"))
            raised = labels.join(offered, "slot", "left").select("slot", F.greatest("label", F.coalesce("offered", "label")).alias("label"))
            labels = written(raised, "propagation")
    return labels


def sweep_labels(labels: np.ndarray, near: list[tuple[int, int]], sweeps: int | None = None, doubling: bool = False) -> np.ndarray:
    """Labels of a ring after sequential sweeps, one stride after the other: a chain of N/2 steps by definition, so driver-sized (SWEPT slots).

    ``near``: (slot, stride) as in ``propagate_passes``. Each stride goes forward and, where
    2 stride < n, backward; ``sweeps`` defaults to ceil(log2 n). ``doubling`` is the
    historical, incomplete variant: strides 1, 2, 4, ... once, forward only.
    """
    n = len(labels)
    if n > SWEPT:
        raise ValueError(f"sweeps are for at most {SWEPT} slots; propagate_passes is for more")
    out, by = np.array(labels).copy(), {}
    for slot, stride in near:
        by.setdefault(stride, []).append(slot)
    by = {k: np.unique(v) for k, v in by.items()}
    strides = [1 << r for r in range(max(0, n - 1).bit_length())] if doubling else range(1, n // 2 + 1)
    for _ in range(1 if doubling else (sweeps if sweeps is not None else max(0, n - 1).bit_length())):
        for k in strides:
            at = by.get(k)
            if at is None or k >= n:
                continue
            out[at] = np.maximum(out[at], out[(at + k) % n])
            if not doubling and 2 * k < n:
                ahead = (at + k) % n
                out[ahead] = np.maximum(out[ahead], out[at])
    return out


def propagate_largest(labels: DataFrame, edges: DataFrame, rounds: int | None = None) -> tuple[DataFrame, int]:
    """Synchronous propagation of the largest label along edges, ``rounds`` times or until nothing changes.

    ``labels``: (id, label). Gives the labels and the number of rounds that changed any.
    """
    near = written(both_ways(edges).distinct(), "propagation-edges")
    labels, done = written(labels.select("id", "label"), "propagation"), 0
    while rounds is None or done < rounds:
        offered = near.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.max("label").alias("offered"))
        raised = labels.join(offered, "id", "left").select("id", F.greatest("label", F.coalesce("offered", "label")).alias("label"), F.col("label").alias("was"))
        raised = written(raised, "propagation")
        if raised.where("label <> was").isEmpty():
            break
        labels, done = raised.select("id", "label"), done + 1
    return labels, done
