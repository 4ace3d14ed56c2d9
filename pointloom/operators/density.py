"""Density clustering: degrees, core points, components, border rules, fuzzy variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators import neighbours as N
from pointloom.operators.points import normalize_global, scale_of, valid, with_slot
from pointloom.plans.components import least_members, propagate_largest
from pointloom.storage import written

TIES = ("first", "min", "max", "stride", "overwrite")


def neighbour_counts(points: DataFrame, edges: DataFrame, self_count: bool = True) -> DataFrame:
    """Points with n_neighbors; every unordered pair counts once for each side, the point itself once."""
    degree = N.symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("__n"))
    return points.join(degree, "id", "left").withColumn("n_neighbors", F.coalesce("__n", F.lit(0)) + int(self_count)).drop("__n")


def core_points(counted: DataFrame, min_pts: float) -> DataFrame:
    return counted.withColumn("is_core", F.col("n_neighbors") >= min_pts)


def fuzzy_degree(points: DataFrame, edges: DataFrame, eps: float) -> DataFrame:
    """Points with weight: 1 for itself and 1 - d2/eps^2 (at least 0) for every neighbour."""
    share = F.greatest(1 - F.col("d2") / F.lit(eps * eps), F.lit(0.0))
    degree = N.symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.sum(share).alias("__w"))
    return points.join(degree, "id", "left").withColumn("weight", F.coalesce("__w", F.lit(0.0)) + 1).drop("__w")


def fuzzy_core(weighted: DataFrame, min_pts: float) -> DataFrame:
    return weighted.withColumn("is_core", F.col("weight") >= min_pts - 0.5)


def diameter(points: DataFrame) -> float:
    """The largest distance: an upper bound's worth of candidates is not enough, so all pairs (small tables)."""
    d = N.dimension(points)
    row = N.join_cross(points, float("inf"), d).agg(F.sqrt(F.max("d2"))).first()
    return row[0] or 0.0


def fn_weights(points: DataFrame, edges: DataFrame, d_max: float, min_pts: float) -> DataFrame:
    """Fuzzy-neighbourhood weights 1 - d/d_max summed over neighbours; core where weight/largest >= min_pts/largest."""
    share = 1 - F.sqrt("d2") / F.lit(d_max)
    degree = N.symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.sum(share).alias("__w"))
    out = points.join(degree, "id", "left").withColumn("weight", F.coalesce("__w", F.lit(0.0))).drop("__w")
    largest = out.agg(F.max("weight").alias("__most"))
    relative = F.col("weight") / F.col("__most")
    return out.crossJoin(F.broadcast(largest)).withColumn("is_core", F.coalesce(relative >= F.lit(min_pts) / F.col("__most"), F.lit(False))).drop("__most")


def core_edges(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """Edges between core points: the loop-invariant part of propagation."""
    ids = cores.where("is_core").select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def core_components(cores: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of core points: components numbered from 1 by their least core id."""
    nodes = cores.where("is_core").select("id")
    roots = least_members(nodes, core_edges(edges, cores))
    return numbered(roots)


def numbered(roots: DataFrame) -> DataFrame:
    """(id, component, root): dense numbers of the roots in ascending order."""
    ranks = with_slot(roots.select("root").distinct(), "root", name="component", first=1)
    return roots.join(ranks, "root").select("id", "component", "root")


def border_links(edges: DataFrame, cores: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, core, and the core's label columns) of every pair of a non-core point and a core neighbour."""
    pairs = N.symmetric(edges).select(F.col("src").alias("id"), F.col("dst").alias("core"))
    pairs = pairs.join(cores.where("not is_core").select("id"), "id", "left_semi")
    return pairs.join(labels.withColumnRenamed("id", "core"), "core")


def assign_borders(links: DataFrame, tie: str = "first", slots: DataFrame | None = None, n: int = 0) -> DataFrame:
    """(id, component) of border points.

    first, min: the component with the least core; max: the one with the largest slot
    (component key); stride: that of the first core neighbour after the point, in
    cyclic slot order; overwrite: the latest component whose first core is a neighbour,
    else the first.
    """
    by = links.groupBy("id")
    if tie in ("first", "min"):
        return by.agg(F.min("component").alias("component"))
    if tie == "max":
        return by.agg(F.max_by("component", "key").alias("component"))
    if tie == "stride":
        at = slots.select("id", "slot")
        rows = links.join(at, "id").join(at.select(F.col("id").alias("core"), F.col("slot").alias("core_slot")), "core")
        return rows.groupBy("id").agg(F.min_by("component", F.pmod(F.col("core_slot") - F.col("slot"), F.lit(n))).alias("component"))
    if tie == "overwrite":
        seeded = F.max(F.when(F.col("core") == F.col("root"), F.col("component")))
        return by.agg(F.coalesce(seeded, F.min("component")).alias("component"))
    raise ValueError(f"tie must be one of {TIES}")


def dbscan(
    points: DataFrame, eps: float, min_pts: float, normalize: str = "none", closed: bool = True, self_count: bool = True, tie: str = "first",
    max_rounds: int | None = None, method: str = "grid", margin: str | float = "exact", alpha: int = 15,
) -> DataFrame:
    """Points with n_neighbors, is_core, role (core, border, noise), cluster (1.., noise -1) and component_key.

    ``normalize`` 'global' scales coordinates and eps by one range for all dimensions.
    Clusters are numbered by their least core id; component_key is the largest slot + 1 of
    the component's core points, slots being the order of ids. With ``max_rounds``, labels
    travel that many steps only, and components of larger diameter stay in parts.
    Rows that are no points (null coordinates) are left out; ids must be unique.
    """
    points = valid(points)
    d = N.dimension(points)
    if normalize == "global":
        _, scale = scale_of(points)
        points, eps = normalize_global(points), eps / scale
    margin = N.squared_margin(margin, d, alpha) if isinstance(margin, str) else margin
    edges = written(N.eps_join(points, eps, method, d=d, margin=margin, closed=closed), "edges")
    cores = written(core_points(neighbour_counts(points, edges, self_count), min_pts), "cores")
    return label_points(cores, edges, tie, max_rounds)


def label_points(cores: DataFrame, edges: DataFrame, tie: str = "first", max_rounds: int | None = None) -> DataFrame:
    """Clusters from core flags (id, is_core) and edges; see dbscan."""
    slots = with_slot(cores.select("id"), "id")
    core_slots = slots.join(cores.where("is_core").select("id"), "id", "left_semi")
    inner = core_edges(edges, cores)
    if max_rounds is None:
        roots = least_members(core_slots.select("id"), inner)
    else:
        reached, _ = propagate_largest(core_slots.select("id", F.col("slot").alias("label")), inner, max_rounds)
        heads = reached.groupBy("label").agg(F.min("id").alias("root"))
        roots = reached.join(heads, "label").select("id", "root")
    labels = numbered(roots)
    keys = labels.join(slots, "id").groupBy("component").agg((F.max("slot") + 1).alias("key"))
    labels = written(labels.join(keys, "component").select("id", "component", "root", "key"), "core-labels")
    links = border_links(edges, cores, labels)
    borders = assign_borders(links, tie, slots, cores.count() if tie == "stride" else 0)
    borders = borders.join(keys, "component").select("id", "component", "key")
    every = labels.select("id", "component", "key").unionByName(borders)
    out = cores.join(every, "id", "left")
    role = F.when(F.col("is_core"), "core").when(F.col("component").isNotNull(), "border").otherwise("noise")
    return out.withColumn("role", role).withColumn("cluster", F.coalesce("component", F.lit(-1)).cast("long")).withColumnRenamed("key", "component_key").drop("component")


def dbscan_textbook(points: DataFrame, eps: float, min_pts: float, **options) -> DataFrame:
    """The textbook form: distances below eps, later clusters' seeds overwrite earlier borders."""
    return dbscan(points, eps, min_pts, closed=False, tie="overwrite", **options)


def fuzzy_dbscan(points: DataFrame, eps: float, min_pts: float, tie: str = "stride", method: str = "grid") -> DataFrame:
    """Density clusters whose cores are chosen by fuzzy weights (weight instead of n_neighbors)."""
    points = valid(points)
    edges = written(N.eps_join(points, eps, method), "edges").where("d2 < %r" % (eps * eps))
    cores = written(fuzzy_core(fuzzy_degree(points, edges, eps), min_pts), "cores")
    return label_points(cores, edges, tie)


def fn_dbscan(points: DataFrame, eps: float, min_pts: float, d_max: float | None = None) -> DataFrame:
    """Fuzzy-neighbourhood clusters; d_max is the table's diameter unless given."""
    points = valid(points)
    d_max = d_max or diameter(points) or 1.0
    edges = written(N.eps_join(points, eps), "edges")
    cores = written(fn_weights(points, edges, d_max, min_pts), "cores")
    return label_points(cores, edges, "first")


def summary(clustered: DataFrame) -> DataFrame:
    """Points by cluster and role."""
    return clustered.groupBy("cluster").agg(
        F.count("*").alias("points"), F.count(F.when(F.col("role") == "core", 1)).alias("core"), F.count(F.when(F.col("role") == "border", 1)).alias("border")
    )


def convergence(points: DataFrame, eps: float, min_pts: float, rounds: list[int], normalize: str = "none") -> DataFrame:
    """Agreement (ARI) with exact clusters after each number of rounds; one row a number."""
    from pointloom.operators.metrics import adjusted_rand

    exact = written(dbscan(points, eps, min_pts, normalize).select("id", F.col("cluster").alias("exact")), "exact")
    out = None
    for r in rounds:
        got = dbscan(points, eps, min_pts, normalize, tie="max", max_rounds=r).select("id", "cluster").join(exact, "id")
        row = adjusted_rand(got, "exact", "cluster").select(F.lit(r).alias("rounds"), "ari")
        out = row if out is None else out.unionByName(row)
    return out


def sweep(points: DataFrame, eps: list[float], min_pts: list[float], **options) -> DataFrame:
    """Clusters, noise and core counts for each pair of parameters."""
    out = None
    for e in eps:
        for m in min_pts:
            got = dbscan(points, e, m, **options)
            row = got.agg(
                F.countDistinct(F.when(F.col("cluster") > 0, F.col("cluster"))).alias("clusters"), F.count(F.when(F.col("is_core"), 1)).alias("core"),
                F.count(F.when(F.col("role") == "noise", 1)).alias("noise"),
            ).select(F.lit(e).alias("eps"), F.lit(m).alias("min_pts"), "clusters", "core", "noise")
            out = row if out is None else out.unionByName(row)
    return out
