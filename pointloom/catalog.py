"""Registered queries of the point-set operators, each with SQL that gives the same rows.

Point views: ``emb2`` is (vec_id, first two components) with the label as truth,
``part`` is (size, retail price) of parts, ``event`` is (second of the day, value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import approx
from pointloom.operators import clustering, density, grid, metrics, neighbours, ordering, points
from pointloom.plans import owners
from pointloom.plans.components import propagate_largest, propagate_passes

EPS, MIN_PTS = 0.02, 4
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return points.point_table(_read(spark, sf_dir, "embeddings"), "vec_id", e[0], e[1], label="label")


def emb3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return points.point_table(_read(spark, sf_dir, "embeddings"), "vec_id", e[0], e[1], e[2], label="label")


def part2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.point_table(_read(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice")


def cust2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.point_table(_read(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "c_acctbal")


def xy(df: DataFrame, *more, digits: int | None = None) -> DataFrame:
    c = [F.col("coords")[k] for k in (0, 1)]
    c = [F.round(x, digits) if digits is not None else x for x in c]
    return df.select("id", c[0].alias("x"), c[1].alias("y"), *more)


#: SQL heads: p is the point view, e the undirected edges, n the degrees with the point itself, and so on.
P = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS true_label FROM embeddings)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
E_ = f"e AS (SELECT a.id AS src, b.id AS dst, {D2} AS d2 FROM p a JOIN p b ON a.id < b.id AND {D2} <= {EPS * EPS!r})"
S_ = "s AS (SELECT src, dst, d2 FROM e UNION ALL SELECT dst, src, d2 FROM e)"
N_ = "n AS (SELECT p.id, count(s.dst) + 1 AS n_neighbors FROM p LEFT JOIN s ON s.src = p.id GROUP BY p.id)"
C_ = f"c AS (SELECT id FROM n WHERE n_neighbors >= {MIN_PTS})"
R_ = "r AS (SELECT id, id AS root FROM c UNION SELECT s.dst, r.root FROM r JOIN s ON s.src = r.id JOIN c ON c.id = s.dst)"
L_ = "l AS (SELECT id, min(root) AS root FROM r GROUP BY id)"
K_ = "k AS (SELECT id, root, dense_rank() OVER (ORDER BY root) AS component FROM l)"
SLOT = "slots AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS slot FROM p)"
KEY = "keys AS (SELECT component, max(slot) + 1 AS key FROM k JOIN slots USING (id) GROUP BY component)"
B_ = "b AS (SELECT n.id, s.dst AS core, k.component, k.root FROM n JOIN s ON s.src = n.id JOIN k ON k.id = s.dst WHERE n.n_neighbors < %d)" % MIN_PTS
HEAD = f"WITH RECURSIVE {P}, {E_}, {S_}, {N_}, {C_}, {R_}, {L_}, {K_}, {SLOT}, {KEY}, {B_}"
FIRST = "first_ AS (SELECT id, component FROM k UNION ALL SELECT id, min(component) FROM b GROUP BY id)"


# --- scalars, normalisation -------------------------------------------------------


@query(f"WITH {P}, g AS (SELECT least(min(x), min(y)) lo, greatest(max(x), max(y)) hi FROM p) SELECT id, round((x - lo) / (hi - lo), 9) AS x, round((y - lo) / (hi - lo), 9) AS y FROM p, g")
def normalize_global(spark, sf):
    return xy(points.normalize_global(emb2(spark, sf)), digits=9)


@query(f"WITH {P}, g AS (SELECT min(x) a, max(x) b, min(y) c, max(y) d FROM p) SELECT id, round((x - a) / (b - a), 9) AS x, round((y - c) / (d - c), 9) AS y FROM p, g")
def normalize_per_dim(spark, sf):
    return xy(points.normalize_per_dimension(emb2(spark, sf), 2), digits=9)


@query(f"WITH {P} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM p")
def denormalize_round(spark, sf):
    p = emb2(spark, sf)
    lo, scale = points.scale_of(p)
    return xy(points.denormalize(points.normalize_global(p), lo, scale))


@query(f"WITH {P}, g AS (SELECT min(x) a, max(x) b, min(y) c, max(y) d FROM p) SELECT id, round(37.3 + (x - a) / (b - a) * 0.2, 9) AS x, round(127.0 + (y - c) / (d - c) * 0.2, 9) AS y FROM p, g")
def affine_box(spark, sf):
    return xy(points.to_box(points.normalize_per_dimension(emb2(spark, sf), 2), [(37.3, 37.5), (127.0, 127.2)]), digits=9)


@query(f"WITH {P} SELECT id, greatest(-0.1, least(0.1, x)) AS x, greatest(-0.1, least(0.1, y)) AS y FROM p")
def clip_coordinates(spark, sf):
    return xy(points.clip(emb2(spark, sf), -0.1, 0.1))


@query(f"WITH {P} SELECT id, x AS x1, y AS x2, true_label FROM p")
def transpose_columns(spark, sf):
    return points.to_columns(emb2(spark, sf), 2)


@query("SELECT event_id AS id, CASE WHEN abs(value) < 50 THEN -1 ELSE value END AS label FROM events")
def noise_band(spark, sf):
    return _read(spark, sf, "events").select(F.col("event_id").alias("id"), points.decode_noise(F.col("value"), 50.0).alias("label"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN round_even(l_discount * 100 - 3, 0) <= 0 THEN -1 ELSE least(round_even(l_discount * 100 - 3, 0)::BIGINT, 5) END AS label FROM lineitem")
def decode_labels(spark, sf):
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", points.decode_range(F.col("l_discount") * 100 - 3, 5).alias("label"))


@query("WITH s AS (SELECT c_nationkey, count(*) n FROM customer GROUP BY 1) SELECT c_custkey AS id, CASE WHEN n < 60 THEN -1 ELSE c_nationkey END AS true_label FROM customer JOIN s USING (c_nationkey)")
def class_to_noise(spark, sf):
    rows = _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("true_label"))
    return points.small_classes_to_noise(rows, 60)


@query("SELECT c_nationkey AS label, count(*) AS points FROM customer GROUP BY 1")
def label_distribution(spark, sf):
    return metrics.label_distribution(_read(spark, sf, "customer").withColumnRenamed("c_nationkey", "label"))


@query("WITH s AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS slot, value FROM events), n AS (SELECT count(*) n FROM s) SELECT s.slot, s.value, t.value AS rotated FROM s, n JOIN s t ON t.slot = (s.slot + 7) % n.n")
def rotate_shift(spark, sf):
    rows = points.with_slot(_read(spark, sf, "events").select("event_id", "value"), "event_id").select("slot", "value")
    return points.rotate(rows, 7, rows.count())


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS value, round(sum(o_totalprice) OVER (), 2) AS total FROM orders")
def rotate_sum(spark, sf):
    rows = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,4)").alias("value"))
    return points.running_total(rows).select("id", F.round(F.col("value").cast("double"), 2).alias("value"), F.round(F.col("total").cast("double"), 2).alias("total"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS slot, o_orderkey AS id FROM orders")
def rank_slots(spark, sf):
    return points.with_slot(_read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), "o_totalprice", "id").select("slot", "id")


@query("SELECT event_id AS id, round(sum(value) OVER (ORDER BY event_id), 6) AS running FROM events")
def running_sums(spark, sf):
    rows = _read(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    return points.running_sum(rows, "value", "id").select("id", F.round("running", 6).alias("running"))


# --- grids ------------------------------------------------------------------------

PARTS = "p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part)"


def _part_box(spark, sf):
    p = part2(spark, sf)
    return p, *([float(v) for v in p.agg(F.min(F.col("coords")[0]), F.min(F.col("coords")[1])).first()], [float(v) for v in p.agg(F.max(F.col("coords")[0]), F.max(F.col("coords")[1])).first()])


GRID = f"{PARTS}, g AS (SELECT min(x) ax, max(x) bx, min(y) ay, max(y) by_ FROM p), h AS (SELECT *, greatest(1, ceil((bx - ax) / 9.0 - 1e-12))::BIGINT nx, greatest(1, ceil((by_ - ay) / 9.0 - 1e-12))::BIGINT ny FROM g), i AS (SELECT id, x, y, nx, ny, greatest(0, least(nx - 1, floor((x - ax) / 9.0)))::BIGINT ix, greatest(0, least(ny - 1, floor((y - ay) / 9.0)))::BIGINT iy FROM p, h)"


def _cells(spark, sf):
    p, lows, highs = _part_box(spark, sf)
    counts = grid.axis_counts(lows, highs, 9.0)
    out = p.withColumn("index", grid.cell_index(F.col("coords"), lows, highs, 9.0))
    return out.withColumn("cell_id", grid.flatten_row_major(F.col("index"), counts)), counts


@query(f"WITH {GRID} SELECT id, ix * ny + iy AS cell_id, ix + iy * nx AS first_fastest FROM i")
def grid_assign(spark, sf):
    cells, counts = _cells(spark, sf)
    return cells.select("id", "cell_id", grid.flatten_first_fastest(F.col("index"), counts).alias("first_fastest"))


@query(f"WITH {GRID} SELECT ix * ny + iy AS cell_id, count(*) AS points FROM i GROUP BY 1")
def grid_cell_counts(spark, sf):
    return grid.occupancy(_cells(spark, sf)[0])


@query(f"WITH {GRID}, q AS (SELECT ax, ay, ny, unnest(range(nx)) AS ix FROM h), t AS (SELECT *, unnest(range(ny)) AS iy FROM q) SELECT ix, iy, ax + 9.0::DOUBLE * (ix + 0.5::DOUBLE) AS cx, ay + 9.0::DOUBLE * (iy + 0.5::DOUBLE) AS cy FROM t")
def grid_centres(spark, sf):
    _, lows, highs = _part_box(spark, sf)
    ny = grid.axis_counts(lows, highs, 9.0)[1]
    c = grid.centres(spark, lows, highs, 9.0)
    return c.select(F.floor(F.col("cell_id") / ny).alias("ix"), (F.col("cell_id") % ny).alias("iy"), F.col("centre")[0].alias("cx"), F.col("centre")[1].alias("cy"))


@query(f"WITH {GRID}, o AS (SELECT * FROM (VALUES (-1), (0), (1)) v(d)), u AS (SELECT DISTINCT ix, iy, nx, ny FROM i) SELECT ix * ny + iy AS cell, (ix + o.d) * ny + iy + q.d AS neighbour FROM u, o, o q WHERE ix + o.d BETWEEN 0 AND nx - 1 AND iy + q.d BETWEEN 0 AND ny - 1")
def grid_neighbors(spark, sf):
    cells, counts = _cells(spark, sf)
    return grid.neighbour_cells(cells.select("index").distinct(), counts)


@query(f"WITH {P} SELECT id, floor(x / {EPS / 2**0.5!r})::BIGINT AS c0, floor(y / {EPS / 2**0.5!r})::BIGINT AS c1 FROM p")
def cell_side_sqrt_d(spark, sf):
    side, _ = grid.exact_side(EPS, 2)
    return grid.free_cells(emb2(spark, sf), side, 2).select("id", "c0", "c1")


OWNED = f"{GRID}, w AS (SELECT id, id % 3 AS owner_id, ix * ny + iy AS cell_id, nx * ny AS cells FROM i), b AS (SELECT *, row_number() OVER (PARTITION BY owner_id, cell_id ORDER BY id) - 1 AS rn FROM w)"


def _owned(spark, sf):
    cells, counts = _cells(spark, sf)
    return cells.withColumn("owner_id", (F.col("id") % 3)).withColumn("owner_local_idx", F.col("id")), counts


@query(f"WITH {OWNED} SELECT id, owner_id, cell_id, rn // 8 AS block_idx, rn % 8 AS pos FROM b")
def bucketize_blocks(spark, sf):
    return grid.blocks(_owned(spark, sf)[0], 8).select("id", "owner_id", "cell_id", F.col("block_idx").cast("long").alias("block_idx"), F.col("pos").cast("long").alias("pos"))


@query(f"WITH {OWNED} SELECT id, owner_id, rn * cells + cell_id AS slot FROM b")
def column_major_slots(spark, sf):
    rows, counts = _owned(spark, sf)
    return grid.column_major(rows, counts[0] * counts[1]).select("id", "owner_id", "slot")


@query(f"WITH {OWNED} SELECT id, row_number() OVER (ORDER BY owner_id, cell_id, rn // 8, rn % 8) - 1 AS global_id FROM b")
def global_index(spark, sf):
    return ordering.global_index(grid.blocks(_owned(spark, sf)[0], 8), "owner_id", "cell_id", "block_idx", "pos").select("id", "global_id")


@query(f"WITH {OWNED} SELECT owner_id, count(DISTINCT cell_id) AS active_cells, count(*) AS valid_slots FROM b GROUP BY 1")
def owner_cells(spark, sf):
    return metrics.owner_cells(_owned(spark, sf)[0])


@query(f"WITH {P}, o AS (SELECT id % 3 AS owner_id, least(min(x), min(y)) lo, greatest(max(x), max(y)) hi, count(*) n FROM p GROUP BY 1) SELECT min(lo) AS lo, max(hi) AS hi, sum(n)::BIGINT AS points FROM o")
def owner_minmax_agg(spark, sf):
    return owners.negotiate(emb2(spark, sf).withColumn("owner_id", F.col("id") % 3))


@query(f"WITH {P}, s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 r, count(*) OVER () n FROM p) SELECT id, least(r // (n // 3), 2) AS owner_id, r - least(r // (n // 3), 2) * (n // 3) AS owner_local_idx FROM s")
def owner_split(spark, sf):
    return ordering.split_contiguous(emb2(spark, sf), 3).select("id", F.col("owner_id").cast("long").alias("owner_id"), "owner_local_idx")


# --- neighbour joins --------------------------------------------------------------

EDGES = f"WITH {P}, {E_} SELECT src, dst, round(d2, 12) AS d2 FROM e"


def _edges_out(e):
    return e.select("src", "dst", F.round("d2", 12).alias("d2"))


@query(EDGES)
def eps_join_cross(spark, sf):
    return _edges_out(neighbours.join_cross(emb2(spark, sf), EPS, 2))


@query(EDGES)
def eps_join_grid(spark, sf):
    return _edges_out(neighbours.join_grid(emb2(spark, sf), EPS, 2))


@query(EDGES)
def eps_join_band(spark, sf):
    return _edges_out(neighbours.join_band(emb2(spark, sf), EPS, d=2))


@query(EDGES)
def eps_join_same_cell(spark, sf):
    return _edges_out(neighbours.join_same_cell_shortcut(emb2(spark, sf), EPS, 2))


@query(
    "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id AND "
    f"(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {0.05 * 0.05!r}"
)
def eps_join_3d(spark, sf):
    return neighbours.join_grid(emb3(spark, sf), 0.05, 3).select("src", "dst")


@query(f"WITH {P} SELECT b.id FROM p a JOIN p b ON a.id = 0 AND {D2} <= {0.05 * 0.05!r}")
def region_query(spark, sf):
    return neighbours.region_of(emb2(spark, sf), 0, 0.05).select("id")


@query(f"WITH {P}, {E_}, {S_} SELECT src AS id, list(dst ORDER BY dst) AS neighbours FROM s GROUP BY src")
def adjacency_lists(spark, sf):
    return neighbours.adjacency(neighbours.join_grid(emb2(spark, sf), EPS, 2))


@query(f"WITH {P}, {E_}, {S_}, {SLOT}, n AS (SELECT count(*) n FROM p) SELECT a.slot, (b.slot - a.slot + n.n) % n.n AS stride FROM s JOIN slots a ON a.id = s.src JOIN slots b ON b.id = s.dst, n")
def stride_edges(spark, sf):
    p = emb2(spark, sf)
    return neighbours.strides(neighbours.join_grid(p, EPS, 2), points.with_slot(p.select("id"), "id"), p.count())


# --- degrees and density ----------------------------------------------------------


def _counted(spark, sf):
    p = emb2(spark, sf)
    return density.neighbour_counts(p, neighbours.join_grid(p, EPS, 2))


@query(f"WITH {P}, {E_}, {S_}, {N_} SELECT id, n_neighbors FROM n")
def neighbor_count(spark, sf):
    return _counted(spark, sf).select("id", "n_neighbors")


@query(f"WITH {P}, {E_}, {S_}, {N_} SELECT n_neighbors, count(*) AS points FROM n GROUP BY 1")
def degree_histogram(spark, sf):
    return _counted(spark, sf).groupBy("n_neighbors").agg(F.count("*").alias("points"))


@query(f"WITH {P}, {E_}, {S_}, {N_} SELECT id, n_neighbors >= {MIN_PTS} AS is_core FROM n")
def core_points(spark, sf):
    return density.core_points(_counted(spark, sf), MIN_PTS).select("id", "is_core")


@query(f"WITH {P}, {E_}, {S_} SELECT p.id, round(coalesce(sum(greatest(1 - d2 / {EPS * EPS!r}, 0)), 0) + 1, 6) AS weight FROM p LEFT JOIN s ON s.src = p.id GROUP BY p.id")
def fuzzy_degree(spark, sf):
    p = emb2(spark, sf)
    return density.fuzzy_degree(p, neighbours.join_grid(p, EPS, 2), EPS).select("id", F.round("weight", 6).alias("weight"))


@query(f"WITH {P}, {E_}, {S_}, w AS (SELECT p.id, coalesce(sum(1 - sqrt(d2) / 0.5), 0) AS w FROM p LEFT JOIN s ON s.src = p.id GROUP BY p.id) SELECT id, round(w, 6) AS weight, w / (SELECT max(w) FROM w) >= 3.0 / (SELECT max(w) FROM w) AS is_core FROM w")
def fn_dbscan_weights(spark, sf):
    p = emb2(spark, sf)
    return density.fn_weights(p, neighbours.join_grid(p, EPS, 2), 0.5, 3.0).select("id", F.round("weight", 6).alias("weight"), "is_core")


@query(f"{HEAD} SELECT id, component FROM k")
def core_components(spark, sf):
    p = emb2(spark, sf)
    e = neighbours.join_grid(p, EPS, 2)
    cores = density.core_points(density.neighbour_counts(p, e), MIN_PTS)
    return density.core_components(cores, e).select("id", "component")


def _labels(tie: str):
    def run(spark, sf):
        return density.dbscan(emb2(spark, sf), EPS, MIN_PTS, tie=tie).select("id", "n_neighbors", "role", "cluster", "component_key")

    return run


def _label_sql(pick: str) -> str:
    return (
        f"{HEAD}, every AS (SELECT id, component FROM k UNION ALL ({pick})) SELECT n.id, n.n_neighbors, CASE WHEN n.n_neighbors >= {MIN_PTS} THEN 'core' WHEN every.component IS NOT NULL THEN 'border' ELSE 'noise' END AS role, "
        "coalesce(every.component, -1) AS cluster, keys.key AS component_key FROM n LEFT JOIN every USING (id) LEFT JOIN keys USING (component)"
    )


for _tie, _pick in {
    "first": "SELECT id, min(component) FROM b GROUP BY id",
    "max": "SELECT b.id, arg_max(component, key) FROM b JOIN keys USING (component) GROUP BY b.id",
    "stride": "SELECT b.id, arg_min(component, (t.slot - o.slot + (SELECT count(*) FROM p)) % (SELECT count(*) FROM p)) FROM b JOIN slots o ON o.id = b.id JOIN slots t ON t.id = b.core GROUP BY b.id",
    "overwrite": "SELECT id, coalesce(max(CASE WHEN core = root THEN component END), min(component)) FROM b GROUP BY id",
}.items():
    _QUERIES[f"dbscan_labels_{_tie}"] = _labels(_tie)
    _SQL[f"dbscan_labels_{_tie}"] = _label_sql(_pick)


@query(f"{HEAD}, {FIRST}, f AS (SELECT n.id, n.n_neighbors >= {MIN_PTS} AS core, coalesce(first_.component, -1) AS cluster FROM n LEFT JOIN first_ USING (id)) SELECT cluster, count(*) AS points, count(*) FILTER (WHERE core) AS core, count(*) FILTER (WHERE NOT core AND cluster > 0) AS border FROM f GROUP BY 1")
def dbscan_summary(spark, sf):
    return density.summary(density.dbscan(emb2(spark, sf), EPS, MIN_PTS))


@query(f"{HEAD} SELECT DISTINCT id FROM b")
def border_only(spark, sf):
    return density.dbscan(emb2(spark, sf), EPS, MIN_PTS).where("role = 'border'").select("id")


@query(f"{HEAD} SELECT id FROM n WHERE n_neighbors < {MIN_PTS} AND id NOT IN (SELECT id FROM b)")
def noise_only(spark, sf):
    return density.dbscan(emb2(spark, sf), EPS, MIN_PTS).where("role = 'noise'").select("id")


_HOP = "t%d AS (SELECT t.id, greatest(t.label, coalesce(max(u.label), t.label)) AS label FROM t%d t LEFT JOIN ce ON ce.src = t.id LEFT JOIN t%d u ON u.id = ce.dst GROUP BY t.id, t.label)"


@query(f"{HEAD}, ce AS (SELECT s.src, s.dst FROM s JOIN c a ON a.id = s.src JOIN c z ON z.id = s.dst), t0 AS (SELECT c.id, slot + 1 AS label FROM c JOIN slots USING (id)), {', '.join(_HOP % (i + 1, i, i) for i in range(3))} SELECT id, label FROM t3")
def max_propagation_r3(spark, sf):
    p = emb2(spark, sf)
    e = neighbours.join_grid(p, EPS, 2)
    cores = density.core_points(density.neighbour_counts(p, e), MIN_PTS)
    start = points.with_slot(p.select("id"), "id").join(cores.where("is_core").select("id"), "id").select("id", (F.col("slot") + 1).alias("label"))
    return propagate_largest(start, density.core_edges(e, cores), 3)[0]


@query(f"{HEAD}, {FIRST} SELECT n.id % 3 AS owner_id, n.id AS owner_local_idx, n.n_neighbors, coalesce(first_.component, -1) > 0 AS clustered, k.root AS head FROM n LEFT JOIN first_ USING (id) LEFT JOIN k USING (id)")
def multi_owner_clusters(spark, sf):
    """Clusters of three owners' points; a core point's cluster is named by the least id of its core points."""
    p = emb2(spark, sf)
    parts = [p.where(F.col("id") % 3 == k) for k in range(3)]
    out = owners.run(parts, EPS, MIN_PTS).select(F.col("owner_id").cast("long").alias("owner_id"), "owner_local_idx", "n_neighbors", "role", "cluster")
    heads = out.where("role = 'core'").groupBy("cluster").agg(F.min("owner_local_idx").alias("head"))
    named = out.join(heads, "cluster", "left")
    return named.select("owner_id", "owner_local_idx", "n_neighbors", (F.col("cluster") > 0).alias("clustered"), F.when(F.col("role") == "core", F.col("head")).alias("head"))


# --- quality --------------------------------------------------------------------


LABELLED = f"{HEAD}, {FIRST}, v AS (SELECT p.id, p.true_label AS t, coalesce(first_.component, -1) AS c FROM p LEFT JOIN first_ USING (id))"


def _clustered(spark, sf):
    return density.dbscan(emb2(spark, sf), EPS, MIN_PTS)


@query(f"{LABELLED}, m AS (SELECT t, c, count(*) n FROM v GROUP BY 1, 2), sums AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM m) cells, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) n FROM m GROUP BY t)) a, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) n FROM m GROUP BY c)) b, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM m) pairs) SELECT round((cells - a * b / pairs) / ((a + b) / 2 - a * b / pairs), 9) AS ari FROM sums")
def ari_vs_label(spark, sf):
    return metrics.adjusted_rand(_clustered(spark, sf), "true_label", "cluster").select(F.round("ari", 9).alias("ari"))


@query(f"{LABELLED} SELECT t AS true_label, c AS cluster, count(*) AS points FROM v GROUP BY 1, 2")
def confusion(spark, sf):
    return metrics.confusion(_clustered(spark, sf), "true_label", "cluster")


@query(f"{LABELLED}, m AS (SELECT c, t, count(*) n FROM v GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, t) r FROM m) SELECT c AS cluster, t AS mapped, n AS points FROM q WHERE r = 1")
def mode_map(spark, sf):
    return metrics.majority_mapping(_clustered(spark, sf), "cluster", "true_label")


@query(f"{LABELLED} SELECT avg(CASE WHEN t = c THEN 1.0 ELSE 0.0 END) AS match_rate FROM (SELECT * FROM v ORDER BY id LIMIT 50)")
def match_rate(spark, sf):
    return metrics.match_rate(_clustered(spark, sf), "true_label", "cluster")


@query(f"{LABELLED} SELECT count(DISTINCT CASE WHEN c <> -1 THEN c END) AS clusters, count(*) FILTER (WHERE c = -1) AS noise FROM v")
def cluster_count(spark, sf):
    return metrics.cluster_count(_clustered(spark, sf))


@query(f"WITH {P}, g AS (SELECT a.id, a.true_label m, b.true_label t, avg(sqrt({D2})) d FROM p a JOIN p b ON a.id <> b.id GROUP BY 1, 2, 3), h AS (SELECT id, max(CASE WHEN m = t THEN d END) a, min(CASE WHEN m <> t THEN d END) b FROM g GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette FROM h")
def silhouette(spark, sf):
    return metrics.silhouette(emb2(spark, sf), "true_label").select(F.round("silhouette", 9).alias("silhouette"))


# --- orders and labels ------------------------------------------------------------


@query(f"{LABELLED} SELECT id, CASE WHEN t < 3 THEN -1 ELSE t - 2 END AS remapped FROM v")
def remap_sequential(spark, sf):
    rows = emb2(spark, sf).withColumn("l", F.when(F.col("true_label") < 3, -1).otherwise(F.col("true_label") * 10))
    return ordering.remap_sequential(rows, "l").select("id", "remapped")


@query(f"WITH {P}, f AS (SELECT true_label, min(id) m FROM p GROUP BY 1), g AS (SELECT true_label, row_number() OVER (ORDER BY m) r FROM f) SELECT id, r AS remapped FROM p JOIN g USING (true_label)")
def remap_by_appearance(spark, sf):
    return ordering.remap_by_appearance(emb2(spark, sf), "true_label").select("id", "remapped")


@query(f"WITH {P}, q AS (SELECT (SELECT count(*) - 1 FROM p z WHERE z.x >= p.x AND z.x <= p.x + {EPS!r}) w FROM p) SELECT least(greatest(max(w), 1), count(*) // 2)::BIGINT AS k_max FROM q")
def kmax_window(spark, sf):
    return ordering.kmax_window(emb2(spark, sf).select("id", F.col("coords")[0].alias("z")), EPS)


@query("WITH p AS (SELECT p_size::DOUBLE x FROM part), q AS (SELECT (SELECT count(*) - 1 FROM p z WHERE z.x >= p.x AND z.x <= p.x + 2) w FROM p) SELECT least(greatest(max(w), 1), count(*) // 2)::BIGINT AS k_max FROM q")
def kmax_window_ties(spark, sf):
    """Part sizes: fifty values, so most positions are ties."""
    return ordering.kmax_window(_read(spark, sf, "part").select(F.col("p_size").cast("double").alias("z")), 2.0)


@query(f"WITH {P}, m AS (SELECT avg(x) mx, avg(y) my, covar_pop(x, x) a, covar_pop(x, y) b, covar_pop(y, y) d FROM p), v AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l FROM m), u AS (SELECT *, b AS vx, l - a AS vy FROM v), w AS (SELECT *, CASE WHEN (CASE WHEN abs(vx) >= abs(vy) THEN vx ELSE vy END) < 0 THEN -1 ELSE 1 END AS sg FROM u) SELECT id, row_number() OVER (ORDER BY ((x - mx) * vx + (y - my) * vy) * sg, id) - 1 AS slot FROM p, w")
def pca_order_pos(spark, sf):
    return ordering.pca_order(emb2(spark, sf)).select("id", "slot")


@query("WITH v AS (SELECT DISTINCT value FROM events WHERE abs(value) >= 0.5), q AS (SELECT value, CASE WHEN value - lag(value) OVER (ORDER BY value) > 0.05 OR lag(value) OVER (ORDER BY value) IS NULL THEN 1 ELSE 0 END o FROM v), g AS (SELECT value, sum(o) OVER (ORDER BY value) AS grp FROM q), m AS (SELECT grp, greatest(1, least(10000, round_even(quantile_cont(value, 0.5), 0)))::BIGINT AS cluster FROM events JOIN g USING (value) GROUP BY grp) SELECT event_id AS id, grp::BIGINT AS grp, coalesce(cluster, -1)::BIGINT AS cluster FROM events LEFT JOIN g USING (value) LEFT JOIN m USING (grp)")
def gap_groups(spark, sf):
    rows = _read(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    return ordering.gap_groups(rows, "value", 0.05, 10_000).select("id", F.col("grp").cast("long").alias("grp"), "cluster")


@query("WITH s AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS slot FROM events) SELECT max(value) / (max(slot) + 1) AS threshold FROM s WHERE abs(value) >= 0.5")
def gap_threshold(spark, sf):
    rows = points.with_slot(_read(spark, sf, "events").select("event_id", "value"), "event_id")
    return ordering.gap_threshold(rows, "value")


# --- other clusterings ------------------------------------------------------------

_CENTRES = [[-0.2, -0.2], [0.0, 0.1], [0.2, 0.2]]
_FAR = ", ".join(f"(x - c.x{i}) * (x - c.x{i}) + (y - c.y{i}) * (y - c.y{i}) AS f{i}" for i in range(3))
_PICK = "CASE WHEN f0 <= f1 AND f0 <= f2 THEN 0 WHEN f1 <= f2 THEN 1 ELSE 2 END"
_KM = "c0 AS (SELECT " + ", ".join(f"{x!r}::DOUBLE AS x{i}, {y!r}::DOUBLE AS y{i}" for i, (x, y) in enumerate(_CENTRES)) + ")"
for _i in range(3):
    _KM += f", a{_i} AS (SELECT id, x, y, {_PICK} AS k FROM (SELECT p.*, {_FAR} FROM p, c{_i} c)), c{_i + 1} AS (SELECT " + ", ".join(f"avg(x) FILTER (WHERE k = {j}) AS x{j}, avg(y) FILTER (WHERE k = {j}) AS y{j}" for j in range(3)) + f" FROM a{_i})"


@query(f"WITH {P}, {_KM} SELECT id, {_PICK} AS cluster FROM (SELECT p.*, {_FAR} FROM p, c3 c)")
def kmeans_lloyd_3(spark, sf):
    return clustering.kmeans(emb2(spark, sf), _CENTRES, iterations=3, tolerance=0.0)[0].select("id", "cluster")


@query(f"WITH {P} SELECT a.id, round(avg(b.x), 9) AS x, round(avg(b.y), 9) AS y, count(*) AS support FROM p a JOIN p b ON {D2} <= {0.05 * 0.05!r} GROUP BY 1")
def mean_shift_step(spark, sf):
    p = emb2(spark, sf)
    return xy(clustering.shift_once(p.select("id", "coords"), p, 0.05, 2), "support", digits=9)


# --- approximate numerics ---------------------------------------------------------


def _unrolled(start: dict[str, str], steps: list[dict[str, str]], result: str, source: str) -> str:
    """SQL that applies assignments step by step to the columns of a source."""
    out = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in start.items())} FROM ({source})"
    for step in steps:
        for k, v in step.items():
            out = f"SELECT * REPLACE ({v} AS {k}) FROM ({out})"
    return f"SELECT id, {result} FROM ({out})"


_LINE = "SELECT l_orderkey * 10 + l_linenumber AS id, l_discount AS u, l_tax AS v FROM lineitem"


def _line(spark, sf):
    return _read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_discount").alias("u"), F.col("l_tax").alias("v"))


@query(_unrolled({"a": "2 - (0.5 + u)", "b": "1 - (0.5 + u)"}, [{"b": "b * b", "a": "a * (1 + b)"}] * 6, "round(a, 9) AS y", _LINE))
def approx_inverse(spark, sf):
    return _line(spark, sf).select("id", F.round(approx.inverse(F.col("u") + 0.5), 9).alias("y"))


_ROOT = [{"a": "a * (1 - b / 2)", "b": "b * b * ((b - 3) / 4)"}] * 6


@query(_unrolled({"a": "u + 0.3", "b": "u + 0.3 - 1"}, _ROOT, "round(a, 9) AS y", _LINE))
def approx_sqrt(spark, sf):
    return _line(spark, sf).select("id", F.round(approx.square_root(F.col("u") + 0.3), 9).alias("y"))


_HALF = {"a": "((u - v) / 2) * ((u - v) / 2)", "b": "((u - v) / 2) * ((u - v) / 2) - 1"}


@query(_unrolled(_HALF, _ROOT, "round((u + v) / 2 - a, 9) AS low, round((u + v) / 2 + a, 9) AS high", _LINE))
def approx_min_max(spark, sf):
    return _line(spark, sf).select("id", F.round(approx.minimum(F.col("u"), F.col("v")), 9).alias("low"), F.round(approx.maximum(F.col("u"), F.col("v")), 9).alias("high"))


def _inverse_sql(x: str, name: str, depth: int) -> list[dict[str, str]]:
    return [{name: f"2 - ({x})", "b": f"1 - ({x})"}] + [{"b": "b * b", name: f"{name} * (1 + b)"}] * depth


_COMPARE = [*_inverse_sql("((0.6 + u) + (0.6 + v)) / 2", "w", 5), {"x": "(0.6 + u) / 2 * w"}]
for _ in range(4):
    _COMPARE += [{"p": "x * x", "q": "(1 - x) * (1 - x)"}, {"p": "p * p", "q": "q * q"}, *_inverse_sql("p + q", "w", 5), {"x": "p * w"}]


@query(_unrolled({"w": "0.0::DOUBLE", "b": "0.0::DOUBLE", "x": "0.0::DOUBLE", "p": "0.0::DOUBLE", "q": "0.0::DOUBLE"}, _COMPARE, "round(x, 9) AS y", _LINE))
def approx_compare(spark, sf):
    return _line(spark, sf).select("id", F.round(approx.compare(F.col("u") + 0.6, F.col("v") + 0.6), 9).alias("y"))


@query(_unrolled({"x": "u - v"}, [{"x": "x * 1.5 - x * x * x * 0.5"}] * 14, "round(x, 9) AS y", _LINE))
def approx_sign(spark, sf):
    return _line(spark, sf).select("id", F.round(approx.cubic_sign(F.col("u") - F.col("v"), 14), 9).alias("y"))


@query(_unrolled({"x": "v - u"}, [{"x": "x * 1.5 - x * x * x * 0.5"}] * 12, "round(u + (v - u) * (1 + x) / 2, 9) AS y", _LINE))
def approx_max_by_sign(spark, sf):
    return _line(spark, sf).select("id", F.round(approx.maximum_by_sign(F.col("u"), F.col("v")), 9).alias("y"))


@query(_unrolled({"x": "u * 10"}, [{"x": "x * x * (3 - 2 * x)"}] * 2, "round(x, 9) AS y", _LINE))
def bit_cleaning(spark, sf):
    return _line(spark, sf).select("id", F.round(approx.clean_bit(F.col("u") * 10, 2), 9).alias("y"))


_CHEB = [1.2, -0.35, 0.15, -0.05]


@query(f"WITH l AS (SELECT id, (u - v) / 0.5 AS x FROM ({_LINE})) SELECT id, round({' + '.join(f'({c}) * cos({2 * k + 1} * acos(x))' for k, c in enumerate(_CHEB))}, 9) AS y FROM l")
def cheb_eval(spark, sf):
    return _line(spark, sf).select("id", F.round(approx.odd_chebyshev(F.col("u") - F.col("v"), _CHEB, 0.5), 9).alias("y"))


@query(f"SELECT id, round((u - v) * (1.5 + (u - v) * (u - v) * (-0.7 + (u - v) * (u - v) * 0.2)), 9) AS y FROM ({_LINE})")
def odd_polynomial(spark, sf):
    return _line(spark, sf).select("id", F.round(approx.odd_polynomial(F.col("u") - F.col("v"), [1.5, -0.7, 0.2]), 9).alias("y"))


_MAX3 = "SELECT o_orderkey AS id, 0.5 + (o_orderkey % 7) / 10.0 AS p, 0.5 + (o_orderkey % 5) / 10.0 AS q, 0.5 + (o_orderkey % 3) / 10.0 AS r FROM orders"
_ARG = [{"t": "p + q + r"}, {"p": "p / t", "q": "q / t", "r": "r / t"}]
for _ in range(4):
    _ARG += [{"p": "p ** 2", "q": "q ** 2", "r": "r ** 2"}, {"t": "p + q + r"}, {"p": "p / t", "q": "q / t", "r": "r / t"}]


@query(_unrolled({"t": "0.0::DOUBLE"}, _ARG, "round(p, 9) AS p, round(q, 9) AS q, round(r, 9) AS r", _MAX3.replace("10.0", "10.0::DOUBLE")))
def argmax_onehot(spark, sf):
    values = F.array(*[F.lit(0.5) + (F.col("o_orderkey") % m) / F.lit(10.0) for m in (7, 5, 3)])
    out = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), approx.argmax_one_hot(values).alias("v"))
    return out.select("id", *[F.round(F.col("v")[k], 9).alias(n) for k, n in enumerate("pqr")])


_SIGN = _unrolled({"x": "u - v", "e": "abs(u - v)"}, [{"x": "x * 1.5 - x * x * x * 0.5"}] * 14, "e, abs(x - sign(u - v)) AS err", _LINE)


@query(f"WITH z AS ({_SIGN}) SELECT CASE WHEN e < 0.01 THEN 0 WHEN e < 0.03 THEN 1 WHEN e < 0.05 THEN 2 ELSE 3 END AS bin, count(*) AS n, round(avg(err), 9) AS mean, round(stddev_pop(err), 9) AS std, round(quantile_cont(err, 0.5), 9) AS median, round(quantile_cont(err, 0.95), 9) AS p95, round(quantile_cont(err, 0.99), 9) AS p99, round(max(err), 9) AS max FROM z GROUP BY 1")
def error_stats_binned(spark, sf):
    diff = F.col("u") - F.col("v")
    stats = metrics.error_stats(_line(spark, sf), approx.cubic_sign(diff, 14) - F.signum(diff), metrics.magnitude_bin(diff, [0.0, 0.01, 0.03, 0.05, 1.0]))
    return stats.select("bin", "n", *[F.round(c, 9).alias(c) for c in ("mean", "std", "median", "p95", "p99", "max")])


# --- propagation on the ring of slots, grids, splits ---------------------------------


CORE_SLOTS = "o AS (SELECT c.id, slot, slot + 1 AS label FROM c JOIN slots USING (id)), total AS (SELECT count(*) AS n FROM p), g AS (SELECT a.slot AS i, z.slot AS j, (z.slot - a.slot + total.n) % total.n AS k, total.n FROM s JOIN o a ON a.id = s.src JOIN o z ON z.id = s.dst, total)"


def _ring(spark, sf):
    p = emb2(spark, sf)
    e = neighbours.join_grid(p, EPS, 2)
    cores = density.core_points(density.neighbour_counts(p, e), MIN_PTS)
    slots = points.with_slot(p.select("id"), "id")
    start = slots.join(cores.where("is_core").select("id"), "id").select("id", "slot", (F.col("slot") + 1).alias("label"))
    n = p.count()
    return start, neighbours.strides(density.core_edges(e, cores), slots, n), n


@query(f"{HEAD}, {CORE_SLOTS}, f AS (SELECT o.slot, greatest(o.label, coalesce(max(q.label), o.label)) AS label FROM o LEFT JOIN g ON g.i = o.slot AND g.k BETWEEN 1 AND g.n // 2 LEFT JOIN o q ON q.slot = g.j GROUP BY o.slot, o.label) SELECT f.slot, greatest(f.label, coalesce(max(q.label), f.label)) AS label FROM f LEFT JOIN g ON g.j = f.slot AND 2 * g.k < g.n AND g.k >= 1 LEFT JOIN f q ON q.slot = g.i GROUP BY f.slot, f.label")
def propagation_passes(spark, sf):
    """One forward and one backward pass, chained."""
    start, near, n = _ring(spark, sf)
    return propagate_passes(start, near, n)


@query(f"{HEAD} SELECT k.id, keys.key AS label FROM k JOIN keys USING (component)")
def max_propagation_converged(spark, sf):
    p = emb2(spark, sf)
    e = neighbours.join_grid(p, EPS, 2)
    cores = density.core_points(density.neighbour_counts(p, e), MIN_PTS)
    start = points.with_slot(p.select("id"), "id").join(cores.where("is_core").select("id"), "id").select("id", (F.col("slot") + 1).alias("label"))
    return propagate_largest(start, density.core_edges(e, cores))[0]


@query(f"WITH {P} SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id AND {D2} <= {EPS * EPS + 1e-4!r}")
def eps_join_mirror(spark, sf):
    """The neighbour predicate with the mirror variant's margin."""
    return neighbours.join_grid(emb2(spark, sf), EPS, 2, margin=neighbours.squared_margin("mirror", 2)).select("src", "dst")


@query("WITH p AS (SELECT s_suppkey AS id, s_nationkey::DOUBLE AS x, s_acctbal::DOUBLE AS y FROM supplier) SELECT a.id AS src, b.id AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM p a JOIN p b ON a.id < b.id")
def distance_matrix(spark, sf):
    p = points.point_table(_read(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal")
    return neighbours.join_cross(p, float("inf"), 2).select("src", "dst", F.round(F.sqrt("d2"), 6).alias("distance"))


GRID5 = "c AS (SELECT a * 5 + b AS id, 0.1 + 0.2 * a AS x, 0.1 + 0.2 * b AS y FROM range(5) q(a), range(5) r(b)), d AS (SELECT u.id AS cell_id, v.id AS other_id FROM c u, c v WHERE greatest(abs(u.x - v.x), abs(u.y - v.y)) <= 0.25 + 0.1)"


def _adjacency5(spark):
    return grid.cell_adjacency(grid.centres(spark, [0.0, 0.0], [1.0, 1.0], 0.2), 0.25, 0.1)


@query(f"WITH {GRID5} SELECT * FROM d")
def grid_adjacency(spark, sf):
    return _adjacency5(spark)


@query(f"WITH {GRID5} SELECT DISTINCT other_id - cell_id AS delta FROM d")
def grid_deltas(spark, sf):
    return grid.cell_deltas(_adjacency5(spark))


@query(f"WITH {GRID5} SELECT i * 25 + c.id AS slot, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.cell_id = c.id AND d.other_id - d.cell_id = 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM c, range(3) q(i)")
def grid_delta_mask(spark, sf):
    return grid.delta_mask(_adjacency5(spark), 6, 25, 3)


@query("SELECT a * 4 + b AS cell_id, (10.0::DOUBLE + 5.0::DOUBLE * (a + 0.5::DOUBLE) - 5.0::DOUBLE) / 20.0::DOUBLE AS x, (10.0::DOUBLE + 5.0::DOUBLE * (b + 0.5::DOUBLE) - 5.0::DOUBLE) / 20.0::DOUBLE AS y FROM range(2) q(a), range(4) r(b)")
def grid_centres_normalized(spark, sf):
    c = grid.normalized_centres(grid.centres(spark, [10.0, 10.0], [20.0, 30.0], 5.0), 5.0, 20.0)
    return c.select("cell_id", F.col("centre")[0].alias("x"), F.col("centre")[1].alias("y"))


@query(f"WITH {OWNED} SELECT id, owner_id, cell_id * 16 + owner_id * 2 + rn AS slot FROM b")
def global_slots(spark, sf):
    rows, _ = _owned(spark, sf)
    return grid.global_slots(rows, 16, {k: 2 * k for k in range(8)}).select("id", "owner_id", "slot")


@query(f"WITH {P}, n AS (SELECT count(*) AS n FROM p), q AS (SELECT id, row_number() OVER (ORDER BY md5('0-' || id), id) - 1 AS s, n // 3 AS size, n % 3 AS more FROM p, n), w AS (SELECT *, CASE WHEN s < more * (size + 1) THEN s // (size + 1) ELSE (s - more * (size + 1)) // size + more END AS owner_id FROM q) SELECT id, owner_id::INT AS owner_id, s - owner_id * size - least(owner_id, more) AS owner_local_idx FROM w")
def owner_split_random(spark, sf):
    return ordering.split_random(emb2(spark, sf), 3).select("id", "owner_id", "owner_local_idx")


@query(f"WITH {P}, q AS (SELECT id, row_number() OVER (ORDER BY x, id) - 1 AS slot FROM p) SELECT id, slot * 2 AS value FROM q")
def restore_order(spark, sf):
    """Values by slot, back to ids."""
    slotted = points.with_slot(emb2(spark, sf).withColumn("z", F.col("coords")[0]), "z", "id")
    return ordering.restore(slotted, slotted.select("slot", (F.col("slot") * 2).alias("value")))


@query("SELECT event_id AS id, value FROM (SELECT event_id, value FROM events ORDER BY abs(value), event_id LIMIT 100)")
def order_by_magnitude(spark, sf):
    rows = _read(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    return ordering.by_magnitude(rows.orderBy("id"), "value").orderBy(F.abs("value"), "id").limit(100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
