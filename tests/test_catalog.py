"""Every registered query gives the rows of its SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__
from pointloom import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
TABLES = "region nation customer supplier part orders lineitem events embeddings"
SOME = ["propagation_passes", "owner_split_random", "multi_owner_clusters", "kmax_window_ties", "grid_neighbors", "grid_delta_mask", "eps_join_grid", "eps_join_band", "dbscan_labels_first", "dbscan_labels_max", "dbscan_labels_stride", "dbscan_labels_overwrite", "kmax_window", "gap_groups", "bucketize_blocks", "kmeans_lloyd_3", "ari_vs_label"]


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b))


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
