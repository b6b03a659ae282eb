"""Queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from kinfold.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["node_stats", "graph_validate", "edge_flags", "move_gain", "best_move_constrained", "accept_moves", "shifted_weights", "louvain_rounds_constrained", "contract_flags", "modularity", "community_diameter", "pred_hybrid", "cluster_medoids", "distortion", "dataset_profile", "log_metrics", "community_maxima", "point_pivot", "pred_hybrid_kmeans", "louvain_rounds_4"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalogue.SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = lambda df: sorted(map(str, df[names].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
