"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from trailspark.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
#: Those that stand for the others in quick runs; all are run by the driver.
CHOSEN = ["route_length", "resample_points", "termini", "circuit_rank", "surface_mix", "ferrata_summary", "poi_classify", "clip_to_box", "gain_loss", "smooth_series", "elevation_gain", "incremental_fill", "lift_access", "route_pois", "poi_inventory", "ferrata_inventory", "feature_split", "place_parse", "coverage_gaps", "area_catalog", "micro_edges", "trail_segments", "loops_in_band", "loops_anchored", "shortest_paths", "route_via", "search_by_transit", "summary_lines", "shapes_of_turned_ways", "two_core", "snap_points", "poi_candidates", "day_loops", "k_shortest_paths", "sub_polylines", "span_surface_runs", "gpx_files", "element_documents", "lift_ends"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
