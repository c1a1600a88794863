"""Places that many routes pass, and places that several objects share."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from trailspark.operators import geometry, measure, spatial, stitch
from trailspark.queries import QUERIES, SQL
from trailspark.sources import fixture

POINT = "area_id int, route_id long, lat double, lon double"
FEATURE = "area_id int, feature_id long, kind string, name string, lat double, lon double"


def hav(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


@pytest.fixture()
def asked(monkeypatch):
    """The numbers of points and features of each radius join."""
    seen, near = [], spatial.near

    def count(points, features, radius_m):
        seen.append((points.count(), features.count()))
        return near(points, features, radius_m)

    for module in (spatial, measure):
        monkeypatch.setattr(module, "near", count)
    return seen


@pytest.mark.parametrize("access", [measure.car_access, measure.lift_access, measure.transit_access])
def test_a_place_is_measured_once(spark, asked, access):
    """500 routes by way of two places, 300 objects at three: two points meet three objects."""
    points = spark.createDataFrame([(0, r, 50.0 + k * 0.001, 15.0) for r in range(500) for k in (0, 1)], POINT)
    features = spark.createDataFrame([(0, n, "halt", None, 50.0005 + 0.0005 * (n % 3), 15.001) for n in range(300)], FEATURE)
    rows = access(points, features).collect()
    assert asked == [(2, 3)] and len(rows) == 500
    nearest = min(hav(50.0 + k * 0.001, 15.0, 50.0005 + 0.0005 * n, 15.001) for k in (0, 1) for n in range(3))
    assert all(abs(r[2] - nearest) < 1e-6 for r in rows)


def test_matched_features_are_all_there_once(spark, asked):
    points = [(0, r, 50.0 + k * 0.001 * (r % 3), 15.0) for r in range(60) for k in (0, 1, 2)]
    features = [(0, n, "parking", None, 50.0 + 0.0007 * (n % 5), 15.001) for n in range(40)]
    got = [(r.route_id, r.feature_id) for r in measure.matched_access(spark.createDataFrame(points, POINT).distinct(), spark.createDataFrame(features, FEATURE), 150.0).collect()]
    want = {(p[1], f[1]) for p in points for f in features if hav(p[2], p[3], f[4], f[5]) <= 150.0}
    assert len(got) == len(set(got)) and set(got) == want and asked[0][0] < 10


def test_the_start_is_the_end_nearest_what_any_point_reaches(spark):
    """An object that only the line's head reaches counts for an open end that doesn't reach it."""
    shape = spark.createDataFrame([(0, 1, (50.0, 15.0), (50.002, 15.0))], "area_id int, route_id long, head struct<lat double, lon double>, tail struct<lat double, lon double>")
    ends = spark.createDataFrame([(0, 1, 50.002, 15.0), (0, 1, 50.004, 15.0)], POINT)
    features = spark.createDataFrame([(0, 7, "parking", None, 49.9995, 15.0)], FEATURE)
    (row,) = measure.route_starts(shape, ends, [(features, 100.0)]).collect()
    assert (row.start.lat, row.start.lon) == (50.002, 15.0)


def compared(spark, folder, name):
    c = duckdb.connect()
    for t in os.listdir(folder):
        c.execute(f"create view {t[:-8]} as select * from '{folder}/{t}/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = ", ".join(sorted(df.columns))
    return sorted(map(tuple, df.selectExpr(*columns.split(", ")).collect())), sorted(c.sql(f"select {columns} from ({SQL[name]})").fetchall())


@pytest.fixture()
def shared(spark, tmp_path):
    """The smallest tables with a second supplier and a second part at the places of the first hundred, in the largest keys' order."""
    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("no test tables here")
    for t in ("lineitem", "orders", "customer", "nation"):
        fixture.table(spark, source, t).write.parquet(f"{tmp_path}/{t}.parquet")
    for t, key in (("supplier", "s_suppkey"), ("part", "p_partkey")):
        rows = fixture.table(spark, source, t)
        both = rows.unionByName(rows.where(F.col(key) < 100).withColumn(key, (F.col(key) + 3600).cast(dict(rows.dtypes)[key])))
        both.orderBy(F.desc(key)).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    return tmp_path


@pytest.mark.parametrize("name", ["stored_places", "route_pois"])
def test_shared_places_give_what_sql_gives(spark, shared, name):
    got, want = compared(spark, shared, name)
    assert got == want and got


def test_a_route_has_all_objects_of_a_place(spark, shared):
    """Three objects of two kinds at one place and one elsewhere that has the id of one of them; the second parts of shared places are in the result of the query."""
    v = spark.createDataFrame([(0, r, 0, k, 50.0, 15.0 + 0.01 * k) for r in (1, 2) for k in (0, 1)], "area_id int, route_id long, way_idx int, vtx_idx int, lat double, lon double")
    f = [(0, 7, "ruins", "a", 50.001, 15.005), (0, 8, "ruins", "b", 50.001, 15.005), (0, 9, "peak", "c", 50.001, 15.005), (0, 8, "ruins", "b", 50.0005, 15.002)]
    got = measure.route_pois(geometry.segments(v), spark.createDataFrame(f, FEATURE), ["ruins", "peak"], 250.0).collect()
    assert sorted((r.route_id, r.kind, r.feature_id, r.f_name, round(r.d)) for r in got) == [(r, *x) for r in (1, 2) for x in [("peak", 9, "c", 111), ("ruins", 7, "a", 111), ("ruins", 8, "b", 56)]]
    got, want = compared(spark, shared, "route_pois")
    assert got == want and any(r[2] >= 3600 for r in got)  # area_id, d, feature_id


def test_a_line_reads_its_vertices_once(spark):
    """Once stitched, a line reads only what was written of the vertices."""
    v = spark.createDataFrame([(0, r, w, k, 50.0 + 0.001 * (w + k), 15.0) for r in range(4) for w in range(3) for k in (0, 1)], "area_id int, route_id long, way_idx int, vtx_idx int, lat double, lon double")
    line = stitch.stitch(v)
    assert "ExistingRDD" not in line._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.route_id, r.pos, round(r.lat, 6)) for r in line.collect()) == [(r, p, round(50.0 + 0.001 * p, 6)) for r in range(4) for p in range(4)]
