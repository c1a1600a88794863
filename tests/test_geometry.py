import math
import random

import pytest
from pyspark.sql import functions as F

from trailspark.functions.geo import haversine_m
from trailspark.operators import components as components_module
from trailspark.operators import elevation, geometry, measure, spatial, stitch
from trailspark.operators.components import components


def line(points, area=0, route=1, way=0):
    return [(area, route, way, k, lat, lon) for k, (lat, lon) in enumerate(points)]


def vertices(spark, rows):
    return spark.createDataFrame(rows, "area_id int, route_id long, way_idx int, vtx_idx int, lat double, lon double")


def hav(a, b):
    (y1, x1), (y2, x2) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def test_resample_equals_a_walk_by_steps(spark):
    rng, rows, want = random.Random(3), [], {}
    for route in range(60):
        points = [(50 + rng.random() * 0.002, 15 + rng.random() * 0.002) for _ in range(rng.randint(2, 6))]
        if route % 5 == 0:
            points.insert(1, points[0])
        rows += line(points, route=route)
        out, at = [points[0]], 0.0
        for a, b in zip(points, points[1:]):
            m = hav(a, b)
            k = math.floor(at / 25) + 1
            while m and k * 25 <= at + m:
                t = (k * 25 - at) / m
                out.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
                k += 1
            at += m
        want[route] = out + ([points[-1]] if out[-1] != points[-1] else [])
    got = geometry.resample(geometry.segments(vertices(spark, rows)), 25.0).orderBy("route_id", "idx").collect()
    for route, points in want.items():
        own = [(r.lat, r.lon) for r in got if r.route_id == route]
        assert len(own) == len(points)
        assert all(abs(a - b) < 1e-9 for p, q in zip(own, points) for a, b in zip(p, q))


def test_radius_join_equals_brute_force_at_all_latitudes(spark):
    rng, points, features = random.Random(9), [], []
    for area, base in enumerate((0.0, 50.7, 68.0, -33.9)):
        features += [(area, area * 1000 + k, "x", None, base + rng.uniform(-0.05, 0.05), 15 + rng.uniform(-0.05, 0.05)) for k in range(300)]
        points += [(area, k, base + rng.uniform(-0.05, 0.05), 15 + rng.uniform(-0.05, 0.05)) for k in range(60)]
    p = spark.createDataFrame(points, "area_id int, p long, lat double, lon double")
    f = spark.createDataFrame(features, "area_id int, feature_id long, kind string, name string, lat double, lon double")
    for radius in (50.0, 250.0, 900.0):
        got = {(r.p, r.feature_id) for r in spatial.near(p, f, radius).collect()}
        want = {(k, i) for a, k, y, x in points for b, i, _, _, v, u in features if a == b and hav((y, x), (v, u)) <= radius}
        assert got == want


def test_objects_are_measured_to_the_line_not_to_its_vertices(spark):
    segs = geometry.segments(vertices(spark, line([(50.0, 15.0), (50.0, 15.1)])))
    f = spark.createDataFrame([(0, 1, "ruins", "R", 50.001, 15.05), (0, 2, "ruins", "far", 50.01, 15.05)], "area_id int, feature_id long, kind string, name string, lat double, lon double")
    hits = measure.route_pois(segs, f, ["ruins"], 250.0).collect()
    assert [(h.feature_id, round(h.d)) for h in hits] == [(1, 111)]


def test_small_graphs(spark):
    ring = [(50, 15), (50, 15.01), (50.01, 15.01), (50.01, 15), (50, 15)]
    rows = line(ring, route=1) + line([(50, 15), (50, 15.02)], route=2) + line([(50, 15.01), (50.01, 15.01)], route=2, way=1)
    segs = geometry.segments(vertices(spark, [(a, r, w, v, float(y), float(x)) for a, r, w, v, y, x in rows]))
    edges = geometry.welded(segs)
    assert {r.route_id: r["rank"] for r in measure.circuit_ranks(edges).collect()} == {1: 1, 2: 0}
    ends = geometry.termini(edges).groupBy("route_id").count().collect()
    assert {r.route_id: r["count"] for r in ends} == {2: 4}


@pytest.mark.parametrize("local", [20, 10_000])
def test_components_of_random_graphs(spark, monkeypatch, local):
    monkeypatch.setattr(components_module, "LOCAL", local)
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    par = list(range(200))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges for v in e}
    structs = spark.createDataFrame([((0, a), (0, b)) for a, b in edges], "a struct<g int, v long>, b struct<g int, v long>")
    assert {r.v.v: r.label.v for r in components(structs).collect()} == got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gain_ignores_noise_and_counts_climbs(spark):
    series = {1: [100, 105, 97, 103, 100], 2: [0, 50, 100], 3: [0, 60, 0], 4: [5.0]}
    rows = [(k, i, float(e)) for k, es in series.items() for i, e in enumerate(es)] + [(5, 0, 1.0), (5, 1, None)]
    df = spark.createDataFrame(rows, "k int, i int, elev double")
    got = {r.k: (r.gain_m, r.loss_m) for r in elevation.gain_loss(df, ["k"], ["i"], 10.0).collect()}
    assert got == {1: (0, 0), 2: (100, 0), 3: (60, 60), 4: (0, 0), 5: (None, None)}


def test_gaps_are_filled_forward_then_backward_within_a_batch(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 5.0), (1, 2, None), (1, 3, 7.0), (2, 0, None)], "k int, i int, elev double")
    got = [r.elev for r in elevation.filled(df, ["k"], ["i"]).orderBy("k", "i").collect()]
    assert got == [5.0, 5.0, 5.0, 7.0, None]


def test_raster_lookup_takes_the_last_tile_that_has_a_value(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 2.0), (0, 0, 1, 3.0), (1, 0, 1, None)], "tile_ord int, grid_row long, grid_col long, elev double")
    points = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 5, 5)], "p int, grid_row long, grid_col long")
    assert {r.p: r.elev for r in elevation.dem_lookup(points, cells).collect()} == {1: 2.0, 2: 3.0, 3: None}


def line_of_ways(ways, reach=30.0):
    """One line, way by way: the first other way that fits either end, tail before head; its places in walking order."""
    left = [w for w in ways if len(w) > 1]
    if not left:
        return []
    out = left.pop(0)
    while True:
        for w in left:
            near = lambda p, q: hav(p, q) <= reach
            if near(out[-1], w[0]):
                new = out + w[1:]
            elif near(out[-1], w[-1]):
                new = out + w[::-1][1:]
            elif near(out[0], w[-1]):
                new = w[:-1] + out
            elif near(out[0], w[0]):
                new = w[::-1][:-1] + out
            else:
                continue
            left.remove(w)
            out = new
            break
        else:
            return out


def test_ways_are_chained_turned_and_left_out(spark):
    """Random ways on few places, some within reach of others, some of one point or of several; equal to the line made way by way."""
    rng, rows, want = random.Random(12), [], {}
    for route in range(60):
        places = [(50 + 0.01 * k, 15.0) for k in range(6)]
        ways = []
        for _ in range(rng.randint(1, 9)):
            w = rng.sample(places, rng.choice([1, 2, 2, 2, 3]))
            ways.append([(y + rng.choice([0.0, 0.0001, 0.0004]), x) for y, x in w])
        rows += [r for k, w in enumerate(ways) for r in line(w, route=route, way=3 * k)]
        want[route] = line_of_ways(ways)
    got = {}
    for r in stitch.stitch(vertices(spark, rows)).orderBy("route_id", "pos").collect():
        got.setdefault(r.route_id, []).append((r.lat, r.lon))
        assert r.pos == len(got[r.route_id]) - 1
    assert got == {k: v for k, v in want.items() if v}


def test_lines_of_broken_routes_cover_their_ways(spark):
    """Ways of a path that passes no place twice give that path, however they are turned and ordered; gaps beyond the tolerance part it."""
    rng, rows, want = random.Random(2), [], {}
    for route in range(40):
        path = [(50 + 0.001 * k, 15 + 0.002 * rng.random()) for k in range(rng.randint(2, 9))]
        ways = [[x, y] for x, y in zip(path, path[1:])]
        if route % 4:
            rng.shuffle(ways)
            ways = [w[::-1] if rng.random() < 0.5 else w for w in ways]
        if route % 5 == 0:
            ways.append([(60.0, 15.0), (60.0, 15.1)])
        if route % 3 == 0:
            ways.insert(rng.randrange(len(ways) + 1), [path[0]])
        rows += [r for k, w in enumerate(ways) for r in line(w, route=route, way=k)]
        want[route] = path
        if route % 5 == 0 and len(ways[0]) > 1 and ways[0][0][0] == 60.0:
            want[route] = ways[0]
    out = stitch.stitch(vertices(spark, rows)).orderBy("route_id", "pos").collect()
    for route, path in want.items():
        got = [(r.lat, r.lon) for r in out if r.route_id == route]
        assert got in (path, path[::-1])
    assert stitch.stitch(vertices(spark, [])).count() == 0


def test_line_and_shape_of_turned_ways(spark):
    """Four ways of one line, two turned round and two swapped: the line is as long as before and its ends as far apart."""
    p = [(50.0, 15.0 + 0.003 * k) for k in range(5)]
    ways = [[p[0], p[1]], [p[3], p[2]], [p[2], p[1]], [p[3], p[4]]]
    v = vertices(spark, [r for k, w in enumerate(ways) for r in line(w, way=k)])
    routes = spark.createDataFrame([(0, 1)], "area_id int, route_id long").withColumn("tags", F.create_map().cast("map<string,string>"))
    own = measure.shapes(routes, v, stitch.stitch(v)).first()
    assert abs(own.gap_m - hav(p[0], p[4])) < 0.01 and abs(own.length_m - own.gap_m) < 0.01 and not own.circular


def test_distance_of_a_point_to_itself_is_zero(spark):
    assert spark.range(1).select(haversine_m(F.lit(50.0), F.lit(15.0), F.lit(50.0), F.lit(15.0)).alias("d")).first().d == 0


def test_lines_segments_and_lengths_come_from_rows_written_once(spark, monkeypatch):
    """Of routes in order nothing is written but the rows that lines and segments are read from; a null end of a way counts for no length."""
    way = lambda r, w, *p: [(1, r, w, k, 50.0, 15.0 + x / 1000) for k, x in enumerate(p)]
    v = vertices(spark, way(1, 0, 0, 1) + way(1, 1, 1, 2, 3) + way(2, 0, 0, 9) + way(3, 0, 5))
    written, cut = [], stitch.cut
    monkeypatch.setattr(stitch, "cut", lambda df: written.append(cut(df)) or written[-1])
    rows = stitch.walked(v, keep=lambda df: df.where("length_m < 500"))
    assert "length_m" not in rows.columns and {r.route_id for r in rows.collect()} == {1}
    rows = stitch.walked(v)
    whole = lambda df: sorted(map(tuple, df.collect()))
    assert whole(stitch.segments_of(rows)) == whole(geometry.segments(v)) and whole(stitch.lines(rows)) == whole(stitch.stitch(v))
    assert [df.count() for df in written[:3]] == [5, 7, 0]
