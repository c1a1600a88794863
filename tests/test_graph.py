import heapq
import random

import pytest
from pyspark.sql import functions as F

from test_geometry import vertices
from trailspark.functions.registry import POI_KINDS
from trailspark.operators import geometry, graph, inventory, loops
from trailspark.params import Criteria, Params
from trailspark.plans import modes, search


def network(spark, lines):
    rows = [(0, 1, w, k, float(y), float(x)) for w, points in enumerate(lines) for k, (y, x) in enumerate(points)]
    v = vertices(spark, rows)
    ways = spark.createDataFrame([(0, 1, w) for w in range(len(lines))], "area_id int, route_id long, way_idx int").withColumn("tags", F.create_map().cast("map<string,string>"))
    return modes.network(v, ways)


S, T, M, N, B = (50, 15), (50, 15.03), (50, 15.015), (50.01, 15.015), (49.99, 15.015)


def test_three_parallel_trails_contract_to_three_segments(spark):
    edges = network(spark, [[S, M, T], [S, N, T], [S, B, T]])
    segments = graph.segments_of(graph.contract(edges)).collect()
    assert len(segments) == 3 and all(s.n_edges == 2 and s.a != s.b for s in segments)


def test_a_ring_is_one_self_loop_and_a_stem_is_no_loop(spark):
    ring = network(spark, [[(50, 15), (50, 15.01), (50.01, 15.01), (50.01, 15), (50, 15)]])
    segments = graph.segments_of(graph.contract(ring)).collect()
    assert [(s.n_edges, s.a == s.b) for s in segments] == [(4, True)]
    stem = network(spark, [[S, M, T], [M, N]])
    assert graph.two_core(graph.segments_of(graph.contract(stem))).count() == 0


def test_loops_of_parallel_trails(spark):
    edges = network(spark, [[S, M, T], [S, N, T], [S, B, T]])
    net = modes.contracted(edges)
    assert loops.search(net.segments, 0.0, 1e5, 12, 1000).found.count() == 3
    out = modes.compose_loops(net, 0.0, 1e5).collect()
    assert out and all(0.05 <= r.compactness <= 1 for r in out)


def test_shaped_loops_are_all_there_however_many_pairs_an_area_has(spark):
    """1,010 trails between two places, ten of which lead far round: their 45 loops are found among 509,545 pairs."""
    edges = network(spark, [[S, (50 + 1e-5 * k, 15.015), T] for k in range(-500, 500)] + [[S, (50.05 + 1e-4 * k, 15.015), T] for k in range(10)])
    sought = modes.shaped_loops(modes.contracted(edges), 20_000.0, 1e5, Params())
    assert sought.loops.count() == 45 and [r.capped for r in sought.areas.collect()] == [False]


def test_distances_equal_dijkstra(spark):
    rng = random.Random(4)
    nodes = [(50 + 0.002 * i, 15 + 0.003 * j) for i in range(5) for j in range(5)]
    lines = [[nodes[a], nodes[b]] for a in range(25) for b in (a + 1, a + 5) if b < 25 and (b != a + 1 or b % 5) and rng.random() < 0.8]
    edges = network(spark, lines)
    rows = edges.collect()
    start = rows[0].a
    got = {r.node: r.m for r in graph.distances(spark.createDataFrame([(0, 7, start, 0.0)], "area_id int, request_id long, node struct<y long, x long>, m double"), edges, 1e9).collect()}
    near = {}
    for e in rows:
        near.setdefault(e.a, []).append((e.b, e.length_m))
        near.setdefault(e.b, []).append((e.a, e.length_m))
    best, queue = {}, [(0.0, start)]
    while queue:
        m, n = heapq.heappop(queue)
        if n not in best:
            best[n] = m
            for o, w in near[n]:
                heapq.heappush(queue, (m + w, o))
    assert got.keys() == best.keys() and all(abs(got[n] - best[n]) < 1e-6 for n in best)


def test_collapse_equals_one_by_one(spark):
    rng = random.Random(8)
    lengths = {k: rng.uniform(1, 5) for k in range(12)}
    items = [(0, f"i{k:02}", sorted(rng.sample(range(12), rng.randint(1, 5)))) for k in range(30)]
    rows = [(a, i, s, sum(lengths[x] for x in s)) for a, i, s in items]
    kept = []
    for a, i, s, m in sorted(rows, key=lambda r: (round(r[3], 3), r[1])):
        if not any(sum(lengths[x] for x in set(s) & set(t)) / m > 0.6 for _, t in kept):
            kept.append((i, s))
    df = spark.createDataFrame(rows, "area_id int, id string, segs array<long>, length_m double")
    segs = spark.createDataFrame([(0, k, v) for k, v in lengths.items()], "area_id int, seg long, length_m double")
    assert {r.id for r in graph.collapse(df, segs, 0.6).collect()} == {i for i, _ in kept}


def test_unknown_kinds_raise():
    with pytest.raises(ValueError):
        inventory.check_kinds(["ruins", "dragon"])
    assert inventory.check_kinds(["peak", "ruins", "peak"]) == ["peak", "ruins"] and len(POI_KINDS) == 28


def test_nearest_object_on_foot_and_what_became_of_the_others(spark):
    edges = network(spark, [[S, M, T], [M, N], [(50.02, 15.0), (50.02, 15.004)]])
    requests = spark.createDataFrame([(0, 1, 50.0, 15.001)], "area_id int, point_id long, lat double, lon double")
    places = [(1, "ruins", 50.0, 15.02), (2, "ruins", 50.009, 15.015), (3, "peak", 50.0, 15.002), (4, "ruins", 50.02, 15.002), (5, "ruins", 50.0, 15.001), (6, "ruins", 49.977, 15.0)]
    pois = spark.createDataFrame([(0, i, k, "n", y, x) for i, k, y, x in places], "area_id int, feature_id long, kind string, name string, lat double, lon double")
    params = Params(routes_max_snap_km=1.0)
    rows = {r.feature_id: r for r in modes.routes_to_poi(edges, requests, pois, ["ruins"], 2, params).collect()}
    assert {k: r.state for k, r in rows.items()} == {1: "ok", 2: "ok", 4: "unreachable", 5: "at_start", 6: "off_network"}
    assert rows[1].place == 1 and rows[2].place == 2 and rows[1].shown and rows[1].certain and rows[1].m < rows[2].m


def all_paths(edges, src, dst):
    """Brute force: every path without a repeated node, as nodes and length."""
    near = {}
    for e in edges:
        near.setdefault(e.a, []).append((e.b, e.length_m))
        near.setdefault(e.b, []).append((e.a, e.length_m))

    def grow(path, m):
        if path[-1] == dst:
            yield m, path
            return
        for o, w in near[path[-1]]:
            if o not in path:
                yield from grow([*path, o], m + w)

    return sorted(grow([src], 0.0), key=lambda x: round(x[0], 3))


def test_k_shortest_distinct_ways_equal_brute_force(spark):
    rng = random.Random(6)
    nodes = [(50 + 0.002 * i + 0.0003 * rng.random(), 15 + 0.003 * j + 0.0003 * rng.random()) for i in range(3) for j in range(4)]
    lines = [[nodes[a], nodes[b]] for a in range(12) for b in (a + 1, a + 4) if b < 12 and (b != a + 1 or b % 4)]
    edges = network(spark, lines)
    (y1, x1), (y2, x2) = nodes[0], nodes[11]
    requests = spark.createDataFrame([(0, 5, y1, x1, y2, x2), (0, 6, y1, x1, 51.0, 15.0)], "area_id int, request_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    for overlap in (0.6, 1.0):
        s, found = modes.routes_between(edges, requests, Params(routes_overlap_frac=overlap), 3000.0)
        got = [round(r.m, 3) for r in found.orderBy("place").collect()]
        ends = {r.point_id: r.node for r in s.points.collect()}
        kept = []
        for m, path in all_paths(edges.collect(), ends[11], ends[12]):
            steps = {frozenset(x) for x in zip(path, path[1:])}
            length = {frozenset((e.a, e.b)): e.length_m for e in edges.collect()} if not kept else length
            if m <= 3000 and len(kept) < 3 and all(sum(length[x] for x in steps & k) <= overlap * m for _, k in kept):
                kept.append((round(m, 3), steps))
        assert got == [m for m, _ in kept] and len(got) == 3


def test_a_way_between_points_of_one_segment_is_cut_from_it(spark):
    edges = network(spark, [[S, M, T]])
    requests = spark.createDataFrame([(0, 1, 50.0, 15.004, 50.0, 15.024)], "area_id int, request_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    rows = modes.routes_between(edges, requests)[1].collect()
    assert len(rows) == 1 and abs(rows[0].m - 0.02 * 111_195 * 0.6428) < 3


def test_round_trips_take_new_ways_where_there_are_any(spark):
    lens = network(spark, [[S, M, T], [S, N, T], [(49.995, 15.0), S]])
    stops = lambda *p: spark.createDataFrame([(0, 1, k, float(y), float(x)) for k, (y, x) in enumerate(p)], "area_id int, request_id long, pos int, lat double, lon double")
    _, way, report = modes.route_via(lens, stops(S, T), loop=True)
    assert report.first().retraced == 0 and len(way.first().segs) == 2
    _, _, report = modes.route_via(lens, stops((49.995, 15.0), S), loop=True)
    assert abs(report.first().retraced - 1) < 1e-9
    _, way, report = modes.route_via(lens, stops((49.995, 15.0), T))
    assert report.first().retraced == 0 and way.count() == 1
    gap = network(spark, [[S, M], [(50.02, 15.0), (50.02, 15.01)]])
    assert modes.route_via(gap, stops(S, (50.02, 15.0)))[1].count() == 0
    assert modes.route_via(gap, stops(S, (52.0, 15.0)))[1].count() == 0


def test_loops_near_a_point_begin_at_it_and_measure_as_routes(spark):
    edges = network(spark, [[S, M, T], [S, N, T], [S, B, T]])
    net = modes.contracted(edges)
    requests = spark.createDataFrame([(0, 7, 50.0101, 15.015), (0, 8, 52.0, 15.0)], "area_id int, request_id long, lat double, lon double")
    rows = modes.loops_around(net, requests, 0.0, 1e5, Params(around_radius_m=100.0)).collect()
    assert rows and {r.request_id for r in rows} == {7} and all((r.anchor.lat, r.anchor.lon) == N for r in rows)
    none = lambda kind: spark.createDataFrame([], kind)
    feature = "area_id int, feature_id long, kind string, name string, lat double, lon double"
    areas = spark.createDataFrame([(0, True, True, True, ["ruins"])], "area_id int, transit_recorded boolean, way_tags_recorded boolean, ferrata_recorded boolean, poi_kinds array<string>")
    parking = spark.createDataFrame([(0, 1, "parking", "P", 50.0, 15.0)], feature)
    tables = search.Tables(areas, none("area_id int"), none("area_id int"), none("area_id int"), parking, none(feature), none(feature), none(feature))
    best = modes.compose_loops(net, 0.0, 1e5).withColumn("path_id", -F.col("place").cast("long"))
    level = lambda points: points.withColumn("elev", (F.col("lat") - 50) * 20_000)
    out = modes.measure_composed(tables, net, best, Criteria(car_access=True), level, Params(), True, "Composed loop").collect()
    lengths = {-r.place: r.length_m for r in modes.compose_loops(net, 0.0, 1e5).collect()}
    assert [(r.circular, abs(r.gain_m - r.loss_m) <= 25, r.gain_m > 0, abs(r.length_m - lengths[r.route_id]) < 1e-6) for r in out] == [(True,) * 4] * len(out) != []
    assert modes.measure_composed(tables, net, best, Criteria(transit_access=True), level, Params(), True, "x").count() == 0


def test_unknown_fails_every_filter_and_cabled_relations_stay_apart(spark):
    v = vertices(spark, [(a, r, 0, k, 50.0, 15.0 + 0.005 * k + a) for a in (0, 1) for r in (1, 2) for k in range(3)])
    kind = "area_id int, route_id long, seq long, name string, ref string, unnamed boolean, tags map<string,string>, is_ferrata boolean"
    routes = spark.createDataFrame([(a, r, r, "n", None, False, {"route": "via_ferrata"} if r == 2 else {}, r == 2) for a in (0, 1) for r in (1, 2)], kind)
    ways = spark.createDataFrame([(a, r, 0, {}) for a in (0, 1) for r in (1, 2)], "area_id int, route_id long, way_idx int, tags map<string,string>")
    areas = spark.createDataFrame([(0, True, True, True, None), (1, False, False, False, None)], "area_id int, transit_recorded boolean, way_tags_recorded boolean, ferrata_recorded boolean, poi_kinds array<string>")
    areas = areas.withColumns({k: F.lit(None).cast("double") for k in ("south", "west", "north", "east")})
    feature = "area_id int, feature_id long, kind string, name string, lat double, lon double"
    stop = spark.createDataFrame([(a, 1, "bus_stop", "B", 50.0, 15.0 + a) for a in (0, 1)], feature)
    none = spark.createDataFrame([], feature)
    tables = search.Tables(areas, routes, ways, v, none, none, stop, none)
    find = lambda **c: sorted((r.area_id, r.route_id) for r in search.search(tables, Criteria(**c), lambda p: p.withColumn("elev", F.lit(1.0))).collect())
    assert find() == [(0, 1), (1, 1)]
    assert find(transit_access=True) == [(0, 1)] and find(transit_access=False) == []
    assert find(ferrata=False) == [(0, 1)] and find(ferrata=True) == [(0, 2), (1, 2)]
    assert find(min_gain_m=0.0) == [(0, 1), (1, 1)]
    unknown = search.search(tables, Criteria(min_gain_m=0.0), lambda p: p.withColumn("elev", F.lit(None).cast("double")))
    assert unknown.count() == 0
    said = {r.area_id: r.notices for r in search.notices(tables, Criteria(ferrata=True, transit_access=True, poi_kinds=("ruins",))).collect()}
    assert said == {0: ["poi_unknown"], 1: ["ferrata_unreadable", "transit_unrecorded", "poi_unknown"]}


def test_requests_at_one_place_are_answered_alike(spark):
    """Findings F6, F13, F40: places are asked for once, whatever the number of requests and objects there."""
    asked = spark.createDataFrame([(1, k, 50.0, 15.0) for k in range(4)] + [(1, 9, 50.01, 15.0)], "area_id int, point_id long, lat double, lon double")
    at = [(50.001, 15.001)] * 20 + [(50.002, 15.0)] * 3 + [(50.0005, 15.0)]
    pois = spark.createDataFrame([(1, 100 - k, "ruins", None, *p) for k, p in enumerate(at)], "area_id int, feature_id long, kind string, name string, lat double, lon double")
    rows = graph.candidates(asked, pois, ["ruins"], 3000.0, 3).collect()
    by = {k: sorted((r.place, r.feature_id, r.d, r.bound) for r in rows if r.point_id == k) for k in (0, 1, 2, 3, 9)}
    assert by[0] == by[1] == by[2] == by[3]
    assert [f for _, f, _, _ in by[0]] == [77, *range(81, 92)] and by[0][0][3] == by[0][1][2]  # the 13th is at the common place, too
    assert [f for _, f, _, _ in by[9]] == [78, 79, 80, *range(81, 90)]
    places = [r for r in graph.candidates(asked, pois, ["ruins"], 3000.0, 3)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode(feature_id" in r]
    assert places  # objects are listed after the places have met


def test_distances_to_goals_stop_at_the_last(spark):
    """Findings F13: a request that has come to its goals goes no farther."""
    node = lambda k: {"y": 0, "x": k}
    edges = spark.createDataFrame([(1, k, node(k), node(k + 1), 10.0) for k in range(30)] + [(1, 99, node(0), node(5), 70.0)], "area_id int, edge long, a struct<y bigint, x bigint>, b struct<y bigint, x bigint>, length_m double")
    starts = spark.createDataFrame([(1, 1, node(0), 0.0), (1, 2, node(0), 0.0)], "area_id int, request_id long, node struct<y bigint, x bigint>, m double")
    goals = spark.createDataFrame([(1, 1, node(2)), (1, 1, node(5)), (1, 2, node(29))], "area_id int, request_id long, node struct<y bigint, x bigint>")
    m = {(r.request_id, r.node.x): r.m for r in graph.distances(starts, edges, 1000.0, goals=goals).collect()}
    assert m[1, 2] == 20.0 and m[1, 5] == 50.0 and m[2, 29] == 290.0
    assert (1, 20) not in m and (2, 20) in m


def test_edges_without_refs(spark):
    """Findings F36, F40-F43: edges that are as wide however many routes take them, and otherwise the same."""
    v = spark.createDataFrame([(1, r, w, k, 50.0 + 0.001 * (w + k), 15.0, {"surface": "s"} if w else {}) for r in (1, 2, 3) for w in (0, 1) for k in (0, 1)], "area_id int, route_id long, way_idx int, vtx_idx int, lat double, lon double, tags map<string,string>")
    ways = v.where("vtx_idx = 0").select("area_id", "route_id", "way_idx", "tags")
    whole = graph.micro_edges(geometry.segments(v), ways)
    bare = graph.micro_edges(geometry.segments(v, "tags"), None, refs=False)
    assert "refs" not in bare.columns
    assert sorted(map(str, bare.collect())) == sorted(map(str, whole.select(*bare.columns).collect()))
    assert "refs" not in graph.segments_of(graph.contract(bare)).columns
