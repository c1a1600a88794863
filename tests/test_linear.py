"""Parts of lines between two positions against brute force."""

from __future__ import annotations

import random

import pytest

from trailspark.operators import linear

LINE = "area_id int, route_id long, way_idx int, vtx_idx int, lat1 double, lon1 double, lat2 double, lon2 double, from_m double, to_m double"
SPANS = "area_id int, route_id long, span_id long, from_m double, to_m double"


def lines(rng: random.Random) -> list[tuple]:
    out = []
    for route in range(4):
        at, lat, lon = 0.0, 50.0, 15.0
        for k in range(rng.randint(1, 30)):
            m = rng.choice([0.0, 10.0, 250.0, 900.0, 4500.0])
            to = (lat + rng.uniform(-0.01, 0.01), lon + rng.uniform(-0.01, 0.01))
            out.append((0, route, k // 3, k % 3, lat, lon, *to, at, at + m))
            at, lat, lon = at + m, *to
    return out


def brute(line: list[tuple], span: tuple) -> list[tuple]:
    """Steps of a span: way, vtx, places and positions of both ends."""
    area, route, _, s, t = span
    out = []
    for _, _, way, vtx, y1, x1, y2, x2, a, b in sorted(x for x in line if x[:2] == (area, route)):
        lo, hi = max(a, min(s, t)), min(b, max(s, t))
        if b > a and lo < hi:
            at = lambda m: (y1 + (y2 - y1) * (m - a) / (b - a), x1 + (x2 - x1) * (m - a) / (b - a), m)  # noqa: B023, E731
            out.append((way, vtx, at(lo), at(hi)))
    return [(w, v, q, p) for w, v, p, q in reversed(out)] if s > t else out


@pytest.mark.parametrize("bucket", [2000.0, 7.0, 1e9])
def test_spans_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(linear, "BUCKET", bucket)
    rng = random.Random(2)
    rows = lines(rng)
    spans = [(0, rng.randrange(5), k, *(rng.choice([-50.0, 0.0, 10.0, 260.0, 3000.0, rng.uniform(0, 20000), 1e7]) for _ in range(2))) for k in range(60)]
    got: dict = {}
    steps = linear.spans_on(spark.createDataFrame(rows, LINE), spark.createDataFrame([*spans, *spans[:5]], SPANS)).persist()
    for r in steps.orderBy("pos").collect():
        got.setdefault(r.span_id, []).append((r.pos, r.way_idx, r.vtx_idx, *(round(x, 9) for x in (r.lat1, r.lon1, r.from_m, r.lat2, r.lon2, r.to_m))))
    expected = {s[2]: [(k, w, v, *(round(x, 9) for x in (*p, *q))) for k, (w, v, p, q) in enumerate(found)] for s in spans if (found := brute(rows, s))}
    assert got == expected
    places: dict = {}
    for r in linear.points(steps).orderBy("pos").collect():
        places.setdefault(r.span_id, []).append((round(r.lat, 9), round(r.lon, 9)))
    assert places == {k: [x[0][3:5], *(y[6:8] for y in x)] for k, x in expected.items()}


def test_tags_along_a_span(spark):
    rows = [(0, 1, w, 0, 50.0, 15.0 + w, 50.0, 16.0 + w, 100.0 * w, 100.0 * w + 100) for w in range(5)]
    ways = spark.createDataFrame([(0, 1, 0, {"surface": "gravel"}), (0, 1, 1, {"surface": "gravel"}), (0, 1, 2, {}), (0, 1, 4, {"surface": "gravel"})], "area_id int, route_id long, way_idx int, tags map<string,string>")
    steps = linear.spans_on(spark.createDataFrame(rows, LINE), spark.createDataFrame([(0, 1, 1, 450.0, 50.0)], SPANS))
    assert {(r.value, r.m) for r in linear.tag_metres(steps, ways, "surface").collect()} == {("gravel", 200.0), (None, 200.0)}
    assert [(r.run, r.value, r.from_m, r.to_m) for r in linear.tag_runs(steps, ways, "surface").orderBy("run").collect()] == [(0, "gravel", 0.0, 50.0), (1, None, 50.0, 250.0), (2, "gravel", 250.0, 400.0)]


def test_odd_spans_give_nothing(spark):
    """Null ends, no length, beside the line, an unknown route; empty tables."""
    rows = [(0, 1, 0, 0, 50.0, 15.0, 50.0, 16.0, 0.0, 100.0)]
    spans = [(0, 1, 1, None, 5.0), (0, 1, 2, 7.0, 7.0), (0, 1, 3, 100.0, 200.0), (0, 1, 4, -9.0, 0.0), (0, 2, 5, 0.0, 9.0), (None, 1, 6, 0.0, 9.0)]
    assert linear.spans_on(spark.createDataFrame(rows, LINE), spark.createDataFrame(spans, SPANS)).count() == 0
    assert linear.spans_on(spark.createDataFrame([], LINE), spark.createDataFrame(spans, SPANS)).count() == 0
    assert linear.spans_on(spark.createDataFrame(rows, LINE), spark.createDataFrame([], SPANS)).count() == 0
