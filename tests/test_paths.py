"""The k shortest distinct ways against brute force, and on a lattice that has far more paths than can be listed."""

from __future__ import annotations

import heapq
import random

import pytest

from trailspark.operators import paths

SEGMENTS = "area_id int, seg long, a struct<y bigint, x bigint>, b struct<y bigint, x bigint>, length_m double"
PAIRS = "area_id int, request_id long, src struct<y bigint, x bigint>, dst struct<y bigint, x bigint>, cap_m double"


def lattice(n: int, rng: random.Random, even: bool = False) -> list[tuple]:
    at = [((y, x), (y + dy, x + dx)) for y in range(n) for x in range(n) for dy, dx in ((0, 1), (1, 0)) if y + dy < n and x + dx < n]
    return [(0, k, a, b, 100.0 if even else round(rng.uniform(80, 120), 1)) for k, (a, b) in enumerate(at)]


def in_order(segments: list[tuple], src: tuple, dst: tuple, cap: float, most: int) -> list[tuple]:
    """(m, nodes, segs) of the shortest simple paths, best first: the way left from each node leads the search."""
    around: dict = {}
    for _, k, a, b, m in segments:
        if a != b:
            around.setdefault(a, []).append((b, k, m))
            around.setdefault(b, []).append((a, k, m))
    left, heap = {}, [(0.0, dst)]
    while heap:
        m, n = heapq.heappop(heap)
        if n not in left:
            left[n] = m
            for o, _, w in around.get(n, []):
                heapq.heappush(heap, (m + w, o))
    found, heap = [], [(round(left[src], 3), [src], [], 0.0)] if src in left and src != dst else []
    while heap and len(found) < most:
        _, nodes, segs, m = heapq.heappop(heap)
        if nodes[-1] == dst:
            found.append((round(m, 3), nodes, segs))
            continue
        for o, k, w in around[nodes[-1]]:
            if o not in nodes and m + w + left[o] <= cap:
                heapq.heappush(heap, (round(m + w + left[o], 3), [*nodes, o], [*segs, k], m + w))
    return found


def distinct(found: list[tuple], k: int, overlap: float, lengths: dict) -> list[tuple]:
    kept: list[tuple] = []
    for m, nodes, segs in found:
        if len(kept) < k and not any(sum(lengths[s] for s in segs if s in q[2]) > overlap * sum(lengths[s] for s in segs) for q in kept):
            kept.append((m, nodes, segs))
    return kept


def got(spark, segments, pairs, k, overlap, most) -> dict[int, list[tuple]]:
    rows = paths.k_shortest(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(pairs, PAIRS), k, overlap, most).orderBy("request_id", "place").collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r.request_id, []).append((round(r.m, 3), [tuple(n) for n in r.nodes], r.segs))
    return out


@pytest.mark.parametrize("overlap", [0.3, 0.6, 1.0])
def test_ways_equal_brute_force(spark, overlap):
    """Random networks with dead ends, parallel segments, rings and unreachable nodes, several requests and areas at once."""
    rng = random.Random(int(overlap * 10))
    segments, pairs = [], []
    for area in range(3):
        n = 12
        for k in range(26):
            segments.append((area, k, (0, rng.randrange(n)), (0, rng.randrange(n)), round(rng.uniform(50, 300), 1)))
        for r in range(3):
            src, dst = ((0, rng.randrange(n + 1)) for _ in range(2))
            pairs.append((area, area * 10 + r, src, dst, rng.choice([400.0, 900.0, 5000.0])))
    expected = {}
    for area, r, src, dst, cap in pairs:
        own = [s for s in segments if s[0] == area]
        found = [x for x in in_order(own, src, dst, cap, 30) if x[0] <= cap]
        if ways := distinct(found, 3, overlap, {s[1]: s[4] for s in own}):
            expected[r] = ways
    assert expected and got(spark, segments, pairs, 3, overlap, 30) == expected


@pytest.mark.parametrize("even", [False, True])
def test_corner_to_corner_of_a_lattice(spark, even):
    """705,432 shortest paths on the even one; no round holds more than a few times the paths that are looked at."""
    rng = random.Random(5)
    segments = lattice(12, rng, even)
    lengths = {s[1]: s[4] for s in segments}
    cut, most = paths.cut, 0

    def counted(df):
        nonlocal most
        out = cut(df)
        if "nearest_m" in df.columns:
            most = max(most, out.count())
        return out

    paths.cut = counted
    try:
        ways = got(spark, segments, [(0, 1, (0, 0), (11, 11), 6000.0)], 3, 0.6, 200)
    finally:
        paths.cut = cut
    assert ways == {1: distinct(in_order(segments, (0, 0), (11, 11), 6000.0, 200), 3, 0.6, lengths)}
    assert most <= 600
