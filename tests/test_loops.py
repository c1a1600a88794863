"""Loops in halves against brute force; budgets end a search where they say."""

from __future__ import annotations

import random

import pytest

from trailspark.operators import loops

SEGMENTS = "area_id int, seg long, a struct<y bigint, x bigint>, b struct<y bigint, x bigint>, length_m double, n_edges long, refs array<long>"


def networks(rng: random.Random, areas: int = 4, nodes: int = 9, n: int = 17) -> list[tuple]:
    """Random segments, some parallel, some loops of their own; nodes have coordinates of either sign."""
    at = [(rng.randrange(-3, 3), rng.randrange(-3, 3)) for _ in range(nodes)]
    return [(area, k, *sorted((rng.choice(at), rng.choice(at))), round(rng.uniform(50, 300), 1), 1, []) for area in range(areas) for k in range(n)]


def brute(segments: list[tuple], low: float, high: float, most: int) -> dict[tuple, float]:
    """Length by area and set of segments of each simple cycle."""
    out = {}
    for area in {s[0] for s in segments}:
        around: dict = {}
        for _, k, a, b, m, *_ in (s for s in segments if s[0] == area):
            if a == b:
                if low <= m <= high:
                    out[area, frozenset([k])] = m
                continue
            around.setdefault(a, []).append((b, k, m))
            around.setdefault(b, []).append((a, k, m))

        def grow(start, at, nodes, segs, m):
            for o, k, w in around.get(at, []):  # noqa: B023
                if k in segs or len(segs) >= most:
                    continue
                if o == start and low <= m + w <= high:
                    out[area, frozenset([*segs, k])] = m + w  # noqa: B023
                elif o > start and o not in nodes and m + w <= high:
                    grow(start, o, [*nodes, o], [*segs, k], m + w)

        for start in around:
            grow(start, start, [start], [], 0.0)
    return out


def rows_of(found) -> list:
    return [(r.area_id, frozenset(r.segs), r) for r in found.collect()]


@pytest.mark.parametrize("low, high, segments", [(0.0, 1e5, 12), (300.0, 900.0, 12), (0.0, 1e5, 2), (0.0, 1e5, 3), (0.0, 1e5, 4), (5000.0, 9000.0, 12)])
def test_loops_equal_brute_force(spark, low, high, segments):
    rows = networks(random.Random(segments))
    sought = loops.search(spark.createDataFrame(rows, SEGMENTS), low, high, segments, 1_000_000)
    got = rows_of(sought.found)
    assert len(got) == len({x[:2] for x in got})
    assert {(a, s): round(r.length_m, 6) for a, s, r in got} == {k: round(m, 6) for k, m in brute(rows, low, high, segments + 1).items()}
    ends = {(x[0], x[1]): {x[2], x[3]} for x in rows}
    for area, segs, r in got:  # the walk goes round
        nodes = [tuple(n) for n in r.nodes]
        assert tuple(r.start) == nodes[0] == min(nodes) and len(set(nodes)) == len(nodes) == len(r.walk) and set(r.walk) == segs and r.segs == sorted(segs)
        assert all(ends[area, k] == {x, y} for k, x, y in zip(r.walk, nodes, [*nodes[1:], nodes[0]], strict=True))
    assert all(not r.capped for r in sought.areas.collect())


@pytest.mark.parametrize("budget", [0, 20, 60, 150])
def test_what_is_found_within_a_budget_is_whole_up_to_what_it_says(spark, budget):
    rows = networks(random.Random(9), areas=6) + [(9, 1, (0, 0), (0, 1), 10.0, 1, [])]
    sought = loops.search(spark.createDataFrame(rows, SEGMENTS), 0.0, 1e5, 12, budget)
    got, areas = rows_of(sought.found), {r.area_id: r for r in sought.areas.collect()}
    expected = brute(rows, 0.0, 1e5, 13)
    assert set(areas) == {*range(6), 9} and all(r.tried <= budget for r in areas.values())
    assert {x[:2] for x in got} == {(a, s) for a, s in expected if not areas[a].capped or len(s) <= areas[a].up_to}
    assert not areas[9].capped and (budget > 60 or any(r.capped for r in areas.values()))
    assert budget or {areas[a].up_to for a in range(6)} == {1}


def test_without_a_budget_an_area_of_very_many_pairs_is_searched_to_the_end(spark):
    """1,100 segments between two nodes make 604,450 pairs, of which those of two of the longest hundred are in the band."""
    rows = [(0, k, (0, 0), (0, 1), 100.0 if k < 1000 else 200.0, 1, []) for k in range(1100)]
    sought = loops.search(spark.createDataFrame(rows, SEGMENTS), 400.0, 500.0, 12)
    got = rows_of(sought.found)
    assert {x[1] for x in got} == {frozenset((a, b)) for a in range(1000, 1100) for b in range(1000, a)} and len(got) == 4950
    assert [(r.up_to, r.capped) for r in sought.areas.collect()] == [(13, False)]


def test_an_area_without_segments_has_no_row(spark):
    sought = loops.search(spark.createDataFrame([], SEGMENTS), 0.0, 1e5, 12, 100)
    assert sought.found.count() == 0 and sought.areas.count() == 0
