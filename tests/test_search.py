"""What a search returns of each route."""

from __future__ import annotations

import os

import pytest

from trailspark import queries
from trailspark.params import Criteria
from trailspark.plans import search
from trailspark.sources import fixture

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_results_have_surface_and_start(spark):
    """Each row has the surface and the start that its route has when all routes are described."""
    found = search.search(fixture.search_tables(spark, DATA), Criteria(min_distance_km=0.5), queries.lookup(spark, DATA), queries.P).select("area_id", "route_id", "surface", "start").collect()
    every = {(r.area_id, r.route_id): r for r in queries.described(spark, DATA)[0].select("area_id", "route_id", "surface", "start").collect()}
    assert found and any(r.surface for r in found)
    for r in found:
        own = every[r.area_id, r.route_id]
        assert (r.surface and (r.surface.value, round(r.surface.fraction, 9))) == (own.surface and (own.surface.value, round(own.surface.fraction, 9))) and r.start is not None and r.start == own.start


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_gaps_are_filled_where_gains_are_folded(spark):
    """No window over the sample points fills gaps before the fold does."""
    plan = queries.criteria_gain(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "ignore nulls" not in plan.lower() and "batch#" not in plan and "lambda" in plan
