"""Rasters of different steps, stacked."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trailspark.operators import elevation

TILES = "tile_ord int, south double, west double, north double, east double, lat_step double, lon_step double"


@pytest.mark.parametrize("index", [0.25, 0.01, 90.0])
def test_stacked_rasters_equal_brute_force(spark, monkeypatch, index):
    """Overlaps, gaps, nodata, edges, repeated places, either sign."""
    monkeypatch.setattr(elevation, "INDEX_DEG", index)
    rng = random.Random(8)
    tiles, cells = [], {}
    for k, (north, west, y, x, rows, cols) in enumerate([(1.0, -1.0, 0.25, 0.5, 8, 4), (0.5, -0.5, 0.125, 0.125, 6, 10), (-0.25, 0.25, 0.0625, 0.25, 4, 2), (5.0, 5.0, 1.0, 1.0, 1, 1)]):
        tiles.append((k, north - rows * y, west, north, west + cols * x, y, x))
        cells |= {(k, r, c): None if rng.random() < 0.2 else float(rng.randrange(3000)) for r in range(rows) for c in range(cols)}
    points = [(i, rng.choice([rng.uniform(-1.5, 1.5), rng.randrange(-12, 12) / 8]), rng.choice([rng.uniform(-1.5, 1.5), rng.randrange(-12, 12) / 8])) for i in range(400)] + [(500, 9.0, 9.0), (501, None, 0.0)]

    def brute(lat, lon):
        out = None
        for k, south, west, north, east, y, x in tiles:
            if lat is not None and south < lat <= north and west <= lon < east:
                own = cells.get((k, int((north - lat) // y), int((lon - west) // x)))
                out = own if own is not None else out
        return out

    got = elevation.tile_lookup(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(tiles, TILES), spark.createDataFrame([(*k, v) for k, v in cells.items()], "tile_ord int, tile_row long, tile_col long, elev double"))
    assert {r.id: r.elev for r in got.collect()} == {i: brute(y, x) for i, y, x in points}
    assert got.columns == ["id", "lat", "lon", "elev"]


def test_series_are_filled_smoothed_and_folded_in_one_gathering(spark):
    rng = random.Random(5)
    rows = [(1, r, i, None if r and (rng.random() < 0.2 or (r == 7 and 100 <= i < 200)) else rng.uniform(300, 400)) for r in range(12) for i in range([1, 2, 3, 4, 99, 100, 101, 320, 205, 7, 60, 200][r])]
    series = spark.createDataFrame(rows, "area_id int, route_id long, idx long, elev double").repartition(3)
    keys = ["area_id", "route_id"]
    apart = elevation.gain_loss(elevation.smoothed(elevation.filled(series, keys, ["idx"]), keys, ["idx"], 3), keys, ["idx"], 10.0)
    once = elevation.gain_loss(series, keys, ["idx"], 10.0, 3, elevation.BATCH)
    assert sorted(map(str, once.collect())) == sorted(map(str, apart.collect())) and once.where("gain_m is null").count() >= 1
    assert once._jdf.queryExecution().executedPlan().toString().count("Window") == 0
    wide = elevation.gain_loss(series, keys, ["idx"], 10.0, 5)
    assert sorted(map(str, wide.collect())) == sorted(map(str, elevation.gain_loss(elevation.smoothed(series, keys, ["idx"], 5), keys, ["idx"], 10.0).collect()))


def test_points_stay_where_they_are_beside_small_rasters(spark, tmp_path):
    """Of 2000 points in one partition none goes through a shuffle, and cells that a tile has twice make no second row of a point."""
    spark.range(2000, numPartitions=1).select((50 + (F.col("id") + 0.5) / 1e5).alias("lat"), (15 + (F.col("id") + 0.5) / 1e5).alias("lon"), F.col("id")).write.parquet(str(tmp_path / "points"))
    tiles = spark.createDataFrame([(0, 49.0, 14.0, 51.0, 16.0, 0.5, 0.5), (3, 50.0, 15.0, 50.01, 15.01, 0.01, 0.01)], TILES)
    cells = spark.createDataFrame([(0, 1, 2, 7.0), (0, 1, 2, 7.0), (3, 0, 0, 9.0)], "tile_ord int, tile_row long, tile_col long, elev double")
    got = elevation.tile_lookup(spark.read.parquet(str(tmp_path / "points")), tiles, cells)
    values = dict(got.groupBy("elev").count().collect())
    assert values == {9.0: 1000, 7.0: 1000}, values
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
