"""Elevation: raster and stored-sample lookups, fallback and fill, smoothing and noise-proof gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import coordinate_key
from .geometry import ROUTE
from .lineage import cut


def dem_lookup(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (with grid_row, grid_col) and elev of their raster cell: of the last tile that has one there. No cell, no elevation. The raster
    is written first, so that the planner knows its size: beside a small one the points stay dealt out by route, as what follows needs them."""
    flat = cut(cells.where(F.col("elev").isNotNull()).groupBy("grid_row", "grid_col").agg(F.max_by("elev", "tile_ord").alias("elev")))
    return points.join(flat, ["grid_row", "grid_col"], "left")


#: Degrees of the index by which points find tiles.
INDEX_DEG = 0.25


def tile_lookup(points: DataFrame, tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """points (lat, lon, ...) and elev from rasters of any extents and steps. tiles: tile_ord, south, west, north, east, lat_step, lon_step; cells:
    tile_ord, tile_row (0 at the north), tile_col (0 in the west), elev. A tile holds its north and west edges, not the others. Of
    the tiles that have an elevation at a place the last counts; null cells let those below through; elsewhere elev is null.

    A point gets the list of the tiles that touch its square of the index, last first, and within the bounds its cell in each follows from the
    tile's own origin and step, so rasters of different steps need not be brought to one grid. The cells are then asked tile after tile, as
    often as tiles touch one square at most: points are neither brought together by place nor gathered again, and stay where they are
    beside rasters that the planner broadcasts."""
    square = lambda x: F.floor(x / INDEX_DEG)
    known = tiles.withColumn("sy", F.explode(F.sequence(square(F.col("south")), square(F.col("north"))))).withColumn("sx", F.explode(F.sequence(square(F.col("west")), square(F.col("east")))))
    whole = F.struct(F.col("tile_ord").alias("ord"), "south", "west", "north", "east", "lat_step", "lon_step")
    lists = cut(known.groupBy("sy", "sx").agg(F.sort_array(F.collect_set(whole), asc=False).alias("near_tiles")))
    most = lists.agg(F.max(F.size("near_tiles"))).first()[0] or 0
    lat, lon = F.col("lat"), F.col("lon")
    inside = lambda t: (lat > t["south"]) & (lat <= t["north"]) & (lon >= t["west"]) & (lon < t["east"])
    cell = lambda t: F.struct(t["ord"].alias("ord"), F.floor((t["north"] - lat) / t["lat_step"]).alias("row"), F.floor((lon - t["west"]) / t["lon_step"]).alias("col"))
    rows = points.withColumn("sy", square(lat)).withColumn("sx", square(lon)).join(lists, ["sy", "sx"], "left")
    rows = rows.select(*points.columns, F.transform(F.filter("near_tiles", inside), cell).alias("asked_cells"))
    flat = cut(cells.where(F.col("elev").isNotNull()).groupBy("tile_ord", "tile_row", "tile_col").agg(F.max("elev").alias("elev")))
    for k in range(most):
        one, at = flat.toDF("c_ord", "c_row", "c_col", f"elev_{k}"), F.get("asked_cells", F.lit(k))
        rows = rows.join(one, (at["ord"] == F.col("c_ord")) & (at["row"] == F.col("c_row")) & (at["col"] == F.col("c_col")), "left").drop("c_ord", "c_row", "c_col")
    elev = F.coalesce(*(F.col(f"elev_{k}") for k in range(most)), F.lit(None).cast(cells.schema["elev"].dataType))
    return rows.select(*points.columns, elev.alias("elev"))


def keyed(points: DataFrame) -> DataFrame:
    """points (lat, lon) with lat_key and lon_key, their place to 7 decimals."""
    return points.withColumn("lat_key", coordinate_key(F.col("lat"))).withColumn("lon_key", coordinate_key(F.col("lon")))


def sample_lookup(points: DataFrame, samples: DataFrame) -> DataFrame:
    """points (lat, lon) and elev of the stored sample (lat_key, lon_key, elev) at the same place to 7 decimals. Samples of several
    areas (area_id) keep to their own."""
    keys = [k for k in ("area_id", "lat_key", "lon_key") if k in samples.columns]
    return keyed(points).join(samples.select(*keys, "elev"), keys, "left").drop("lat_key", "lon_key")


def first_complete(answers: DataFrame) -> DataFrame:
    """answers (source, route, idx, elev): of each route, the answer of the first source that knows all its points."""
    full = answers.groupBy(*ROUTE, "source").agg(F.count("*").alias("n"), F.count("elev").alias("known")).where("n = known")
    return answers.join(full.groupBy(*ROUTE).agg(F.min("source").alias("source")), [*ROUTE, "source"])


def missing_points(points: DataFrame, samples: DataFrame) -> DataFrame:
    """Distinct places (lat_key, lon_key) that the store lacks: all that has to be looked up."""
    keys = points.select(coordinate_key(F.col("lat")).alias("lat_key"), coordinate_key(F.col("lon")).alias("lon_key")).distinct()
    return keys.join(samples.select("lat_key", "lon_key"), ["lat_key", "lon_key"], "left_anti")


def added(samples: DataFrame, found: DataFrame) -> DataFrame:
    """The store with what was found; what it held stays, of several new values the least counts."""
    new = found.groupBy("lat_key", "lon_key").agg(F.min("elev").alias("elev")).join(samples, ["lat_key", "lon_key"], "left_anti")
    return samples.select("lat_key", "lon_key", "elev").unionByName(new.select("lat_key", "lon_key", "elev"))


#: Points of one request for elevations; gaps are filled within one.
BATCH = 100


def filled(series: DataFrame, keys: list[str], order: list[str], batch: int = BATCH) -> DataFrame:
    """Missing elevations become the last known one of their batch, before it the first known one."""
    rows = series.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn("batch", F.floor(F.col("nth") / batch))
    own = Window.partitionBy(*keys, "batch").orderBy("nth")
    before = F.last("elev", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("elev", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("elev", F.coalesce(before, after)).drop("nth", "batch")


def smoothed(series: DataFrame, keys: list[str], order: list[str], window: int) -> DataFrame:
    """Centred moving average that shrinks at the ends; series no longer than the window stay as they are."""
    if window <= 1:
        return series
    own, half = Window.partitionBy(*keys), window // 2
    mean = F.avg("elev").over(own.orderBy(*order).rowsBetween(-half, half))
    return series.withColumn("elev", F.when(F.count("*").over(own) > window, mean).otherwise(F.col("elev")))


def _filled(e: Column, batch: int) -> Column:
    """What filled does, of a route's elevations in one array."""
    def one(chunk: Column) -> Column:
        known = lambda part: F.filter(part, lambda x: x.isNotNull())
        return F.transform(chunk, lambda x, i: F.coalesce(x, F.try_element_at(known(F.slice(chunk, F.lit(1), i)), F.lit(-1)), F.get(known(chunk), F.lit(0))))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / batch).cast("int")), lambda b: one(F.slice(e, b * batch + 1, F.lit(batch))))
    return F.when(F.exists(e, lambda x: x.isNull()), F.flatten(chunks)).otherwise(e)


def _smoothed(e: Column, window: int) -> Column:
    """What smoothed does, likewise."""
    half = window // 2
    near = lambda i: F.filter(F.slice(e, F.greatest(i - half, F.lit(0)) + 1, F.least(i, F.lit(half)) + half + 1), lambda x: x.isNotNull())
    mean = lambda part: F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part))
    return F.when(F.size(e) > window, F.transform(e, lambda _, i: mean(near(i)))).otherwise(e)


def gain_loss(series: DataFrame, keys: list[str], order: list[str], threshold_m: float, window: int = 1, batch: int | None = None) -> DataFrame:
    """Sums of the moves of a reference level that follows only by threshold_m or more. Null where an elevation is missing. A series is gathered once:
    with batch it is filled first, with window smoothed then, as filled and smoothed do, which would each sort all rows."""
    state = F.struct(F.element_at("e", 1).alias("ref"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))
    diff = lambda s, x: x - s["ref"]
    step = lambda s, x: F.when(diff(s, x) >= threshold_m, F.struct(x.alias("ref"), (s["gain"] + diff(s, x)).alias("gain"), s["loss"].alias("loss"))).when(
        diff(s, x) <= -threshold_m, F.struct(x.alias("ref"), s["gain"].alias("gain"), (s["loss"] - diff(s, x)).alias("loss"))
    ).otherwise(s)
    lists = series.groupBy(*keys).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("elev").cast("double").alias("elev")))), lambda p: p["elev"]).alias("e"))
    lists = lists if batch is None else lists.withColumn("e", _filled(F.col("e"), batch))
    lists = lists if window <= 1 else lists.withColumn("e", _smoothed(F.col("e"), window))
    known = ~F.exists("e", lambda x: x.isNull())
    out = lists.withColumn("s", F.when(known, F.aggregate(F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0))), state, step)))
    return out.select(*keys, F.col("s.gain").alias("gain_m"), F.col("s.loss").alias("loss_m"), "n")
