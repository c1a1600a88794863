"""Geometry operators on vertices (area_id, route_id, way_idx, vtx_idx, lat, lon)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, weld_key

ROUTE = ["area_id", "route_id"]


def along() -> WindowSpec:
    return Window.partitionBy(*ROUTE).orderBy("way_idx", "vtx_idx")


def segments(vertices: DataFrame, *more: str) -> DataFrame:
    """Consecutive vertices of each way: area_id, route_id, way_idx, vtx_idx, lat1, lon1, lat2, lon2, seg_m. Dealt out by route, so
    that aggregates over routes need no other shuffle. more: columns of the first vertex that go along."""
    after = lambda c: F.lead(c).over(along())
    rows = vertices.select(*ROUTE, "way_idx", "vtx_idx", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), after("lat").alias("lat2"), after("lon").alias("lon2"), after("way_idx").alias("next"), *more)
    return rows.where(F.col("next") == F.col("way_idx")).drop("next").withColumn("seg_m", haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))


def route_lengths(segs: DataFrame) -> DataFrame:
    """length_m over all member ways of a route, whether or not they join up."""
    return segs.groupBy(*ROUTE).agg(F.sum("seg_m").alias("length_m"), F.countDistinct("way_idx").alias("n_ways"))


def welded(segs: DataFrame) -> DataFrame:
    """Segments with their ends' node keys u and v; those within one cell are no edges."""
    node = lambda k: F.struct(weld_key(F.col(f"lat{k}")).alias("y"), weld_key(F.col(f"lon{k}")).alias("x"))
    return segs.withColumn("u", node(1)).withColumn("v", node(2)).where("u <> v")


def termini(edges: DataFrame) -> DataFrame:
    """Nodes of degree one of each route's graph: area_id, route_id, node, lat, lon."""
    end = lambda c, k: F.struct(F.col(c).alias("node"), F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon"), F.col("way_idx").alias("way"), F.col("vtx_idx").alias("vtx"), F.lit(k).alias("k"))
    ends = edges.select(*ROUTE, F.explode(F.array(end("u", 1), end("v", 2))).alias("e")).select(*ROUTE, "e.*")
    first = F.min_by(F.struct("lat", "lon"), F.struct("way", "vtx", "k"))
    return ends.groupBy(*ROUTE, "node").agg(F.count("*").alias("degree"), first.alias("at")).where("degree = 1").select(*ROUTE, "node", "at.lat", "at.lon")


def line_of(segs: DataFrame) -> DataFrame:
    """Distance from the start of each route's ways, laid end to end: segments with from_m and to_m."""
    before = Window.partitionBy(*ROUTE).orderBy("way_idx", "vtx_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return segs.withColumn("to_m", F.sum("seg_m").over(before)).withColumn("from_m", F.coalesce(F.lag("to_m").over(along()), F.lit(0.0)))


def resample(segs: DataFrame, interval_m: float) -> DataFrame:
    """Evenly spaced points of each route's line: area_id, route_id, idx, lat, lon. The first point stays, the last is added if no
    sample falls on it; segments without length give none."""
    line = line_of(segs.where("seg_m > 0"))
    k = lambda m: F.floor(m / interval_m)
    last = Window.partitionBy(*ROUTE)
    rows = line.withColumn("end_m", F.max("to_m").over(last))
    numbers = F.when(k(F.col("to_m")) > k(F.col("from_m")), F.sequence(k(F.col("from_m")) + 1, k(F.col("to_m")))).otherwise(F.array().cast("array<bigint>"))
    numbers = F.when(F.col("from_m") == 0, F.concat(F.array(F.lit(0).cast("long")), numbers)).otherwise(numbers)
    is_last = (F.col("to_m") == F.col("end_m")) & (k(F.col("to_m")) * interval_m != F.col("to_m"))
    numbers = F.when(is_last, F.concat(numbers, F.array(F.lit(-1).cast("long")))).otherwise(numbers)
    rows = rows.withColumn("k", F.explode(numbers))
    t = F.when(F.col("k") < 0, 1.0).otherwise((F.col("k") * interval_m - F.col("from_m")) / F.col("seg_m"))
    at = lambda c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * t
    idx = F.when(F.col("k") < 0, k(F.col("to_m")) + 1).otherwise(F.col("k"))
    return rows.select(*ROUTE, idx.alias("idx"), F.when(F.col("k") < 0, F.col("lat2")).otherwise(at("lat")).alias("lat"), F.when(F.col("k") < 0, F.col("lon2")).otherwise(at("lon")).alias("lon"))


def clip(vertices: DataFrame, inside: Column) -> DataFrame:
    """Ways cut to runs of two or more vertices for which `inside` holds; each run is a way of its own, numbered anew."""
    per_way = Window.partitionBy(*ROUTE, "way_idx").orderBy("vtx_idx")
    rows = vertices.withColumn("inside", F.coalesce(inside, F.lit(False))).withColumn("run", F.sum((~F.col("inside")).cast("int")).over(per_way)).where("inside")
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy(*ROUTE, "way_idx", "run"))).where("size >= 2")
    per_route = Window.partitionBy(*ROUTE).orderBy("way_idx", "run")
    within = Window.partitionBy(*ROUTE, "way_idx", "run").orderBy("vtx_idx")
    return rows.select(*ROUTE, F.col("way_idx").alias("from_way"), (F.dense_rank().over(per_route) - 1).alias("way_idx"), (F.row_number().over(within) - 1).alias("vtx_idx"), "lat", "lon")


def compactness(points: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """4 pi A / P^2 of closed lines (keys, order, lat, lon) in a plane about their mean latitude; 0 for fewer than four points."""
    own = Window.partitionBy(*keys)
    along = own.orderBy(order)
    x, y = F.col("lon") * 111320.0 * F.cos(F.radians(F.avg("lat").over(own))), F.col("lat") * 111320.0
    rows = points.select(*keys, order, x.alias("x"), y.alias("y"))
    nx, ny = F.lead("x").over(along), F.lead("y").over(along)
    rows = rows.select(*keys, (F.col("x") * ny - nx * F.col("y")).alias("cross"), F.sqrt((nx - F.col("x")) ** 2 + (ny - F.col("y")) ** 2).alias("step"))
    shape = 4 * F.pi() * F.abs(F.sum("cross")) / 2 / F.sum("step") ** 2
    return rows.groupBy(*keys).agg(F.when((F.count("*") >= 4) & (F.sum("step") > 0), shape).otherwise(0.0).alias("compactness"))
