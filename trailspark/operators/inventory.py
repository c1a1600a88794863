"""Inventories of objects and cabled lines, and names of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import ferrata_scale
from ..functions.geo import haversine_m
from ..functions.registry import PLACE_KEYS, POI_KINDS
from .geometry import ROUTE


def check_kinds(kinds: list[str] | tuple[str, ...]) -> list[str]:
    """The kinds once each, in the order given; unknown ones raise."""
    if unknown := [k for k in kinds if k not in POI_KINDS]:
        raise ValueError(f"unknown kinds: {', '.join(unknown)}; known are {', '.join(POI_KINDS)}")
    return list(dict.fromkeys(kinds))


def kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, POI_KINDS)), kind)


def select_pois(pois: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Objects of the kinds (none given: of all), once per place and kind, in registry order, then by name and place."""
    rows = pois.where(F.col("kind").isin(*check_kinds(kinds))) if kinds else pois
    rows = rows.groupBy("area_id", "kind", "lat", "lon").agg(F.min(F.struct("feature_id", "name")).alias("f"))
    return rows.select("area_id", "kind", "lat", "lon", "f.feature_id", "f.name").orderBy("area_id", kind_order(F.col("kind")), F.coalesce("name", F.lit("")), "lat", "lon")


def count_by_kind(pois: DataFrame) -> DataFrame:
    """Objects per area and kind, in registry order; kinds without objects have no row."""
    return select_pois(pois).groupBy("area_id", "kind").agg(F.count("*").alias("n")).withColumn("place", kind_order(F.col("kind"))).orderBy("area_id", "place")


def select_ferrata(routes: DataFrame, segs: DataFrame, ways: DataFrame) -> DataFrame:
    """Cabled relations (routes), then single cabled ways, longest first. A way of a relation is listed as well."""
    start = F.min_by(F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), F.struct("way_idx", "vtx_idx")).alias("start")
    of_routes = segs.groupBy(*ROUTE).agg(F.sum("seg_m").alias("length_m"), start).join(routes.select(*ROUTE, "name", ferrata_scale(F.col("tags")).alias("scale")), ROUTE)
    of_ways = segs.groupBy(*ROUTE, "way_idx").agg(F.sum("seg_m").alias("length_m"), start).join(ways.select(*ROUTE, "way_idx", F.col("tags")["name"].alias("name"), ferrata_scale(F.col("tags")).alias("scale")), [*ROUTE, "way_idx"])
    both = of_routes.select("area_id", F.lit("route").alias("source"), "route_id", F.lit(-1).alias("way_idx"), "name", "scale", "length_m", "start").unionByName(of_ways.select("area_id", F.lit("way").alias("source"), "route_id", "way_idx", "name", "scale", "length_m", "start"))
    return both.orderBy("area_id", "source", F.desc("length_m"), F.coalesce("name", F.lit("")), "route_id", "way_idx")


def parse_place(address: Column, name: Column) -> Column:
    """The first part of an address that names a place, else the name."""
    return F.coalesce(*(F.nullif(address[k], F.lit("")) for k in PLACE_KEYS), F.nullif(name, F.lit("")))


def stored_place(points: DataFrame, places: DataFrame, now: Column, ttl_days: float) -> DataFrame:
    """points (lat_key, lon_key) with the stored place of their cell, if it is not older than ttl_days; a stored blank says that there is none."""
    fresh = places.where(F.col("fetched_at") >= now - F.make_dt_interval(F.lit(int(ttl_days))))
    return points.join(fresh.select("lat_key", "lon_key", F.nullif("place", F.lit("")).alias("place")), ["lat_key", "lon_key"], "left")


def label_points(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """starts (route, start, circular, head, tail) with `far`: of a one-way route the end farthest from its start."""
    tips = starts.where("not circular").select(*ROUTE, F.explode(F.array("head", "tail")).alias("p")).select(*ROUTE, "p.lat", "p.lon").unionByName(ends.select(*ROUTE, "lat", "lon")).distinct()
    d = haversine_m(F.col("start.lat"), F.col("start.lon"), F.col("lat"), F.col("lon"))
    far = tips.join(starts.select(*ROUTE, "start", "circular"), ROUTE).where(~F.col("circular") & (F.struct("lat", "lon") != F.col("start"))).groupBy(*ROUTE).agg(F.min(F.struct((-F.round(d, 6)).alias("d"), "lat", "lon")).alias("f"))
    return starts.join(far, ROUTE, "left").select(starts["*"], F.when(F.col("f").isNotNull(), F.struct("f.lat", "f.lon")).alias("far"))


def compose_label(start: Column, end: Column, circular: Column) -> Column:
    """loop near A; A → B; near A. Null if no place is known."""
    s, e = (F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit("")) for x in (start, end))
    one = F.coalesce(s, e)
    return F.when(circular, F.concat(F.lit("loop near "), s)).when(s.isNotNull() & e.isNotNull() & (s != e), F.concat(s, F.lit(" → "), e)).otherwise(F.concat(F.lit("near "), one))
