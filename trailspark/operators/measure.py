"""Measures of a route: shape, access, surface, cabled parts, objects passed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import ferrata_scale, is_rail, relation_is_ferrata, tag, way_is_ferrata
from ..functions.geo import closure_limit_m, haversine_m
from ..params import Params
from .components import labels_of
from .geometry import ROUTE, route_lengths, segments, welded
from .lineage import cut
from .spatial import PLACE, at_places, near, near_segments, once
from .stitch import line_ends


def circuit_ranks(edges: DataFrame) -> DataFrame:
    """E - V + C of each route's welded multigraph: area_id, route_id, rank. A route's edges are gathered to one row, on the partitioning
    that they have, and the graphs of a batch of rows are labelled together."""
    node = lambda c: F.xxhash64(*ROUTE, F.col(f"{c}.y"), F.col(f"{c}.x"))
    rows = edges.groupBy(*ROUTE).agg(F.collect_list(node("u")).alias("a"), F.collect_list(node("v")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_e = batch["a"].value_lengths().to_numpy()
            a, b = (batch[c].flatten().to_numpy() for c in ("a", "b"))
            nodes, label = labels_of(a, b)  # a node's number holds its route
            row = np.empty(len(nodes), np.int64)
            row[np.searchsorted(nodes, a)] = np.repeat(np.arange(len(n_e)), n_e)
            row[np.searchsorted(nodes, b)] = np.repeat(np.arange(len(n_e)), n_e)
            n_v, n_c = np.bincount(row, minlength=len(n_e)), np.bincount(row[label == nodes], minlength=len(n_e))
            yield pa.RecordBatch.from_pydict({"area_id": batch["area_id"], "route_id": batch["route_id"], "rank": pa.array(n_e - n_v + n_c, pa.int64())})

    kind = dict(edges.dtypes)
    return rows.mapInArrow(run, f"area_id {kind['area_id']}, route_id {kind['route_id']}, rank long")


def is_circular(roundtrip: Column, rank: Column, gap_m: Column, length_m: Column, params: Params) -> Column:
    """The tag decides; without a clear one, a cycle among the ways; else ends that lie close together."""
    said = F.lower(F.trim(roundtrip))
    closed = (F.coalesce(rank, F.lit(0)) > 0) | F.coalesce(gap_m <= closure_limit_m(length_m, params.loop_tolerance_m), F.lit(False))
    return F.when(said.isin("yes", "true", "1"), True).when(said.isin("no", "false", "0"), False).otherwise(closed)


def shapes(routes: DataFrame, vertices: DataFrame, line: DataFrame, params: Params = Params()) -> DataFrame:
    """What shapes_of gives, of routes' vertices."""
    return shapes_of(routes, segments(vertices), line, params)


def shapes_of(routes: DataFrame, segs: DataFrame, line: DataFrame, params: Params = Params()) -> DataFrame:
    """area_id, route_id, length_m (of all ways), rank, head, tail and gap_m (of the stitched line), circular. Routes whose line has less
    than two points are left out. segs: what geometry.segments gives; line: what stitch.stitch gives."""
    base = line_ends(line).join(route_lengths(segs), ROUTE).join(circuit_ranks(welded(segs)), ROUTE, "left").join(routes.select(*ROUTE, "tags"), ROUTE)
    base = base.withColumn("gap_m", haversine_m(F.col("head.lat"), F.col("head.lon"), F.col("tail.lat"), F.col("tail.lon")))
    return base.select(*ROUTE, "length_m", "n_ways", F.coalesce("rank", F.lit(0)).alias("rank"), "head", "tail", "gap_m", is_circular(tag(F.col("tags"), "roundtrip"), F.col("rank"), F.col("gap_m"), F.col("length_m"), params).alias("circular"))


def line_closes(params: Params) -> Column:
    """Whether the stitched line returns to its start; a loop's gain counts only then."""
    return F.col("gap_m") <= closure_limit_m(F.col("length_m"), params.loop_tolerance_m)


def end_points(shape: DataFrame, ends: DataFrame) -> DataFrame:
    """Open ends of a route and both ends of its line, once each."""
    tips = shape.select(*ROUTE, F.explode(F.array("head", "tail")).alias("p")).select(*ROUTE, "p.lat", "p.lon")
    return tips.unionByName(ends.select(*ROUTE, "lat", "lon")).distinct()


def access_points(shape: DataFrame, line: DataFrame, ends: DataFrame) -> DataFrame:
    """Where one can get onto a route: its open ends and both ends of its line; of a loop, every point of the line."""
    loops = line.join(shape.where("circular").select(*ROUTE), ROUTE).select(*ROUTE, "lat", "lon")
    return loops.unionByName(end_points(shape, ends)).distinct()


def car_access(points: DataFrame, parking: DataFrame, params: Params = Params()) -> DataFrame:
    """Nearest parking within the relaxed radius: car_distance_m, car_access."""
    reach = params.car_radius_m * (1 + params.near_miss_radius_frac)
    best = at_places(points, parking, reach, F.min("d").alias("d")).groupBy(*ROUTE).agg(F.min("d").alias("car_distance_m"))
    return best.withColumn("car_access", F.col("car_distance_m") <= params.car_radius_m)


def lift_access(points: DataFrame, lifts: DataFrame, params: Params = Params()) -> DataFrame:
    """Nearest lift station within the relaxed radius: lift_distance_m, chairlift_access, lift_type (null if not in reach)."""
    reach = params.lift_radius_m * (1 + params.near_miss_radius_frac)
    best = at_places(points, lifts, reach, F.min(F.struct("d", "feature_id", "kind")).alias("b")).groupBy(*ROUTE).agg(F.min("b").alias("b"))
    within = F.col("b.d") <= params.lift_radius_m
    return best.select(*ROUTE, F.col("b.d").alias("lift_distance_m"), within.alias("chairlift_access"), F.when(within, F.col("b.kind")).alias("lift_type"))


def transit_access(points: DataFrame, transit: DataFrame, params: Params = Params()) -> DataFrame:
    """A stop counts within its own class's radius; rail goes before road, then the nearest. transit_distance_m is the nearest of any
    class within the relaxed rail radius, transit_near its kind."""
    reach = params.transit_rail_radius_m * (1 + params.near_miss_radius_frac)
    rail = is_rail(F.col("kind"))
    within = F.col("d") <= F.when(rail, params.transit_rail_radius_m).otherwise(params.transit_stop_radius_m)
    found = at_places(points, transit, reach, F.min(F.struct("d", "feature_id", "kind")).alias("near"), F.min(F.when(within, F.struct((~rail).alias("road"), "d", "feature_id", "kind"))).alias("b"))
    best = found.groupBy(*ROUTE).agg(F.min("near").alias("near"), F.min("b").alias("b"))
    return best.select(*ROUTE, F.col("near.d").alias("transit_distance_m"), F.col("near.kind").alias("transit_near"), F.col("b").isNotNull().alias("transit_access"), F.col("b.kind").alias("transit_type"))


def matched_access(points: DataFrame, features: DataFrame, radius_m: float) -> DataFrame:
    """Every feature within the radius of some access point, once: area_id, route_id, feature_id, f_lat, f_lon. A point gives only what no
    point before it on its route has in reach, so that the pairs, which can be very many, need no shuffle to be told apart."""
    tips = points.groupBy(*ROUTE).agg(F.array_sort(F.collect_set(F.struct("lat", "lon"))).alias("tips"))
    rows = tips.select(*ROUTE, "tips", F.posexplode("tips").alias("nth", "p")).select(*ROUTE, F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.slice("tips", F.lit(1), F.col("nth")).alias("before"))
    there = features.groupBy(*PLACE).agg(F.collect_set("feature_id").alias("feature_id")).withColumn("kind", F.lit(None)).withColumn("name", F.lit(None))
    pairs = rows.join(near(points.select(*PLACE).distinct(), there, radius_m).select(*PLACE, "feature_id", "f_lat", "f_lon"), PLACE)
    seen = F.exists("before", lambda b: haversine_m(b["lat"], b["lon"], F.col("f_lat"), F.col("f_lon")) <= radius_m)
    return pairs.where(~seen).select(*ROUTE, F.explode("feature_id").alias("feature_id"), "f_lat", "f_lon")


def nearest_ends(points: DataFrame, ends: DataFrame, reached: list[tuple[DataFrame, float]]) -> DataFrame:
    """a (struct<d, lat, lon>): the open end nearest to any feature that is within its radius of some access point of the route, to the
    micrometre; of several the smallest. Each place, and each two places, are measured once, however many routes have them."""
    pair = [*PLACE, "e_lat", "e_lon"]
    asked = points.join(ends.select(*ROUTE, F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon")), ROUTE)
    places, pairs = asked.select(*PLACE).distinct(), asked.select(*pair).distinct()
    spots = [near(places, once(features.withColumn("kind", F.lit(None).cast("string"))), radius).select(*PLACE, "f_lat", "f_lon") for features, radius in reached]
    gap = F.round(haversine_m(F.col("e_lat"), F.col("e_lon"), F.col("f_lat"), F.col("f_lon")), 6)
    gaps = pairs.join(reduce(DataFrame.unionByName, spots), PLACE).groupBy(*pair).agg(F.min(gap).alias("d"))
    return asked.join(gaps, pair).groupBy(*ROUTE).agg(F.min(F.struct("d", F.col("e_lat").alias("lat"), F.col("e_lon").alias("lon"))).alias("a"))


def route_starts(shape: DataFrame, ends: DataFrame, reached: list[tuple[DataFrame, float]]) -> DataFrame:
    """The open end nearest a feature in reach (features, radius); else the line's head if it is an open end or there is none; else the smallest."""
    by_access = nearest_ends(cut(end_points(shape, ends)), ends, reached)
    rows = shape.join(ends.groupBy(*ROUTE).agg(F.min(F.struct("lat", "lon")).alias("least"), F.collect_list(F.struct("lat", "lon")).alias("ends")), ROUTE, "left").join(by_access, ROUTE, "left")
    head_is_end = F.exists("ends", lambda e: haversine_m(F.col("head.lat"), F.col("head.lon"), e["lat"], e["lon"]) <= 1.0)
    at = F.when(F.col("a").isNotNull(), F.struct("a.lat", "a.lon")).when(F.col("ends").isNull() | head_is_end, F.col("head")).otherwise(F.col("least"))
    return rows.select(*ROUTE, at.alias("start"))


def tag_mix(segs: DataFrame, ways: DataFrame, key: str) -> DataFrame:
    """Share of each value of a way tag in a route's whole length, and the length that has the tag at all: area_id, route_id, value,
    fraction, coverage, place (1: the largest). Ways without length count for nothing."""
    per_way = segs.groupBy(*ROUTE, "way_idx").agg(F.sum("seg_m").alias("m")).where("m > 0")
    rows = per_way.join(ways.select(*ROUTE, "way_idx", F.nullif(tag(F.col("tags"), key), F.lit("")).alias("value")), [*ROUTE, "way_idx"])
    values = rows.groupBy(*ROUTE, "value").agg(F.sum("m").alias("m"))
    listed = values.groupBy(*ROUTE).agg(F.sum("m").alias("total"), F.sum(F.when(F.col("value").isNotNull(), F.col("m")).otherwise(0.0)).alias("known"), F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct((-F.col("m")).alias("m"), "value")))).alias("shares"))
    rows = listed.select(*ROUTE, "total", (F.col("known") / F.col("total")).alias("coverage"), F.posexplode_outer("shares").alias("place", "s"))
    return rows.select(*ROUTE, F.col("s.value").alias("value"), (-F.col("s.m") / F.col("total")).alias("fraction"), "coverage", (F.col("place") + 1).alias("place"))


def ferrata_summary(segs: DataFrame, ways: DataFrame, routes: DataFrame) -> DataFrame:
    """present, cabled_m, fraction, grades, relation_tagged; present is null where no member way could be read and the relation is silent."""
    cabled, tags = F.col("cabled"), F.col("tags")
    read = ways.select(*ROUTE, "way_idx", way_is_ferrata(tags).alias("cabled"), F.when(way_is_ferrata(tags), ferrata_scale(tags)).alias("scale"))  # no tags go through the shuffle
    per_way = segs.groupBy(*ROUTE, "way_idx").agg(F.sum("seg_m").alias("m")).where("m > 0").join(read, [*ROUTE, "way_idx"])
    sums = per_way.groupBy(*ROUTE).agg(F.sum("m").alias("total"), F.sum(F.when(cabled, F.col("m")).otherwise(0.0)).alias("cabled_m"), F.collect_set("scale").alias("scales"))
    rows = routes.select(*ROUTE, relation_is_ferrata(F.col("tags")).alias("relation_tagged"), ferrata_scale(F.col("tags")).alias("own")).join(sums, ROUTE, "left")
    grades = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("scales", F.array().cast("array<string>")), F.array("own")))))
    present = F.when(F.col("total").isNull(), F.when(F.col("relation_tagged"), True)).otherwise((F.col("cabled_m") > 0) | F.col("relation_tagged"))
    return rows.select(*ROUTE, present.alias("present"), F.coalesce("cabled_m", F.lit(0.0)).alias("cabled_m"), F.coalesce(F.col("cabled_m") / F.col("total"), F.lit(0.0)).alias("fraction"), grades.alias("grades"), "relation_tagged")


def passed(segs: DataFrame, features: DataFrame, radius_m: float) -> DataFrame:
    """Features within the radius of a route's line: area_id, route_id, feature_id, kind, d (at the closest approach). A straight line between two
    places is measured once, however many routes take it."""
    line = ["area_id", "lat1", "lon1", "lat2", "lon2"]
    hits = near_segments(segs.select(*line, "seg_m").distinct(), features, radius_m).select(*line, "feature_id", "kind", "d")
    return segs.select(*ROUTE, *line[1:]).join(hits, line).groupBy(*ROUTE, "feature_id", "kind").agg(F.min("d").alias("d"))


def passed_places(segs: DataFrame, pois: DataFrame, kinds: list[str], radius_m: float) -> DataFrame:
    """What a route passes by kinds and places, as inventories count it: the columns of route_pois, of several objects of a kind at one place only
    the one of the smallest feature_id."""
    own = cut(once(pois.where(F.col("kind").isin(*kinds))))
    return passed(segs, own, radius_m).join(own.select("area_id", "feature_id", "kind", F.col("name").alias("f_name")), ["area_id", "feature_id", "kind"]).select(*ROUTE, "kind", "f_name", "feature_id", "d")


def route_pois(segs: DataFrame, pois: DataFrame, kinds: list[str], radius_m: float) -> DataFrame:
    """All objects of the kinds within the radius of a route's line, once each at the closest approach: area_id, route_id, kind, f_name,
    feature_id, d. A place is measured once, and all objects there have its distance."""
    key = ["area_id", "feature_id", "kind"]
    own = pois.where(F.col("kind").isin(*kinds)).groupBy(*PLACE, "kind", "feature_id").agg(F.min("name").alias("f_name"))
    there = cut(own.groupBy(*PLACE, "kind").agg(F.collect_list(F.struct("feature_id", "f_name")).alias("all")).select("*", F.struct("lat", "lon").alias("feature_id"), F.lit(None).cast("string").alias("name")))
    rows = passed(segs, there.drop("all"), radius_m).join(there.select(*key, "all"), key).select(*ROUTE, "kind", F.explode("all").alias("o"), "d").select(*ROUTE, "kind", "o.f_name", "o.feature_id", "d")
    if there.select("area_id", "kind", F.explode("all.feature_id").alias("feature_id")).groupBy(*key).count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy(*ROUTE, "kind", "feature_id").agg(F.min(F.struct("d", "f_name")).alias("b")).select(*ROUTE, "kind", "b.f_name", "feature_id", "b.d")  # an id at several places
