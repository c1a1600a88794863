"""Search of mapped routes: cheap measures first, elevation for survivors only. One job serves all areas.

What an area never recorded stays unknown: its fields are null, and an unknown fails every active filter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import unrecorded
from ..functions.geo import haversine_m
from ..operators import criteria as rules
from ..operators import elevation, geometry, inventory, measure, stitch
from ..operators.geometry import ROUTE
from ..operators.lineage import cut
from ..params import Criteria, Params
from ..sources import store

#: Joins elev (null: unknown) to points (area_id, route_id, idx, lat, lon).
Lookup = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Tables:
    """What is known of some areas.

    areas: area_id, south, west, north, east, sample_interval_m, transit_recorded, way_tags_recorded, ferrata_recorded, poi_kinds (null:
    never recorded). routes: area_id, route_id, seq, name, ref, unnamed, tags, is_ferrata. ways: area_id, route_id, way_idx, tags.
    vertices: area_id, route_id, way_idx, vtx_idx, lat, lon. parking, lifts (a row per station), transit, pois: area_id, feature_id, kind,
    name, lat, lon."""

    areas: DataFrame
    routes: DataFrame
    ways: DataFrame
    vertices: DataFrame
    parking: DataFrame
    lifts: DataFrame
    transit: DataFrame
    pois: DataFrame


@dataclass(frozen=True)
class Measured:
    """Rows of measured routes, and the stitched lines, open ends and segments of the same routes; each written once."""

    rows: DataFrame
    line: DataFrame
    ends: DataFrame
    segs: DataFrame


def candidates(tables: Tables, c: Criteria) -> Tables:
    """Cabled relations are candidates only where they are asked for."""
    if c.ferrata:
        return tables
    cabled = cut(tables.routes.where("is_ferrata").select(*ROUTE))  # few, which the planner then knows
    return replace(tables, routes=tables.routes.where("not is_ferrata"), vertices=tables.vertices.join(cabled, ROUTE, "left_anti"))


def of_right_length(tables: Tables, c: Criteria, p: Params, margin_km: float) -> DataFrame:
    """Rows of stitch.walked of the routes within the distance bounds (give or take the margin) and not too long for their area, known from
    lengths alone: what else is measured reads these rows, and no vertices."""
    diagonal, km = haversine_m(F.col("south"), F.col("west"), F.col("north"), F.col("east")), F.round(F.col("length_m") / 1000, 2)
    fits = F.coalesce(F.col("length_m") <= p.max_route_factor * F.col("diagonal_m"), F.lit(True))
    fits = fits if c.min_distance_km is None else fits & (km >= c.min_distance_km - margin_km)
    fits = fits if c.max_distance_km is None else fits & (km <= c.max_distance_km + margin_km)
    sized = tables.areas.select("area_id", diagonal.alias("diagonal_m"))
    return stitch.walked(tables.vertices, keep=lambda rows: rows.join(sized, "area_id", "left").where(fits).drop("diagonal_m"))


def outlined(tables: Tables, c: Criteria, p: Params, margin_km: float = 0.0) -> tuple[Tables, DataFrame, DataFrame, DataFrame]:
    """The candidates' tables, segments, lines and shapes; a candidate that has a shape is one that measured has a row for."""
    t = candidates(tables, c)
    rows = of_right_length(t, c, p, margin_km)
    segs, line = stitch.segments_of(rows), stitch.lines(rows)
    return t, segs, line, cut(measure.shapes_of(t.routes, segs, line, p))


def measured(tables: Tables, c: Criteria, p: Params, margin_km: float = 0.0) -> Measured:
    """All that is known of each candidate without elevation."""
    t, segs, line, shape = outlined(tables, c, p, margin_km)
    ends = cut(geometry.termini(geometry.welded(segs)))
    points = cut(measure.access_points(shape, line, ends))
    flags = t.areas.select("area_id", *(F.coalesce(f, F.lit(False)).alias(f) for f in ("transit_recorded", "way_tags_recorded")))
    read = t.ways.join(flags.where("way_tags_recorded").select("area_id"), "area_id", "left_semi")
    rows = shape.join(t.routes.select(*ROUTE, "seq", "name", "ref", "unnamed", "tags"), ROUTE).join(flags, "area_id", "left")
    rows = rows.join(measure.car_access(points, t.parking, p), ROUTE, "left").join(measure.lift_access(points, t.lifts, p), ROUTE, "left").join(measure.transit_access(points, t.transit, p), ROUTE, "left")
    rows = rows.join(measure.ferrata_summary(segs, read, t.routes).select(*ROUTE, F.col("present").alias("ferrata"), "cabled_m", "grades"), ROUTE, "left")
    if c.poi_kinds:
        hits = measure.passed_places(segs, t.pois, inventory.check_kinds(c.poi_kinds), p.poi_radius_m)
        rows = rows.join(hits.groupBy(*ROUTE).agg(F.array_sort(F.collect_list(F.struct("d", "kind", F.col("f_name").alias("name")))).alias("pois")), ROUTE, "left")
    else:
        rows = rows.withColumn("pois", F.lit(None).cast("array<struct<d double, kind string, name string>>"))
    known = F.coalesce("transit_recorded", F.lit(False))
    rows = rows.withColumn("transit_access", F.when(known, F.coalesce("transit_access", F.lit(False))))
    for column in ("transit_distance_m", "transit_near", "transit_type"):
        rows = rows.withColumn(column, F.when(known, F.col(column)))
    rows = rows.withColumn("distance_km", F.round(F.col("length_m") / 1000, 2)).withColumn("n_pois", F.coalesce(F.size("pois"), F.lit(0)))
    return Measured(cut(rows.na.fill(False, ["car_access", "chairlift_access"])), line, ends, segs)


def samples(rows: DataFrame, line: DataFrame, p: Params) -> DataFrame:
    """Evenly spaced points of the lines of some routes."""
    return geometry.resample(stitch.line_segments(line.join(rows.select(*ROUTE), ROUTE, "left_semi")), p.sample_interval_m)


def gains(series: DataFrame, p: Params, batch: int | None = None) -> DataFrame:
    """gain_m, loss_m of elevation series (area_id, route_id, idx, elev); null where an elevation is missing. With batch, gaps are filled first."""
    return elevation.gain_loss(series, ROUTE, ["idx"], p.gain_threshold_m, p.smooth_window, batch).select(*ROUTE, "gain_m", "loss_m")


def elevated(rows: DataFrame, line: DataFrame, lookup: Lookup, p: Params, batch: int | None = None) -> DataFrame:
    """rows with gain_m and loss_m, in whole metres. A loop whose line does not close has neither. With batch, gaps that lookup leaves are filled
    within so many points."""
    out = rows.join(gains(lookup(samples(rows, line, p)), p, batch), ROUTE, "left")
    counts = ~F.col("circular") | measure.line_closes(p)
    return out.withColumn("gain_m", F.when(counts, F.rint("gain_m"))).withColumn("loss_m", F.when(counts, F.rint("loss_m")))


def tracks(rows: DataFrame, line: DataFrame, lookup: Lookup, p: Params) -> DataFrame:
    """area_id, route_id, track (array of idx, lat, lon, ele in order) of elevated rows whose line keeps nearly all of their length and whose elevations are all known."""
    known = rows.where("gain_m is not null")
    whole = stitch.faithful(known, line).where("faithful").select(*ROUTE)
    points = lookup(samples(known.join(whole, ROUTE, "left_semi"), line, p))
    return points.groupBy(*ROUTE).agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon", F.col("elev").alias("ele")))).alias("track"))


def described(rows: DataFrame, m: Measured, tables: Tables, p: Params) -> DataFrame:
    """Some measured rows with surface (struct<value, fraction, coverage> of the commonest surface; null where none is known) and start (where one
    gets onto the route)."""
    own = rows.select(*ROUTE)
    read = tables.ways.join(tables.areas.where("way_tags_recorded").select("area_id"), "area_id", "left_semi")
    mix = measure.tag_mix(m.segs.join(own, ROUTE, "left_semi"), read, "surface").where("place = 1").select(*ROUTE, F.struct("value", "fraction", "coverage").alias("surface"))
    ends = m.ends.join(own, ROUTE, "left_semi")
    reached = [(tables.parking, p.car_radius_m), (tables.lifts, p.lift_radius_m)]
    return rows.join(mix, ROUTE, "left").join(measure.route_starts(rows, ends, reached), ROUTE, "left")


def search(tables: Tables, c: Criteria, lookup: Lookup, p: Params = Params(), near: str = "off", batch: int | None = None) -> DataFrame:
    """Matches of each area with surface and start, most gain first, unknown gain last; then near misses with notes. near: off, always, or auto
    (in areas with fewer matches than near_miss_trigger). Elevation is looked up for strict survivors; for near misses only where they are
    wanted; surfaces and starts are sought for what is returned. With batch, gaps that lookup leaves are filled within so many points."""
    m = measured(tables, c, p, 0.0 if near == "off" else p.near_miss_dist_km)
    strict = rules.accepts_geometry(c)
    sure = cut(elevated(m.rows.where(strict), m.line, lookup, p, batch))
    out = sure.where(rules.accepts_gain(c)).withColumn("near_miss", F.lit(False)).withColumn("notes", F.lit(None).cast("array<string>"))
    if near != "off":
        pool, missed = m.rows.where(rules.accepts_relaxed(c, p) & ~strict), sure.where(~rules.accepts_gain(c))
        if near == "auto":
            enough = cut(out.groupBy("area_id").count().where(F.col("count") >= p.near_miss_trigger).select("area_id"))
            pool, missed = pool.join(enough, "area_id", "left_anti"), missed.join(enough, "area_id", "left_anti")
        close = missed.unionByName(elevated(cut(pool), m.line, lookup, p, batch))
        out = out.unionByName(close.withColumn("near_miss", F.lit(True)).withColumn("notes", rules.near_miss_notes(c, p)).where(F.col("notes").isNotNull()))
    return described(cut(out), m, tables, p).orderBy("area_id", "near_miss", F.desc_nulls_last("gain_m"), "seq", "route_id")


def notices(tables: Tables, c: Criteria) -> DataFrame:
    """area_id, notices: what an area's data can't answer of the criteria: no_routes, ferrata_unreadable, ferrata_unrecorded,
    transit_unrecorded, poi_unknown, poi_missing."""
    counts = tables.routes.where("not is_ferrata").groupBy("area_id").agg(F.count("*").alias("n_routes"))
    a = tables.areas.join(counts, "area_id", "left").withColumn("n_routes", F.coalesce("n_routes", F.lit(0)))
    said = lambda f: F.coalesce(F.col(f), F.lit(False))
    readable = (F.col("n_routes") == 0) | said("way_tags_recorded")
    found = [F.when(F.col("n_routes") == 0, "no_routes")]
    if c.ferrata is not None:
        found.append(F.when(~readable, "ferrata_unreadable"))
        found += [F.when(readable & ~said("ferrata_recorded"), "ferrata_unrecorded")] if c.ferrata else []
    if c.transit_access is not None:
        found.append(F.when(~said("transit_recorded"), "transit_unrecorded"))
    if c.poi_kinds:
        _, state = unrecorded(F.col("poi_kinds"), F.array(*map(F.lit, inventory.check_kinds(c.poi_kinds))))
        found.append(F.when(state.isin("unknown", "missing"), F.concat(F.lit("poi_"), state)))
    return a.select("area_id", F.array_compact(F.array(*found)).alias("notices"))


def stored_lookup(kept: DataFrame) -> Lookup:
    """Elevations as they were recorded: lat_key, lon_key, elev."""
    return lambda points: elevation.sample_lookup(points, kept)


def record(tables: Tables, c: Criteria, lookup: Lookup, path: str, p: Params = Params(), places: DataFrame | None = None) -> None:
    """Stores areas with the elevations of all their measured routes, for search_stored. places: lat_key, lon_key, place, fetched_at. What
    can be reached from a route or lies along it is not stored, so it isn't measured here."""
    _, _, line, shape = outlined(tables, c, p)
    seen = lookup(samples(shape, line, p)).where(F.col("elev").isNotNull())
    keyed = elevation.keyed(seen).groupBy("area_id", "lat_key", "lon_key").agg(F.min("elev").alias("elev"))
    features = [df.withColumn("class", F.lit(k)).select("area_id", "class", "feature_id", "kind", "name", "lat", "lon") for k, df in (("parking", tables.parking), ("lift", tables.lifts), ("transit", tables.transit), ("poi", tables.pois))]
    stored = {
        "areas": tables.areas.withColumn("sample_interval_m", F.lit(p.sample_interval_m)), "routes": tables.routes, "ways": tables.ways, "vertices": tables.vertices,
        "features": features[0].unionByName(features[1]).unionByName(features[2]).unionByName(features[3]), "elevation_samples": keyed,
    }
    store.download(shape, stored | ({"places": places} if places is not None else {}), path)


def stored_tables(spark: SparkSession, path: str) -> tuple[Tables, DataFrame]:
    """The tables of a store and its elevations."""
    load = lambda name: store.load(spark, path, name, store.SCHEMAS[name])
    features = load("features")
    of = lambda k: features.where(F.col("class") == k).drop("class")
    return Tables(load("areas"), load("routes"), load("ways"), load("vertices"), of("parking"), of("lift"), of("transit"), of("poi")), load("elevation_samples")


def search_stored(spark: SparkSession, path: str, c: Criteria, p: Params = Params(), near: str = "off") -> DataFrame:
    """search on stored areas. They must have been sampled alike: their interval takes the place of the one in p."""
    tables, kept = stored_tables(spark, path)
    intervals = [r[0] for r in tables.areas.select("sample_interval_m").distinct().limit(2).collect()]
    if len(intervals) > 1:
        raise ValueError("areas were sampled at different intervals; search them apart")
    return search(tables, c, stored_lookup(kept), replace(p, sample_interval_m=intervals[0]) if intervals else p, near)
