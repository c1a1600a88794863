"""Registered queries on routes and objects, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.classify import lift_kind, poi_kind, relation_is_ferrata, transit_kind, unrecorded, way_is_ferrata
from .functions.geo import box, coordinate_key, haversine_m
from .operators import criteria, elevation, export, geometry, graph, inventory, measure, stitch
from .operators.components import cut
from .operators.geometry import ROUTE
from .params import Criteria, Params
from .operators.lineage import shared_dir
from .plans import modes, search
from .sources import elements, fixture, store
from .sources.fixture import hav_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
P = Params()


def query(sql: str | None = None, base: bool = True) -> Callable:
    """Registers a query under its function's name; sql follows the fixture's common table expressions."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (fixture.SQL + ("\n" if sql.lstrip().startswith("SELECT") else ",\n") if base else "") + sql
        return f

    return register


def segs(spark: SparkSession, d: str) -> DataFrame:
    return geometry.segments(fixture.vertices(spark, d))


def r3(c: str | F.Column, name: str | None = None) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 3).alias(name or c)


def pois(spark: SparkSession, d: str) -> DataFrame:
    return fixture.pois(spark, d).select("area_id", "feature_id", poi_kind(F.col("tags")).alias("kind"), F.col("tags")["name"].alias("name"), "lat", "lon").where(F.col("kind").isNotNull())


def transit(spark: SparkSession, d: str) -> DataFrame:
    return fixture.stops(spark, d).withColumn("kind", transit_kind(F.col("tags"))).where(F.col("kind").isNotNull())


def lifts(spark: SparkSession, d: str) -> DataFrame:
    return fixture.stops(spark, d).withColumn("kind", lift_kind(F.col("tags"))).where(F.col("kind").isNotNull())


def lines(spark: SparkSession, d: str) -> DataFrame:
    return stitch.stitch(fixture.vertices(spark, d))


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of all routes, computed once: several joins of a query read them."""
    return surveyed(spark, d)[0]


def surveyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shapes, lines and open ends of all routes, from rows that are written once."""
    rows = stitch.walked(fixture.vertices(spark, d))
    line, s = stitch.lines(rows), stitch.segments_of(rows)
    return cut(measure.shapes_of(fixture.routes(spark, d), s, line, P)), line, cut(geometry.termini(geometry.welded(s)))


def ends(spark: SparkSession, d: str) -> DataFrame:
    return geometry.termini(geometry.welded(segs(spark, d)))


# geometry


@query("SELECT area_id, route_id, way_idx, round(seg_m, 3) AS seg_m FROM ways")
def way_segments(spark: SparkSession, d: str) -> DataFrame:
    return segs(spark, d).select(*ROUTE, "way_idx", r3("seg_m"))


@query("SELECT area_id, route_id, round(sum(seg_m), 3) AS length_m, count(DISTINCT way_idx) AS n_ways FROM ways GROUP BY ALL")
def route_length(spark: SparkSession, d: str) -> DataFrame:
    return geometry.route_lengths(segs(spark, d)).select(*ROUTE, r3("length_m"), "n_ways")


SAMPLES = """cum AS (SELECT *, sum(seg_m) OVER (PARTITION BY route_id ORDER BY way_idx ROWS UNBOUNDED PRECEDING) AS to_m FROM ways),
line AS (SELECT *, coalesce(lag(to_m) OVER (PARTITION BY route_id ORDER BY way_idx), 0e0) AS from_m, max(to_m) OVER (PARTITION BY route_id) AS end_m FROM cum),
samples AS MATERIALIZED (SELECT area_id, route_id, k AS idx, lat1 + (lat2 - lat1) * ((k * 25 - from_m) / seg_m) AS lat, lon1 + (lon2 - lon1) * ((k * 25 - from_m) / seg_m) AS lon FROM (SELECT *, unnest(generate_series((floor(from_m / 25) + 1)::BIGINT, floor(to_m / 25)::BIGINT)) AS k FROM line)
  UNION ALL SELECT area_id, route_id, 0, lat1, lon1 FROM line WHERE way_idx = 0
  UNION ALL SELECT area_id, route_id, floor(to_m / 25)::BIGINT + 1, lat2, lon2 FROM line WHERE to_m = end_m AND floor(to_m / 25) * 25 <> to_m)"""


@query(SAMPLES + "\nSELECT area_id, route_id, idx, round(lat, 6) AS lat, round(lon, 6) AS lon FROM samples")
def resample_points(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select(*ROUTE, "idx", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return geometry.resample(stitch.line_segments(lines(spark, d)), P.sample_interval_m)


NODES = """nodes AS (SELECT area_id, route_id, way_idx, 0 AS k, i1 AS i, j1 AS j, lat1 AS lat, lon1 AS lon FROM ways UNION ALL SELECT area_id, route_id, way_idx, 1, i2, j2, lat2, lon2 FROM ways),
ends AS (SELECT area_id, route_id, i, j, any_value(lat) AS lat, any_value(lon) AS lon FROM nodes GROUP BY area_id, route_id, i, j HAVING count(*) = 1)"""


@query(NODES + "\nSELECT area_id, route_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ends")
def termini(spark: SparkSession, d: str) -> DataFrame:
    return ends(spark, d).select(*ROUTE, F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


# the ways of a fixture route are one walk, so its graph has one component
RANK = NODES + ",\nranks AS (SELECT area_id, route_id, count(DISTINCT (way_idx)) - (count(DISTINCT (i, j))) + 1 AS rank FROM nodes GROUP BY area_id, route_id)"


@query(RANK + "\nSELECT area_id, route_id, rank FROM ranks")
def circuit_rank(spark: SparkSession, d: str) -> DataFrame:
    return measure.circuit_ranks(geometry.welded(segs(spark, d)))


SHAPE = RANK + f""",
tips AS (SELECT area_id, route_id, sum(seg_m) AS length_m, arg_min(lat1, way_idx) AS hlat, arg_min(lon1, way_idx) AS hlon, arg_max(lat2, way_idx) AS tlat, arg_max(lon2, way_idx) AS tlon FROM ways GROUP BY area_id, route_id),
gaps AS (SELECT *, {hav_sql("hlat", "hlon", "tlat", "tlon")} AS gap_m FROM tips),
shape AS MATERIALIZED (SELECT g.*, rank, CASE WHEN roundtrip IN ('yes', 'true', '1') THEN true WHEN roundtrip IN ('no', 'false', '0') THEN false ELSE rank > 0 OR gap_m <= least(150e0, 5e-2 * length_m) END AS circular FROM gaps g JOIN ranks USING (area_id, route_id) JOIN routes USING (area_id, route_id))"""


@query(SHAPE + "\nSELECT area_id, route_id, rank, round(gap_m, 3) AS gap_m, circular FROM shape")
def is_circular(spark: SparkSession, d: str) -> DataFrame:
    return shapes(spark, d).select(*ROUTE, "rank", r3("gap_m"), "circular")


BOX = (50.004, 50.018, 15.003, 15.027)


@query(
    f"""v AS (SELECT area_id, route_id, way_idx, 0 AS vtx_idx, lat1 AS lat, lon1 - area_id * 2e-1 AS lon FROM ways UNION ALL SELECT area_id, route_id, way_idx, 1, lat2, lon2 - area_id * 2e-1 FROM ways),
runs AS (SELECT area_id, route_id, way_idx FROM v WHERE lat BETWEEN {BOX[0] - 1e-9} AND {BOX[1] + 1e-9} AND lon BETWEEN {BOX[2] - 1e-9} AND {BOX[3] + 1e-9} GROUP BY ALL HAVING count(*) = 2)
SELECT area_id, route_id, way_idx AS from_way, dense_rank() OVER (PARTITION BY area_id, route_id ORDER BY way_idx) - 1 AS way_idx, 2 AS n FROM runs"""
)
def clip_to_box(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon") - F.col("area_id") * fixture.AREA_STEP
    inside = lat.between(BOX[0] - 1e-9, BOX[1] + 1e-9) & lon.between(BOX[2] - 1e-9, BOX[3] + 1e-9)
    return geometry.clip(fixture.vertices(spark, d), inside).groupBy(*ROUTE, "from_way", "way_idx").agg(F.count("*").alias("n"))


# tags


def mix_sql(column: str) -> str:
    return f"""m AS (SELECT area_id, route_id, {column} AS value, sum(seg_m) AS m FROM ways GROUP BY ALL), t AS (SELECT area_id, route_id, sum(m) AS total, coalesce(sum(m) FILTER (WHERE value IS NOT NULL), 0) AS known FROM m GROUP BY ALL)
SELECT area_id, route_id, value, round(m / total, 6) AS fraction, round(known / total, 6) AS coverage FROM t LEFT JOIN (SELECT * FROM m WHERE value IS NOT NULL) m USING (area_id, route_id)"""


def _mix(spark: SparkSession, d: str, key: str) -> DataFrame:
    return measure.tag_mix(segs(spark, d), fixture.ways(spark, d), key).select(*ROUTE, "value", F.round("fraction", 6).alias("fraction"), F.round("coverage", 6).alias("coverage"))


@query(mix_sql("surface"))
def surface_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, "surface")


@query(mix_sql("tracktype"))
def tracktype_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, "tracktype")


FERRATA = """cabled AS MATERIALIZED (SELECT area_id, route_id, r.rel_ferrata AS relation_tagged, w.total, coalesce(w.cabled_m, 0) AS cabled_m, coalesce(w.grades, '') AS grades, CASE WHEN w.total IS NULL THEN CASE WHEN r.rel_ferrata THEN true END ELSE w.cabled_m > 0 OR r.rel_ferrata END AS present
  FROM routes r LEFT JOIN (SELECT area_id, route_id, sum(seg_m) AS total, coalesce(sum(seg_m) FILTER (WHERE scale IS NOT NULL), 0) AS cabled_m, string_agg(DISTINCT scale, '/' ORDER BY scale) AS grades FROM ways GROUP BY ALL) w USING (area_id, route_id))"""


@query(FERRATA + "\nSELECT area_id, route_id, present, round(cabled_m, 3) AS cabled_m, round(coalesce(cabled_m / total, 0), 6) AS fraction, grades, relation_tagged FROM cabled")
def ferrata_summary(spark: SparkSession, d: str) -> DataFrame:
    out = measure.ferrata_summary(segs(spark, d), fixture.ways(spark, d), fixture.routes(spark, d))
    return out.select(*ROUTE, "present", r3("cabled_m"), F.round("fraction", 6).alias("fraction"), F.array_join("grades", "/").alias("grades"), "relation_tagged")


@query("SELECT area_id, feature_id, kind FROM pois")
def poi_classify(spark: SparkSession, d: str) -> DataFrame:
    return fixture.pois(spark, d).select("area_id", "feature_id", poi_kind(F.col("tags")).alias("kind"))


@query("SELECT area_id, feature_id, CASE WHEN kind IN ('bus_stop', 'halt') THEN kind END AS transit_kind, CASE WHEN kind = 'chair_lift' THEN kind END AS lift_kind FROM stops WHERE kind IS NOT NULL")
def transit_classify(spark: SparkSession, d: str) -> DataFrame:
    return fixture.stops(spark, d).select("area_id", "feature_id", transit_kind(F.col("tags")).alias("transit_kind"), lift_kind(F.col("tags")).alias("lift_kind"))


# access


def access_points(spark: SparkSession, d: str) -> DataFrame:
    return cut(measure.access_points(*surveyed(spark, d)))


ACCESS = SHAPE + """,
points AS MATERIALIZED (SELECT area_id, route_id, lat, lon FROM ends UNION SELECT area_id, route_id, lat, lon FROM nodes JOIN shape USING (area_id, route_id) WHERE circular UNION SELECT area_id, route_id, hlat, hlon FROM shape UNION SELECT area_id, route_id, tlat, tlon FROM shape)"""
NEAR = f"(SELECT p.route_id, p.area_id, f.feature_id, f.kind, f.lat AS f_lat, f.lon AS f_lon, {hav_sql('p.lat', 'p.lon', 'f.lat', 'f.lon')} AS d FROM points p JOIN {{}} f ON p.area_id = f.area_id AND abs(p.lat - f.lat) < {{}})"
PARKED = ",\nparked AS (SELECT area_id, route_id, min(d) AS car_distance_m, min(d) <= 300 AS car_access FROM " + NEAR.format("(SELECT *, 'parking' AS kind FROM parking)", 0.005) + " WHERE d <= 450 GROUP BY ALL)"
LIFTED = ",\nlifted AS (SELECT area_id, route_id, min(d) AS lift_distance_m, min(d) <= 400 AS chairlift_access, CASE WHEN min(d) <= 400 THEN arg_min(kind, (d, feature_id)) END AS lift_type FROM " + NEAR.format("(SELECT * FROM stops WHERE kind = 'chair_lift')", 0.007) + " WHERE d <= 600 GROUP BY ALL)"
CARRIED = """,
carried AS (SELECT area_id, route_id, min(d) AS transit_distance_m, arg_min(kind, (d, feature_id)) AS transit_near, count(*) FILTER (WHERE ok) > 0 AS transit_access, arg_min(kind, (kind <> 'halt', d, feature_id)) FILTER (WHERE ok) AS transit_type
FROM (SELECT *, d <= CASE WHEN kind = 'halt' THEN 1000 ELSE 400 END AS ok FROM """ + NEAR.format("(SELECT * FROM stops WHERE kind IN ('halt', 'bus_stop'))", 0.015) + " WHERE d <= 1500) GROUP BY ALL)"


@query(ACCESS + PARKED + "\nSELECT area_id, route_id, round(car_distance_m, 3) AS car_distance_m, car_access FROM parked")
def car_access(spark: SparkSession, d: str) -> DataFrame:
    return measure.car_access(access_points(spark, d), fixture.parking(spark, d), P).select(*ROUTE, r3("car_distance_m"), "car_access")


@query(ACCESS + LIFTED + "\nSELECT area_id, route_id, round(lift_distance_m, 3) AS lift_distance_m, chairlift_access, lift_type FROM lifted")
def lift_access(spark: SparkSession, d: str) -> DataFrame:
    return measure.lift_access(access_points(spark, d), lifts(spark, d), P).select(*ROUTE, r3("lift_distance_m"), "chairlift_access", "lift_type")


@query(ACCESS + CARRIED + "\nSELECT area_id, route_id, round(transit_distance_m, 3) AS transit_distance_m, transit_access, transit_type FROM carried")
def transit_access(spark: SparkSession, d: str) -> DataFrame:
    return measure.transit_access(access_points(spark, d), transit(spark, d), P).select(*ROUTE, r3("transit_distance_m"), "transit_access", "transit_type")


MATCHED = """,
tips2 AS (SELECT area_id, route_id, lat, lon FROM ends UNION SELECT area_id, route_id, hlat, hlon FROM shape UNION SELECT area_id, route_id, tlat, tlon FROM shape),
matched AS (SELECT DISTINCT area_id, route_id, feature_id, kind, f_lat, f_lon FROM (SELECT * FROM """ + NEAR.replace("points p", "tips2 p").format("(SELECT *, 'parking' AS kind FROM parking)", 0.005) + " WHERE d <= 300 UNION ALL SELECT * FROM " + NEAR.replace("points p", "tips2 p").format("(SELECT * FROM stops WHERE kind = 'chair_lift')", 0.007) + " WHERE d <= 400))"


def matched(spark: SparkSession, d: str) -> DataFrame:
    shape, _, ends = surveyed(spark, d)
    points = cut(measure.end_points(shape, ends))
    both = (("parking", fixture.parking(spark, d), P.car_radius_m), ("chair_lift", lifts(spark, d), P.lift_radius_m))
    found = [measure.matched_access(points, features, radius).withColumn("kind", F.lit(kind)) for kind, features, radius in both]
    return found[0].unionByName(found[1])


@query(ACCESS + MATCHED + "\nSELECT area_id, route_id, feature_id, kind FROM matched")
def matched_access(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).select(*ROUTE, "feature_id", "kind")


START = ACCESS + MATCHED + f""",
by_access AS (SELECT e.area_id, e.route_id, min((round({hav_sql("e.lat", "e.lon", "f_lat", "f_lon")}, 6), e.lat, e.lon)) AS a FROM ends e JOIN matched m USING (area_id, route_id) GROUP BY ALL),
least AS (SELECT area_id, route_id, min((lat, lon)) AS least FROM ends GROUP BY ALL),
starts AS MATERIALIZED (SELECT s.area_id, s.route_id, CASE WHEN a IS NOT NULL THEN a[2] WHEN least IS NULL OR h.lat IS NOT NULL THEN hlat ELSE least[1] END AS lat, CASE WHEN a IS NOT NULL THEN a[3] WHEN least IS NULL OR h.lat IS NOT NULL THEN hlon ELSE least[2] END AS lon
  FROM shape s LEFT JOIN least USING (area_id, route_id) LEFT JOIN by_access USING (area_id, route_id) LEFT JOIN ends h ON h.area_id = s.area_id AND h.route_id = s.route_id AND h.lat = hlat AND h.lon = hlon)"""


@query(START + "\nSELECT area_id, route_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM starts")
def route_start(spark: SparkSession, d: str) -> DataFrame:
    shape, _, ends = surveyed(spark, d)
    return starts(spark, d, shape, ends).select(*ROUTE, F.round("start.lat", 6).alias("lat"), F.round("start.lon", 6).alias("lon"))


def starts(spark: SparkSession, d: str, shape: DataFrame, ends: DataFrame) -> DataFrame:
    return measure.route_starts(shape, ends, [(fixture.parking(spark, d), P.car_radius_m), (lifts(spark, d), P.lift_radius_m)])


def to_line_sql(lat: str, lon: str) -> str:
    """Distance from a point to the way (lat1, lon1)-(lat2, lon2) in a plane about the point."""
    kx, ky = f"(111320e0 * cos(radians({lat})))", "111320e0"
    dx, dy, ex, ey = f"((lon2 - lon1) * {kx})", f"((lat2 - lat1) * {ky})", f"(({lon} - lon1) * {kx})", f"(({lat} - lat1) * {ky})"
    t = f"greatest(0e0, least(1e0, ({ex} * {dx} + {ey} * {dy}) / ({dx} ** 2 + {dy} ** 2)))"
    return f"sqrt(({ex} - {t} * {dx}) ** 2 + ({ey} - {t} * {dy}) ** 2)"


def nearby_sql(columns: str) -> str:
    """The objects within reach of each way of a route."""
    return f"(SELECT w.area_id, w.route_id, {columns}, {to_line_sql('p.lat', 'p.lon')} AS d FROM ways w JOIN pois p ON w.area_id = p.area_id AND p.kind IN ('ruins', 'peak') AND abs(w.lat1 - p.lat) < 0.007 AND abs(w.lon1 - p.lon) < 0.012) WHERE d <= 250"


# searches count a kind at a place once; several feature_id there go by the smallest
PASSED = "passed AS MATERIALIZED (SELECT area_id, route_id, kind, min(feature_id) AS feature_id, min(d) AS d FROM " + nearby_sql("p.kind, p.feature_id, p.lat, p.lon") + " GROUP BY area_id, route_id, kind, lat, lon)"


@query("passed AS MATERIALIZED (SELECT area_id, route_id, kind, feature_id, min(d) AS d FROM " + nearby_sql("p.kind, p.feature_id") + " GROUP BY ALL)\nSELECT area_id, route_id, kind, feature_id, round(d, 3) AS d FROM passed")
def route_pois(spark: SparkSession, d: str) -> DataFrame:
    return measure.route_pois(segs(spark, d), pois(spark, d), ["ruins", "peak"], P.poi_radius_m).select(*ROUTE, "kind", "feature_id", r3("d"))


# elevation

ELEVATED = SAMPLES + """,
tiles AS (SELECT grid_row, grid_col, arg_max(elev, tile_ord) FILTER (WHERE elev IS NOT NULL) AS elev FROM dem GROUP BY ALL),
elevated AS MATERIALIZED (SELECT s.area_id, s.route_id, s.idx, t.elev FROM samples s LEFT JOIN tiles t ON t.grid_row = floor((s.lat - 50) / 5e-4 + 1e-6) AND t.grid_col = floor((s.lon - 15 - s.area_id * 2e-1) / 7.5e-4 + 1e-6))"""


def elevated(spark: SparkSession, d: str, points: DataFrame | None = None) -> DataFrame:
    """The sample points with the raster's elevation."""
    points = samples(spark, d) if points is None else points
    return elevation.dem_lookup(points.select("*", *fixture.grid_of(F.col("lat"), F.col("lon"), F.col("area_id"))), fixture.dem_cells(spark, d))


@query(ELEVATED + "\nSELECT area_id, route_id, idx, round(elev, 3) AS elev FROM elevated")
def dem_lookup(spark: SparkSession, d: str) -> DataFrame:
    return elevated(spark, d).select(*ROUTE, "idx", r3("elev"))


FILLED = """filled AS MATERIALIZED (SELECT area_id, route_id, idx, coalesce(last_value(elev IGNORE NULLS) OVER (PARTITION BY route_id, b ORDER BY idx ROWS UNBOUNDED PRECEDING), first_value(elev IGNORE NULLS) OVER (PARTITION BY route_id, b ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS elev
  FROM (SELECT *, (row_number() OVER (PARTITION BY route_id ORDER BY idx) - 1) // 100 AS b FROM elevated))"""


@query(ELEVATED + ",\n" + FILLED + "\nSELECT area_id, route_id, idx, round(elev, 3) AS elev FROM filled")
def elevation_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return elevation.filled(elevated(spark, d), ROUTE, ["idx"]).select(*ROUTE, "idx", r3("elev"))


SMOOTH = "smooth AS MATERIALIZED (SELECT area_id, route_id, idx, CASE WHEN count(*) OVER (PARTITION BY route_id) > 3 THEN avg(elev) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE elev END AS elev FROM filled)"


@query("SELECT user_id, event_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) > 3 THEN avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE value END, 3) AS elev FROM events", base=False)
def smooth_series(spark: SparkSession, d: str) -> DataFrame:
    series = fixture.table(spark, d, "events").select("user_id", "ts", "event_id", F.col("value").alias("elev"))
    return elevation.smoothed(series, ["user_id"], ["ts", "event_id"], P.smooth_window).select("user_id", "event_id", r3("elev"))


def fold_sql(series: str, key: str, order: str) -> str:
    """gain and loss per key of a series by a walk over its rows."""
    return f"""numbered AS MATERIALIZED (SELECT {key} AS k, elev, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS nth, count(*) OVER (PARTITION BY {key}) AS n, count(elev) OVER (PARTITION BY {key}) AS known FROM {series}),
walk AS (SELECT k, 1::BIGINT AS nth, elev AS ref, 0e0 AS gain, 0e0 AS loss FROM numbered WHERE nth = 1 AND n = known
  UNION ALL SELECT w.k, w.nth + 1, CASE WHEN abs(s.elev - ref) >= 10 THEN s.elev ELSE ref END, gain + CASE WHEN s.elev - ref >= 10 THEN s.elev - ref ELSE 0 END, loss + CASE WHEN ref - s.elev >= 10 THEN ref - s.elev ELSE 0 END FROM walk w JOIN numbered s ON s.k = w.k AND s.nth = w.nth + 1),
folded AS MATERIALIZED (SELECT w.k, gain AS gain_m, loss AS loss_m FROM walk w JOIN numbered s ON s.k = w.k AND s.nth = w.nth WHERE s.nth = s.n)"""


@query("WITH RECURSIVE series AS (SELECT user_id, ts, event_id, value AS elev FROM events),\n" + fold_sql("series", "user_id", "ts, event_id") + "\nSELECT k AS user_id, round(gain_m, 3) AS gain_m, round(loss_m, 3) AS loss_m FROM folded", base=False)
def gain_loss(spark: SparkSession, d: str) -> DataFrame:
    series = fixture.table(spark, d, "events").select("user_id", "ts", "event_id", F.col("value").alias("elev"))
    return elevation.gain_loss(series, ["user_id"], ["ts", "event_id"], P.gain_threshold_m).select("user_id", r3("gain_m"), r3("loss_m"))


def route_gain(spark: SparkSession, d: str, points: DataFrame | None = None) -> DataFrame:
    """gain_m and loss_m of each route: raster, fill, smoothing, fold."""
    return elevation.gain_loss(elevated(spark, d, points), ROUTE, ["idx"], P.gain_threshold_m, P.smooth_window, elevation.BATCH)


GAIN = ELEVATED + ",\n" + FILLED + ",\n" + SMOOTH + ",\n" + fold_sql("smooth", "route_id", "idx")


@query((fixture.SQL + ",\n" + GAIN).replace("WITH ln", "WITH RECURSIVE ln", 1) + "\nSELECT k AS route_id, round(gain_m, 3) AS gain_m, round(loss_m, 3) AS loss_m FROM folded", base=False)
def elevation_gain(spark: SparkSession, d: str) -> DataFrame:
    return route_gain(spark, d).select("route_id", r3("gain_m"), r3("loss_m"))


@query(ELEVATED + """,
told AS (SELECT *, 0 AS source FROM elevated UNION ALL SELECT area_id, route_id, idx, 500e0 + idx, 1 FROM samples WHERE route_id % 3 = 0),
complete AS (SELECT route_id, min(source) AS source FROM (SELECT route_id, source FROM told GROUP BY ALL HAVING count(*) = count(elev)) GROUP BY ALL)
SELECT area_id, route_id, idx, source, round(elev, 3) AS elev FROM told JOIN complete USING (route_id, source)""")
def elevation_fallback(spark: SparkSession, d: str) -> DataFrame:
    points = samples(spark, d)
    raster = elevated(spark, d).select(*ROUTE, "idx", "elev", F.lit(0).alias("source"))
    other = points.where(F.col("route_id") % 3 == 0).select(*ROUTE, "idx", (500.0 + F.col("idx")).alias("elev"), F.lit(1).alias("source"))
    return elevation.first_complete(raster.unionByName(other)).select(*ROUTE, "idx", "source", r3("elev"))


KEYS = SAMPLES + ",\nkeys AS (SELECT DISTINCT round(lat * 1e7)::BIGINT AS lat_key, round(lon * 1e7)::BIGINT AS lon_key FROM samples)"


@query(KEYS + "\nSELECT lat_key, lon_key FROM keys WHERE (lat_key + lon_key) % 3 <> 0")
def incremental_fill(spark: SparkSession, d: str) -> DataFrame:
    points = samples(spark, d)
    stored = elevation.missing_points(points, spark.createDataFrame([], "lat_key long, lon_key long, elev double")).where((F.col("lat_key") + F.col("lon_key")) % 3 == 0).withColumn("elev", F.lit(0.0))
    return elevation.missing_points(points, stored)


# search


MEASURED = ACCESS + PARKED + LIFTED + CARRIED + ",\n" + PASSED + ",\n" + FERRATA + """,
hits AS (SELECT area_id, route_id, count(*) AS n_pois FROM passed GROUP BY ALL),
measured AS MATERIALIZED (SELECT s.area_id, s.route_id, length_m, round(length_m / 1000, 2) AS distance_km, circular, gap_m, car_distance_m, coalesce(car_access, false) AS car_access, lift_distance_m, coalesce(chairlift_access, false) AS chairlift_access, lift_type,
  CASE WHEN s.area_id % 5 <> 3 THEN transit_distance_m END AS transit_distance_m, CASE WHEN s.area_id % 5 <> 3 THEN coalesce(transit_access, false) END AS transit_access, CASE WHEN s.area_id % 5 <> 3 THEN transit_type END AS transit_type, CASE WHEN s.area_id % 5 <> 3 THEN transit_near END AS transit_near,
  coalesce(n_pois, 0) AS n_pois, CASE WHEN s.area_id % 7 <> 4 OR relation_tagged THEN present END AS ferrata, relation_tagged, s.hlat, s.hlon, s.tlat, s.tlon
  FROM shape s LEFT JOIN parked USING (area_id, route_id) LEFT JOIN lifted USING (area_id, route_id) LEFT JOIN carried USING (area_id, route_id) LEFT JOIN hits USING (area_id, route_id) LEFT JOIN cabled USING (area_id, route_id))"""
FIND = Criteria(min_distance_km=1.0, max_distance_km=2.0, car_access=True, poi_kinds=("ruins", "peak"), ferrata=False, min_gain_m=50.0)
RELAXED = "coalesce(NOT relation_tagged AND distance_km >= -1.0 AND distance_km <= 4.0 AND car_distance_m <= 450 AND n_pois > 0 AND NOT ferrata, false)"
STRICT = "coalesce(NOT relation_tagged AND distance_km >= 1.0 AND distance_km <= 2.0 AND car_access AND n_pois > 0 AND NOT ferrata, false)"
RIDE = Criteria(min_distance_km=0.8, transit_access=True, circular=False, min_gain_m=20.0)
RIDE_RELAXED = "coalesce(NOT relation_tagged AND distance_km >= -1.2 AND NOT circular AND transit_distance_m <= 1500, false)"
RIDE_STRICT = "coalesce(NOT relation_tagged AND distance_km >= 0.8 AND NOT circular AND transit_access, false)"
CABLED = Criteria(max_distance_km=1.5, ferrata=True, chairlift_access=False)


def measured(spark: SparkSession, d: str, c: Criteria, margin_km: float = 0.0) -> DataFrame:
    return search.measured(fixture.search_tables(spark, d), c, P, margin_km).rows


@query(MEASURED + f"\nSELECT area_id, route_id, distance_km FROM measured WHERE {STRICT}")
def criteria_strict(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, FIND).where(criteria.accepts_geometry(FIND)).select(*ROUTE, "distance_km")


@query(MEASURED + f"\nSELECT area_id, route_id, distance_km FROM measured WHERE {RELAXED} AND NOT {STRICT}")
def near_miss_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = measured(spark, d, FIND, P.near_miss_dist_km)
    return rows.where(criteria.accepts_relaxed(FIND, P) & ~criteria.accepts_geometry(FIND)).select(*ROUTE, "distance_km")


@query(MEASURED + "\nSELECT area_id, route_id, distance_km, relation_tagged FROM measured WHERE coalesce(distance_km <= 1.5 AND ferrata AND NOT chairlift_access, false)")
def ferrata_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Cabled relations are searched where cabled routes are asked for, and only there."""
    rows = measured(spark, d, CABLED).where(criteria.accepts_geometry(CABLED))
    return rows.select(*ROUTE, "distance_km", relation_is_ferrata(F.col("tags")).alias("relation_tagged"))


@query(MEASURED + """
SELECT area_id, count(*) AS n_routes, count(*) FILTER (WHERE transit_access IS NULL) AS n_transit_unknown, count(*) FILTER (WHERE transit_access) AS n_transit, count(*) FILTER (WHERE NOT transit_access) AS n_no_transit,
  count(*) FILTER (WHERE ferrata IS NULL) AS n_ferrata_unknown, count(*) FILTER (WHERE ferrata) AS n_ferrata FROM measured WHERE NOT relation_tagged GROUP BY area_id""")
def unknown_fields(spark: SparkSession, d: str) -> DataFrame:
    """What each area knows of its routes: yes, no, or never recorded."""
    n = lambda what: F.count(F.when(what, 1))
    t, f = F.col("transit_access"), F.col("ferrata")
    rows = measured(spark, d, Criteria()).groupBy("area_id")
    return rows.agg(F.count("*").alias("n_routes"), n(t.isNull()).alias("n_transit_unknown"), n(t).alias("n_transit"), n(~t).alias("n_no_transit"), n(f.isNull()).alias("n_ferrata_unknown"), n(f).alias("n_ferrata"))


@query("""SELECT n_nationkey AS area_id, concat_ws(',', CASE WHEN n = 0 THEN 'no_routes' END, CASE WHEN n > 0 AND area_id % 7 = 4 THEN 'ferrata_unreadable' END, CASE WHEN (n = 0 OR area_id % 7 <> 4) AND area_id % 6 = 1 THEN 'ferrata_unrecorded' END,
  CASE WHEN area_id % 5 = 3 THEN 'transit_unrecorded' END, CASE WHEN area_id % 8 = 2 THEN 'poi_unknown' WHEN area_id % 3 = 0 THEN 'poi_missing' END) AS notices
FROM (SELECT n_nationkey, n_nationkey AS area_id, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT area_id, count(*) AS n FROM routes WHERE NOT rel_ferrata GROUP BY area_id) r ON r.area_id = n_nationkey)""")
def area_notices(spark: SparkSession, d: str) -> DataFrame:
    asked = Criteria(ferrata=True, transit_access=True, poi_kinds=("ruins", "castle"))
    return search.notices(fixture.search_tables(spark, d), asked).select("area_id", F.array_join("notices", ",").alias("notices"))


@query("area AS (SELECT area_id, " + hav_sql("min(least(lat1, lat2))", "min(least(lon1, lon2))", "max(greatest(lat1, lat2))", "max(greatest(lon1, lon2))") + " / 40 AS diagonal_m FROM ways GROUP BY ALL)\nSELECT area_id, route_id, round(sum(seg_m), 3) AS length_m FROM ways JOIN area USING (area_id) GROUP BY area_id, route_id, diagonal_m HAVING sum(seg_m) <= 4 * diagonal_m")
def overlength_guard(spark: SparkSession, d: str) -> DataFrame:
    s = segs(spark, d)
    area = s.groupBy("area_id").agg((haversine_m(F.min(F.least("lat1", "lat2")), F.min(F.least("lon1", "lon2")), F.max(F.greatest("lat1", "lat2")), F.max(F.greatest("lon1", "lon2"))) / 40).alias("diagonal_m"))
    return criteria.within_area(geometry.route_lengths(s), area, P.max_route_factor).select(*ROUTE, r3("length_m"))


def lookup(spark: SparkSession, d: str) -> Callable[[DataFrame], DataFrame]:
    """The raster's elevation of sample points, gaps filled. What only folds them takes raster, and fills them in the fold: no sort of all points."""
    return lambda points: elevation.filled(elevated(spark, d, points), ROUTE, ["idx"])


def raster(spark: SparkSession, d: str) -> Callable[[DataFrame], DataFrame]:
    return lambda points: elevated(spark, d, points)


def found_sql(strict: str, relaxed: str, notes: str, least_gain: int) -> str:
    """What search finds: only survivors of the cheap filter are sampled, there as here."""
    closes = "NOT circular OR gap_m <= least(150e0, 5e-2 * length_m)"
    elevated_only = GAIN.replace("FROM ways", "FROM (SELECT ways.* FROM ways JOIN kept USING (area_id, route_id)) ways", 1)
    sql = fixture.SQL + ",\n" + MEASURED + f",\nkept AS MATERIALIZED (SELECT * FROM measured WHERE {relaxed} OR {strict}),\n" + elevated_only + f""",
known AS (SELECT kept.*, {strict} AS strict, CASE WHEN {closes} THEN round_even(gain_m, 0) END AS gain_m, CASE WHEN {closes} THEN round_even(loss_m, 0) END AS loss_m FROM kept LEFT JOIN folded ON k = route_id),
noted AS (SELECT *, NOT (strict AND coalesce(gain_m >= {least_gain}, false)) AS near_miss, list_filter([CASE WHEN gain_m < {least_gain} THEN 'gain ' || gain_m::BIGINT || ' m — ' || ({least_gain} - gain_m)::BIGINT || ' m below the {least_gain} m minimum' END, {notes}], lambda x: x IS NOT NULL) AS notes FROM known),
found AS MATERIALIZED (SELECT *, count(*) FILTER (WHERE NOT near_miss) OVER (PARTITION BY area_id) AS n_strict FROM noted WHERE NOT near_miss OR (gain_m IS NOT NULL AND {least_gain} - gain_m <= {least_gain} * 0.2 AND len(notes) > 0))"""
    return sql.replace("WITH ln", "WITH RECURSIVE ln", 1)


SEARCH = found_sql(STRICT, RELAXED, """CASE WHEN distance_km < 1 THEN round(distance_km, 2)::VARCHAR || ' km — ' || round(1 - distance_km, 2)::VARCHAR || ' km below the 1.0 km minimum' END, CASE WHEN distance_km > 2 THEN round(distance_km, 2)::VARCHAR || ' km — ' || round(distance_km - 2, 2)::VARCHAR || ' km above the 2.0 km maximum' END,
  CASE WHEN NOT car_access AND car_distance_m IS NOT NULL THEN 'nearest parking ' || round_even(car_distance_m, 0)::BIGINT || ' m away — just past the 300 m limit' END""", 50)
RIDES = found_sql(RIDE_STRICT, RIDE_RELAXED, """CASE WHEN distance_km < 0.8 THEN round(distance_km, 2)::VARCHAR || ' km — ' || round(0.8 - distance_km, 2)::VARCHAR || ' km below the 0.8 km minimum' END,
  CASE WHEN NOT transit_access AND transit_distance_m IS NOT NULL THEN 'nearest public transport ' || round_even(transit_distance_m, 0)::BIGINT || ' m away — just past the ' || CASE WHEN transit_near = 'halt' THEN 1000 ELSE 400 END || ' m limit' END""", 20)
LISTED = "\nSELECT area_id, route_id, distance_km, near_miss, CASE WHEN near_miss THEN array_to_string(notes, '; ') ELSE '' END AS notes FROM found"
RANKED = "\nSELECT area_id, route_id, distance_km, gain_m, loss_m, near_miss FROM found WHERE NOT near_miss OR n_strict < 3"


def listed(rows: DataFrame) -> DataFrame:
    return rows.select(*ROUTE, "distance_km", "near_miss", F.coalesce(F.array_join("notes", "; "), F.lit("")).alias("notes"))


@query(SEARCH + LISTED, base=False)
def near_miss_notes(spark: SparkSession, d: str) -> DataFrame:
    return listed(search.search(fixture.search_tables(spark, d), FIND, raster(spark, d), P, near="always", batch=elevation.BATCH))


@query(RIDES + LISTED, base=False)
def search_by_transit(spark: SparkSession, d: str) -> DataFrame:
    """Areas that never recorded stops have no answer at all."""
    return listed(search.search(fixture.search_tables(spark, d), RIDE, raster(spark, d), P, near="always", batch=elevation.BATCH))


@query(SEARCH + RANKED, base=False)
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    return search.search(fixture.search_tables(spark, d), FIND, raster(spark, d), P, near="auto", batch=elevation.BATCH).select(*ROUTE, "distance_km", "gain_m", "loss_m", "near_miss")


@query(SEARCH + RANKED, base=False)
def search_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same from a store that holds the areas and the elevations of all their routes."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    search.record(fixture.search_tables(spark, d), Criteria(), lookup(spark, d), path, P)
    return search.search_stored(spark, path, FIND, P, near="auto").select(*ROUTE, "distance_km", "gain_m", "loss_m", "near_miss")


CLIMB = Criteria(min_distance_km=1.0, min_gain_m=50.0)


@query((fixture.SQL + ",\n" + SHAPE + ",\n" + GAIN).replace("WITH ln", "WITH RECURSIVE ln", 1) + """
SELECT area_id, route_id, distance_km, gain_m FROM (SELECT area_id, route_id, round(length_m / 1000, 2) AS distance_km, CASE WHEN NOT circular OR gap_m <= least(150e0, 5e-2 * length_m) THEN round_even(gain_m, 0) END AS gain_m FROM shape JOIN folded ON k = route_id) WHERE distance_km >= 1 AND gain_m >= 50""", base=False)
def criteria_gain(spark: SparkSession, d: str) -> DataFrame:
    """Routes of a kilometre or more with at least 50 m of gain, most gain first. Lengths are cheap, so they decide first."""
    v = fixture.vertices(spark, d)
    long = geometry.route_lengths(geometry.segments(v)).where(F.round(F.col("length_m") / 1000, 2) >= CLIMB.min_distance_km).select(*ROUTE)
    v = cut(v.join(long, ROUTE, "left_semi"))
    line = cut(stitch.stitch(v))
    rows = cut(measure.shapes(fixture.routes(spark, d), v, line, P).withColumn("distance_km", F.round(F.col("length_m") / 1000, 2)))
    out = search.elevated(rows, line, lambda points: elevated(spark, d, points), P, elevation.BATCH).where(criteria.accepts_gain(CLIMB))
    return out.select(*ROUTE, "distance_km", "gain_m").orderBy(F.desc("gain_m"), "area_id", "route_id")


# inventories, names, exports


@query("SELECT area_id, kind, min(feature_id) AS feature_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pois WHERE kind IS NOT NULL GROUP BY area_id, kind, pois.lat, pois.lon")
def poi_inventory(spark: SparkSession, d: str) -> DataFrame:
    return inventory.select_pois(pois(spark, d)).select("area_id", "kind", "feature_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SELECT area_id, kind, count(DISTINCT (lat, lon)) AS n FROM pois WHERE kind IS NOT NULL GROUP BY ALL")
def poi_counts(spark: SparkSession, d: str) -> DataFrame:
    return inventory.count_by_kind(pois(spark, d)).select("area_id", "kind", "n")


@query("""SELECT area_id, 'way' AS source, route_id, way_idx, scale, round(seg_m, 3) AS length_m FROM ways WHERE scale IS NOT NULL
UNION ALL SELECT area_id, 'route', route_id, -1, NULL, round(sum(seg_m), 3) FROM ways JOIN routes USING (area_id, route_id) WHERE rel_ferrata GROUP BY area_id, route_id""")
def ferrata_inventory(spark: SparkSession, d: str) -> DataFrame:
    routes, ways = fixture.routes(spark, d).where(relation_is_ferrata(F.col("tags"))), fixture.ways(spark, d)
    s = segs(spark, d)
    cabled = ways.where(way_is_ferrata(F.col("tags")))
    both = inventory.select_ferrata(routes.withColumn("name", F.col("tags")["name"]), s, cabled)
    return both.select("area_id", "source", "route_id", "way_idx", "scale", r3("length_m"))


@query("""SELECT area_id, feature_id, 'poi' AS class, kind FROM pois WHERE kind IS NOT NULL UNION ALL SELECT area_id, feature_id, 'parking', NULL FROM parking
UNION ALL SELECT area_id, feature_id, CASE WHEN kind = 'chair_lift' THEN 'lift' ELSE 'transit' END, kind FROM stops WHERE kind IN ('chair_lift', 'bus_stop', 'halt')""")
def feature_split(spark: SparkSession, d: str) -> DataFrame:
    return elements.features(elements.split(raw_elements(spark, d))).select("area_id", "feature_id", "class", "kind").withColumn("feature_id", F.col("feature_id") % 1_000_000_000)


def raw_elements(spark: SparkSession, d: str) -> DataFrame:
    """The fixture's objects as raw elements, each twice."""
    bare = {"lat": "double", "lon": "double", "center": f"{elements.POINT}", "geometry": f"array<{elements.POINT}>", "members": f"array<struct<type string, ref long, role string, geometry array<{elements.POINT}>>>"}
    parked = fixture.parking(spark, d).withColumn("tags", F.create_map(F.lit("amenity"), F.lit("parking")))
    rows = [df.select("area_id", (F.col("feature_id") + k * 1_000_000_000).alias("id"), "tags", "lat", "lon") for k, df in enumerate((fixture.pois(spark, d), parked, fixture.stops(spark, d)))]
    rows = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")))
    return rows.select("area_id", "pos", F.lit("node").alias("type"), "id", "tags", "lat", "lon", *(F.lit(None).cast(t).alias(c) for c, t in bare.items() if c not in ("lat", "lon")))


@query("SELECT area_id, route_id, coalesce(tag_name, tag_ref, 'route/' || route_id) AS name, tag_name IS NULL AND tag_ref IS NULL AS unnamed FROM routes")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    tags = F.col("tags")
    return fixture.routes(spark, d).select(*ROUTE, *elements.display_name(tags["name"], tags["ref"], F.col("route_id")))


PLACE = "CASE WHEN (floor({0} * 1e4)::BIGINT + floor({1} * 1e4)::BIGINT) % 5 = 0 THEN NULL ELSE 'Place ' || (round({0} * 200)::BIGINT % 20) END"


@query(START + f""",
far AS (SELECT s.area_id, s.route_id, min((-round({hav_sql("s.lat", "s.lon", "t.lat", "t.lon")}, 6), t.lat, t.lon)) AS f FROM starts s JOIN shape h USING (area_id, route_id) JOIN tips2 t USING (area_id, route_id) WHERE NOT h.circular AND (s.lat, s.lon) <> (t.lat, t.lon) GROUP BY ALL),
named AS (SELECT s.area_id, s.route_id, circular, {PLACE.format("s.lat", "s.lon")} AS sp, {PLACE.format("f[2]", "f[3]")} AS ep FROM starts s JOIN shape USING (area_id, route_id) LEFT JOIN far USING (area_id, route_id) JOIN routes r USING (area_id, route_id) WHERE tag_name IS NULL AND tag_ref IS NULL)
SELECT area_id, route_id, CASE WHEN circular THEN 'loop near ' || sp WHEN sp <> ep THEN sp || ' → ' || ep ELSE 'near ' || coalesce(sp, ep) END AS label FROM named""")
def route_names(spark: SparkSession, d: str) -> DataFrame:
    shape, _, ends = surveyed(spark, d)
    rows = inventory.label_points(cut(starts(spark, d, shape, ends).join(shape, ROUTE)), ends)
    unnamed = fixture.routes(spark, d).where(F.col("tags")["name"].isNull() & F.col("tags")["ref"].isNull()).select(*ROUTE)
    place = lambda p: F.when(p.isNotNull() & ((F.floor(p["lat"] * 1e4) + F.floor(p["lon"] * 1e4)) % 5 != 0), F.concat(F.lit("Place "), F.round(p["lat"] * 200).cast("long") % 20))
    return rows.join(unnamed, ROUTE).select(*ROUTE, inventory.compose_label(place(F.col("start")), place(F.col("far")), F.col("circular")).alias("label"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'V' || c_custkey % 10 END, CASE WHEN c_custkey % 4 = 0 THEN 'C' || c_custkey % 7 END, c_name) AS place FROM customer", base=False)
def place_parse(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    address = F.map_from_entries(F.array_compact(F.array(F.when(key % 4 == 0, F.struct(F.lit("city"), F.concat(F.lit("C"), key % 7))), F.when(key % 3 == 0, F.struct(F.lit("village"), F.concat(F.lit("V"), key % 10))))))
    return fixture.table(spark, d, "customer").select("c_custkey", inventory.parse_place(address, F.col("c_name")).alias("place"))


@query("""a AS (SELECT n_nationkey AS area_id FROM nation)
SELECT area_id, (SELECT count(*) FROM routes r WHERE r.area_id = a.area_id) AS n_routes, (SELECT count(*) FROM pois p WHERE p.area_id = a.area_id AND kind IS NOT NULL) AS n_features, (SELECT count(*) FROM ways w WHERE w.area_id = a.area_id) AS n_ways FROM a""")
def area_catalog(spark: SparkSession, d: str) -> DataFrame:
    areas = fixture.table(spark, d, "nation").select(F.col("n_nationkey").alias("area_id"))
    return store.catalog(areas, routes=fixture.routes(spark, d), features=pois(spark, d), ways=fixture.ways(spark, d))


@query("""recorded AS (SELECT area_id, list_distinct(list(kind) FILTER (WHERE kind IS NOT NULL)) AS kinds FROM pois GROUP BY area_id)
SELECT n_nationkey AS area_id, array_to_string(list_sort(list_filter(['castle', 'peak', 'ruins'], lambda k: NOT list_contains(coalesce(kinds, []), k))), ',') AS lacking, CASE WHEN kinds IS NULL THEN 'unknown' WHEN list_has_all(kinds, ['castle', 'peak', 'ruins']) THEN 'ok' ELSE 'missing' END AS state FROM nation LEFT JOIN recorded ON area_id = n_nationkey""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    recorded = pois(spark, d).groupBy("area_id").agg(F.collect_set("kind").alias("kinds"))
    lacking, state = unrecorded(F.col("kinds"), F.array(F.lit("castle"), F.lit("peak"), F.lit("ruins")))
    return fixture.table(spark, d, "nation").select(F.col("n_nationkey").alias("area_id")).join(recorded, "area_id", "left").select("area_id", F.array_join(F.array_sort(lacking), ",").alias("lacking"), state.alias("state"))


def described(spark: SparkSession, d: str) -> tuple[DataFrame, search.Measured]:
    """All routes as a search without criteria finds them, with surface, start and summary."""
    tables = fixture.search_tables(spark, d)
    m = search.measured(tables, Criteria(), P)
    rows = search.described(cut(search.elevated(m.rows, m.line, raster(spark, d), P, elevation.BATCH)), m, tables, P)
    rows = rows.withColumn("near_miss", F.lit(False)).withColumn("notes", F.lit(None).cast("array<string>")).withColumn("place_name", F.lit(None).cast("string"))
    return cut(rows.withColumn("line", export.summary_line())), m


DESCRIBED = (fixture.SQL + ",\n" + MEASURED.replace(ACCESS, START, 1) + ",\n" + GAIN).replace("WITH ln", "WITH RECURSIVE ln", 1) + """,
mix1 AS (SELECT area_id, route_id, surface AS value, sum(seg_m) AS m FROM ways GROUP BY ALL), mix2 AS (SELECT area_id, route_id, sum(m) AS total, coalesce(sum(m) FILTER (WHERE value IS NOT NULL), 0) AS known FROM mix1 GROUP BY ALL),
mix AS (SELECT area_id, route_id, first(value ORDER BY -m, value) AS value, max(m) / any_value(total) AS fraction, any_value(known / total) AS coverage FROM mix1 JOIN mix2 USING (area_id, route_id) WHERE value IS NOT NULL AND area_id % 7 <> 4 GROUP BY ALL),
described AS MATERIALIZED (SELECT m.*, starts.lat AS slat, starts.lon AS slon, CASE WHEN NOT circular OR gap_m <= least(150e0, 5e-2 * length_m) THEN round_even(gain_m, 0)::BIGINT END AS gain, CASE WHEN NOT circular OR gap_m <= least(150e0, 5e-2 * length_m) THEN round_even(loss_m, 0)::BIGINT END AS loss,
  value, fraction, coverage, coalesce(tag_name, tag_ref, 'route/' || m.route_id) AS name, CASE WHEN m.area_id % 7 <> 4 THEN cabled.cabled_m ELSE 0 END AS own_cabled_m, CASE WHEN m.area_id % 7 <> 4 THEN cabled.grades ELSE '' END AS own_grades
  FROM measured m JOIN starts USING (area_id, route_id) JOIN routes USING (area_id, route_id) JOIN cabled USING (area_id, route_id) LEFT JOIN mix USING (area_id, route_id) LEFT JOIN folded ON k = m.route_id WHERE NOT m.relation_tagged),
lined AS MATERIALIZED (SELECT *, name || ' — ' || distance_km || ' km, ' || coalesce('+' || gain || ' m / -' || loss || ' m', 'gain n/a') || ' [' || concat_ws(', ', CASE WHEN circular THEN 'loop' ELSE 'one-way' END, CASE WHEN car_access THEN 'car' END, CASE WHEN chairlift_access THEN 'lift:' || lift_type END,
  CASE WHEN transit_access THEN 'transit:' || CASE transit_type WHEN 'halt' THEN 'train halt' ELSE 'bus stop' END END,
  CASE WHEN round(coverage, 9) >= 0.5 THEN CASE WHEN round(fraction, 9) >= 0.4 THEN 'surface:' || value || ' ' || round_even(fraction * 100, 0)::BIGINT || '%' ELSE 'surface:mixed (' || round_even(coverage * 100, 0)::BIGINT || '% known)' END END,
  CASE WHEN ferrata THEN concat_ws(' ', 'ferrata', nullif(own_grades, ''), CASE WHEN own_cabled_m > 0 THEN printf('%.1f', own_cabled_m / 1000) || ' km' END) END)
  || '] (start ' || printf('%.4f,%.4f', slat, slon) || ', OSM relation ' || route_id || ')' AS line FROM described)"""


@query(DESCRIBED + "\nSELECT area_id, route_id, line FROM lined", base=False)
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    return described(spark, d)[0].select(*ROUTE, "line")


@query(DESCRIBED + """
SELECT area_id, route_id, name, distance_km, gain::DOUBLE AS gain_m, circular, transit_access, CASE transit_type WHEN 'halt' THEN 'train halt' WHEN 'bus_stop' THEN 'bus stop' END AS transit_label, round(coverage, 3) AS coverage, value AS surface, CASE WHEN ferrata IS NOT NULL THEN round_even(own_cabled_m, 0)::BIGINT END AS cabled_m,
  round(slat, 6) AS start_lat, round(slon, 6) AS start_lon FROM described""", base=False)
def row_views(spark: SparkSession, d: str) -> DataFrame:
    rows = described(spark, d)[0].select(*export.row_view())
    return rows.select(*ROUTE, "name", "distance_km", "gain_m", "circular", "transit_access", "transit_label", F.col("surface.coverage").alias("coverage"), F.col("surface.value").alias("surface"), F.col("ferrata.length_m").alias("cabled_m"), F.round("start.lat", 6).alias("start_lat"), F.round("start.lon", 6).alias("start_lon"))


PARTS = """
SELECT area_id, route_id, name, n_lines, n_points FROM (SELECT d.area_id, d.route_id, any_value(name) AS name, CASE WHEN any_value(gain) IS NOT NULL THEN 1 ELSE count(*) END AS n_lines, CASE WHEN any_value(gain) IS NOT NULL THEN any_value(n_samples) ELSE 2 * count(*) END AS n_points
  FROM described d JOIN ways USING (area_id, route_id) JOIN (SELECT route_id, count(*) AS n_samples FROM samples GROUP BY route_id) n USING (route_id) GROUP BY ALL)"""


@query(DESCRIBED + PARTS, base=False)
def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    """Features read back: what each route's geometry is made of."""
    rows, m = described(spark, d)
    tracks = search.tracks(rows, m.line, lookup(spark, d), P)
    text = export.geojson_features(rows.select(*ROUTE, "name", "distance_km", "gain_m"), export.route_lines(fixture.vertices(spark, d)), tracks)
    read = F.from_json("value", "geometry struct<type string, coordinates array<array<array<double>>>>, properties struct<name string>")
    lines = F.col("f.geometry.coordinates")
    return text.select(*ROUTE, read.alias("f")).select(*ROUTE, F.col("f.properties.name").alias("name"), F.size(lines).cast("long").alias("n_lines"), F.size(F.flatten(lines)).cast("long").alias("n_points"))


@query(DESCRIBED + PARTS, base=False)
def gpx_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks read back, likewise."""
    rows, m = described(spark, d)
    text = export.gpx_tracks(rows, export.route_lines(fixture.vertices(spark, d)), search.tracks(rows, m.line, lookup(spark, d), P))
    n = lambda tag: F.regexp_count("trk", F.lit(tag)).cast("long")
    return text.select(*ROUTE, F.regexp_extract("trk", "<trk><name>(.*?)</name>", 1).alias("name"), n("<trkseg>").alias("n_lines"), n("<trkpt ").alias("n_points"))


@query("SELECT area_id, feature_id, coalesce(name, CASE kind WHEN 'church' THEN 'place of worship' WHEN 'ruins' THEN 'ruin' WHEN 'tree' THEN 'named tree' ELSE kind END) AS shown, kind FROM pois WHERE kind IS NOT NULL")
def gpx_waypoints(spark: SparkSession, d: str) -> DataFrame:
    text = export.gpx_waypoints(pois(spark, d))
    return text.select("area_id", "feature_id", F.regexp_extract("value", "<name>(.*?)</name>", 1).alias("shown"), F.regexp_extract("value", "<type>(.*?)</type>", 1).alias("kind"))


@query("SELECT area_id, feature_id, kind, name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pois WHERE kind IS NOT NULL")
def point_features(spark: SparkSession, d: str) -> DataFrame:
    f = F.from_json("value", "geometry struct<coordinates array<double>>, properties struct<kind string, name string>")
    text = export.point_features(pois(spark, d)).select("area_id", "feature_id", f.alias("f"))
    return text.select("area_id", "feature_id", "f.properties.kind", "f.properties.name", F.round(F.get("f.geometry.coordinates", F.lit(1)), 6).alias("lat"), F.round(F.get("f.geometry.coordinates", F.lit(0)), 6).alias("lon"))


def broken_vertices(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """The fixture's ways as a map has them: some turned round; and, but for whole, some missing, in no order."""
    rows = fixture.steps(spark, d).where(F.lit(whole) | (F.col("l_quantity") <= 48)).select(*ROUTE, "way_idx", (F.col("l_suppkey") % 3 == 0).alias("turned"))
    v = fixture.vertices(spark, d).join(rows, [*ROUTE, "way_idx"])
    v = v.withColumn("vtx_idx", F.when(F.col("turned"), 1 - F.col("vtx_idx")).otherwise(F.col("vtx_idx"))).drop("turned")
    return v if whole else v.withColumn("way_idx", F.xxhash64("route_id", "way_idx"))


@query()
def stitch_lines(spark: SparkSession, d: str) -> DataFrame:
    return stitch.stitch(broken_vertices(spark, d)).select(*ROUTE, "pos", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query()
def faithful_lines(spark: SparkSession, d: str) -> DataFrame:
    broken = cut(broken_vertices(spark, d))
    return stitch.faithful(geometry.route_lengths(geometry.segments(broken)), stitch.stitch(broken))


@query(SHAPE + "\nSELECT area_id, route_id, round(length_m, 3) AS length_m, rank, round(gap_m, 3) AS gap_m, circular FROM shape WHERE rank = 0")
def shapes_of_turned_ways(spark: SparkSession, d: str) -> DataFrame:
    """Of routes that pass no place twice: ways that are turned round give the same shape as ways that are not."""
    v = cut(broken_vertices(spark, d, whole=True))
    return measure.shapes(fixture.routes(spark, d), v, stitch.stitch(v), P).where("rank = 0").select(*ROUTE, r3("length_m"), "rank", r3("gap_m"), "circular")


@query(ACCESS + PARKED + "\nSELECT area_id, route_id, round(car_distance_m, 3) AS car_distance_m, car_access FROM parked JOIN shape USING (area_id, route_id) WHERE rank = 0")
def car_access_of_turned_ways(spark: SparkSession, d: str) -> DataFrame:
    v = cut(broken_vertices(spark, d, whole=True))
    line = cut(stitch.stitch(v))
    points = measure.access_points(cut(measure.shapes(fixture.routes(spark, d), v, line, P).where("rank = 0")), line, geometry.termini(geometry.welded(geometry.segments(v))))
    points = cut(points.join(measure.circuit_ranks(geometry.welded(geometry.segments(v))).where("rank = 0"), ROUTE, "left_semi"))
    return measure.car_access(points, fixture.parking(spark, d), P).select(*ROUTE, r3("car_distance_m"), "car_access")


# stores, elevations and names as they were recorded


@query(KEYS + "\nSELECT lat_key, lon_key, round(CASE WHEN (lat_key + lon_key) % 3 = 0 THEN 7e0 ELSE 5e0 END, 3) AS elev FROM keys")
def fill_added(spark: SparkSession, d: str) -> DataFrame:
    """A store with what was looked up: what it held stays."""
    places = elevation.missing_points(samples(spark, d), spark.createDataFrame([], "lat_key long, lon_key long, elev double"))
    held = places.where((F.col("lat_key") + F.col("lon_key")) % 3 == 0).withColumn("elev", F.lit(7.0))
    return elevation.added(held, places.withColumn("elev", F.lit(5.0))).select("lat_key", "lon_key", r3("elev"))


@query("SELECT area_id, feature_id, CASE WHEN teller % 4 < 2 AND teller % 5 <> 0 THEN 'P' || teller END AS place FROM (SELECT area_id, feature_id, min(feature_id) OVER (PARTITION BY round(lat * 1e7)::BIGINT, round(lon * 1e7)::BIGINT) AS teller FROM parking)")
def stored_places(spark: SparkSession, d: str) -> DataFrame:
    """Names from a store: old ones and blanks say nothing. A place has one name there, that of the smallest feature_id."""
    points = fixture.parking(spark, d).withColumn("lat_key", coordinate_key(F.col("lat"))).withColumn("lon_key", coordinate_key(F.col("lon")))
    key, now = F.col("feature_id"), F.to_timestamp(F.lit("2024-06-01"))
    kept = points.select("lat_key", "lon_key", key.alias("teller"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("P"), key)).alias("place"), F.when(key % 4 < 2, F.to_timestamp(F.lit("2024-01-01"))).otherwise(F.to_timestamp(F.lit("2022-01-01"))).alias("fetched_at"))
    kept = kept.groupBy("lat_key", "lon_key").agg(F.min_by("place", "teller").alias("place"), F.min_by("fetched_at", "teller").alias("fetched_at"))
    return inventory.stored_place(points, kept, now, P.place_ttl_days).select("area_id", "feature_id", "place")


@query("SELECT area_id, route_id, round(min(lat) - 250 / 111320e0, 6) AS south, round(max(lat) + 250 / 111320e0, 6) AS north FROM (SELECT area_id, route_id, unnest([lat1, lat2]) AS lat FROM ways) GROUP BY ALL")
def padded_boxes(spark: SparkSession, d: str) -> DataFrame:
    bounds = fixture.vertices(spark, d).groupBy(*ROUTE).agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))))
    south, north, _, _ = box((F.col("lo_lat"), F.col("hi_lat")), (F.col("lo_lon"), F.col("hi_lon")), P.poi_radius_m)
    return bounds.select(*ROUTE, F.round(south, 6).alias("south"), F.round(north, 6).alias("north"))


from . import document_queries, file_queries, linear_queries, network_queries  # noqa: E402, F401
