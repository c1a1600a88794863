"""Registered queries on parts of lines between two positions and on rasters of several steps, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import elevation, geometry, linear
from .operators.lineage import cut
from .queries import SAMPLES, query, r3, samples, segs
from .sources import fixture

#: Of every route: its middle half; 500 m back to 100 m; all of it and more.
SPANS = """line AS (SELECT *, sum(seg_m) OVER (PARTITION BY area_id, route_id ORDER BY way_idx) AS to_m FROM ways),
steps AS (SELECT *, coalesce(lag(to_m) OVER (PARTITION BY area_id, route_id ORDER BY way_idx), 0e0) AS from_m, max(to_m) OVER (PARTITION BY area_id, route_id) AS end_m FROM line),
spans AS (SELECT DISTINCT area_id, route_id, end_m, k AS span_id, CASE k WHEN 1 THEN end_m / 4 WHEN 2 THEN 100e0 ELSE 0e0 END AS low, CASE k WHEN 1 THEN end_m * 3 / 4 WHEN 2 THEN least(500e0, end_m) ELSE end_m END AS high, k = 2 AS back FROM steps, (SELECT unnest([1, 2, 3]) AS k)),
parts AS (SELECT s.area_id, s.route_id, p.span_id, p.back, s.way_idx, s.l_returnflag, s.i1, s.j1, s.i2, s.j2, greatest(s.from_m, p.low) AS a, least(s.to_m, p.high) AS b, (greatest(s.from_m, p.low) - s.from_m) / (s.to_m - s.from_m) AS ta, (least(s.to_m, p.high) - s.from_m) / (s.to_m - s.from_m) AS tb
  FROM steps s JOIN spans p ON p.area_id = s.area_id AND p.route_id = s.route_id WHERE greatest(s.from_m, p.low) < least(s.to_m, p.high))"""


def middle_spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The steps of the spans above, and the ways of their routes."""
    line = cut(geometry.line_of(segs(spark, d)))
    end = line.groupBy(*geometry.ROUTE).agg(F.max("to_m").alias("m"))
    span = lambda k, a, b: F.struct(F.lit(k).alias("span_id"), a.alias("from_m"), b.alias("to_m"))
    asked = F.array(span(1, F.col("m") / 4, F.col("m") * 3 / 4), span(2, F.lit(500.0), F.lit(100.0)), span(3, F.lit(-5.0), F.col("m") + 1000))
    spans = end.select(*geometry.ROUTE, F.explode(asked).alias("s")).select(*geometry.ROUTE, "s.*")
    return cut(linear.spans_on(line, spans)), fixture.ways(spark, d)


@query(SPANS + """
SELECT area_id, route_id, span_id, count(*) + 1 AS n_points, round(sum(b - a), 3) AS m,
  round(50 + arg_min(i1 + (i2 - i1) * ta, way_idx) FILTER (WHERE NOT back) * 2e-3, 6) AS lat1, round(50 + arg_max(i1 + (i2 - i1) * tb, way_idx) FILTER (WHERE NOT back) * 2e-3, 6) AS lat2,
  round(15 + area_id * 2e-1 + arg_max(j1 + (j2 - j1) * tb, way_idx) FILTER (WHERE back) * 3e-3, 6) AS lon_back
FROM parts GROUP BY area_id, route_id, span_id""")
def sub_polylines(spark: SparkSession, d: str) -> DataFrame:
    """Parts of every route between two positions: points, length, and where they begin and end."""
    steps, _ = middle_spans(spark, d)
    places = linear.points(steps).groupBy(*linear.SPAN).agg(F.count("*").alias("n_points"), F.min_by("lat", "pos").alias("lat1"), F.max_by("lat", "pos").alias("lat2"), F.min_by("lon", "pos").alias("lon1"))
    m = steps.groupBy(*linear.SPAN).agg(F.sum("m").alias("m"))
    turned = F.col("span_id") == 2
    one = lambda c, when, name: F.when(when, F.round(c, 6)).alias(name)
    return places.join(m, linear.SPAN).select(*linear.SPAN, "n_points", r3("m"), one("lat1", ~turned, "lat1"), one("lat2", ~turned, "lat2"), one("lon1", turned, "lon_back"))


@query(SPANS + """
SELECT area_id, route_id, span_id, CASE l_returnflag WHEN 'A' THEN 'asphalt' WHEN 'N' THEN 'gravel' END AS value, round(sum(b - a), 3) AS m FROM parts GROUP BY ALL""")
def span_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Metres of each surface between two positions of every route."""
    steps, ways = middle_spans(spark, d)
    return linear.tag_metres(steps, ways, "surface").select(*linear.SPAN, "value", r3("m"))


@query(SPANS + """,
valued AS (SELECT area_id, route_id, span_id, a, b, CASE WHEN back THEN -b ELSE a END AS k, coalesce(CASE l_returnflag WHEN 'A' THEN 'asphalt' WHEN 'N' THEN 'gravel' END, '') AS value FROM parts),
marked AS (SELECT *, CASE WHEN lag(value) OVER w = value THEN 0 ELSE 1 END AS new FROM valued WINDOW w AS (PARTITION BY area_id, route_id, span_id ORDER BY k)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY area_id, route_id, span_id ORDER BY k) - 1 AS run FROM marked)
SELECT area_id, route_id, span_id, CAST(run AS BIGINT) AS run, nullif(any_value(value), '') AS value, round(sum(b - a), 3) AS m FROM numbered GROUP BY area_id, route_id, span_id, run""")
def span_surface_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one surface between two positions of every route, in walking order."""
    steps, ways = middle_spans(spark, d)
    return linear.tag_runs(steps, ways, "surface").select(*linear.SPAN, F.col("run").cast("long").alias("run"), "value", r3(F.col("to_m") - F.col("from_m"), "m"))


#: A coarse raster over all and a fine one over the middle, which lies on top; all areas share them. Their edges lie off the lattice.
RASTERS = ((0, 50.1003, 14.9004, 1e-3, 1.5e-3, 200, 160, "500 + (tile_row * 7 + tile_col * 3) % 211", "(tile_row * 31 + tile_col * 17) % 97"), (1, 50.0303, 14.9804, 2.5e-4, 3.75e-4, 160, 120, "700 + (tile_row * 5 + tile_col * 11) % 173", "(tile_row * 13 + tile_col * 29) % 89"))


def rasters(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """tiles and cells as elevation.tile_lookup takes them."""
    tiles = spark.createDataFrame([(k, n - rows * y, w, n, w + cols * x, y, x) for k, n, w, y, x, rows, cols, _, _ in RASTERS], "tile_ord int, south double, west double, north double, east double, lat_step double, lon_step double")
    parts = [spark.range(rows * cols).select(F.lit(k).alias("tile_ord"), F.expr(f"id div {cols}").alias("tile_row"), (F.col("id") % cols).alias("tile_col")).select("*", F.expr(f"if({none} = 0, null, cast({elev} as double))").alias("elev")) for k, _, _, _, _, rows, cols, elev, none in RASTERS]
    return tiles, parts[0].unionByName(parts[1])


def raster_sql() -> str:
    """What each raster says of each sample, as columns e0 and e1."""
    one = lambda k, n, w, y, x, rows, cols, elev, none: f"""CASE WHEN lat > {n}::DOUBLE - {rows} * {y}::DOUBLE AND lat <= {n}::DOUBLE AND own >= {w}::DOUBLE AND own < {w}::DOUBLE + {cols} * {x}::DOUBLE THEN (SELECT CASE WHEN {none} = 0 THEN NULL ELSE ({elev})::DOUBLE END FROM (SELECT floor(({n}::DOUBLE - lat) / {y}::DOUBLE)::BIGINT AS tile_row, floor((own - {w}::DOUBLE) / {x}::DOUBLE)::BIGINT AS tile_col)) END AS e{k}"""
    return ", ".join(one(*r) for r in RASTERS)


@query(SAMPLES + f""",
placed AS (SELECT area_id, route_id, idx, lat, lon - area_id * 2e-1 AS own FROM samples)
SELECT area_id, route_id, idx, coalesce(e1, e0) AS elev FROM (SELECT *, {raster_sql()} FROM placed)""")
def mixed_dem(spark: SparkSession, d: str) -> DataFrame:
    """The sample points' elevations from two rasters of different steps."""
    points = samples(spark, d).withColumn("lon", F.col("lon") - F.col("area_id") * 2e-1)
    return elevation.tile_lookup(points, *rasters(spark)).select(*geometry.ROUTE, "idx", "elev")
