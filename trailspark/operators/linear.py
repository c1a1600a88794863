"""Linear referencing: parts of lines between two positions, their places, lengths and tags.

A line's steps and the spans asked for meet by the stretches of BUCKET metres that both touch, so a line of any length, or one with
any number of spans, is dealt over many tasks; each meeting counts in the stretch where it begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import ROUTE

#: Metres of a line that are one join key.
BUCKET = 2000.0
SPAN = [*ROUTE, "span_id"]


def spans_on(line: DataFrame, spans: DataFrame) -> DataFrame:
    """The steps of spans in walking order: area_id, route_id, span_id, pos, way_idx, vtx_idx, lat1, lon1, lat2, lon2, from_m, to_m (places on the line,
    falling where a span runs against it), m. line: what geometry.line_of gives. spans: area_id, route_id, span_id, from_m, to_m.
    The first and last step are cut at the span's ends by their share of the step's length. Ends beyond the line are moved to its
    end; steps without length, spans without length, with a null end or off the line altogether give nothing. Repeated spans are one."""
    low, high = F.least("s_from", "s_to"), F.greatest("s_from", "s_to")
    touched = lambda a, b: F.explode(F.sequence(F.floor(F.greatest(a, F.lit(0.0)) / BUCKET), F.floor(F.greatest(b, F.lit(0.0)) / BUCKET)))
    ends = line.groupBy(*ROUTE).agg(F.max("to_m").alias("end_m"))
    asked = spans.select(*SPAN, F.col("from_m").alias("s_from"), F.col("to_m").alias("s_to")).distinct().where("s_from is not null and s_to is not null").join(ends, ROUTE)
    # no span has more stretches than its line
    asked = asked.where((low < F.col("end_m")) & (high > 0)).select(*SPAN, F.greatest(low, F.lit(0.0)).alias("low"), F.least(high, "end_m").alias("high"), (F.col("s_from") > F.col("s_to")).alias("back")).where("low < high")
    steps = line.where("to_m > from_m").select(*ROUTE, "way_idx", "vtx_idx", "lat1", "lon1", "lat2", "lon2", "from_m", "to_m")
    met = steps.withColumn("stretch", touched(F.col("from_m"), F.col("to_m"))).join(asked.withColumn("stretch", touched(F.col("low"), F.col("high"))), [*ROUTE, "stretch"])
    a, b = F.greatest("from_m", "low"), F.least("to_m", "high")
    met = met.where((a < b) & (F.col("stretch") == F.floor(a / BUCKET)))
    t = lambda m: (m - F.col("from_m")) / (F.col("to_m") - F.col("from_m"))
    at = lambda c, m: F.when(m == F.col("from_m"), F.col(f"{c}1")).when(m == F.col("to_m"), F.col(f"{c}2")).otherwise(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * t(m))
    place = lambda m: F.struct(at("lat", m).alias("lat"), at("lon", m).alias("lon"), m.alias("m"))
    rows = met.select(*SPAN, "way_idx", "vtx_idx", "back", F.when(F.col("back"), place(b)).otherwise(place(a)).alias("p"), F.when(F.col("back"), place(a)).otherwise(place(b)).alias("q"))
    order = Window.partitionBy(*SPAN).orderBy(F.when(F.col("back"), -F.col("p.m")).otherwise(F.col("p.m")))
    return rows.select(
        *SPAN, (F.row_number().over(order) - 1).alias("pos"), "way_idx", "vtx_idx", F.col("p.lat").alias("lat1"), F.col("p.lon").alias("lon1"), F.col("q.lat").alias("lat2"), F.col("q.lon").alias("lon2"),
        F.col("p.m").alias("from_m"), F.col("q.m").alias("to_m"), F.abs(F.col("q.m") - F.col("p.m")).alias("m"),
    )


def points(steps: DataFrame) -> DataFrame:
    """The places of each span in walking order: area_id, route_id, span_id, pos, lat, lon."""
    first = F.struct(F.col("pos"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon"))
    second = F.struct((F.col("pos") + 1).alias("pos"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))
    return steps.select(*SPAN, F.explode(F.when(F.col("pos") == 0, F.array(first, second)).otherwise(F.array(second))).alias("p")).select(*SPAN, "p.*")


def tag_metres(steps: DataFrame, ways: DataFrame, key: str) -> DataFrame:
    """Metres of each span by the value of a tag of the ways below (area_id, route_id, way_idx, tags): area_id, route_id, span_id, value, m;
    a null value stands for ways without the tag or unknown ones."""
    own = ways.select(*ROUTE, "way_idx", F.try_element_at("tags", F.lit(key)).alias("value"))
    return steps.join(own, [*ROUTE, "way_idx"], "left").groupBy(*SPAN, "value").agg(F.sum("m").alias("m"))


def tag_runs(steps: DataFrame, ways: DataFrame, key: str) -> DataFrame:
    """Runs of one value of a tag along each span, in walking order: area_id, route_id, span_id, run, value, from_m, to_m (from the span's start)."""
    own = ways.select(*ROUTE, "way_idx", F.try_element_at("tags", F.lit(key)).alias("value"))
    along = Window.partitionBy(*SPAN).orderBy("pos")
    rows = steps.join(own, [*ROUTE, "way_idx"], "left")
    new = F.when((F.row_number().over(along) == 1) | ~F.col("value").eqNullSafe(F.lag("value").over(along)), 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("walked", F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return rows.groupBy(*SPAN, "run").agg(F.first("value").alias("value"), F.min(F.col("walked") - F.col("m")).alias("from_m"), F.max("walked").alias("to_m"))
