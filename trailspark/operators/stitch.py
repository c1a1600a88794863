"""One walking line out of a route's ways.

The line begins as the first way and takes in, again and again, the first other way that continues one of its two ends within a
tolerance; ways that never fit are left out. Where each way already begins at the end of the one before, that is the ways as they
come, and no Python is needed; of other routes the ends of the ways are packed and chained, as each choice hangs on those before,
and the points follow from that without Python.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine_m
from .geometry import ROUTE, along, segments
from .lineage import cut

#: How far apart the ends of two ways may be.
TOLERANCE_M = 30.0


def gaps_m(point: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Great-circle distances from one (lat, lon) to many."""
    (y, x), (v, u) = np.radians(point), np.radians(others).T
    h = np.sin((v - y) / 2) ** 2 + np.cos(y) * np.cos(v) * np.sin((u - x) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def order_of(heads: np.ndarray, tails: np.ndarray, tolerance_m: float = TOLERANCE_M) -> list[tuple[int, bool]]:
    """The ways of the line in walking order, and whether each is turned round. Each way has four places in a table of fits, in order
    of preference: its head or its tail at the line's end, its tail or its head at the line's beginning. The first place that is open
    and fits, by way, is taken; then only the two columns of the end that moved are measured anew."""
    n = len(heads)
    if not n:
        return []
    fits, is_open, line = np.zeros((n, 4), bool), np.ones((n, 1), bool), deque([(0, False)])
    is_open[0] = False

    def moved(end: np.ndarray, columns: tuple[int, int]) -> None:
        fits[:, columns[0]], fits[:, columns[1]] = gaps_m(end, heads) <= tolerance_m, gaps_m(end, tails) <= tolerance_m

    moved(tails[0], (0, 1))
    moved(heads[0], (3, 2))
    while (places := np.flatnonzero(fits & is_open)).size:
        way, place = divmod(int(places[0]), 4)
        is_open[way] = False
        if place < 2:
            line.append((way, place == 1))
            moved(tails[way] if place == 0 else heads[way], (0, 1))
        else:
            line.appendleft((way, place == 3))
            moved(heads[way] if place == 2 else tails[way], (3, 2))
    return list(line)


def orders(ends: DataFrame, tolerance_m: float) -> DataFrame:
    """area_id, route_id, way_idx, place (in the line), turned, side (-1 before the first way, 0, 1 after it) of the ways that a line takes in.
    ends: area_id, route_id, way_idx, head, tail (structs of lat, lon). Only the ends of ways go to Python, many routes a batch."""
    packed = ends.groupBy(*ROUTE).agg(F.array_sort(F.collect_list(F.struct("way_idx", "head", "tail"))).alias("w"))
    flat = lambda end: F.flatten(F.transform("w", lambda x: F.array(x[end]["lat"], x[end]["lon"]))).alias(end)
    packed = packed.select(*ROUTE, F.transform("w", lambda x: x["way_idx"]).alias("ways"), flat("head"), flat("tail"))
    kind = dict(ends.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = {c: b[c].flatten().to_numpy() for c in ("ways", "head", "tail")}
            n = b["ways"].value_lengths().to_numpy()
            row, way, place, turned, side = [], [], [], [], []
            for k, (first, size) in enumerate(zip(np.cumsum(n) - n, n, strict=True)):
                at = slice(2 * first, 2 * (first + size))
                line = order_of(flat["head"][at].reshape(-1, 2), flat["tail"][at].reshape(-1, 2), tolerance_m)
                start = next(i for i, (w, _) in enumerate(line) if w == 0)
                row += [k] * len(line)
                way += [first + w for w, _ in line]
                place += range(len(line))
                turned += [t for _, t in line]
                side += [int(np.sign(i - start)) for i in range(len(line))]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_pydict({"area_id": b["area_id"].take(at), "route_id": b["route_id"].take(at), "way_idx": pa.array(flat["ways"][np.array(way, np.int64)]), "place": pa.array(place, pa.int64()), "turned": pa.array(turned, pa.bool_()), "side": pa.array(side, pa.int64())})

    return packed.mapInArrow(run, f"area_id {kind['area_id']}, route_id {kind['route_id']}, way_idx {kind['way_idx']}, place long, turned boolean, side long")


def walked(vertices: DataFrame, tolerance_m: float = TOLERANCE_M, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What lines and segments are made of, in one pass, written once: the vertices of ways of two or more, with the next one of the way (lat2, lon2;
    none where goes_on is false), joint (a way's first vertex, where the one before ends), pos (in the line of ways as they come) and in_order (whether
    these continue one another). keep: picks rows by their route's length_m, which lives no longer."""
    way = Window.partitionBy(*ROUTE, "way_idx")
    rows = vertices.select(*ROUTE, "way_idx", "vtx_idx", "lat", "lon").withColumn("n", F.count("*").over(way)).where("n > 1").drop("n")
    before, after = lambda c: F.lag(c).over(along()), lambda c: F.lead(c).over(along())
    rows = rows.withColumn("goes_on", F.coalesce(after("way_idx") == F.col("way_idx"), F.lit(False)))
    rows = rows.withColumn("lat2", F.when(F.col("goes_on"), after("lat"))).withColumn("lon2", F.when(F.col("goes_on"), after("lon")))
    new_way = before("way_idx").isNotNull() & (before("way_idx") != F.col("way_idx"))
    rows = rows.withColumn("joint", F.coalesce(new_way, F.lit(False))).withColumn("gap", F.when(F.col("joint"), haversine_m(before("lat"), before("lon"), F.col("lat"), F.col("lon"))))
    so_far = along().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("pos", F.sum(F.when(F.col("joint"), 0).otherwise(1)).over(so_far).cast("long") - 1)
    route = Window.partitionBy(*ROUTE)
    rows = rows.withColumn("in_order", F.coalesce(F.max("gap").over(route), F.lit(0.0)) <= tolerance_m).drop("gap")
    if keep is not None:
        rows = keep(rows.withColumn("length_m", F.sum(F.when(F.col("goes_on"), haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))).over(route))).drop("length_m")
    return cut(rows)


def segments_of(rows: DataFrame) -> DataFrame:
    """What geometry.segments gives, from rows of walked."""
    seg_m = haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return rows.where("goes_on").select(*ROUTE, "way_idx", "vtx_idx", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "lat2", "lon2", seg_m.alias("seg_m"))


def stitch(vertices: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """area_id, route_id, pos, lat, lon of each route's line; ways of a single vertex are left out, routes without others have no row."""
    return lines(walked(vertices, tolerance_m), tolerance_m)


def lines(rows: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """What stitch gives, from rows of walked: lines of ways in order are read from these, only the others are written."""
    loose = rows.where("not in_order").select(*ROUTE, "way_idx", "vtx_idx", "lat", "lon")
    at = F.struct("lat", "lon")
    ends = loose.groupBy(*ROUTE, "way_idx").agg(F.min_by(at, "vtx_idx").alias("head"), F.max_by(at, "vtx_idx").alias("tail"), F.min("vtx_idx").alias("low"), F.max("vtx_idx").alias("high"))
    placed = orders(ends, tolerance_m).join(ends.select(*ROUTE, "way_idx", "low", "high"), [*ROUTE, "way_idx"])
    # a way after the first gives up the point that it begins at, one before it the point that it ends at
    given = F.when(F.col("side") == 0, None).when((F.col("side") > 0) != F.col("turned"), F.col("low")).otherwise(F.col("high"))
    walked = Window.partitionBy(*ROUTE).orderBy("place", F.when(F.col("turned"), -F.col("vtx_idx")).otherwise(F.col("vtx_idx")))
    kept = loose.join(placed.select(*ROUTE, "way_idx", "place", "turned", given.alias("given")), [*ROUTE, "way_idx"]).where(F.col("given").isNull() | (F.col("vtx_idx") != F.col("given")))
    chained = cut(kept.select(*ROUTE, (F.row_number().over(walked) - 1).cast("long").alias("pos"), "lat", "lon"))
    plain = rows.where("in_order and not joint").select(*ROUTE, "pos", "lat", "lon")
    return plain.unionByName(chained)


def line_segments(line: DataFrame) -> DataFrame:
    """The line as segments of a single way, for operators on segments."""
    return segments(line.select(*ROUTE, F.lit(0).alias("way_idx"), F.col("pos").alias("vtx_idx"), "lat", "lon"))


def line_ends(line: DataFrame) -> DataFrame:
    """area_id, route_id, head and tail (structs of lat, lon) of lines of two points or more."""
    at = F.struct("lat", "lon")
    return line.groupBy(*ROUTE).agg(F.min_by(at, "pos").alias("head"), F.max_by(at, "pos").alias("tail"), F.count("*").alias("n")).where("n > 1").drop("n")


def faithful(length: DataFrame, line: DataFrame, share: float = 0.98) -> DataFrame:
    """area_id, route_id, faithful: whether the line keeps `share` of the ways' whole length (length: area_id, route_id, length_m)."""
    kept = line_segments(line).groupBy(*ROUTE).agg(F.sum("seg_m").alias("line_m"))
    return length.select(*ROUTE, "length_m").join(kept, ROUTE, "left").select(*ROUTE, F.coalesce((F.col("line_m") >= share * F.col("length_m")) & (F.col("length_m") > 0), F.lit(False)).alias("faithful"))
