"""The trail graph: edges, contraction, loops and shortest ways. Every job works on all areas and requests at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.geo import haversine_m, weld_key
from .components import components, cut
from .geometry import welded
from .spatial import PLACE, at_places, near, near_segments, shared_places


def micro_edges(segs: DataFrame, ways: DataFrame | None, refs: bool = True) -> DataFrame:
    """Distinct welded pairs of an area: area_id, edge (hash of the pair), a, b (nodes, a < b), length_m, refs (routes), tags (of the first
    tagged way), and the ends' coordinates. Without refs, edges are as wide however many routes take them. Without ways, segs have
    the tags themselves."""
    rows = welded(segs)
    rows = rows if ways is None else rows.join(ways.select("area_id", "route_id", "way_idx", "tags"), ["area_id", "route_id", "way_idx"], "left")
    turned = F.col("u") > F.col("v")
    at = lambda k: F.struct(F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon"))
    rows = rows.select("area_id", "route_id", "way_idx", "vtx_idx", "tags", "seg_m", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.when(turned, at(2)).otherwise(at(1)).alias("pa"), F.when(turned, at(1)).otherwise(at(2)).alias("pb"))
    order = F.struct("route_id", "way_idx", "vtx_idx")
    first = lambda c: F.min_by(c, order)
    tagged = F.min_by("tags", F.when(F.size("tags") > 0, order))
    taken = [F.array_sort(F.collect_set("route_id")).alias("refs")] if refs else []
    out = rows.groupBy("area_id", "a", "b").agg(first("seg_m").alias("length_m"), *taken, tagged.alias("tags"), first("pa").alias("pa"), first("pb").alias("pb"))
    return out.withColumn("edge", F.xxhash64("area_id", "a", "b"))


def incidence(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: area_id, node, other, edge, length_m."""
    way = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("other"))
    return edges.select("area_id", "edge", "length_m", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select("area_id", "w.node", "w.other", "edge", "length_m")


def contract(edges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """edges with their segment `seg`: runs of edges through nodes of degree two are one segment, named by its smallest edge. At the nodes
    in keep (area_id, node) segments end."""
    ends = incidence(edges)
    through = ends.groupBy("area_id", "node").agg(F.count("*").alias("degree"), F.min("edge").alias("e1"), F.max("edge").alias("e2")).where("degree = 2 and e1 <> e2")
    if keep is not None:
        through = through.join(keep, ["area_id", "node"], "left_anti")
    names = components(through.select(F.col("e1").alias("a"), F.col("e2").alias("b"))).select(F.col("v").alias("edge"), F.col("label").alias("seg"))  # an edge's number holds its area
    return edges.join(names, "edge", "left").withColumn("seg", F.coalesce("seg", "edge"))


def segments_of(contracted: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """area_id, seg, a, b (end nodes; equal for rings and loops on a stem), length_m, n_edges, refs (if the edges have them). A ring without a junction or
    a kept node begins at its smallest node."""
    nodes = contracted.select("area_id", "seg", F.explode(F.array("a", "b")).alias("node")).groupBy("area_id", "seg", "node").agg(F.count("*").alias("k"))
    rows = nodes.join(nodes.groupBy("area_id", "node").agg(F.sum("k").alias("degree")), ["area_id", "node"])
    rows = rows.withColumn("kept", F.lit(False)) if keep is None else rows.join(keep.select("area_id", "node").distinct().withColumn("kept", F.lit(True)), ["area_id", "node"], "left")
    tip, knot = F.when(F.col("k") == 1, F.col("node")), F.when((F.col("degree") != 2) | F.coalesce("kept", F.lit(False)), F.col("node"))
    tips = rows.groupBy("area_id", "seg").agg(F.min(tip).alias("lo"), F.max(tip).alias("hi"), F.min(knot).alias("knot"), F.min("node").alias("any"))
    refs = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs")] if "refs" in contracted.columns else []
    sums = contracted.groupBy("area_id", "seg").agg(F.sum("length_m").alias("length_m"), F.count("*").alias("n_edges"), *refs)
    return sums.join(tips, ["area_id", "seg"]).select("area_id", "seg", F.coalesce("lo", "knot", "any").alias("a"), F.coalesce("hi", "knot", "any").alias("b"), "length_m", "n_edges", *(["refs"] if refs else []))


def segment_steps(contracted: DataFrame, segments: DataFrame) -> DataFrame:
    """area_id, seg, a, steps: the edges of each segment in order from its end a, each with the node that it begins at, the one that it leads
    to, its length and its tags."""
    rows = contracted.select("area_id", "seg", "edge", F.col("a").alias("u"), F.col("b").alias("v"), "length_m", F.to_json("tags").alias("tags")).join(segments.select("area_id", "seg", "a", "n_edges"), ["area_id", "seg"])
    step = lambda x, y: F.struct("edge", F.col(x).alias("from"), F.col(y).alias("to"), F.col("length_m").alias("m"), "tags")
    short = rows.where("n_edges = 1").select("area_id", "seg", "a", F.array(F.when(F.col("u") == F.col("a"), step("u", "v")).otherwise(step("v", "u"))).alias("steps"))

    def walk(at: tuple, edges: list[tuple]) -> list[dict]:
        """From node `at` along edges (edge, u, v, m, tags), at each node by the one whose ends come first."""
        used, out, around = set(), [], defaultdict(list)
        for edge, u, v, m, tags in sorted(edges, key=lambda e: e[1:3]):
            around[u].append((edge, v, m, tags))
            around[v].append((edge, u, m, tags))
        while ways := [x for x in around[at] if x[0] not in used]:
            edge, to, m, tags = ways[0]
            used.add(edge)
            out.append({"edge": edge, "from": {"y": at[0], "x": at[1]}, "to": {"y": to[0], "x": to[1]}, "m": m, "tags": tags})
            at = to
        return out

    node, area = "struct<y bigint, x bigint>", dict(contracted.dtypes)["area_id"]
    kind = f"area_id {area}, seg long, a {node}, steps array<struct<edge bigint, `from` {node}, `to` {node}, m double, tags string>>"
    arrow = to_arrow_schema(StructType.fromDDL(kind))
    long = rows.where("n_edges > 1").groupBy("area_id", "seg", "a").agg(F.collect_list(F.struct("edge", "u", "v", "length_m", "tags")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lambda n: (n["y"], n["x"])
        for batch in batches:
            steps = [walk(key(a), [(e["edge"], key(e["u"]), key(e["v"]), e["length_m"], e["tags"]) for e in edges]) for a, edges in zip(batch["a"].to_pylist(), batch["edges"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["area_id"], batch["seg"], batch["a"].cast(arrow.field("a").type), pa.array(steps, arrow.field("steps").type)], schema=arrow)

    return short.unionByName(long.mapInArrow(run, kind))


def segment_paths(steps: DataFrame) -> DataFrame:
    """area_id, seg, a, path: the nodes of each segment (steps: what segment_steps gives) in order, from its end a to its end b."""
    nodes = F.concat(F.array(F.get("steps", F.lit(0))["from"]), F.transform("steps", lambda x: x["to"]))
    return steps.select("area_id", "seg", "a", nodes.alias("path"))


def two_core(segments: DataFrame, rooted: DataFrame | None = None) -> DataFrame:
    """Segments that can lie on a cycle through junctions: without self-loops and, again and again, without those that end in a node
    of degree one. Nodes in rooted (area_id, node) never count as ends."""
    now = cut(segments.where("a <> b"))
    left = now.count()
    while True:
        tips = now.select("area_id", F.explode(F.array("a", "b")).alias("node")).groupBy("area_id", "node").count().where("count = 1").select("area_id", "node")
        tips = tips if rooted is None else tips.join(rooted, ["area_id", "node"], "left_anti")
        now = cut(now.join(tips.withColumnRenamed("node", "a"), ["area_id", "a"], "left_anti").join(tips.withColumnRenamed("node", "b"), ["area_id", "b"], "left_anti"))
        n = now.count()
        if n == left:
            return now
        left = n


def ring(loops: DataFrame, paths: DataFrame) -> DataFrame:
    """Every node of each loop in walking order, the first again at the end: area_id, id, pos, node."""
    steps = loops.select("area_id", "id", F.posexplode(F.arrays_zip("walk", "nodes")).alias("leg", "z")).select("area_id", "id", "leg", F.col("z.walk").alias("seg"), F.col("z.nodes").alias("node"))
    rows = steps.join(paths, ["area_id", "seg"]).withColumn("path", F.when(F.col("node") == F.col("a"), F.col("path")).otherwise(F.reverse("path")))
    body = rows.select("area_id", "id", "leg", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("k", "node")).select("area_id", "id", F.struct("leg", "k").alias("pos"), "node")
    last = loops.select("area_id", "id", F.struct(F.size("walk").alias("leg"), F.lit(0).alias("k")).alias("pos"), F.col("start").alias("node"))
    return body.unionByName(last)


def collapse(items: DataFrame, segments: DataFrame, overlap: float, keys: list[str] = ["area_id"]) -> DataFrame:  # noqa: B006
    """items (keys, id, segs, length_m) without those that share more than `overlap` of their own length with a kept shorter one of the same
    keys. Rounds: what has no undecided or kept rival before it stays, what has a kept one goes; the same as one by one, shortest
    first. An item looks for rivals by its rarest segments alone, as many as no rival can miss. An id is the same item under all keys of an
    area, so whether two are rivals is measured once an area."""
    own = keys if len(keys) == 1 else ["area_id"]
    alone = items if len(keys) == 1 else cut(items.select("area_id", "id", "segs", "length_m").dropDuplicates(["area_id", "id"]))
    parts = alone.select(*own, "id", F.round("length_m", 3).alias("m"), F.col("length_m").alias("own"), F.explode("segs").alias("seg")).join(segments.select("area_id", "seg", "length_m"), ["area_id", "seg"])
    parts = parts.withColumn("times", F.count("*").over(Window.partitionBy(*own, "seg")))
    before = Window.partitionBy(*own, "id").orderBy("times", "seg").rowsBetween(Window.unboundedPreceding, -1)
    probes = parts.withColumn("ahead", F.coalesce(F.sum("length_m").over(before), F.lit(0.0))).where(F.col("ahead") <= (1 - overlap) * F.col("own"))
    x = probes.select(*own, "seg", F.col("id").alias("late"), F.col("m").alias("late_m"))
    y = parts.select(*own, "seg", F.col("id").alias("early"), F.col("m").alias("early_m"))
    shorter = F.struct(F.col("early_m").alias("m"), F.col("early").alias("id")) < F.struct(F.col("late_m").alias("m"), F.col("late").alias("id"))
    pairs = x.join(y, [*own, "seg"]).where(shorter).select(*own, "late", "early").distinct()
    whole = parts.groupBy(*own, "id").agg(F.collect_list(F.struct("seg", "length_m")).alias("parts"), F.first("own").alias("own"))
    late, early = whole.select(*own, F.col("id").alias("late"), "parts", "own"), whole.select(*own, F.col("id").alias("early"), F.transform("parts", lambda p: p["seg"]).alias("others"))
    shared = F.aggregate(F.filter("parts", lambda p: F.array_contains("others", p["seg"])), F.lit(0.0), lambda total, p: total + p["length_m"])
    rivals = cut(pairs.join(late, [*own, "late"]).join(early, [*own, "early"]).where(shared / F.col("own") > overlap).select(*own, "late", "early"))
    state = cut(items.select(*keys, "id").withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept is null").isEmpty():
        known = rivals.join(state.select(*keys, F.col("id").alias("early"), "kept").where("kept is null or kept"), [*own, "early"]).groupBy(*keys, F.col("late").alias("id")).agg(F.max(F.coalesce("kept", F.lit(False))).alias("beaten"), F.max(F.col("kept").isNull()).alias("waits"))
        judged = state.join(known, [*keys, "id"], "left")
        state = cut(judged.select(*keys, "id", F.coalesce("kept", F.when(F.col("beaten"), False).when(F.col("waits"), None).otherwise(True)).alias("kept")))
    return items.join(state.where("kept").select(*keys, "id"), [*keys, "id"], "left_semi")


def anchored(ring: DataFrame, requirements: list[tuple[DataFrame, float]]) -> DataFrame:
    """Of each loop (ring: area_id, id, lat, lon) that comes within reach of every requirement (features, radius in metres): area_id, id, start,
    the place of it that is nearest a feature of the first. Features may be requests (request_id); a loop then has a row for each."""
    out = None
    for features, radius in requirements:
        asked = ["request_id"] if "request_id" in features.columns else []
        own = features.withColumn("feature_id", F.col("request_id")).withColumn("kind", F.lit("point")).withColumn("name", F.lit(None).cast("string")) if asked else features
        if asked:
            pairs = near(ring.select(*PLACE).distinct(), own, radius).select(*PLACE, F.col("feature_id").alias("request_id"), "d")
            hits = ring.select("area_id", "id", "lat", "lon").join(pairs, PLACE)
        else:
            hits = at_places(ring.select("area_id", "id", "lat", "lon"), own, radius, F.min("d").alias("d"))
        best = hits.groupBy("area_id", "id", *asked).agg(F.min(F.struct("d", "lat", "lon")).alias("s")).select("area_id", "id", *asked, F.struct("s.lat", "s.lon").alias("start"))
        out = best if out is None else out.join(best.select("area_id", "id").distinct(), ["area_id", "id"], "left_semi")
    return out


def snap(points: DataFrame, edges: DataFrame, max_m: float) -> DataFrame:
    """Nearest place on the network of each point (area_id, point_id, lat, lon): edge, a, b, length_m, t (fraction from a), d, at (the place).
    Farther than max_m, a point has no row. Points that share a place are sought once."""
    first, placed = shared_places(points.select(*PLACE, "point_id"), "point_id")
    feature = first.select("area_id", F.col("point_id").alias("feature_id"), F.lit("point").alias("kind"), F.lit(None).cast("string").alias("name"), "lat", "lon")
    lines = edges.select("area_id", "edge", "a", "b", "length_m", F.col("pa.lat").alias("lat1"), F.col("pa.lon").alias("lon1"), F.col("pb.lat").alias("lat2"), F.col("pb.lon").alias("lon2"), F.col("length_m").alias("seg_m"))
    along = lambda c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col("t")
    found = near_segments(lines, feature, max_m).withColumn("at", F.struct(along("lat").alias("lat"), along("lon").alias("lon")))
    best = found.groupBy("area_id", F.col("feature_id").alias("first")).agg(F.min(F.struct("d", "a", "b", "t", "edge", "length_m", "at")).alias("s"))
    return placed.join(best, ["area_id", "first"]).select("area_id", "point_id", "s.*")


def split(edges: DataFrame, snapped: DataFrame, weld_m: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The network with a node at each snapped place, and area_id, point_id, node, d of every point. A place within weld_m of an end of its edge
    is that end; places of one weld cell on an edge are one node; an edge is cut at all its places at once."""
    cell = F.struct(weld_key(F.col("at.lat"), weld_m).alias("y"), weld_key(F.col("at.lon"), weld_m).alias("x"))
    from_a, m = F.col("t") * F.col("length_m"), F.col("length_m")
    node = F.when(from_a <= weld_m, F.col("a")).when(m - from_a <= weld_m, F.col("b")).otherwise(cell)
    points = cut(snapped.withColumn("node", node))
    inner = points.where((F.col("node") != F.col("a")) & (F.col("node") != F.col("b"))).groupBy("area_id", "edge", "node").agg(F.min_by(F.struct("t", "at"), "t").alias("c"))
    cuts = inner.groupBy("area_id", "edge").agg(F.array_sort(F.collect_list(F.struct(F.col("c.t").alias("t"), "node", F.col("c.at").alias("at")))).alias("cuts"))
    rows = edges.join(cuts, ["area_id", "edge"])
    mark = lambda t, n, p: F.struct(F.lit(t).alias("t"), F.col(n).alias("node"), F.col(p).alias("at"))
    marks = F.concat(F.array(mark(0.0, "a", "pa")), F.col("cuts"), F.array(mark(1.0, "b", "pb")))
    pieces = rows.withColumn("marks", marks).withColumn("piece", F.explode(F.transform(F.sequence(F.lit(1), F.size("marks") - 1), lambda k: F.struct(F.get("marks", k - 1).alias("x"), F.get("marks", k).alias("y")))))
    turned = F.col("piece.x.node") > F.col("piece.y.node")
    side = lambda first, field: F.when(turned, F.col(f"piece.{'y' if first else 'x'}.{field}")).otherwise(F.col(f"piece.{'x' if first else 'y'}.{field}"))
    new = pieces.select(
        "area_id", side(True, "node").alias("a"), side(False, "node").alias("b"), ((F.col("piece.y.t") - F.col("piece.x.t")) * F.col("length_m")).alias("length_m"), *(["refs"] if "refs" in edges.columns else []), "tags",
        side(True, "at").alias("pa"), side(False, "at").alias("pb"), F.xxhash64("area_id", side(True, "node"), side(False, "node"), "edge").alias("edge"),
    )
    whole = edges.join(cuts.select("area_id", "edge"), ["area_id", "edge"], "left_anti")
    return cut(whole.select(*new.columns).unionByName(new)), points.select("area_id", "point_id", "node", "d")


def distances(starts: DataFrame, edges: DataFrame, cap_m: float, barred: DataFrame | None = None, goals: DataFrame | None = None) -> DataFrame:
    """Way lengths from each start: area_id, request_id, node, m, prev (the node before), via (the edge between). starts: area_id, request_id,
    node, m, and cap_m if requests have caps of their own. All requests relax together, a round an edge, until none gets nearer or all are
    beyond the cap. barred: area_id, request_id, edge that a request may not take. goals: area_id, request_id, node, if only these lengths count: a
    request that has come to all of its goals goes no farther than to the last of them, and is exact up to there."""
    ways = cut(incidence(edges).select("area_id", "node", "other", "edge", "length_m"))
    key = ["area_id", "request_id", "node"]
    cap = F.least(F.lit(float(cap_m)), F.col("cap_m")) if "cap_m" in starts.columns else F.lit(float(cap_m))
    best = cut(starts.withColumn("cap", cap).groupBy(*key).agg(F.min("m").alias("m"), F.max("cap").alias("cap")).select(*key, "m", F.col("node").alias("prev"), F.lit(None).cast("long").alias("via"), "cap"))
    front = best
    while not front.isEmpty():
        steps = front.join(ways, ["area_id", "node"])
        steps = steps if barred is None else steps.join(barred, ["area_id", "request_id", "edge"], "left_anti")
        reach = steps.select("area_id", "request_id", F.col("other").alias("node"), (F.col("m") + F.col("length_m")).alias("m"), F.col("node").alias("prev"), F.col("edge").alias("via"), "cap").where(F.col("m") <= F.col("cap"))
        step = reach.groupBy(*key).agg(F.min(F.struct("m", "prev", "via")).alias("n"), F.max("cap").alias("cap"))
        nearer = F.col("old").isNull() | (F.col("n.m") < F.col("old"))
        front = cut(step.join(best.select(*key, F.col("m").alias("old")), key, "left").where(nearer).select(*key, "n.m", "n.prev", "n.via", "cap"))
        best = cut(best.join(front.select(*key), key, "left_anti").unionByName(front))
        if goals is not None:
            met = goals.select(*key).distinct().join(best.select(*key, "m"), key, "left").groupBy(*key[:2]).agg(F.max("m").alias("last"), (F.count("m") == F.count("*")).alias("all"))
            done = cut(met.where("all").select(*key[:2], "last"))
            front = front.join(done, key[:2], "left").where(F.col("last").isNull() | (F.col("m") < F.col("last"))).withColumn("cap", F.least("cap", "last")).drop("last")
    return best.drop("cap")


def start_nodes(snapped: DataFrame) -> DataFrame:
    """Both ends of the edge that a point was snapped to, at their distance from it: the graph itself needs no cut."""
    ends = F.array(F.struct(F.col("a").alias("node"), (F.col("t") * F.col("length_m")).alias("m")), F.struct(F.col("b").alias("node"), ((1 - F.col("t")) * F.col("length_m")).alias("m")))
    return snapped.select("area_id", F.col("point_id").alias("request_id"), F.explode(ends).alias("e")).select("area_id", "request_id", "e.node", "e.m")


def candidates(requests: DataFrame, pois: DataFrame, kinds: list[str], radius_m: float, n: int) -> DataFrame:
    """Objects of the kinds around each request (area_id, point_id, lat, lon), nearest by air first, max(4 n, 10) at most: area_id, point_id,
    feature_id, f_lat, f_lon, d, and `bound`, the distance of the first one left out (null: none was)."""
    most = max(4 * n, 10)
    # of a place of requests no objects count but those of its most + 1 nearest places, of a place of objects none but the most + 1 smallest
    held = Window.partitionBy(*PLACE).orderBy("feature_id")
    own = pois.where(F.col("kind").isin(*kinds)).withColumn("nth", F.row_number().over(held)).where(F.col("nth") <= most + 1)
    there = own.groupBy(*PLACE).agg(F.collect_list("feature_id").alias("feature_id")).withColumn("kind", F.lit(None)).withColumn("name", F.lit(None))
    first, placed = shared_places(requests.select(*PLACE, "point_id"), "point_id")
    pairs = near(first.withColumnRenamed("point_id", "first"), there, radius_m)
    close = pairs.withColumn("r", F.rank().over(Window.partitionBy("area_id", "first").orderBy("d"))).where(F.col("r") <= most + 1)
    pairs = close.select("area_id", F.col("first").alias("point_id"), F.explode("feature_id").alias("feature_id"), "f_lat", "f_lon", "d")
    order = Window.partitionBy("area_id", "point_id").orderBy("d", "feature_id")
    rows = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1)
    rows = rows.withColumn("bound", F.max(F.when(F.col("place") == most + 1, F.col("d"))).over(Window.partitionBy("area_id", "point_id")))
    rows = rows.where(F.col("place") <= most).withColumnRenamed("point_id", "first")
    return placed.select("area_id", "point_id", "first").join(rows, ["area_id", "first"]).select("area_id", "point_id", "feature_id", "f_lat", "f_lon", "d", "place", "bound")


def meeting(dist: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """Way length m from each request to each of its targets. starts, targets: snapped points, targets with request_id and point_id."""
    t = targets.select("area_id", "request_id", "point_id", F.col("edge").alias("t_edge"), F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("t").alias("tt"), F.col("length_m").alias("t_len"))
    ends = F.array(F.struct(F.col("ta").alias("node"), (F.col("tt") * F.col("t_len")).alias("more")), F.struct(F.col("tb").alias("node"), ((1 - F.col("tt")) * F.col("t_len")).alias("more")))
    around = t.select("area_id", "request_id", "point_id", F.explode(ends).alias("e")).select("area_id", "request_id", "point_id", "e.*").join(dist, ["area_id", "request_id", "node"]).select("area_id", "request_id", "point_id", (F.col("m") + F.col("more")).alias("m"))
    same = t.join(starts.select("area_id", F.col("point_id").alias("request_id"), F.col("edge").alias("t_edge"), F.col("t").alias("st")), ["area_id", "request_id", "t_edge"]).select("area_id", "request_id", "point_id", (F.abs(F.col("st") - F.col("tt")) * F.col("t_len")).alias("m"))
    return around.unionByName(same).groupBy("area_id", "request_id", "point_id").agg(F.min("m").alias("m"))


def backtrack(dist: DataFrame, goals: DataFrame) -> DataFrame:
    """The way to each goal (area_id, request_id, point_id, node), from the start: area_id, request_id, point_id, nodes, edges."""
    none = F.array().cast("array<long>")
    open_, done = cut(goals.select("area_id", "request_id", "point_id", "node", F.array("node").alias("nodes"), none.alias("edges"))), []
    while not open_.isEmpty():
        rows = cut(open_.join(dist.select("area_id", "request_id", "node", "prev", "via"), ["area_id", "request_id", "node"]))
        done.append(rows.where("via is null").select("area_id", "request_id", "point_id", "nodes", "edges"))
        open_ = rows.where("via is not null").select("area_id", "request_id", "point_id", F.col("prev").alias("node"), F.concat(F.array("prev"), "nodes").alias("nodes"), F.concat(F.array("via"), "edges").alias("edges"))
    return reduce(DataFrame.unionByName, done) if done else open_.drop("node")


def retraced(legs: DataFrame, key: list[str]) -> DataFrame:
    """legs (key, edge, length_m; a row for each passage): walked length, length of distinct edges, and the repeated length as a share of the
    latter: 0 where nothing is walked twice, 1 for a way there and back."""
    each = legs.groupBy(*key, "edge").agg(F.count("*").alias("n"), F.first("length_m").alias("length_m"))
    again = F.sum((F.col("n") - 1) * F.col("length_m")) / F.sum("length_m")
    return each.groupBy(*key).agg(F.sum(F.col("n") * F.col("length_m")).alias("length_m"), F.sum("length_m").alias("distinct_m"), again.alias("retraced"))


def ranked(shaped: DataFrame, n: int, min_compactness: float, keys: list[str] = ["area_id"]) -> DataFrame:  # noqa: B006
    """The n roundest items of each key (compactness, then length, then id); thinner ones than min_compactness are left out first."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("compactness", 6)), F.round("length_m", 3), "id")
    return shaped.where(F.col("compactness") >= min_compactness).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def node_places(edges: DataFrame) -> DataFrame:
    """area_id, node, lat, lon."""
    at = lambda n, p: F.struct(F.col(n).alias("node"), F.col(f"{p}.lat").alias("lat"), F.col(f"{p}.lon").alias("lon"))
    rows = edges.select("area_id", F.explode(F.array(at("a", "pa"), at("b", "pb"))).alias("x")).select("area_id", "x.*")
    return rows.groupBy("area_id", "node").agg(F.min(F.struct("lat", "lon")).alias("p")).select("area_id", "node", "p.lat", "p.lon")


def column_of(node: str) -> Column:
    """A node as text, for output."""
    return F.concat_ws(",", F.col(f"{node}.y").cast("string"), F.col(f"{node}.x").cast("string"))
