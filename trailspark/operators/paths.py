"""Ways between points of the trail network: simple paths by length, distinct ones, legs, and what lies along them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import cut
from .graph import distances, incidence

PAIR = ["area_id", "request_id"]


def shortest_paths(segments: DataFrame, pairs: DataFrame, rest: DataFrame, most: int) -> DataFrame:
    """The `most` shortest paths without a repeated node of each request, none longer than its cap: area_id, request_id, segs, lens, nodes, m.
    pairs: area_id, request_id, src, dst, cap_m; rest: the way length m from each node to dst.

    Partial paths deviate at every node, a segment a round, for all requests at once. One is as long as what it has walked and the way left
    from its end, and exactly so where no node of it is nearer the goal than its end: the shortest way on then comes by none of them.
    Partial paths of a round are apart from each other, so where `most` of them (or whole ones) are exact, whatever is longer than all these can't
    be among the `most` shortest, and goes. Equal lengths (to a millimetre) go by their nodes, then by their segments."""
    ways = cut(incidence(segments.withColumnRenamed("seg", "edge").where("a <> b")).withColumnRenamed("edge", "seg"))
    left = rest.select(*PAIR, F.col("node").alias("other"), F.col("m").alias("left_m"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    first = pairs.where("src <> dst").join(rest.select(*PAIR, F.col("node").alias("src"), F.col("m").alias("left_m")), [*PAIR, "src"])
    # nearest_m: the least way left from a node passed before the end
    now = cut(first.select(*PAIR, "dst", "cap_m", F.col("src").alias("node"), none("long").alias("segs"), none("double").alias("lens"), F.array("src").alias("nodes"), F.lit(0.0).alias("m"), "left_m", F.lit(float("inf")).alias("nearest_m")))
    ahead = Window.partitionBy(*PAIR).orderBy("r", "nodes", "segs").rowsBetween(Window.unboundedPreceding, -1)
    while not now.where("node <> dst").isEmpty():
        steps = now.where("node <> dst").withColumn("nearest_m", F.least("nearest_m", "left_m")).drop("left_m")
        steps = steps.join(ways, ["area_id", "node"]).where(~F.array_contains("nodes", F.col("other"))).join(left, [*PAIR, "other"]).where(F.col("m") + F.col("length_m") + F.col("left_m") <= F.col("cap_m"))
        grown = steps.select(
            *PAIR, "dst", "cap_m", F.col("other").alias("node"), F.array_append("segs", F.col("seg")).alias("segs"), F.array_append("lens", F.col("length_m")).alias("lens"),
            F.array_append("nodes", F.col("other")).alias("nodes"), (F.col("m") + F.col("length_m")).alias("m"), "left_m", "nearest_m",
        )
        ranked = now.where("node = dst").unionByName(grown).withColumn("r", F.round(F.col("m") + F.col("left_m"), 3))
        exact = F.coalesce(F.sum((F.col("nearest_m") >= F.col("left_m")).cast("int")).over(ahead), F.lit(0))
        now = cut(ranked.withColumn("ahead", exact).where(F.col("ahead") < most).drop("ahead", "r"))
    return now.select(*PAIR, "segs", "lens", "nodes", "m")


def distinct_paths(found: DataFrame, k: int, overlap: float, most: int) -> DataFrame:
    """Of each request's paths, shortest first and `most` at most, up to k of which none shares more than `overlap` of its length with one
    taken before: area_id, request_id, n (paths looked at), kept (array of m, segs, lens, nodes)."""
    path = F.struct(F.round("m", 3).alias("r"), "nodes", "segs", "lens", "m")
    order = Window.partitionBy(*PAIR).orderBy(F.round("m", 3), "nodes", "segs")
    lists = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).groupBy(*PAIR).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(path)).alias("paths"))

    def shared(p, q):
        return F.aggregate(F.filter(F.arrays_zip(p["segs"], p["lens"]), lambda x: F.array_contains(q["segs"], x["segs"])), F.lit(0.0), lambda total, x: total + x["lens"])

    def take(kept, p):
        full = (F.size(kept) >= k) | F.exists(kept, lambda q: shared(p, q) > overlap * p["m"])
        return F.when(full, kept).otherwise(F.array_append(kept, p))

    kind = found.select(F.array(path).alias("p")).schema["p"].dataType
    return lists.select(*PAIR, "n", F.aggregate("paths", F.array().cast(kind), take).alias("kept"))


def k_shortest(segments: DataFrame, pairs: DataFrame, k: int, overlap: float, most: int) -> DataFrame:
    """The k shortest distinct ways of each request (area_id, request_id, src, dst, cap_m): area_id, request_id, place, m, segs, lens, nodes. They
    are looked for among the `most` shortest paths, as in the model."""
    goals = pairs.select(*PAIR, F.col("dst").alias("node"), F.lit(0.0).alias("m"), "cap_m")
    rest = cut(distances(goals, segments.withColumnRenamed("seg", "edge"), float("inf")).select(*PAIR, "node", "m"))
    found = shortest_paths(segments, pairs, rest, most)
    kept = distinct_paths(found, k, overlap, most).select(*PAIR, F.posexplode("kept").alias("place", "p"))
    return kept.select(*PAIR, (F.col("place") + 1).alias("place"), "p.m", "p.segs", "p.lens", "p.nodes")


def walked(paths: DataFrame, steps: DataFrame, key: list[str]) -> DataFrame:
    """The edges of paths (area_id, key, start, segs) in walking order: area_id, key, pos, edge, from, to, m, tags, seg, leg, forward. steps: what
    graph.segment_steps gives. A segment is turned round where the path enters it at its other end."""
    legs = paths.select("area_id", *key, "start", F.posexplode("segs").alias("leg", "seg")).join(steps, ["area_id", "seg"])
    tail = F.element_at("steps", -1)["to"]
    ends = legs.groupBy("area_id", *key).agg(F.first("start").alias("start"), F.array_sort(F.collect_list(F.struct("leg", F.col("a").alias("a"), tail.alias("b")))).alias("legs"))
    # the node that each leg begins at: where the one before it ended
    node = F.aggregate("legs", F.array(F.col("start")), lambda at, leg: F.array_append(at, F.when(leg["a"] == F.element_at(at, -1), leg["b"]).otherwise(leg["a"])))
    begins = ends.select("area_id", *key, F.posexplode(node).alias("leg", "begin"))
    rows = legs.drop("start").join(begins, ["area_id", *key, "leg"]).withColumn("forward", F.col("a") == F.col("begin"))
    turned = F.transform(F.reverse("steps"), lambda x: F.struct(x["edge"].alias("edge"), x["to"].alias("from"), x["from"].alias("to"), x["m"].alias("m"), x["tags"].alias("tags")))
    rows = rows.withColumn("steps", F.when(F.col("forward"), F.col("steps")).otherwise(turned)).select("area_id", *key, "leg", "seg", "forward", F.posexplode("steps").alias("k", "s"))
    order = Window.partitionBy("area_id", *key).orderBy("leg", "k")
    return rows.select("area_id", *key, "leg", "seg", "forward", (F.row_number().over(order) - 1).alias("pos"), "s.edge", "s.from", "s.to", "s.m", "s.tags")


def series_along(paths: DataFrame, segment_series: DataFrame, key: list[str]) -> DataFrame:
    """Series along paths (area_id, key, leg, seg, forward; a row a leg) from the series of their segments (area_id, seg, idx, and values): turned
    round where a segment is, without the sample that two legs share. A path with a segment that has no series has none."""
    lacking = paths.join(segment_series.select("area_id", "seg").distinct(), ["area_id", "seg"], "left_anti").select("area_id", *key).distinct()
    rows = paths.join(lacking, ["area_id", *key], "left_anti").join(segment_series, ["area_id", "seg"]).withColumn("at", F.when(F.col("forward"), F.col("idx")).otherwise(-F.col("idx")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("area_id", *key, "leg").orderBy("at"))).where("nth > 1 or leg = 0")
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("area_id", *key).orderBy("leg", "at")) - 1).drop("at", "nth")
