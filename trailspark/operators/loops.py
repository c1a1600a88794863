"""Loops of the trail network: simple cycles within a band of lengths, sought in halves that meet in the middle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import cut
from .graph import incidence, two_core

HALF = ["area_id", "start", "node"]


@dataclass(frozen=True)
class Search:
    """found: area_id, start (its smallest node), segs (sorted), walk and nodes (segments and the nodes they begin at, in walking order),
    length_m; each loop once. areas: area_id, tried (ways, and pairs of ways with the same ends), up_to (segments up to which all loops
    are found), capped (the caller's budget, if there is one, ended the search before it was done)."""

    found: DataFrame
    areas: DataFrame


def number(node: str) -> Column:
    """A node as one number, in the nodes' own order."""
    return F.shiftleft(F.col(f"{node}.y"), 32) + F.col(f"{node}.x") + (1 << 31)


def node(n: Column) -> Column:
    return F.struct(F.shiftright(n, 32).alias("y"), (n.bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).alias("x"))


def inside(nodes: str) -> Column:
    return F.slice(nodes, F.lit(2), F.size(nodes) - 2)


def grown(halves: DataFrame, ways: DataFrame, max_m: float) -> DataFrame:
    """Half ways with a segment more; none comes by a node smaller than its start."""
    steps = halves.join(ways, ["area_id", "node"]).where((F.col("other") > F.col("start")) & (F.col("m") + F.col("length_m") <= max_m) & ~F.array_contains("nodes", F.col("other")))
    return steps.select("area_id", "start", F.col("other").alias("node"), F.array_append("segs", F.col("seg")).alias("segs"), F.array_append("nodes", F.col("other")).alias("nodes"), (F.col("m") + F.col("length_m")).alias("m"))


def meetings(long: DataFrame, short: DataFrame, same: bool, min_m: float, max_m: float) -> DataFrame:
    """Pairs of groups of half ways (sizes, least and greatest lengths of both sides) that can make a loop of the band: area_id, start, node, pairs and
    the lengths."""
    other = short.toDF(*HALF, "n2", "low2", "top2")
    both = long.join(other, HALF).where((F.col("low") + F.col("low2") <= max_m) & (F.col("top") + F.col("top2") >= min_m))
    pairs = F.col("n") * (F.col("n") - 1) / 2 if same else F.col("n") * F.col("n2")
    return both.select(*HALF, pairs.cast("long").alias("pairs"), "low", "top", "low2", "top2").where("pairs > 0")


def closed(long: DataFrame, short: DataFrame, meet: DataFrame, min_m: float, max_m: float) -> DataFrame:
    """Loops of half ways that meet and have no other node in common. Of a loop's two directions the one counts whose first segment has the
    smaller number than its last. Halves go out first that are too short or too long for every one on the other side."""
    fits = lambda low, top: (F.col("m") + F.col(low) <= max_m) & (F.col("m") + F.col(top) >= min_m)
    there = long.join(meet.select(*HALF, "low2", "top2"), HALF).where(fits("low2", "top2")).drop("low2", "top2")
    back = short.join(meet.select(*HALF, "low", "top"), HALF).where(fits("low", "top")).select(*HALF, F.col("segs").alias("segs2"), F.col("nodes").alias("nodes2"), F.col("m").alias("m2"))
    pairs = there.join(back, HALF).where((F.get("segs", F.lit(0)) < F.get("segs2", F.lit(0))) & (F.col("m") + F.col("m2")).between(min_m, max_m) & ~F.arrays_overlap(inside("nodes"), inside("nodes2")))
    return pairs.select("area_id", "start", F.concat("segs", F.reverse("segs2")).alias("walk"), F.concat("nodes", F.reverse(inside("nodes2"))).alias("nodes"), (F.col("m") + F.col("m2")).alias("length_m"))


def search(segments: DataFrame, min_m: float, max_m: float, max_segments: int, budget: int | None = None) -> Search:
    """All loops of min_m to max_m and of max_segments + 1 segments at most; segments that are loops themselves count.

    Ways from each node to greater ones grow a segment a round, to half a loop; two of them that end at the same node make one. So the
    work grows with the number of halves, the root of that of loops. Halves are dealt out by the node that they start from.
    Only where a caller sets a budget, an area whose ways, and pairs of ways with the same ends, would be more than that stops there:
    what it has found is whole up to a number of segments, and it is marked as capped."""
    parts = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), segments.sparkSession.sparkContext.defaultParallelism)
    core = two_core(segments)
    ways = cut(incidence(core.withColumnRenamed("seg", "edge")).select("area_id", number("node").alias("node"), number("other").alias("other"), F.col("edge").alias("seg"), "length_m"))
    halves = ways.where("other > node").select("area_id", F.col("node").alias("start"), F.col("other").alias("node"), F.array("seg").alias("segs"), F.array("node", "other").alias("nodes"), F.col("length_m").alias("m")).repartition(parts, "area_id", "start")
    most = max_segments + 1
    state = cut(segments.select("area_id").distinct().select("area_id", F.lit(0).cast("long").alias("tried"), F.lit(1 if budget is not None else most).alias("up_to"), F.lit(False).alias("capped")))
    found, costs, before, sizes_before = [], [], None, None

    def spend(cost: DataFrame, up_to: int) -> None:
        """cost: area_id, cost. With a budget, areas that can't bear it are capped, and all others are done up to so many segments."""
        nonlocal state
        if budget is None:
            costs.append(cost)
            return
        total = F.col("tried") + F.coalesce("cost", F.lit(0))
        over = F.col("capped") | (total > budget)
        state = cut(state.join(cost, "area_id", "left").select("area_id", F.when(over, F.col("tried")).otherwise(total).alias("tried"), F.when(over, F.col("up_to")).otherwise(up_to).alias("up_to"), over.alias("capped")))

    def going(rows: DataFrame) -> DataFrame:
        return rows if budget is None else rows.join(state.where("not capped").select("area_id"), "area_id", "left_semi")

    for h in range(1, (most + 1) // 2 + 1):
        halves = cut(going(halves.where(F.col("m") <= max_m) if before is None else grown(before, ways, max_m)))
        if halves.isEmpty():
            break
        spend(halves.groupBy("area_id").agg(F.count("*").alias("cost")), max(1, 2 * h - 2))
        sizes = cut(halves.groupBy(*HALF).agg(F.count("*").alias("n"), F.min("m").alias("low"), F.max("m").alias("top")))
        for size, other, other_sizes in ((2 * h - 1, before, sizes_before), (2 * h, halves, sizes)):
            if other is None or size > most:
                continue
            meet = cut(meetings(sizes, other_sizes, other is halves, min_m, max_m))
            spend(meet.groupBy("area_id").agg(F.sum("pairs").alias("cost")), size)
            found.append(cut(closed(halves, other, going(meet), min_m, max_m)))
        before, sizes_before = halves, sizes
    if costs:
        spent = cut(reduce(DataFrame.unionByName, costs).groupBy("area_id").agg(F.sum("cost").alias("cost")))
        state = state.join(spent, "area_id", "left").select("area_id", F.coalesce("cost", "tried").alias("tried"), "up_to", "capped")
    alone = segments.where((F.col("a") == F.col("b")) & F.col("length_m").between(min_m, max_m)).select("area_id", F.col("a").alias("start"), F.array("seg").alias("segs"), F.array("seg").alias("walk"), F.array("a").alias("nodes"), "length_m")
    if not found:
        return Search(alone, state)
    rings = reduce(DataFrame.unionByName, found).select("area_id", node(F.col("start")).alias("start"), F.array_sort("walk").alias("segs"), "walk", F.transform("nodes", node).alias("nodes"), "length_m")
    return Search(rings.unionByName(alone), state)
