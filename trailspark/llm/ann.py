"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees searched through one queue.

The forest is fitted on a bounded sample, then every vector goes to its leaf in each tree. A query walks all trees at once,
best margin first, through a single priority queue, until the leaves it has reached hold enough vectors. How many are enough,
and how many trees and levels serve it at the least cost, is found on each table: a few queries are answered by a full scan, and
the reach is the least that finds RECALL of these neighbours; a full scan is one of the choices. Vectors are dealt out over a fixed
number of parts, whatever their leaf, and go by a block of queries leaf by leaf; each query meets those of the leaves it has reached and
keeps the best few of a part. So a query makes as many rows on a large table as on a small one. Inner products of what is kept are then
computed anew on the original vectors. Vectors are extended by one component so that nearness is by angle. Equal vectors are
searched once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, mapped, picked

#: Distinct vectors that the forest is fitted on, at most; vectors in a leaf, about; vectors that a block of queries meets at once.
SAMPLE, LEAF, BLOCK = 20_000, 1600, 4096
TREES = 8
#: A query reaches leaves until they hold this many vectors at least (counted once per leaf); smaller tables are scanned whole.
REACH = 48_000
#: Neighbours that the reach must find, of those of so many queries.
RECALL, PROBES = 0.95, 128
#: What meeting a leaf and placing a vector in a tree cost, in inner products.
VISIT, PLACE = 1000, 200
#: Parts that vectors are dealt over; components of the queries that a task holds.
PARTS, HELD = 8, 1 << 20


@dataclass(frozen=True)
class Tree:
    """Splits in heap order: children of node i are 2i+1 and 2i+2; leaves are numbered from the left."""

    normals: np.ndarray
    offsets: np.ndarray


def fit(sample: np.ndarray, leaves: int, trees: int = TREES, seed: int = 5) -> list[Tree]:
    """Each split is across the difference of two random members, at the members' median. leaves is a power of two."""
    rng, forest = np.random.default_rng(seed), []
    for _ in range(trees):
        normals, offsets = np.zeros((leaves - 1, sample.shape[1])), np.zeros(leaves - 1)
        members = {0: np.arange(len(sample))}
        for i in range(leaves - 1):
            own = members.pop(i)
            a, b = sample[rng.choice(own, 2)] if len(own) > 1 else rng.normal(size=(2, sample.shape[1]))
            normal = a - b
            norm = np.linalg.norm(normal)
            normal = normal / norm if norm else np.eye(1, sample.shape[1], i % sample.shape[1])[0]
            x = sample[own] @ normal
            normals[i], offsets[i] = normal, np.median(x) if len(own) else 0.0
            members[2 * i + 1], members[2 * i + 2] = own[x <= offsets[i]], own[x > offsets[i]]
        forest.append(Tree(normals, offsets))
    return forest


def extended(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the component that makes them all as long as the longest."""
    return np.hstack([vectors, np.sqrt(np.maximum(0.0, norm**2 - (vectors**2).sum(1, keepdims=True)))])


def leaves_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    at, inner = np.zeros(len(vectors), np.int64), len(tree.offsets)
    while len(at) and at[0] < inner:  # all leaves are as deep
        at = 2 * at + 1 + ((vectors * tree.normals[at]).sum(1) > tree.offsets[at])
    return at - inner


def reached(forest: list[Tree], margins: list[np.ndarray], counts: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs of one query, nearest first. margins: per tree the query's signed distances to all splits."""
    queue, found, held = [(-np.inf, t, 0) for t in range(len(forest))], [], 0
    heapq.heapify(queue)
    while queue and held < reach:
        worst, t, i = heapq.heappop(queue)  # the least crossing of a boundary on the way comes first
        m, inner = margins[t], len(margins[t])
        while i < inner:
            right = m[i] > 0
            heapq.heappush(queue, (max(worst, abs(m[i])), t, 2 * i + 1 + (not right)))
            i = 2 * i + 1 + right
        if counts[t, i - inner]:
            found.append((t, i - inner))
            held += counts[t, i - inner]
    return found


def shallow(forest: list[Tree], trees: int, leaves: int) -> list[Tree]:
    """The first trees, cut to their upper levels."""
    return [Tree(t.normals[: leaves - 1], t.offsets[: leaves - 1]) for t in forest[:trees]]


def settle(forest: list[Tree], share: np.ndarray, probes: np.ndarray, homes: list[np.ndarray], n: int, asked: int, recall: float = RECALL, least: int = REACH) -> tuple[int, int, int]:
    """Trees, leaves and reach of the least cost that find recall of the neighbours. share: of the n vectors, by tree and leaf;
    homes: per probe the leaves [neighbour, tree] of its true neighbours."""
    best, most = (math.inf, 1, 1, n), share.shape[1]
    margins = [probes @ t.normals.T - t.offsets for t in forest]
    for trees in sorted({1, len(forest)}):
        leaves = 1 if trees == 1 else 2
        while leaves <= most:
            counts = np.maximum(1, np.round(n * share[:trees].reshape(trees, leaves, -1).sum(2))).astype(np.int64)
            need = []
            for i, home in enumerate(homes):
                way = reached(shallow(forest, trees, leaves), [m[i, : leaves - 1] for m in margins[:trees]], counts, trees * n * 2)
                at = np.zeros((trees, leaves), np.int64)
                at[tuple(np.array(way).T)] = np.cumsum([counts[x] for x in way])
                need.append(at[np.arange(trees), home[:, :trees] // (most // leaves)].min(1))
            need = np.sort(np.concatenate([np.zeros(0, np.int64), *need]))
            reach = max(least, int(need[math.ceil(recall * len(need)) - 1])) if leaves > 1 and len(need) else n
            size = n / leaves
            cost = asked * (reach + VISIT * reach / size * math.ceil(size / BLOCK)) + PLACE * n * trees
            best = min(best, (cost, trees, leaves, reach))
            leaves *= 2
    return best[1:]


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: rows that take part. Null ids, null or empty vectors, null or non-finite components, zero vectors and
    vectors of another length than most don't; rows repeated whole count once."""
    v, usable = F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = picked(vectors, vec_id=id_col, v=vector_col).where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, usable) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def inner(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


class Near:
    """The nearest found of a block of queries, of all vectors that go by."""

    def __init__(self, keep: int):
        self.keep, self.asked, self.x = keep, [], None

    def ask(self, ids: np.ndarray, x: np.ndarray, leaves: np.ndarray, n: np.ndarray) -> None:
        """Queries with the leaves they have reached, n of them each. All come before the first vector."""
        self.asked.append((ids, x, leaves, n))

    def begin(self) -> None:
        self.ids, self.x, leaves, n = map(np.concatenate, zip(*self.asked, strict=True))
        self.asked, rows, by = [], np.repeat(np.arange(len(n)), n), np.argsort(leaves, kind="stable")
        self.leaves, self.rows = leaves[by], rows[by]
        self.score, self.found = np.full((len(n), self.keep), -np.inf), np.zeros((len(n), self.keep), np.int64)  # best first

    def meet(self, leaf: int, ids: np.ndarray, y: np.ndarray) -> None:
        """Vectors of a leaf. Of equal ones those of the smaller ids count."""
        if self.x is None:
            if not self.asked:
                return
            self.begin()
        rows, keep = self.rows[slice(*np.searchsorted(self.leaves, [leaf, leaf + 1]))], self.keep
        for at in range(0, len(rows), 512):
            own = rows[at : at + 512]
            s, least = self.x[own] @ y.T, self.score[own, -1]
            new = np.isneginf(least)
            if new.any() and s.shape[1] > keep:
                least[new] = -np.partition(-s[new], keep - 1, 1)[:, keep - 1]
            row, col = np.nonzero(s >= least[:, None])
            if not len(row):
                continue
            held = np.unique(row)
            r = np.concatenate([row, np.repeat(held, keep)])
            score, c = np.concatenate([s[row, col], self.score[own[held]].ravel()]), np.concatenate([ids[col], self.found[own[held]].ravel()])
            by = np.lexsort((c, -score, r))
            first = by[np.arange(len(r)) - np.searchsorted(r[by], r[by]) < keep]
            self.score[own[held]], self.found[own[held]] = score[first].reshape(-1, keep), c[first].reshape(-1, keep)

    def rows_found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, vector and score of what is kept."""
        if self.x is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, col = np.nonzero(self.score > -np.inf)
        return self.ids[row], self.found[row, col], self.score[row, col]


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, reach: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query (over vec_id) holds, the query's own
    id excepted; ties go to the smaller id. Ids are integers. Rows that clean leaves out take no part, equal vectors are each listed; vectors of
    any length; other columns are left out; an empty table gives an empty one. Without a reach, the table's own is found."""
    rows = clean(vectors, id_col, vector_col)
    id_type, v_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "v"))
    # one class per vector: its k + 1 smallest ids can be answers
    per_vector = Window.partitionBy("v").orderBy("vec_id")
    members = cut(rows.groupBy("v", "vec_id").agg(F.lit(1).alias("one")).withColumn("nth", F.row_number().over(per_vector)).where(F.col("nth") <= k + 1).select("v", "vec_id", "nth"))
    classes = cut(members.where("nth = 1").select(F.col("vec_id").alias("c"), F.xxhash64("v").alias("h"), "v"))
    queries = cut(rows.where(is_query).select("v", F.col("vec_id").alias("query_id")).distinct())
    asked = cut(queries.select("v").distinct().join(classes, "v").select(F.col("c").alias("q"), "v"))

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        v = batch["v"]
        return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)

    top = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") ** 2)).alias("sq")).first()
    n, norm = top["n"], float(top["sq"] or 0) ** 0.5
    some = [matrix(b) for b in classes.orderBy("h", "c").limit(sample).select("v").toArrow().to_batches() if b.num_rows]
    picked_rows = np.concatenate(some) if some else np.zeros((1, 1))
    leaves = 1
    while leaves * LEAF < n and leaves * 16 < len(picked_rows):
        leaves *= 2
    points = extended(picked_rows, norm)
    built, sc = fit(points, leaves, trees), classes.sparkSession.sparkContext

    def towards(x: np.ndarray) -> np.ndarray:
        x = np.hstack([x, np.zeros((len(x), 1))])
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    if reach is None and n <= REACH:
        built, reach = shallow(built, 1, 1), n
    elif reach is None:
        tried = asked.orderBy(F.xxhash64("v"), "q").limit(PROBES).toArrow()
        probes = np.array(tried["v"].to_pylist() or np.zeros((0, points.shape[1] - 1)), float)
        known = sc.broadcast((built, norm, probes, np.array(tried["q"].to_pylist())))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, longest, w, ids = known.value
            best = [[] for _ in w]
            for batch in batches:
                x, c = matrix(batch), batch["c"].to_numpy()
                s = w @ x.T
                s[ids[:, None] == c[None]] = -np.inf
                for i, row in enumerate(s):
                    top = np.argpartition(-row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                    best[i] = sorted(best[i] + [(row[j], int(c[j]), x[j]) for j in top if row[j] > -np.inf], key=lambda y: (-y[0], y[1]))[:k]
            for i, rows in enumerate(best):
                if rows:
                    homes = np.stack([leaves_of(t, extended(np.stack([y[2] for y in rows]), longest)) for t in own], 1)
                    yield pa.RecordBatch.from_pydict({"i": pa.array([i] * len(rows), pa.int32()), "c": pa.array([y[1] for y in rows], pa.int64()), "s": pa.array([y[0] for y in rows], pa.float64()), "leaf": pa.array(homes.tolist(), pa.list_(pa.int32()))})

        found = classes.select("c", "v").mapInArrow(nearest, "i int, c long, s double, leaf array<int>")
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "c"))).where(F.col("r") <= k).select("i", "leaf").collect()  # PROBES x k rows at most
        homes = [np.array([r["leaf"] for r in found if r["i"] == i], np.int64).reshape(-1, trees) for i in range(len(probes))]
        share = np.stack([np.bincount(leaves_of(t, points), minlength=leaves) for t in built]) / len(points)
        n_trees, n_leaves, reach = settle(built, share, towards(probes), homes, n, asked.count())
        built = shallow(built, n_trees, n_leaves)
    trees, leaves = len(built), len(built[0].offsets) + 1
    forest = sc.broadcast((built, norm))

    def place(batch: pa.RecordBatch) -> dict:
        built, longest = forest.value
        x = extended(matrix(batch), longest)
        return {"c": batch["c"], "v": batch["v"], "leaf": np.stack([leaves_of(t, x) for t in built], 1).tolist()}

    # every class in its leaf of every tree
    placed = cut(mapped(classes.select("c", "v"), place, f"c {id_type}, v {v_type}, leaf array<int>").select("c", "v", F.posexplode("leaf").alias("tree", "leaf")))
    found = placed.groupBy("tree", "leaf").count().collect()  # trees x leaves rows, bounded by the sample
    counts = np.zeros((trees, leaves), np.int64)
    for r in found:
        counts[r["tree"], r["leaf"]] = r["count"]

    def walk(batch: pa.RecordBatch) -> dict:
        built, _ = forest.value
        x = towards(matrix(batch))
        margins = [x @ t.normals.T - t.offsets for t in built]
        ways = [reached(built, [m[i] for m in margins], counts, reach) for i in range(len(x))]
        by_tree = lambda way: [{"tree": t, "leaves": [leaf for u, leaf in way if u == t]} for t in sorted({t for t, _ in way})]
        return {"q": batch["q"], "v": batch["v"], "way": list(map(by_tree, ways))}

    walked = mapped(asked, walk, f"q {id_type}, v {v_type}, way array<struct<tree int, leaves array<int>>>").select("q", "v", F.explode("way").alias("way")).select("q", "v", "way.tree", "way.leaves")
    # a query goes to all parts, a vector to all blocks of queries
    parts, blocks = -(-PARTS // trees), max(1, -(-asked.count() // max(512, HELD // (points.shape[1] - 1 or 1))))
    keys, keep = ["tree", "part", "block"], k + 5
    some = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = walked.select("tree", every(parts).alias("part"), some("q", blocks).alias("block"), F.lit(-1).alias("leaf"), F.col("q").alias("id"), "v", "leaves")
    right = placed.select("tree", some("c", parts).alias("part"), every(blocks).alias("block"), F.col("leaf"), F.col("c").alias("id"), "v", F.lit(None).cast("array<int>").alias("leaves"))
    dealt = left.unionByName(right).repartition(trees * parts * blocks, *keys).sortWithinPartitions(*keys, "leaf")  # queries come first
    arrow_id = to_arrow_type(rows.schema["vec_id"].dataType)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(near: Near) -> pa.RecordBatch:
            q, c, s = near.rows_found()
            return pa.RecordBatch.from_pydict({"q": pa.array(q).cast(arrow_id), "c": pa.array(c).cast(arrow_id), "s": pa.array(s)})

        own, near = None, Near(keep)
        for batch in batches:
            marks = np.stack([batch[x].to_numpy() for x in (*keys, "leaf")], 1)
            new = np.append(True, (marks[1:] != marks[:-1]).any(1)) if len(marks) else np.zeros(0, bool)
            for run in np.split(np.arange(len(marks)), np.flatnonzero(new))[1:]:
                key, leaf = tuple(marks[run[0], :3]), int(marks[run[0], 3])
                if key != own:
                    yield found(near)
                    own, near = key, Near(keep)
                for at in range(0, len(run), BLOCK):
                    part = batch.slice(int(run[0]) + at, min(BLOCK, len(run) - at))
                    ids, x = part["id"].to_numpy().astype(np.int64), matrix(part)
                    if leaf < 0:
                        near.ask(ids, x, part["leaves"].flatten().to_numpy(), part["leaves"].value_lengths().to_numpy())
                    else:
                        near.meet(leaf, ids, x)
        yield found(near)

    met = dealt.mapInArrow(meet, f"q {id_type}, c {id_type}, s double")
    near = met.groupBy("q", "c").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c"))).where(F.col("r") <= keep).select("q", "c")
    near = near.unionByName(asked.select("q", F.col("q").alias("c"))).distinct()
    # exact scores on the original vectors, then members of the classes
    scored = near.join(asked.withColumnRenamed("v", "w"), "q").join(classes.select("c", "v"), "c").select("q", "c", inner("w", "v").alias("score"))
    listed = members.join(members.where("nth = 1").select("v", F.col("vec_id").alias("c")), "v").select("c", "vec_id")
    answers = scored.join(listed, "c").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).select("q", "vec_id", "score")
    ask = queries.join(asked, "v").select("query_id", "q")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ask.join(answers, "q").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 20 == 0)
