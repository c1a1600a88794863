"""Connected components of edges: contracted within partitions, then joined by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .lineage import cut

__all__ = ["components", "cut"]

#: Edges that a task contracts at a time, about; bounds its memory.
LOCAL = 1_000_000


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of some edges and the smallest vertex that each reaches."""
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(vertices))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
    return vertices, vertices[label]


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Each vertex (a) with the smallest one (b) that it reaches within its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0

        def drain() -> pa.RecordBatch:
            v, label = labels_of(np.concatenate(a), np.concatenate(b))
            a.clear()
            b.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array(v), "b": pa.array(label)})

        for batch in batches:
            a.append(batch["a"].to_numpy())
            b.append(batch["b"].to_numpy())
            held += batch.num_rows
            if parts > 1 and held > 2 * LOCAL:  # partitions of the planner may be larger than asked for
                yield drain()
                held = 0
        if a:
            yield drain()

    return edges.coalesce(parts).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """v, label (the smallest vertex of its component) for each vertex of edges (a, b). Vertices are of any type with an order; those
    of several graphs go in one call as structs that begin with the graph. Numbers are contracted within partitions first, which is
    all where one partition holds the graph; then each round halves what is left, roughly."""
    first = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if isinstance(first.schema["a"].dataType, LongType):
        n = first.count()
        parts = max(1, -(-n // LOCAL))
        found = cut(contracted(first, parts))
        if parts == 1:
            return found.select(F.col("a").alias("v"), F.col("b").alias("label"))
        first = found.distinct()
    now, last = cut(first.where("a <> b")), None
    while (state := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != last and state[0]:
        last = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        stars = both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        pairs = stars.join(stars.groupBy("a").agg(F.min("b").alias("m")), "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(pairs.select(F.col("e.a").alias("a"), F.col("e.b").alias("b")).where("a <> b").distinct())
    vertices = first.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    return vertices.join(now.withColumnRenamed("a", "v"), "v", "left").select("v", F.coalesce("b", "v").alias("label"))
