"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.lineage import cut, shared_dir  # noqa: F401

#: Rows that a Python task turns into objects at a time; bounds a worker's memory.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns of docs can't clash with what an operator adds."""
    return docs.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def mapped(rows: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, start: Callable | None = None) -> DataFrame:
    """Row-local Arrow map in slices of SLICE_ROWS. start() makes a task's state, which f then gets as second argument."""

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (start(),) if start else ()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = f(batch.slice(at, SLICE_ROWS), *state)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out, schema=arrow)

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class BitMap:
    """Flags of hashes, for tasks to leave out what others don't ask for. It may say yes wrongly, never no; its size is bounded."""

    words: np.ndarray
    bits: int

    @staticmethod
    def of(rows: DataFrame, column: str, bits: int) -> BitMap:
        """Of the hashes in a column. Tasks send words of 64 flags that aren't empty, 2**(bits - 6) at most."""
        b = F.shiftrightunsigned(F.col(column), 64 - bits)
        found = rows.groupBy(F.shiftright(b, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))).alias("flags"))
        words = np.zeros(1 << bits - 6, np.uint64)
        for batch in found.toArrow().to_batches():
            words[batch["at"].to_numpy()] = batch["flags"].to_numpy().astype(np.uint64)
        return BitMap(words, bits)

    @staticmethod
    def bits_for(n: int) -> int:
        """16 flags for each of n hashes, 2**28 in all at most."""
        return min(28, max(16, (16 * n).bit_length()))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        b = hashes.astype(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


class Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n
