"""Written tables go with their last reader, not before."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from trailspark.operators import lineage


def swept(spark, wanted) -> bool:
    """Whether the tables left come to be as wanted; the JVM lets go of them in its own time."""
    for _ in range(20):
        lineage.sweep(spark, collect=True)
        if wanted():
            return True
    return False


def test_a_table_stays_as_long_as_a_plan_reads_it(spark):
    table = lineage.cut(spark.range(100).withColumn("x", F.col("id") % 7))
    at = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    counts = table.groupBy("x").count()
    joined = counts.join(table, "x")
    del table, counts
    for _ in range(3):
        lineage.sweep(spark, collect=True)
    assert os.path.isdir(at) and joined.count() == 100
    del joined
    assert swept(spark, lambda: not os.path.isdir(at))


def test_tables_of_other_work_stay(spark):
    kept = lineage.cut(spark.range(10))
    gone = lineage.cut(spark.range(20))
    at = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    del gone
    assert swept(spark, lambda: not os.path.isdir(at)) and kept.count() == 10
