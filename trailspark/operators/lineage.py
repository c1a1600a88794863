"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or setCheckpointDir names. Where neither is set, a new one is, but only in local mode, where
    driver and executors are one process; a cluster must name a folder that all of it sees."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(found)
    return found


#: Seconds after which cut asks the JVM to collect its garbage: until it does, Spark's own cleaner doesn't learn of dead shuffles either.
COLLECT_EVERY = 15.0
_collected = 0.0
#: Folders that cut has written, each with a weak reference to what plans hold of it.
_tables: list[tuple[str, object]] = []


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of tables. Nothing may read from it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, collect: bool = False) -> int:
    """Deletes the tables of cut that no plan reads any more: those of DataFrames that are gone, as are all made from them. That is known
    once the JVM has collected its garbage, which collect asks for. Returns how many tables are left."""
    global _collected
    if collect:
        _collected = time.monotonic()
        gc.collect()
        time.sleep(0.2)  # Python lets go of the JVM's objects in a thread of its own
        spark._jvm.System.gc()
    for table in list(_tables):
        try:
            gone = table[1].get() is None
        except Py4JError:  # the JVM that wrote it has ended
            gone = False
            _tables.remove(table)
        if gone:
            _tables.remove(table)
            remove(spark, table[0])
    return len(_tables)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read again from Parquet in the shared folder: its lineage ends there, lost executors don't lose it, later
    readers take the columns that they need, and the planner knows its size. The table goes some time after its last reader; see sweep."""
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    sweep(spark, time.monotonic() - _collected > COLLECT_EVERY)
    df.write.parquet(to)
    if time.monotonic() - _collected > COLLECT_EVERY:  # what a long write has shuffled isn't kept beside all that its readers do
        sweep(spark, True)
    out = spark.read.schema(df.schema).parquet(to)
    files = out._jdf.queryExecution().analyzed().relation().location()  # every plan made from out holds it
    _tables.append((to, spark._jvm.java.lang.ref.WeakReference(files)))
    return out
