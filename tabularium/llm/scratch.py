"""Lineage cuts in the folder that all executors share, and what is summed over a whole order without one task for it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder if all runs on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return "file://" + _own[0]


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder, there already, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, place = _file_system(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the plan restarts there, whichever executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.mode("overwrite").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def let_go(*tables: DataFrame) -> None:
    """Deletes what ``cut`` has written of tables that nothing reads any more."""
    for t in tables:
        files, place = _file_system(t.sparkSession, t._written)
        files.delete(place, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_ROWS`` rows meanwhile: one of Spark's usual 10,000 is some 30 MB of texts, which the JVM and the worker hold several times over."""
    before = spark.conf.get(_BATCH)
    if int(before) > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package when the repository is not installed (a local run from another folder)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in have:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def dealt(df: DataFrame) -> DataFrame:
    """``df``, dealt to as many partitions as there are cores if it comes in fewer: a small table of one file would else be one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as make it none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """``df`` with columns ``values``: each the sum of that value over all rows before, in ``order``, which has to be a total one.

    Rows are sorted by ranges; sums of the ranges, one row for each, are added up in
    order, and rows within their range: no task holds all of them.
    """
    own = {f"_value_{k}": v for k, v in values.items()}
    placed = df.select("*", *[v.alias(k) for k, v in own.items()]).orderBy(*order)
    placed = cut(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "running")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(*[F.sum(k).alias(k) for k in own])
    parts = parts.select("_part", *[F.coalesce(F.sum(k).over(upto), F.lit(0)).alias(f"_before{k}") for k in own])
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select("*", *[F.coalesce(F.sum(k).over(within), F.lit(0)).alias(f"_within{k}") for k in own])
    both = summed.join(F.broadcast(parts), "_part")
    return both.select(*[c for c in df.columns if c not in values], *[(F.col(f"_before_value_{k}") + F.col(f"_within_value_{k}")).alias(k) for k in values])
