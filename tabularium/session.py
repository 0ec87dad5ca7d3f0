"""What a session needs: this package for Python workers, and a folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Adds the repository to the workers' path, for a local run from another folder; on a cluster the package is installed or sent along."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in have:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


_own: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in a new folder of ``spark.checkpoint.dir``, which goes when the driver ends; where that is unset, a temporary one if all runs on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        folder = _own[0]
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/data"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the plan restarts there, whichever executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
