"""Streams: alerts polled by increasing id, latest status per key, windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabularium.operators.tables import last_rows


def alert_stream(spark: SparkSession, folder: str, schema: str | StructType, files_per_batch: int = 64) -> DataFrame:
    """New files of an append-only alert table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def poll(alerts: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Hands every batch, in order of id, to ``act``; once over what is there, or each ``seconds``."""
    writer = alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: act(df.orderBy("id"), n))
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def windowed(events: DataFrame, time: str, width: str, late: str, *by: str | Column) -> DataFrame:
    """Counts and sums per window of event time; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n"))


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a Parquet table, each batch once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_state(rows: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """The result table of an aggregated stream once all that is there has been read.

    Every batch writes the rows it has changed (update mode: the state of windows that the
    watermark has passed is dropped) under its own number, so a batch that is run again
    overwrites only itself; the last row of each key is the result.
    """

    def put(df: DataFrame, n: int) -> None:
        df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/{n:09d}")

    rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    # all batches that are there, those of earlier runs from the same checkpoint as well
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], rows.schema)
    found = spark.read.parquet(f"{path}/*")
    return last_rows(found, keys, "_batch").drop("_batch").select(rows.columns)
