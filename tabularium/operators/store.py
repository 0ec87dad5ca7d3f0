"""Sinks and update paths: partitioned results with metadata, appends without repeats, latest-wins rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.text import file_name

LEVELS = ("state", "county", "year", "kind", "race")


def with_path(results: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """``path``: the levels as folder names, 'Unknown' where one is missing."""
    names = [F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("Unknown")) for c in levels]
    return results.withColumn("path", F.array_join(F.array(*[file_name(n) for n in names]), "/"))


def write_results(results: DataFrame, folder: str, levels: Sequence[str] = LEVELS, kind: str = "parquet") -> DataFrame:
    """Results by folders of their levels; returns one metadata row per folder, also written as JSON."""
    filled = results.select(*[F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("Unknown")).alias(c) if c in levels else F.col(c) for c in results.columns])
    filled.repartition(*levels).write.mode("append").partitionBy(*levels).format(kind).save(f"{folder}/results")
    meta = filled.groupBy(*levels).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("headers", F.lit(",".join(c for c in results.columns if c not in levels)))
    meta.write.mode("append").json(f"{folder}/metadata")
    return meta


def append_new(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` with keys not there yet, one per key."""
    return new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def existing_outputs(wanted: DataFrame, cache: DataFrame, keys: Sequence[str] = ("state", "county", "year", "race")) -> DataFrame:
    return wanted.join(cache.select(*keys), list(keys), "left_semi")


def rewrite_latest(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], order: str) -> str:
    """A new version of the table at ``path`` beside the old ones: readers of an old version are not disturbed; returns its folder."""
    from tabularium.operators.ordered import upsert

    versions = sorted(_versions(spark, path))
    base = spark.read.parquet(f"{path}/v{versions[-1]:06d}") if versions else changes.limit(0)
    target = f"{path}/v{(versions[-1] + 1 if versions else 0):06d}"
    upsert(base, changes, keys, order).write.parquet(target)
    return target


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def write_fixed_csv(rows: DataFrame, folder: str, leading: Sequence[str]) -> None:
    """CSV with the leading columns first and the others by name."""
    rows.select(*[F.col(f"`{c}`") for c in (*leading, *sorted(c for c in rows.columns if c not in leading))]).write.option("header", True).option("escape", '"').csv(folder)


def corrected(library: DataFrame, changes: DataFrame, key: str, count: str) -> DataFrame:
    """The library (key, label, count) after corrections (key, action, label, into): 'edit' gives another label, 'merge' adds the count to the row ``into``, which and 'remove' take the row away."""
    merged = library.select(key, F.col(count).cast("bigint").alias("_n")).join(changes.where("action = 'merge'").select(key, "into"), key).groupBy(F.col("into").alias(key)).agg(F.sum("_n").alias("_more"))
    edits = changes.where("action = 'edit'").select(key, F.col("label").alias("_label"))
    stays = library.join(changes.where("action <> 'edit'").select(key), key, "left_anti").join(edits, key, "left").join(merged, key, "left")
    return stays.select(key, F.coalesce("_label", "label").alias("label"), (F.col(count).cast("bigint") + F.coalesce("_more", F.lit(0))).alias(count))
