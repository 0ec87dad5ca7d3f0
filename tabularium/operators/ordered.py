"""Order-dependent logic as windows within a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_before(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` before each row."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(window))


def carried(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` up to each row."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(window))


def within(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str, rows: int = 5) -> DataFrame:
    """The first non-null ``value`` among the ``rows`` rows before and after."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(-rows, rows)
    return df.withColumn(name, F.first(value, ignorenulls=True).over(window))


def keep_last(df: DataFrame, by: Sequence[str], order: Column, n: int) -> DataFrame:
    """The n last rows of each key; Spark keeps n per key and task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Union; the row with the greatest ``order`` of each key stays."""
    from tabularium.operators.tables import last_rows

    return last_rows(base.unionByName(changes, allowMissingColumns=True), keys, order)


def nth_occurrence(df: DataFrame, keys: Sequence[Column], order: str, name: str = "nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def adjusted_threshold(history: DataFrame, by: str, order: str, accepted: str, start: float = 0.85) -> DataFrame:
    """Per key, from its last five decisions: four accepted raise the threshold by .02, two or fewer lower it by .05."""
    last = keep_last(history, [by], F.desc(order), 5)
    counts = last.groupBy(by).agg(F.sum(F.col(accepted).cast("int")).alias("accepted"))
    return counts.withColumn("threshold", F.round(F.lit(start) + F.when(F.col("accepted") >= 4, 0.02).when(F.col("accepted") <= 2, -0.05).otherwise(0.0), 6))
