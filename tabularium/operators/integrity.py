"""Integrity rules, outliers and counts: one row per issue found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions import text as T


def issues(contests: DataFrame, key: str, title: str, year: str, state: str, county: str, order: str) -> DataFrame:
    """key, issue: 'duplicate' from the second contest of a title, year and place on; 'missing_location'; 'missing_year'."""
    own = Window.partitionBy(F.lower(F.trim(title)), year, state, county).orderBy(order)
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    found = F.array_compact(
        F.array(F.when(F.col("_n") > 1, "duplicate"), F.when(blank(state) & blank(county), "missing_location"), F.when(blank(year) | ~F.regexp_like(F.coalesce(F.col(year).cast("string"), F.lit("")), F.lit(r"^\d+$")), "missing_year"))
    )
    return contests.withColumn("_n", F.row_number().over(own)).select(key, F.explode(found).alias("issue"))


def cross_field(contests: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, issue for every rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return contests.select(key, F.explode(broken).alias("issue"))


def z_outliers(df: DataFrame, by: Sequence[str], value: str, limit: float = 3.0) -> DataFrame:
    """Rows further than ``limit`` population standard deviations from their group's mean; none where that is 0."""
    if by:
        joined = df.join(df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")), list(by))
    else:
        joined = df.withColumns({"mean": df.agg(F.avg(value)).scalar(), "std": df.agg(F.stddev_pop(value)).scalar()})
    return joined.where("std > 0").withColumn("z", (F.col(value) - F.col("mean")) / F.col("std")).where(F.abs("z") > limit).drop("mean", "std")


def contamination(scores: DataFrame, score: str, share: float = 0.9, low: float = 0.01, high: float = 0.2) -> DataFrame:
    """The share of rows at or above the ``share`` quantile, within bounds."""
    over = scores.withColumn("_over", F.col(score) >= scores.agg(F.percentile(score, share)).scalar())
    return over.agg(F.greatest(F.lit(low), F.least(F.lit(high), F.round(F.avg(F.col("_over").cast("double")), 6))).alias("contamination"))


def suspicious(df: DataFrame, key: str, title: str, state: str, county: str) -> DataFrame:
    """Titles that are not valid, with reasons."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    reasons = F.array_compact(F.array(F.when(blank(state), "no state"), F.when(blank(county), "no county"), F.when(T.any_word(F.coalesce(F.col(title), F.lit("")), T.NOISE_WORDS), "noise")))
    return df.select(key, F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def counts_by(df: DataFrame, *by: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def top_counts(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return counts_by(df, by).orderBy(F.desc("n"), by).limit(n)


def run_summary(log: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """One row: how many keys ended in each status, by their last entry."""
    from tabularium.operators.tables import last_rows

    last = last_rows(log.select(key, status, order), [key], order)
    return last.agg(F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col(status) == s).alias(s) for s in ("success", "partial", "fail", "error")])
