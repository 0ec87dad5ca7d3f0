"""Joins and lookups: routes through small dimensions, contained-in matches, anti-joins.

Dimensions are joined by equality and Spark broadcasts them by their measured
size.  Contained-in matches are made equalities: the text's words (or word
pairs) meet the dimension's.  Close matches are in ``similar``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def routed(rows: DataFrame, *steps: tuple[DataFrame, str]) -> DataFrame:
    """Left joins up a chain of parents: each step (dimension, key) adds its columns."""
    for dim, key in steps:
        rows = rows.join(dim, key, "left")
    return rows


def contained(texts: DataFrame, key: str, text: str, words: DataFrame, word: str) -> DataFrame:
    """texts x words where the word is one of the text's: an equality on exploded distinct words."""
    own = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))).alias("_w"))
    return own.join(words, F.col("_w") == F.lower(word)).drop("_w")


def unmatched(rows: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    return rows.join(matched.select(key).distinct(), key, "left_anti")


def filtered(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Equality on every key, whatever the case."""
    for k, v in wanted.items():
        rows = rows.where(F.lower(F.trim(F.col(k).cast("string"))) == v.lower().strip())
    return rows


def scored(rows: DataFrame, parts: Sequence[tuple[float, Column]], name: str = "score") -> DataFrame:
    """A weighted sum of conditions and numbers; null counts as 0."""
    return rows.withColumn(name, F.round(sum((w * F.coalesce(p.cast("double"), F.lit(0.0)) for w, p in parts), F.lit(0.0)), 6))


def best_per_key(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def overridden(rows: DataFrame, text: str, hints: DataFrame, most: int = 1000) -> DataFrame:
    """rows with ``module``: that of the first hint (ord, fragment, module) whose fragment the text holds; the hints are a list of bounded size (checked)."""
    found = hints.orderBy("ord").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} hints")
    table = F.array(*[F.struct(F.lit(r["fragment"]).alias("fragment"), F.lit(r["module"]).alias("module")) for r in found]) if found else F.expr("cast(array() as array<struct<fragment: string, module: string>>)")
    return rows.withColumn("module", F.get(F.filter(table, lambda h: F.contains(F.col(text), h["fragment"])), F.lit(0))["module"])


def first_source(keys: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """key, source, and the rows of the first source that has any of the key: each source is asked only for what the earlier ones lack."""
    out, rest = None, keys
    for i, source in enumerate(sources):
        own = source.join(rest, key, "left_semi").withColumn("source", F.lit(i))
        out = own if out is None else out.unionByName(own)
        rest = rest.join(source.select(key).distinct(), key, "left_anti")
    return out
