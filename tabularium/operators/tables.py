"""Cleaning and merging of result tables.

A table is a DataFrame with an ordinal column where "first" and "last" matter:
row order is never taken from partitions.  Keyed steps are grouped minima
(combined before the shuffle), not windows, wherever only one row per key stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions import text as T


def first_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the least ``order`` of each key."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(F.min_by(rest, F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(df.columns)


def last_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(rest, F.col(order)).alias("_r")).select(*keys, "_r.*").select(df.columns)


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")).isin("", "0")


def drop_empty_columns(df: DataFrame, among: Sequence[str]) -> DataFrame:
    """Without those of ``among`` whose values are all '', '0' or null; all stay if none would."""
    some = df.agg(*[F.max(~blank(F.col(c))).alias(c) for c in among]).first()
    gone = {c for c in among if not some[c]}
    return df if len(gone) == len(among) else df.drop(*gone)


def harmonise(df: DataFrame, location: str, candidate: str, ballots: Sequence[str], order: str) -> DataFrame:
    """Blanks filled, repeated (location, candidate, ballots) rows dropped but for the first, empty ballot columns dropped."""
    filled = df.fillna("", subset=[c for c, t in df.dtypes if t == "string"])
    whole = ~blank(F.col(location)) & ~blank(F.col(candidate))
    keyed = first_rows(filled.where(whole), [location, candidate, *ballots], order)
    return drop_empty_columns(keyed.unionByName(filled.where(~whole)), ballots)


def informative_columns(df: DataFrame, least_filled: float = 0.05) -> list[str]:
    """Columns with two different values at least and enough of them filled: one pass, no distinct count."""
    row = df.agg(*[x for c in df.columns for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.avg((~blank(F.col(c))).cast("double")).alias(f"f_{c}"))]).first()
    return [c for c in df.columns if row[f"lo_{c}"] is not None and row[f"lo_{c}"] != row[f"hi_{c}"] and row[f"f_{c}"] >= least_filled]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.where(F.exists(F.array(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in df.columns]), lambda x: x != ""))


def drop_footers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without rows in which one of the columns holds a word for totals or miscellaneous counts."""
    words = T.TOTAL_WORDS + T.MISC_WORDS
    hit = F.lit(False)
    for c in columns:
        hit = hit | T.any_word(F.coalesce(F.col(c), F.lit("")), words)
    return df.where(~hit)


def union_filled(*tables: DataFrame) -> DataFrame:
    """Union by name; what a table lacks is ''."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.fillna("")


def merge_keyed(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join; a blank on the left is filled from the right."""
    extra = [c for c in right.columns if c not in keys]
    joined = left.join(right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in extra]), list(keys), "full_outer")
    pick = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.col(f"_r_{c}")).alias(c) if c in left.columns else F.col(f"_r_{c}").alias(c)
    return joined.select(*keys, *[pick(c) for c in extra], *[c for c in left.columns if c not in keys and c not in extra])


def numbered(df: DataFrame, by: Sequence[str], order: str, name: str = "row_idx") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def patch_by_position(df: DataFrame, other: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Columns of ``other``, row by row within each table."""
    right = numbered(other, by, order).select(*by, "row_idx", *columns)
    return numbered(df, by, order).join(right, [*by, "row_idx"], "left")


def basic_type(values: Column) -> Column:
    """Aggregate: 'int', 'percent' or 'str' by full match over the non-empty values."""
    text = F.nullif(F.trim(values), F.lit(""))
    every = lambda pattern: F.coalesce(F.bool_and(F.regexp_like(text, F.lit(pattern))), F.lit(False))
    return F.when(every(r"^\d{1,3}(,\d{3})*$|^\d+$"), "int").when(every(r"^\d+(\.\d+)?%$"), "percent").otherwise("str")


def statistical_type(values: Column) -> Column:
    """Aggregate: numeric (over 70 % parse), date (all parse), categorical (under ten values), else string."""
    text = F.nullif(F.trim(values), F.lit(""))
    number = F.avg(F.when(text.isNotNull(), F.replace(text, F.lit(","), F.lit("")).try_cast("double").isNotNull().cast("double")))
    dates = F.bool_and(F.when(text.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()))
    return F.when(number > 0.7, "numeric").when(dates, "date").when(F.count_distinct(text) < 10, "categorical").otherwise("string")


def melted(df: DataFrame, keys: Sequence[str], name: str = "header", value: str = "value") -> DataFrame:
    """One row for each key and other column; the values as text."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in rest])).alias("_c")).select(*keys, "_c.*")


def column_figures(df: DataFrame) -> DataFrame:
    """header, filled share, numeric share, distinct values, both inferred types: one pass over the cells."""
    cells = melted(df, [])
    text = F.nullif(F.trim("value"), F.lit(""))
    return cells.groupBy("header").agg(
        F.round(F.avg(text.isNotNull().cast("double")), 6).alias("filled"),
        F.round(F.avg(F.replace(text, F.lit(","), F.lit("")).try_cast("double").isNotNull().cast("double")), 6).alias("numeric"),
        F.count_distinct(text).alias("distinct_values"),
        basic_type(F.col("value")).alias("basic_type"),
        statistical_type(F.col("value")).alias("stat_type"),
    )


def merge_multiline(df: DataFrame, column: str) -> DataFrame:
    """'Name' over 'Party' in one cell becomes 'Name (Party)'."""
    parts = F.split(F.col(column), "\n")
    return df.withColumn(column, F.when(F.size(parts) == 2, F.concat(F.trim(parts[0]), F.lit(" ("), F.trim(parts[1]), F.lit(")"))).otherwise(F.col(column)))


def merge_next_rows(df: DataFrame, by: Sequence[str], order: str, column: str, others: Sequence[str]) -> DataFrame:
    """A row that holds only ``column`` is the second half of the row before it: joined as 'A (B)'."""
    window = Window.partitionBy(*by).orderBy(order)
    lone = F.forall(F.array(*[blank(F.col(c)) for c in others]), lambda x: x) & ~blank(F.col(column))
    marked = df.withColumn("_lone", lone)
    # runs of lone rows pair off from their start: a half is one at an odd place behind a full row
    marked = marked.withColumn("_run", F.sum((~F.col("_lone")).cast("int")).over(window)).withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_run").orderBy(order)))
    half = F.col("_lone") & (F.col("_place") % 2 == 0)
    marked = marked.withColumn("_half", half).withColumn("_next", F.lead(F.when(F.col("_half"), F.col(column))).over(window))
    merged = F.when(F.col("_next").isNotNull(), F.concat(F.col(column), F.lit(" ("), F.col("_next"), F.lit(")"))).otherwise(F.col(column))
    return marked.withColumn(column, merged).where(~F.col("_half")).select(df.columns)


def merged_headers(rows: Sequence[Column]) -> Column:
    """Header rows zipped: the parts of each column that are neither blank nor digits, joined by a space."""
    joined = F.arrays_zip(*[r.alias(f"h{i}") for i, r in enumerate(rows)])
    useful = lambda x: (F.coalesce(F.trim(x), F.lit("")) != "") & ~F.regexp_like(F.trim(x), F.lit(r"^\d+$"))
    return F.transform(joined, lambda z: F.array_join(F.filter(F.array(*[z[f"h{i}"] for i in range(len(rows))]), useful), " "))


def missing_columns(rows: DataFrame, table: str, required: dict[str, Column]) -> DataFrame:
    """table, n_rows, missing: the columns, of those required where their condition holds, that are blank in some row of a table."""
    gone = {c: F.bool_or(need & F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))) for c, need in required.items()}
    found = rows.groupBy(table).agg(F.count(F.lit(1)).alias("n_rows"), *[g.alias(c) for c, g in gone.items()])
    return found.select(table, "n_rows", F.array_join(F.array_compact(F.array(*[F.when(F.col(c), c) for c in required])), ",").alias("missing"))
