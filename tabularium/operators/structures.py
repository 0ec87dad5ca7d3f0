"""What kind of table is it, and which of several is best: roles of headers, scores, choices."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions import text as T


def header_role(header: Column) -> Column:
    """'location', 'percent', 'candidate', 'total' or 'other' by the domain's words, in that order."""
    rule = F.when(T.any_word(header, T.LOCATION_WORDS), "location").when(F.contains(header, F.lit("%")) | T.any_word(header, ("percent", "reported", "reporting")), "percent")
    return rule.when(T.any_word(header, T.CANDIDATE_WORDS), "candidate").when(T.any_word(header, T.TOTAL_WORDS), "total").otherwise("other")


def orientation(has_candidates: Column, has_locations: Column, wide_headers: Column) -> Column:
    """Aggregated facts of a table -> its structure."""
    rule = F.when(wide_headers & has_locations, "already-wide").when(has_candidates & has_locations, "precinct-major")
    return rule.when(has_candidates, "candidate-major").otherwise("ambiguous")


def candidate_score(model: Column, n_rows: Column, n_cols: Column, fill: Column, entities: Column, generic: Column) -> Column:
    """Weighted parts, a fill ratio of .7 or less costs .5; within 0 and 1."""
    part = lambda x, most: F.least(x / most, F.lit(1.0))
    fill_part = F.when(fill > 0.7, fill).otherwise(F.lit(-0.5))
    total = 0.5 * model + 0.2 * part(n_rows, 10) + 0.2 * part(n_cols, 8) + fill_part + 0.2 * entities.cast("double") - 0.2 * generic.cast("double")
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)


def best_of_signature(tables: DataFrame, signature: str, size: str, order: str) -> DataFrame:
    """Of tables with one signature, the one with most rows; ties: the first."""
    rest = F.struct(*[c for c in tables.columns if c != signature])
    best = tables.groupBy(signature).agg(F.max_by(rest, F.struct(F.col(size), -F.col(order))).alias("_r"))
    return best.select(signature, "_r.*").select(tables.columns)


def top_one(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def chosen(rows: DataFrame, order: str, choice: str) -> DataFrame:
    """'all', or the rows at the places named ('1,3'), counted from 1 in the given order; other places are ignored."""
    if choice.strip().lower() == "all":
        return rows
    places = sorted({int(x) for x in choice.split(",") if x.strip().isdigit() and int(x) > 0})
    if not places:
        return rows.limit(0)
    head = rows.orderBy(order).limit(places[-1])
    return head.withColumn("_n", F.row_number().over(Window.orderBy(order))).where(F.col("_n").isin(places)).drop("_n")


def merge_similar_headers(df: DataFrame, least: float = 0.85) -> DataFrame:
    """Columns whose names are alike become one, named as the first: its value, else that of the next one."""
    groups: list[list[str]] = []
    for name in df.columns:
        low = name.lower().strip()
        own = next((g for g in groups if SequenceMatcher(None, g[0].lower().strip(), low).ratio() > least), None)
        if own is None:
            groups.append([name])
        else:
            own.append(name)
    filled = lambda n: F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit(""))
    return df.select(*[F.col(f"`{g[0]}`") if len(g) == 1 else F.coalesce(*map(filled, g)).alias(g[0]) for g in groups])


def merged_maps(left: Column, right: Column) -> Column:
    """Keys of both; the right one's value wins where it has one."""
    return F.map_zip_with(left, right, lambda _, a, b: F.coalesce(b, a))


def unseen(library: DataFrame, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The library with the values of ``found`` that it lacks, whatever their case."""
    key = F.concat_ws("\x1f", *[F.lower(F.trim(F.col(c).cast("string"))) for c in columns])
    new = found.select(*columns).withColumn("_k", key).groupBy("_k").agg(*[F.min(c).alias(c) for c in columns])
    return library.select(*columns).unionByName(new.join(library.select(key.alias("_k")), "_k", "left_anti").drop("_k"))


def as_of(history: DataFrame, keys: Sequence[str], order: str, version: int) -> DataFrame:
    """The state after the given version: the last row of each key up to it."""
    from tabularium.operators.tables import last_rows

    return last_rows(history.where(F.col(order) <= version), keys, order)


def rows_of_lines(lines: DataFrame, key: str, text: str, width: int, mark: str = r"\s{2,}|\t|,") -> DataFrame:
    """key, cells of the lines that split into just ``width`` parts."""
    return lines.select(key, F.transform(F.split(text, mark), lambda x: F.trim(x)).alias("cells")).where(F.size("cells") == width)


def header_lines(texts: DataFrame, key: str, text: str, hints: tuple[str, ...], least: int = 2) -> DataFrame:
    """The first line of each text that holds ``least`` of the hints."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value")).where(T.words_present(F.col("value"), hints) >= least)
    return lines.groupBy(key).agg(F.min(F.struct("line", "value")).alias("z")).select(key, "z.*")


KNOWN_FIELDS = ("candidate", "votes", "percent", "party", "district")


def likely_header(cells: Column) -> Column:
    """Whether two of the cells, equal ones included, are known field names."""
    return F.size(F.filter(cells, lambda c: F.lower(c).isin(*KNOWN_FIELDS))) >= 2


def top_n(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def rescanned(headers: DataFrame, table: str, order: str, name: str, score: Column, entity: Column, least: float = 0.85) -> DataFrame:
    """table, order, header, score, mean, passed, kept of every header.

    A table whose headers score ``least`` on average keeps them; else each becomes the first
    entity that it names, and of headers that are equal then, the first stays (kept).
    """
    rows = headers.withColumn("score", F.round(score, 6))
    means = rows.groupBy(table).agg(F.round(F.avg("score"), 6).alias("mean"))
    rows = rows.join(means, table).withColumn("passed", F.col("mean") >= least).withColumn("_new", F.when(F.col("passed"), F.col(name)).otherwise(F.coalesce(entity, name)))
    first = rows.groupBy(table, "_new").agg(F.min(order).alias("_first"))
    return rows.join(first, [table, "_new"]).select(table, order, F.col("_new").alias("header"), "score", "mean", "passed", (F.col("passed") | (F.col(order) == F.col("_first"))).alias("kept"))
