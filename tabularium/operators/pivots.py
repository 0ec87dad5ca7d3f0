"""Wide result tables from long cells.

A pivot names its columns beforehand where the caller knows them; otherwise the
distinct keys are collected once, sorted, and bounded by ``most_columns`` (more
is an error, not a silent cut).  All pivots are one partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions import text as T
from tabularium.functions.names import organisation


def column_key(candidate: Column, party: Column, ballot: Column) -> Column:
    return F.concat(candidate, F.lit(" ("), party, F.lit(") - "), ballot)


def keys_of(df: DataFrame, key: str, most_columns: int = 5000) -> list[str]:
    found = [r[0] for r in df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(most_columns + 1).collect()]
    if len(found) > most_columns:
        raise ValueError(f"more than {most_columns} columns")
    return found


def pivoted(df: DataFrame, unit: str, key: str, value: Column, keys: Sequence[str] | None = None) -> DataFrame:
    return df.groupBy(unit).pivot(key, list(keys) if keys is not None else keys_of(df, key)).agg(value)


def with_totals(wide: DataFrame, unit: str, groups: dict[str, Sequence[str]], total: str = "Grand Total") -> DataFrame:
    """One total per group of columns, and the grand total; nulls count as 0."""
    add = lambda names: sum((F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names), F.lit(0).cast("bigint"))
    out = wide.select("*", *[add(names).alias(name) for name, names in groups.items()])
    return out.withColumn(total, add([n for names in groups.values() for n in names]))


def with_total_row(wide: DataFrame, unit: str, name: str = "TOTAL") -> DataFrame:
    """One more row with the sums of all numeric columns."""
    numeric = [c for c, t in wide.dtypes if c != unit and t in ("bigint", "int", "double")]
    sums = wide.agg(*[F.sum(f"`{c}`").alias(c) for c in numeric])
    return wide.unionByName(sums.withColumn(unit, F.lit(name)), allowMissingColumns=True)


def wide_results(votes: DataFrame, unit: str = "unit", keys: Sequence[str] | None = None) -> DataFrame:
    """votes (unit, candidate, party, ballot, votes_raw) -> columns candidate (party) - ballot, totals per candidate, grand total, TOTAL row."""
    cells = votes.withColumn("v", T.votes(F.col("votes_raw"))).withColumn("key", column_key(F.col("candidate"), F.col("party"), F.col("ballot")))
    names = list(keys) if keys is not None else keys_of(cells, "key")
    wide = pivoted(cells, unit, "key", F.sum("v"), names)
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(n.rsplit(" - ", 1)[0] + " - Total Votes", []).append(n)
    return with_total_row(with_totals(wide, unit, groups), unit)


def first_wins(cells: DataFrame, unit: str, key: str, value: str, order: str, keys: Sequence[str] | None = None) -> DataFrame:
    """The first non-empty value of each cell."""
    return pivoted(cells.where(F.coalesce(F.trim(value), F.lit("")) != ""), unit, key, F.min_by(value, order), keys)


def last_wins(cells: DataFrame, unit: str, key: str, value: str, order: str, keys: Sequence[str] | None = None) -> DataFrame:
    return pivoted(cells.where(F.coalesce(F.trim(value), F.lit("")) != ""), unit, key, F.max_by(value, order), keys)


def parsed_headers(cells: DataFrame, header: str = "header") -> DataFrame:
    """candidate, party, ballot of 'Candidate (Party) - Ballot' or 'Candidate - Ballot'; all null for other headers."""
    full, short = r"^(.+?)\s*\((.+?)\)\s*-\s*(.+)$", r"^(.+?)\s*-\s*(.+)$"
    part = lambda pattern, i: F.nullif(F.regexp_extract(header, pattern, i), F.lit(""))
    whole = F.regexp_like(F.col(header), F.lit(full))
    return cells.select(
        "*",
        F.when(whole, part(full, 1)).otherwise(part(short, 1)).alias("candidate"),
        F.when(whole, part(full, 2)).alias("party"),
        F.when(whole, part(full, 3)).otherwise(part(short, 2)).alias("ballot"),
    )


def ballot_rank(ballot: Column) -> Column:
    """Place in the customary order of ballot types; others follow, to be sorted by name."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, T.BALLOT_ORDER)), F.lower(ballot)), F.lit(0)), F.lit(len(T.BALLOT_ORDER) + 1))


def grand_total_row(df: DataFrame, first: str, name: str = "Grand Total") -> DataFrame:
    """One more row with the sums of the columns that are counts in every row; '' in the others."""
    others = [c for c in df.columns if c != first]
    checks = df.agg(*[F.bool_and(T.votes(F.col(c)).isNotNull()).alias(c) for c in others]).first()
    sums = [F.sum(T.votes(F.col(c))).cast("string").alias(c) if checks[c] else F.lit("").alias(c) for c in others]
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unionByName(df.agg(*sums).withColumn(first, F.lit(name)))


def nested_results(docs: DataFrame, column: str) -> DataFrame:
    """Long rows (contest, candidate, party, precinct, method, votes) of nested results JSON in a text column."""
    schema = (
        "struct<results: struct<ballotItems: array<struct<name: string, ballotOptions: array<struct<name: string, politicalParty: string,"
        " precinctResults: array<struct<name: string, voteCount: bigint, groupResults: array<struct<groupName: string, voteCount: bigint>>>>>>>>>>"
    )
    items = docs.select(F.inline_outer(F.from_json(column, schema).results.ballotItems)).withColumnRenamed("name", "contest")
    options = items.select("contest", F.inline_outer("ballotOptions")).withColumnRenamed("name", "candidate").withColumnRenamed("politicalParty", "party")
    precincts = options.select("contest", "candidate", "party", F.inline_outer("precinctResults"))
    precincts = precincts.select("contest", "candidate", "party", F.nullif("name", F.lit("-")).alias("precinct"), F.col("voteCount").alias("all_votes"), "groupResults")
    groups = precincts.select("contest", "candidate", "party", "precinct", "all_votes", F.inline_outer("groupResults"))
    method = F.when(F.col("groupName") == "Mail-In", "Absentee Mail").otherwise(F.col("groupName"))
    return groups.select("contest", "candidate", "party", "precinct", method.alias("method"), F.col("voteCount").alias("votes"), "all_votes")


def candidate_cells(rows: DataFrame, candidate: str, location: str, ballots: Sequence[str], order: str) -> DataFrame:
    """location ('All' where there is none), column, value of tables with a row for each candidate.

    Columns are 'name (party) - ballot', 'name (party) - Total' and 'Grand Total'; the party
    is an organisation that the candidate's cell names, else Other.  Counts are numbers with
    or without commas, else 0; of two rows of a candidate and place the last one counts.
    """
    name = F.trim(F.split(F.col(candidate), "\n")[0])
    label = F.concat(name, F.lit(" ("), F.coalesce(organisation(F.col(candidate)), F.lit("Other")), F.lit(")"))
    counts = {b: F.coalesce(T.votes(F.col(b)), F.lit(0)) for b in ballots}
    own = rows.select(F.coalesce(F.col(location), F.lit("All")).alias("location"), label.alias("label"), F.col(order).alias("_order"), F.struct(*[c.alias(b) for b, c in counts.items()]).alias("_counts"))
    last = own.groupBy("location", "label").agg(F.max_by("_counts", "_order").alias("_counts"))
    total = sum((F.col("_counts")[b] for b in ballots), F.lit(0))
    cells = [F.struct(F.concat("label", F.lit(f" - {b}")).alias("column"), F.col("_counts")[b].alias("value")) for b in ballots]
    cells += [F.struct(F.concat("label", F.lit(" - Total")).alias("column"), total.alias("value")), F.struct(F.lit("Grand Total").alias("column"), total.alias("value"))]
    return last.select("location", F.inline(F.array(*cells))).groupBy("location", "column").agg(F.sum("value").alias("value"))
