"""Which columns of a table tell the place and the share reported, what kinds of table it is, and what it names.

Tables are long cells: ``by`` (one or more columns) names the table, then row_idx,
col_idx, header, value, as ``sources.pages.table_cells`` returns them; ``headers`` are
by, col_idx, header.  A row may lack cells; those count as blank.  Everything is sums of
cells by column, row and table, so no table is gathered into a list and a table of any
length is met by map-side sums.  Cells that are dealt by their table stay where they are:
what is found out about tables comes to them, and no cell is shuffled or sorted for it.

A null value is blank; a null header is a blank one; a table without rows or headers has
no result; of columns that score alike the first is taken.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions import text as T
from tabularium.session import cut

from . import similar

# Names of places and of shares reported, in headers; "ed" is only looked for as a whole header.
LOCATION_NAMES = ("precinct", "ward", "district", "city", "municipal", "location", "area", "ed", "district name", "division", "subdistrict", "polling place")
PERCENT_NAMES = ("% precincts reporting", "% reporting", "percent reporting")
PERCENT_WORDS = ("percent", "reported", "reporting")


def _said(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def location_headers(headers: DataFrame, by: Sequence[str], entity: Column | None = None, locations: Sequence[str] = LOCATION_NAMES, percents: Sequence[str] = PERCENT_NAMES) -> DataFrame:
    """by, location_header, location_method, percent_header, percent_method of each table, in stages.

    A place is a header that is a known name ('exact'), else one that contains a name of
    more than two letters ('contains'), else one of which ``entity`` says so ('entity'),
    else the first ('first'); a share is 'exact', 'contains', or holds '%' ('sign'), else
    there is none.  Within a stage the first header counts.
    """
    low = T.collapse(_said("header"))
    holds = lambda names: T.any_word(low, tuple(n for n in names if len(n) > 2))
    place = F.when(low.isin(*locations), 0).when(holds(locations), 1)
    place = (place if entity is None else place.when(F.coalesce(entity, F.lit(False)), 2)).otherwise(3)
    share = F.when(low.isin(*percents), 0).when(holds(percents), 1).when(F.contains(low, F.lit("%")), 2)
    rows = headers.select(*by, "col_idx", "header", place.alias("_place"), share.alias("_share"))
    first = rows.groupBy(*by).agg(F.min(F.struct("_place", "col_idx", "header")).alias("_p"), F.min(F.when(F.col("_share").isNotNull(), F.struct("_share", "col_idx", "header"))).alias("_s"))
    method = lambda c, names: F.coalesce(*[F.when(c == i, F.lit(n)) for i, n in enumerate(names)])
    return first.select(
        *by, F.col("_p.header").alias("location_header"), method(F.col("_p._place"), ("exact", "contains", "entity", "first")).alias("location_method"),
        F.col("_s.header").alias("percent_header"), method(F.col("_s._share"), ("exact", "contains", "sign")).alias("percent_method"))


def known_values(cells: DataFrame, known: DataFrame, name: str, scope: Sequence[str] = (), least: float = 0.8) -> DataFrame:
    """scope, value: the different values of cells (in lower case) that are at least ``least`` like a ``known`` name, whatever the case.  They are written, so that Spark knows how few they are."""
    values = cells.select(*scope, F.lower("value").alias("_v")).where("_v <> ''")
    names = known.where(F.col(name).isNotNull()).select(*scope, F.lower(name).alias("_known"))
    return cut(similar.close_pairs(values, "_v", names, "_known", least, scope).select(*scope, F.col("_v").alias("value")).distinct(), "alike")


def _sums(cells: DataFrame, by: Sequence[str], rows: str | None, *sums: Column) -> DataFrame:
    """by, col_idx, header, ``sums``, and _rows: how many rows the table has."""
    own = cells.groupBy(*by, "col_idx", "header")
    if rows is not None:
        return own.agg(*sums, F.max(rows).alias("_rows"))
    return own.agg(*sums).join(cells.groupBy(*by).agg(F.count_distinct("row_idx").alias("_rows")), list(by))


def _yes(c: Column, points: float) -> Column:
    return F.when(c, F.lit(float(points))).otherwise(F.lit(0.0))


def _share(c: str) -> Column:
    return F.round(F.col(c) / F.col("_rows"), 6)


def _beyond(c: str) -> Column:
    return F.when(F.col(c) > 0.5, 0.5 + F.col(c)).otherwise(F.lit(0.0))


def _signs() -> Column:
    return F.count_if(F.contains(_said("value"), F.lit("%"))).alias("_signs")


def _percent_score() -> Column:
    """By header and percent_share."""
    low = F.lower(_said("header"))
    sign = _yes(T.any_word(low, PERCENT_WORDS), 1)
    sign = F.when(sign > 0, sign).otherwise(_yes(F.contains(low, F.lit("%")), 0.8))
    return F.round(F.greatest(sign, _beyond("percent_share")), 6).alias("percent_score")


def percent_scores(cells: DataFrame, by: Sequence[str], rows: str | None = None) -> DataFrame:
    """by, col_idx, header, percent_share, percent_score of each column, as ``column_scores`` has them, and first_sign, the first row with a sign there; values are not held against any names."""
    first = F.min(F.when(F.contains(_said("value"), F.lit("%")), F.col("row_idx"))).alias("first_sign")
    return _sums(cells, by, rows, _signs(), first).withColumn("percent_share", _share("_signs")).select(*by, "col_idx", "header", "percent_share", _percent_score(), "first_sign")


def column_scores(cells: DataFrame, by: Sequence[str], known: DataFrame, name: str, scope: Sequence[str] = (), entity: Column | None = None, header_score: float = 0.5, least: float = 0.8, rows: str | None = None, alike: DataFrame | None = None) -> DataFrame:
    """by, col_idx, header, known_share, percent_share, location_score, percent_score of each column.

    A place scores by its header (1 if ``entity`` says that it names one; ``header_score``
    and .3 if it holds a word for a place and is not 'candidate'), by its values (.7 if
    more than half are ``known`` names, or at least ``least`` like one, whatever the case;
    .2 if there are more than three different ones, and not all numbers), or, where that
    is more, .5 and the share of known values if that is beyond a half.  A share scores 1 for a word,
    else .8 for a sign in the header, or .5 and the share of values with a sign if that is
    beyond a half.  ``scope``: columns of both that a known name must agree in, as the county.
    ``rows``: a column of cells that has how many rows their table has; counted if not
    given.  ``alike``: ``known_values`` of these cells, if they are at hand.
    """
    alike = known_values(cells, known, name, scope, least) if alike is None else alike
    said = cells.select(*dict.fromkeys([*by, *scope]), "col_idx", "header", "value", F.lower(_said("value")).alias("_v"), rows or "row_idx")
    said = said.join(alike.select(*scope, F.col("value").alias("_v"), F.lit(True).alias("_like")), [*scope, "_v"], "left")
    digits = F.regexp_like(F.replace("_v", F.lit(","), F.lit("")), F.lit(r"^\d+$"))
    columns = _sums(
        said, by, rows, F.count(F.lit(1)).alias("_n"), F.count("_like").alias("_hits"), _signs(), F.count_distinct("_v").alias("_values"),
        F.count_if(F.col("_v") == "").alias("_blank"), F.bool_and((F.col("_v") == "") | digits).alias("_numbers"))
    low = F.lower(_said("header"))
    named = T.any_word(low, T.LOCATION_WORDS) & (low != "candidate")
    # cells that a short row lacks are one more value, the blank one
    values = F.col("_values") + ((F.col("_n") < F.col("_rows")) & (F.col("_blank") == 0)).cast("int")
    head = _yes(named, header_score + 0.3)
    if entity is not None:
        head = head + _yes(F.coalesce(entity, F.lit(False)) & (low != "candidate"), 1)
    place = head + _yes(F.col("known_share") > 0.5, 0.7) + _yes((values > 3) & ~F.col("_numbers"), 0.2)
    out = columns.withColumn("known_share", _share("_hits")).withColumn("percent_share", _share("_signs"))
    return out.select(*by, "col_idx", "header", "known_share", "percent_share", F.round(F.greatest(place, _beyond("known_share")), 6).alias("location_score"), _percent_score())


def picked_columns(scores: DataFrame, by: Sequence[str], beyond: float = 0.7) -> DataFrame:
    """by, location_idx, location, percent_idx, percent: the best column of each kind; null if none scores more than ``beyond``."""
    best = lambda c: F.max(F.when(F.col(c) > beyond, F.struct(c, (-F.col("col_idx")).alias("at"), "header")))
    found = scores.groupBy(*by).agg(best("location_score").alias("_l"), best("percent_score").alias("_p"))
    return found.select(*by, (-F.col("_l.at")).alias("location_idx"), F.col("_l.header").alias("location"), (-F.col("_p.at")).alias("percent_idx"), F.col("_p.header").alias("percent"))


def marked_columns(scores: DataFrame, by: Sequence[str], beyond: float = 0.7) -> DataFrame:
    """scores, and is_location, is_percent: whether ``picked_columns`` has the column.  Scores that are dealt by their table stay there, and are made once."""
    from pyspark.sql import Window

    best = lambda c: F.max(F.when(F.col(c) > beyond, F.struct(c, (-F.col("col_idx")).alias("at")))).over(Window.partitionBy(*by))["at"]
    taken = lambda c: F.coalesce(F.col("col_idx") == -best(c), F.lit(False))
    return scores.select("*", taken("location_score").alias("is_location"), taken("percent_score").alias("is_percent"))


def picked_percent(scores: DataFrame, by: Sequence[str], beyond: float = 0.7) -> DataFrame:
    """by, percent_idx, percent, as ``picked_columns`` has them, and own_row, any_row, any_idx: the first row with a sign in that column, and row and column of the table's first cell with one.  From ``percent_scores``."""
    best = F.max(F.when(F.col("percent_score") > beyond, F.struct("percent_score", (-F.col("col_idx")).alias("at"), "header", "first_sign"))).alias("_p")
    found = scores.groupBy(*by).agg(best, F.min(F.when(F.col("first_sign").isNotNull(), F.struct("first_sign", "col_idx"))).alias("_f"))
    return found.select(*by, (-F.col("_p.at")).alias("percent_idx"), F.col("_p.header").alias("percent"), F.col("_p.first_sign").alias("own_row"), F.col("_f.first_sign").alias("any_row"), F.col("_f.col_idx").alias("any_idx"))


def with_percent(cells: DataFrame, picked: DataFrame, by: Sequence[str], whole_page: Column | None = None) -> DataFrame:
    """Cells (by, row_idx, col_idx, header, value) whose share column has no blanks any more, if the table tells a share.

    That is the column's first value with a sign, else ``whole_page`` (an expression over
    ``picked``), else the table's first cell with a sign.  Rows that lack the cell get it.
    """
    signs = cells.where(F.contains(_said("value"), F.lit("%"))).groupBy(*by, "col_idx").agg(F.min("row_idx").alias("_row"))
    signs = signs.join(picked.select(*by, "percent_idx"), list(by)).groupBy(*by).agg(
        F.min(F.when(F.col("col_idx") == F.col("percent_idx"), F.col("_row"))).alias("own_row"), F.min(F.struct(F.col("_row").alias("any_row"), F.col("col_idx").alias("any_idx"))).alias("_f"))
    told = picked.join(signs.select(*by, "own_row", "_f.any_row", "_f.any_idx"), list(by), "left")
    rows = cells.groupBy(*by, "row_idx").agg(F.collect_list(F.struct("col_idx", "header", "value")).alias("cells"))
    return rows_with_percent(rows, told, by, whole_page)


def rows_with_percent(rows: DataFrame, picked: DataFrame, by: Sequence[str], whole_page: Column | None = None) -> DataFrame:
    """As ``with_percent``, of rows: by, row_idx, cells (an array of col_idx, header, value), and what ``picked_percent`` returns.  Rows dealt and sorted by their table are neither shuffled nor sorted; only ``picked`` is."""
    from pyspark.sql import Window

    page = F.lit(None).cast("string") if whole_page is None else whole_page
    own, told = F.col("own_row").isNotNull(), picked.where("percent_idx is not null").withColumn("_page", page)
    row, at = F.when(own, F.col("own_row")).when(F.col("_page").isNull(), F.col("any_row")), F.when(own, F.col("percent_idx")).otherwise(F.col("any_idx"))
    told = told.select(*by, "percent_idx", F.col("percent").alias("_header"), "_page", row.alias("_row"), at.alias("_at"))
    rows = rows.select(*by, "row_idx", "cells").join(told.hint("shuffle_hash"), list(by), "left")
    sign = F.get(F.filter("cells", lambda c: (c["col_idx"] == F.col("_at")) & F.contains(c["value"], F.lit("%"))), F.lit(0))["value"]
    found = F.max(F.when(F.col("row_idx") == F.col("_row"), sign)).over(Window.partitionBy(*by))
    rows = rows.withColumn("_fill", F.coalesce(found, "_page"))
    blank = lambda c: F.coalesce(c["value"], F.lit("")) == ""
    cell = lambda i, header, v: F.struct(i.alias("col_idx"), header.alias("header"), v.alias("value"))
    filled = F.transform("cells", lambda c: cell(c["col_idx"], c["header"], F.when((c["col_idx"] == F.col("percent_idx")) & blank(c), F.col("_fill")).otherwise(c["value"])))
    has = F.coalesce(F.array_contains("cells.col_idx", F.col("percent_idx")), F.lit(False))
    lacking = F.concat("cells", F.array(cell(F.col("percent_idx"), F.col("_header"), F.col("_fill"))))
    whole = F.when(F.col("_fill").isNull(), F.col("cells")).when(has, filled).otherwise(lacking)
    return rows.select(*by, "row_idx", F.inline(whole)).select(*by, "row_idx", "col_idx", "header", _said("value").alias("value"))


def previews(cells: DataFrame, picked: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, kind, value: what a table names, once each: values of candidates' columns, headers of kinds of ballot, numbers of up to three digits before the point, values of the place's column."""
    rows = cells.where(_said("value") != "").select(*by, "col_idx", "header", "value").join(picked.select(*by, "location_idx").hint("shuffle_hash"), list(by), "left")
    # asked of every cell, so one pattern for all words
    holds = lambda words: F.regexp_like(F.lower(_said("header")), F.lit("|".join(map(re.escape, words))))
    kinds = F.array(
        F.when(holds(T.CANDIDATE_WORDS), F.struct(F.lit("candidate").alias("kind"), F.col("value").alias("value"))),
        F.when(holds(T.BALLOT_ORDER), F.struct(F.lit("ballot_type").alias("kind"), F.col("header").alias("value"))),
        F.when(F.regexp_like(F.replace("value", F.lit(","), F.lit("")), F.lit(r"^-?\d{1,3}(\.\d+)?%?$")), F.struct(F.lit("number").alias("kind"), F.col("value").alias("value"))),
        F.when(F.col("col_idx") == F.col("location_idx"), F.struct(F.lit("location").alias("kind"), F.col("value").alias("value"))))
    return rows.select(*by, F.inline(kinds)).where("kind is not null").distinct()


def predicates(cells: DataFrame, headers: DataFrame, by: Sequence[str], person: Column | None = None, place: Column | None = None) -> DataFrame:
    """by and what holds of each table that has headers.

    candidate_rows: the first header is a word for candidates, with more rows than one;
    candidate_cols: a header is, and none is a word for a place; precinct_major: the first
    header is a word for a place; flat_candidates: the first is a word for candidates and
    all hold one or a word for totals; single_row: there is one row; candidate_footer: a
    cell of the last row holds a word for candidates or for what is no vote; shape: 'wide'
    (more than ten headers, fewer than ten rows), 'long' (at most five, more than ten) or
    'ambiguous'; by_entities: 'precinct-major' if headers name persons and places
    (``person``, ``place``: expressions over a header; by words if not given),
    'candidate-major' if persons alone, else 'ambiguous'.
    """
    low = T.collapse(_said("header"))
    is_candidate, is_place = low.isin(*T.CANDIDATE_WORDS), low.isin(*T.LOCATION_WORDS)
    person = T.any_word(low, T.CANDIDATE_WORDS) if person is None else F.coalesce(person, F.lit(False))
    place = T.any_word(low, T.LOCATION_WORDS) if place is None else F.coalesce(place, F.lit(False))
    heads = headers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_cols"), F.min_by(is_candidate, "col_idx").alias("_first_candidate"), F.min_by(is_place, "col_idx").alias("precinct_major"), F.bool_or(is_candidate).alias("_any"),
        F.bool_or(is_place).alias("_placed"), F.bool_and(T.any_word(low, T.TOTAL_WORDS + T.CANDIDATE_WORDS)).alias("_plain"), F.bool_or(person).alias("_person"), F.bool_or(place).alias("_place"))
    ends = cells.groupBy(*by, "row_idx").agg(F.bool_or(T.any_word(T.collapse(_said("value")), T.CANDIDATE_WORDS + T.MISC_WORDS)).alias("_footer"))
    rows = ends.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.max_by("_footer", "row_idx").alias("_footer"))
    both = heads.join(rows, list(by), "left").withColumn("_rows", F.coalesce("_rows", F.lit(0)))
    shape = F.when((F.col("_cols") > 10) & (F.col("_rows") < 10), "wide").when((F.col("_cols") <= 5) & (F.col("_rows") > 10), "long").otherwise("ambiguous")
    return both.select(
        *by, (F.col("_first_candidate") & (F.col("_rows") > 1)).alias("candidate_rows"), (F.col("_any") & ~F.col("_placed")).alias("candidate_cols"), "precinct_major",
        (F.col("_first_candidate") & F.col("_plain")).alias("flat_candidates"), (F.col("_rows") == 1).alias("single_row"), F.coalesce("_footer", F.lit(False)).alias("candidate_footer"), shape.alias("shape"),
        F.when(F.col("_person") & F.col("_place"), "precinct-major").when(F.col("_person"), "candidate-major").otherwise("ambiguous").alias("by_entities"))
