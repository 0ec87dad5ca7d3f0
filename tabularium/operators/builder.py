"""One result table for each page: candidates of three sources, scored, patched, annotated, cleaned, classified, pivoted.

A candidate is rows (page_id, source, table_idx, row_no, headers, values), ``values`` a map
of header to text; sources are table markup, repeated rows and lists, in that order.  The
best candidate of a page is its table.  Where that has generic headers or no rows, it is
patched: joined with the rows of the page's other tables, of those with the same headers
the longest, and the candidates are scored again; the patched one is taken if none scores higher.  That is a
loop over written stages, at most ``most_patches`` rounds, and it ends when a round changes
no page.  Pages never meet each other: all steps are grouped by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions import spans
from tabularium.functions import text as T
from tabularium.session import cut
from tabularium.sources import pages as P

from . import extraction as X
from . import structures

# Headers that are a place's, whole and whatever the case.
PLACE_HEADERS = ("location", "precinct", "ward", "district", "area", "city", "municipal", "town")
TABLE = ["page_id", "source", "table_idx"]
_GENERIC = r"(?i)^(column.*)?$"


def _map(entries: Column) -> Column:
    """(header, value) entries as a map; of equal headers the first."""
    heads = F.transform(entries, lambda e: e["header"])
    once = F.filter(entries, lambda e, i: F.array_position(heads, e["header"]) == i + 1)
    return F.map_from_entries(F.transform(once, lambda e: F.struct(e["header"].alias("key"), F.coalesce(e["value"], F.lit("")).alias("value"))))


def candidates(found: DataFrame) -> DataFrame:
    """page_id, source, rank, table_idx, row_no, headers, values of all tables that the segments of pages hold."""

    def of_cells(cells: DataFrame, rank: int, source: str) -> DataFrame:
        heads = cells.groupBy("page_id", "table_idx").agg(F.transform(F.array_sort(F.collect_set(F.struct("col_idx", "header"))), lambda x: x["header"]).alias("headers"))
        rows = cells.groupBy("page_id", "table_idx", F.col("row_idx").alias("row_no")).agg(F.array_sort(F.collect_list(F.struct("col_idx", "header", "value"))).alias("cells"))
        rows = rows.join(heads, ["page_id", "table_idx"]).select("page_id", F.lit(source).alias("source"), F.lit(rank).alias("rank"), "table_idx", "row_no", "headers", _map(F.col("cells")).alias("values"))
        return rows

    rows = X.repeated_rows(found)
    heads = X.headers_of(rows)
    repeated = X.body_of(rows, heads).join(heads.select("page_id", "table_idx", "headers"), ["page_id", "table_idx"]).select("page_id", F.lit("repeated").alias("source"), F.lit(1).alias("rank"), "table_idx", "row_no", "headers", "values")
    return of_cells(P.table_cells(found), 0, "markup").unionByName(repeated).unionByName(of_cells(P.list_cells(found), 2, "list"))


def scored(tables: DataFrame) -> DataFrame:
    """TABLE, rank, headers, n_rows, generic, score of each candidate.

    What a model would say of a table is the share of its headers that tell a field; it has
    entities if a cell names a person or a number.
    """
    full = F.size(F.filter(F.map_values("values"), lambda v: F.trim(v) != ""))
    named = F.exists(F.map_values("values"), lambda v: F.regexp_like(v, F.lit(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b|^\d[\d,.]*$")))
    facts = tables.groupBy(*TABLE, "rank", "headers").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(full).alias("full"), F.bool_or(named).alias("entities"))
    width = F.size("headers")
    known = "(?i)" + "|".join(p for p, _ in spans.HEADER_RULES)
    model = F.size(F.filter("headers", lambda h: F.regexp_like(h, F.lit(known)))) / F.greatest(width, F.lit(1))
    generic = F.exists("headers", lambda h: F.regexp_like(F.trim(h), F.lit(_GENERIC)))
    fill = F.col("full") / F.greatest(F.col("n_rows") * width, F.lit(1))
    return facts.select(*TABLE, "rank", "headers", "n_rows", generic.alias("generic"), structures.candidate_score(model, F.col("n_rows"), width, fill, F.col("entities"), generic).alias("score"))


def best(tables: DataFrame) -> DataFrame:
    """The rows of each page's best candidate (score; of equal ones a patched one, else by source and place), with its score and whether its headers are generic."""
    order = F.struct(-F.col("score"), F.when(F.col("source") == "patched", 0).otherwise(1), "rank", "table_idx")
    first = scored(tables).groupBy("page_id").agg(F.min_by(F.struct("source", "table_idx", "score", "generic"), order).alias("b")).select("page_id", "b.*")
    return tables.join(first, TABLE)


def patched(chosen: DataFrame, tables: DataFrame, round_: int) -> DataFrame:
    """Candidates of pages whose table is generic: its rows and those of the page's other tables, each once, with the headers of all."""
    open_ = chosen.where("generic")
    sizes = tables.withColumn("signature", T.signature(F.col("headers"))).groupBy("page_id", "signature", *TABLE[1:], "rank").agg(F.count(F.lit(1)).alias("n"))
    longest = sizes.groupBy("page_id", "signature").agg(F.min_by(F.struct("source", "table_idx"), F.struct(-F.col("n"), "rank", "table_idx")).alias("t")).select("page_id", "t.*")
    others = tables.join(longest, TABLE).join(open_.select("page_id").distinct(), "page_id", "left_semi")
    columns = ["page_id", "rank", "source", "table_idx", "row_no", "headers", "values"]
    both = open_.select(*columns, F.lit(0).alias("late")).unionByName(others.select(*columns, F.lit(1).alias("late")))
    order = F.struct("late", "rank", "table_idx", "row_no")
    heads = both.groupBy("page_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("late", "rank", "table_idx", "headers"))), lambda x: x["headers"]))).alias("all"))
    rows = both.join(heads, "page_id").withColumn("values", F.map_from_entries(F.transform("all", lambda h: F.struct(h.alias("key"), F.coalesce(F.element_at("values", h), F.lit("")).alias("value")))))
    once = rows.groupBy("page_id", "all", F.to_json("values").alias("said")).agg(F.min(order).alias("at"), F.first("values").alias("values"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1
    return once.select("page_id", F.lit("patched").alias("source"), F.lit(3).alias("rank"), F.lit(-round_).alias("table_idx"), place.alias("row_no"), F.col("all").alias("headers"), "values")


def chosen(tables: DataFrame, most_patches: int = 2) -> DataFrame:
    """The rows of each page's table, patched where its headers are generic; rounds: how many patches it took part in."""
    own = cut(best(tables).withColumn("rounds", F.lit(0)), "chosen")
    for n in range(1, most_patches + 1):
        if own.where("generic").isEmpty():
            break
        more = tables.unionByName(patched(own, tables, n))
        again = best(more.join(own.where("generic").select("page_id").distinct(), "page_id", "left_semi")).withColumn("rounds", F.lit(n))
        said = lambda df: df.groupBy("page_id").agg(F.sum(F.xxhash64("row_no", "headers", F.to_json("values")).cast("decimal(38,0)")).alias("said"))
        again = cut(again, "patched")
        changed = cut(said(again).withColumnRenamed("said", "now").join(said(own), "page_id").where("now <> said").select("page_id"), "changed")
        own = cut(own.join(changed, "page_id", "left_anti").unionByName(again.join(changed, "page_id", "left_semi")), "chosen")
        if changed.isEmpty():
            break
    return own


def annotated(rows: DataFrame) -> DataFrame:
    """rows with people, places, ballots, numbers: what a row's cells name, each once, in order."""
    cells, low = F.map_values("values"), F.lower(F.concat_ws(" ", F.map_keys("values"), F.map_values("values")))
    people = F.flatten(F.transform(cells, lambda v: F.regexp_extract_all(v, F.lit(r"(\b[A-Z][a-z]+ [A-Z][a-z]+\b)"), F.lit(1))))
    known = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    numbers = F.filter(cells, lambda v: F.regexp_like(F.regexp_replace(v, "[,.]", ""), F.lit(r"^\d+$")))
    return rows.withColumns({"people": F.array_sort(F.array_distinct(people)), "places": known(T.LOCATION_WORDS), "ballots": known(T.BALLOT_ORDER), "numbers": F.array_sort(F.array_distinct(numbers))})


def _roles(rows: DataFrame) -> DataFrame:
    """rows with place_header and candidate_header: the first header of its kind, or null."""
    first = lambda rule: F.get(F.filter("headers", rule), F.lit(0))
    return rows.withColumns({"place_header": first(lambda h: F.lower(h).isin(*PLACE_HEADERS)), "candidate_header": first(lambda h: T.any_word(h, T.CANDIDATE_WORDS))})


def cleaned(rows: DataFrame) -> DataFrame:
    """Rows that say the same as an earlier one of their page go, if they name a place and a candidate; a row that has a candidate's cell alone is the end of the one before it: 'A (B)'."""
    value = lambda name: F.coalesce(F.element_at("values", F.col(name)), F.lit(""))
    rows = _roles(rows).withColumns({"_place": value("place_header"), "_candidate": value("candidate_header")})
    whole = (F.col("_place") != "") & (F.col("_candidate") != "")
    said = F.when(whole, F.to_json("values")).otherwise(F.col("row_no").cast("string"))
    rest = F.struct(*rows.columns)
    kept = rows.groupBy("page_id", said.alias("_said")).agg(F.min_by(rest, "row_no").alias("r")).select("r.*")
    others = F.filter(F.map_entries("values"), lambda e: (e["key"] != F.col("candidate_header")) & (F.trim(e["value"]) != ""))
    kept = kept.withColumn("_alone", (F.col("_candidate") != "") & (F.size(others) == 0) & (F.size("headers") > 1))
    by = Window.partitionBy("page_id").orderBy("row_no")
    kept = kept.withColumns({"_next": F.lead(F.when(F.col("_alone"), F.col("_candidate"))).over(by), "_before": F.lag("_alone").over(by)})
    kept = kept.where(~(F.col("_alone") & F.coalesce(~F.col("_before"), F.lit(False))))
    joined = F.when(~F.col("_alone") & F.col("_next").isNotNull(), F.concat("_candidate", F.lit(" ("), "_next", F.lit(")"))).otherwise(F.col("_candidate"))
    named = F.transform_values("values", lambda k, v: F.when(k == F.col("candidate_header"), F.regexp_replace(joined, r"^(.*?)\s*\n\s*(.*)$", "$1 ($2)")).otherwise(v))
    return kept.withColumn("values", named).drop("_place", "_candidate", "_said", "_alone", "_next", "_before")


def classified(rows: DataFrame) -> DataFrame:
    """page_id, structure, n_places: already-wide (places, and two headers or more that name a ballot type), precinct-major, candidate-major or ambiguous."""
    places = F.count_distinct(F.nullif(F.element_at("values", F.col("place_header")), F.lit("")))
    wide = F.size(F.filter("headers", lambda h: T.any_word(h, T.BALLOT_ORDER))) >= 2
    facts = rows.groupBy("page_id").agg(places.alias("n_places"), F.bool_or(F.col("candidate_header").isNotNull()).alias("c"), F.bool_or(F.col("place_header").isNotNull()).alias("p"), F.bool_or(wide & F.col("candidate_header").isNull()).alias("w"))
    return facts.select("page_id", structures.orientation(F.col("c"), F.col("p"), F.col("w")).alias("structure"), "n_places")


def built(found: DataFrame, most_patches: int = 2) -> tuple[DataFrame, DataFrame]:
    """The results of pages, and what is told of them.

    Cells: page_id, unit, column, value.  Tables of several places with candidates are
    pivoted: a unit is a place, a column a candidate with a further header ('Ann - Votes');
    of equal ones the first row's value stays.  Others keep their rows, numbered, as units.
    Facts: page_id, source, score, rounds, structure, n_rows, people, numbers (how many different ones).
    """
    tables = cut(candidates(found), "candidates")
    rows = cut(cleaned(annotated(chosen(tables, most_patches))), "rows")
    kinds = cut(classified(rows), "kinds")
    marked = rows.join(kinds, "page_id")
    pivots = (F.col("n_places") > 1) & F.col("candidate_header").isNotNull() & (F.col("structure") != "already-wide")
    cells = marked.select("page_id", "row_no", pivots.alias("pivots"), "place_header", "candidate_header", "values", F.explode("values").alias("header", "value"))
    key = F.concat(F.element_at("values", F.col("candidate_header")), F.lit(" - "), "header")
    wide = cells.where(F.col("pivots") & (F.col("header") != F.col("place_header")) & (F.col("header") != F.col("candidate_header"))).select("page_id", "row_no", F.element_at("values", F.col("place_header")).alias("unit"), key.alias("column"), "value")
    wide = wide.where("unit <> ''").groupBy("page_id", "unit", "column").agg(F.min_by("value", "row_no").alias("value"))
    long = cells.where(~F.col("pivots")).select("page_id", F.col("row_no").cast("string").alias("unit"), F.col("header").alias("column"), "value")
    facts = rows.groupBy("page_id", "source", "score", "rounds").agg(F.count(F.lit(1)).alias("n_rows"))
    names = rows.select("page_id", F.inline(F.arrays_zip(F.array(F.lit("people"), F.lit("numbers")).alias("kind"), F.array("people", "numbers").alias("found")))).select("page_id", "kind", F.explode("found").alias("name"))
    names = names.groupBy("page_id").agg(F.count_distinct(F.when(F.col("kind") == "people", F.col("name"))).alias("people"), F.count_distinct(F.when(F.col("kind") == "numbers", F.col("name"))).alias("numbers"))
    facts = facts.join(kinds.select("page_id", "structure"), "page_id").join(names, "page_id", "left").fillna(0, ["people", "numbers"])
    return wide.unionByName(long), facts
