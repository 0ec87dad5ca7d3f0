"""Pages with one table for each precinct below its label: cells by candidate and method of voting.

Segments are those of ``sources.pages``.  In page order a label opens a precinct and a
table closes it, so a table belongs to the last label since the table before it, and one
without a label of its own is left out.  A table without column heads in a ``thead`` or
rows in a ``tbody`` is none, and closes nothing.  Labels are headings of the third level
and spans, those within tables too, that name a kind of place or hold a digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extraction import candidate_and_party

# Words of labels, as they are written.
LABEL_WORDS = ("Ward", "District", "Precinct", "Point", "Town")
TOTAL = "Total Votes"


def is_label(text: Column) -> Column:
    """Whether a text names a precinct: by a word for it, or a digit."""
    return F.exists(F.array(*map(F.lit, LABEL_WORDS)), lambda w: F.contains(text, w)) | F.regexp_like(text, F.lit(r"\d"))


def precinct_cells(found: DataFrame, marks: tuple[str, ...] = ("fw-bold", "ng-star-inserted"), reported: str = "Fully Reported") -> DataFrame:
    """page_id, table_idx, precinct, report, candidate, method, votes: one row for each candidate and method of a precinct.

    The first column of a table names candidates ('No Name Words Party' as 'Name Words
    (Party)'), the last is their total, those between are methods.  Rows that are not as
    long as the heads are left out; of rows of one candidate, or heads of one name, the
    last counts.  ``report`` is ``reported`` if a span of the page with the classes
    ``marks`` holds it, else ''.
    """
    page = ["page_id"]
    tags = found.select("page_id", F.col("idx").alias("above"), F.col("tag").alias("above_tag")).where("above_tag in ('table', 'thead', 'tbody', 'tr')")
    up = found.where("tag in ('th', 'td')").select("page_id", "idx", "tag", F.trim("text").alias("text"), F.posexplode("ancestors").alias("up", "above")).join(tags, ["page_id", "above"])
    near = lambda tag: F.min_by("above", F.when(F.col("above_tag") == tag, F.col("up")))
    cells = up.groupBy("page_id", "idx").agg(F.first("tag").alias("tag"), F.first("text").alias("text"), near("table").alias("table_idx"), near("tr").alias("tr"), F.bool_or(F.col("above_tag") == "thead").alias("head"), F.bool_or(F.col("above_tag") == "tbody").alias("body"))
    cells = cells.where("table_idx is not null and tr is not null")
    heads = cells.where("head and tag = 'th'").withColumn("place", F.row_number().over(Window.partitionBy("page_id", "table_idx").orderBy("idx")))
    heads = heads.select("page_id", "table_idx", "place", F.col("text").alias("method"))
    widths = heads.groupBy("page_id", "table_idx").agg(F.max("place").alias("width"))
    rows = cells.where("body and tag = 'td'").withColumn("place", F.row_number().over(Window.partitionBy("page_id", "tr").orderBy("idx")))
    lengths = rows.groupBy("page_id", "table_idx", "tr").agg(F.count(F.lit(1)).alias("length"), F.max(F.when(F.col("place") == 1, F.col("text"))).alias("name"))
    tables = widths.join(lengths.select("page_id", "table_idx").distinct(), ["page_id", "table_idx"])

    labels = found.where(F.col("tag").isin("h3", "span") & is_label(F.col("text"))).select("page_id", "idx", F.struct(F.trim("text").alias("label")).alias("event"))
    events = labels.unionByName(tables.select("page_id", F.col("table_idx").alias("idx"), F.struct(F.lit(None).cast("string").alias("label")).alias("event")))
    before = Window.partitionBy("page_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    opened = events.withColumn("precinct", F.last("event").over(before)["label"]).where(F.col("event.label").isNull() & F.col("precinct").isNotNull())
    tables = tables.join(opened.select("page_id", F.col("idx").alias("table_idx"), "precinct"), ["page_id", "table_idx"])

    whole = lengths.join(tables, ["page_id", "table_idx"]).where("length = width").select("page_id", "table_idx", "tr", "width", "precinct", candidate_and_party(F.col("name")).alias("candidate"))
    votes = rows.where("place > 1").select("page_id", "tr", "place", F.col("text").alias("votes")).join(whole, ["page_id", "tr"]).join(heads, ["page_id", "table_idx", "place"])
    votes = votes.withColumn("method", F.when(F.col("place") == F.col("width"), TOTAL).otherwise(F.col("method")))
    last = votes.groupBy("page_id", "table_idx", "precinct", "candidate", "method").agg(F.max_by("votes", F.struct("tr", "place")).alias("votes"))
    spans = found.where((F.col("tag") == "span") & (F.size(F.array_except(F.array(*map(F.lit, marks)), "classes")) == 0) & F.contains("text", F.lit(reported)))
    told = spans.select(*page).distinct().withColumn("report", F.lit(reported))
    return last.join(told, page, "left").select("page_id", "table_idx", "precinct", F.coalesce("report", F.lit("")).alias("report"), "candidate", "method", "votes")


def with_missing(cells: DataFrame, blank: str = "-") -> DataFrame:
    """``precinct_cells`` with a ``blank`` cell for each method of a table and each candidate that an earlier table of the page has and it has not."""
    seen = cells.groupBy("page_id", "candidate").agg(F.min("table_idx").alias("_since"))
    methods = cells.select("page_id", "table_idx", "precinct", "report", "method").distinct()
    # a page's tables meet its own candidates: that is the result's size
    every = methods.join(seen, "page_id").where("_since <= table_idx").drop("_since")
    keys = ["page_id", "table_idx", "candidate", "method"]
    return every.join(cells.select(*keys, "votes"), keys, "left").select("page_id", "table_idx", "precinct", "report", "candidate", "method", F.coalesce("votes", F.lit(blank)).alias("votes"))
