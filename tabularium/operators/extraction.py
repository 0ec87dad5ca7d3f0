"""Tables out of page segments: repeated rows, their headers, places and shares, candidates, and the chain that builds one result.

Segments are those of ``sources.pages``; a table is the rows (page_id, table_idx,
row_no, cells) of one container.  Containers, rows and cells are found by
equalities on (page_id, number), never by walking pages in Python again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions import text as T
from tabularium.operators import structures
from tabularium.sources.pages import HEADINGS

# Classes of containers that hold rows.
ROW_CLASSES = ("row", "table-row", "ballot-option", "candidate-info", "result-row", "precinct-row")
_NUMBER = r"^\d+([,.]\d+)?$"


def _children(found: DataFrame) -> DataFrame:
    """page_id, parent_idx, idx, text, place (from 0) of every segment below another one."""
    own = Window.partitionBy("page_id", "parent_idx").orderBy("idx")
    return found.where("parent_idx is not null").select("page_id", "parent_idx", "idx", "tag", "text").withColumn("place", F.row_number().over(own) - 1)


def repeated_rows(found: DataFrame, classes: tuple[str, ...] = ROW_CLASSES, least: int = 2, most: int = 100) -> DataFrame:
    """page_id, table_idx, heading, row_no, cells: the children of likely containers as rows, theirs as cells.

    Containers are divs of a likely class and list items, the first ``most`` of each
    selector and page; the heading is the nearest one before among the container's
    siblings, else 'Section i'.
    """
    kind = F.when((F.col("tag") == "div") & F.arrays_overlap("classes", F.array(*map(F.lit, classes))), F.array_intersect("classes", F.array(*map(F.lit, classes)))[0]).when(F.col("tag") == "li", "li")
    boxes = found.withColumn("selector", kind).where("selector is not null")
    boxes = boxes.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "selector").orderBy("idx"))).where(F.col("n") <= most)
    children = _children(found)
    heads = children.where(F.col("tag").isin(*HEADINGS)).select("page_id", "parent_idx", F.col("idx").alias("head_idx"), F.col("text").alias("head"))
    boxes = boxes.select("page_id", F.col("idx").alias("table_idx"), "parent_idx", "n")
    near = boxes.join(heads, ["page_id", "parent_idx"]).where("head_idx < table_idx").groupBy("page_id", "table_idx").agg(F.max_by("head", "head_idx").alias("head"))
    boxes = boxes.join(near, ["page_id", "table_idx"], "left").select("page_id", "table_idx", F.coalesce("head", F.concat(F.lit("Section "), F.col("n").cast("string"))).alias("heading"))
    rows = boxes.join(children.select("page_id", F.col("parent_idx").alias("table_idx"), F.col("idx").alias("row_idx"), F.col("place").alias("row_no")), ["page_id", "table_idx"])
    rows = rows.withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy("page_id", "table_idx"))).where(F.col("n_rows") >= least).drop("n_rows")
    cells = children.select("page_id", F.col("parent_idx").alias("row_idx"), F.struct("place", F.trim("text").alias("text")).alias("cell"))
    cells = cells.groupBy("page_id", "row_idx").agg(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["text"]).alias("cells"))
    return rows.join(cells, ["page_id", "row_idx"], "left").select("page_id", "table_idx", "heading", "row_no", F.coalesce("cells", F.array().cast("array<string>")).alias("cells"))


def headers_of(rows: DataFrame, within: int = 10) -> DataFrame:
    """page_id, table_idx, header_row, last_header_row, headers: the first of the leading rows with two known fields or no number, joined with the next one if that is words alone; 'Column i' names if there is none."""
    plain = F.forall("cells", lambda c: ~F.regexp_like(c, F.lit(_NUMBER)))
    table = ["page_id", "table_idx"]
    heads = rows.where((F.col("row_no") < within) & (structures.likely_header(F.col("cells")) | plain)).groupBy(*table).agg(F.min(F.struct("row_no", "cells")).alias("h"))
    every = rows.groupBy(*table).agg(F.min_by("cells", "row_no").alias("first")).join(heads, table, "left")
    guessed = F.transform("first", lambda _, i: F.concat(F.lit("Column "), (i + 1).cast("string")))
    every = every.select(*table, F.coalesce(F.col("h.row_no"), F.lit(-1)).alias("header_row"), F.coalesce(F.col("h.cells"), guessed).alias("headers"))
    words = F.forall("cells", lambda c: F.regexp_like(c, F.lit(r"(?U)^\p{Alpha}*$"))) & F.exists("cells", lambda c: c != "")
    second = rows.where(words).select(*table, (F.col("row_no") - 1).alias("header_row"), F.col("cells").alias("more"))
    both = F.transform(F.arrays_zip("headers", "more"), lambda z: F.array_join(F.filter(F.array(z["headers"], z["more"]), lambda x: F.coalesce(x, F.lit("")) != ""), " "))
    joined = every.join(second, [*table, "header_row"], "left")
    return joined.select(*table, "header_row", (F.col("header_row") + F.col("more").isNotNull().cast("int")).alias("last_header_row"), F.when(F.col("more").isNull(), F.col("headers")).otherwise(F.slice(both, 1, F.least(F.size("headers"), F.size("more")))).alias("headers"))


def body_of(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """page_id, table_idx, heading, row_no, values: rows behind the headers, as long as these, without footers and empty rows; values: header -> text."""
    body = rows.join(headers.select("page_id", "table_idx", "last_header_row", "headers"), ["page_id", "table_idx"]).where("row_no > last_header_row")
    footer = F.exists("cells", lambda c: T.any_word(c, T.MISC_WORDS + ("total",)))
    empty = F.forall("cells", lambda c: c == "")
    filled = F.transform("headers", lambda h, i: F.struct(h.alias("key"), F.coalesce(F.get("cells", i), F.lit("")).alias("value")))
    once = F.filter(filled, lambda e, i: F.array_position("headers", e["key"]) == i + 1)
    return body.where(~footer & ~empty).select("page_id", "table_idx", "heading", "row_no", F.map_from_entries(once).alias("values"))


def column_stats(rows: DataFrame, headers: DataFrame, sample: int = 20) -> DataFrame:
    """page_id, table_idx, header, numeric, empty, distinct: shares over the first ``sample`` rows behind the headers."""
    first = rows.join(headers.select("page_id", "table_idx", "last_header_row", "headers"), ["page_id", "table_idx"])
    first = first.where((F.col("row_no") > F.col("last_header_row")) & (F.col("row_no") <= F.col("last_header_row") + sample))
    cells = first.select("page_id", "table_idx", F.posexplode(F.arrays_zip("headers", F.slice("cells", 1, F.size("headers")).alias("value"))).alias("i", "z"))
    cells = cells.select("page_id", "table_idx", "i", F.col("z.headers").alias("header"), F.col("z.value").alias("value")).where("value is not null")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    found = cells.groupBy("page_id", "table_idx", "i", "header").agg(share(F.regexp_like("value", F.lit(_NUMBER))).alias("numeric"), share(F.col("value") == "").alias("empty"), F.size(F.collect_set("value")).alias("distinct"))
    return found.drop("i")


def section_headings(found: DataFrame, depth: int = 6) -> DataFrame:
    """page_id, idx, section: of each table, the first heading or span of the nearest ancestor (up to ``depth``) that has one, else the nearest one before among its siblings, else 'Section i'."""
    tables = found.where("tag = 'table'").withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("idx")))
    marks = found.where(F.col("tag").isin(*HEADINGS, "span") & (F.trim("text") != ""))
    firsts = marks.select("page_id", "idx", "text", F.explode("ancestors").alias("above")).groupBy("page_id", "above").agg(F.min_by("text", "idx").alias("head"))
    up = tables.select("page_id", "idx", F.posexplode(F.slice("ancestors", 1, depth)).alias("level", "above")).join(firsts, ["page_id", "above"])
    near = up.groupBy("page_id", "idx").agg(F.min_by("head", "level").alias("section"))
    beside = tables.select("page_id", "idx", "parent_idx").join(marks.select("page_id", "parent_idx", F.col("idx").alias("mark"), "text"), ["page_id", "parent_idx"])
    beside = beside.where("mark < idx").groupBy("page_id", "idx").agg(F.max_by("text", "mark").alias("sibling"))
    named = tables.select("page_id", "idx", "n").join(near, ["page_id", "idx"], "left").join(beside, ["page_id", "idx"], "left")
    return named.select("page_id", "idx", F.coalesce("section", "sibling", F.concat(F.lit("Section "), F.col("n").cast("string"))).alias("section"))


def with_place(body: DataFrame, whole_page: Column | None = None) -> DataFrame:
    """``values`` with a place and a share reported: columns that name them keep what they have, blanks get the heading and its share; new ones are named by the heading's word for a place."""
    keys = F.map_keys("values")
    has = lambda words: F.filter(keys, lambda k: T.any_word(k, words))
    word = F.coalesce(*[F.when(F.contains(F.lower("heading"), F.lit(w)), F.initcap(F.lit(w))) for w in T.LOCATION_WORDS], F.lit("District"))
    place = F.coalesce(F.get(has(T.LOCATION_WORDS), F.lit(0)), word)
    share = F.coalesce(F.get(has(("percent", "reported", "%")), F.lit(0)), F.lit("Percent Reported"))
    told = F.coalesce(T.percent_reported(F.col("heading")), whole_page if whole_page is not None else F.lit(None).cast("string"), F.lit(""))
    fill = lambda name, value: F.coalesce(F.nullif(F.element_at("values", name), F.lit("")), value)
    entries = F.map_from_entries(F.array(F.struct(place.alias("key"), fill(place, F.col("heading")).alias("value")), F.struct(share.alias("key"), fill(share, told).alias("value"))))
    others = F.map_filter("values", lambda k, _: ~F.map_contains_key(entries, k))
    return body.withColumn("values", F.map_concat(others, entries)).withColumn("place_column", place)


def candidates(tables: DataFrame, repeated: DataFrame, pattern: DataFrame) -> DataFrame:
    """source, page_id, table_idx, headers, n_rows: tables by markup, by repeated rows and by approved patterns, in that order."""
    own = [df.select(F.lit(i).alias("rank"), F.lit(name).alias("source"), "page_id", "table_idx", "headers", "n_rows") for i, (name, df) in enumerate((("table", tables), ("repeated", repeated), ("pattern", pattern)))]
    return own[0].unionByName(own[1]).unionByName(own[2])


def first_of_headers(found: DataFrame) -> DataFrame:
    """Of the candidates of a page with the same headers, the first source's first."""
    rest = F.struct("source", "table_idx", "headers", "n_rows")
    best = found.groupBy("page_id", T.signature(F.col("headers")).alias("signature")).agg(F.min_by(rest, F.struct("rank", "table_idx")).alias("r"))
    return best.select("page_id", "r.*")


def fuller(candidate_major: DataFrame, precinct_major: DataFrame, key: str) -> DataFrame:
    """Long cells (key, unit, column, value) of two readings: of each key the reading with more cells that are neither blank nor zero; ties go to the first."""
    full = ~F.coalesce(F.trim(F.col("value").cast("string")), F.lit("")).isin("", "0")
    both = candidate_major.withColumn("reading", F.lit("candidate-major")).unionByName(precinct_major.withColumn("reading", F.lit("precinct-major")))
    counts = both.groupBy(key).agg(F.count_if(full & (F.col("reading") == "candidate-major")).alias("c"), F.count_if(full & (F.col("reading") == "precinct-major")).alias("p"))
    chosen = counts.select(key, F.when(F.col("c") >= F.col("p"), "candidate-major").otherwise("precinct-major").alias("reading"))
    return both.join(chosen, [key, "reading"])


def candidate_and_party(name: Column) -> Column:
    """'No Name Words Party' as 'Name Words (Party)'; fewer than three words as they are."""
    parts = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    n = F.size(parts)
    return F.when(n >= 3, F.concat(F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(1))), " "), F.lit(" ("), F.element_at(parts, -1), F.lit(")"))).otherwise(F.array_join(parts, " "))


def sibling_reports(found: DataFrame, mark: str = "fw-bold") -> DataFrame:
    """page_id, idx, report: a segment's own marked span with 'Reported', else the first one within a sibling."""
    spans = found.where((F.col("tag") == "span") & F.array_contains("classes", mark) & F.contains("text", F.lit("Reported"))).select("page_id", F.col("idx").alias("span"), "text", F.concat(F.array("idx"), "ancestors").alias("up"))
    held = spans.select("page_id", "span", "text", F.explode("up").alias("idx")).groupBy("page_id", "idx").agg(F.min_by("text", "span").alias("own"))
    rows = found.select("page_id", "idx", "parent_idx").join(held, ["page_id", "idx"], "left")
    beside = rows.where("own is not null and parent_idx is not null").groupBy("page_id", "parent_idx").agg(F.min_by("own", "idx").alias("sibling"))
    return rows.join(beside, ["page_id", "parent_idx"], "left").select("page_id", "idx", F.coalesce("own", "sibling", F.lit("")).alias("report"))


def grouped_labels(nodes: DataFrame, key: str, labels: str, value: str) -> DataFrame:
    """label, key, value: nodes by each of their labels, once; a label's nodes are in the order of ``key``, and as many rows as they are."""
    return nodes.select(key, F.explode(F.array_distinct(labels)).alias("label"), value).select("label", key, value)


def label_digests(grouped: DataFrame, key: str, value: str, span: int = 10_000) -> DataFrame:
    """label, digest, n: of each label, the md5 of its nodes' values in the order of ``key`` (a number of its own for each node), comma-joined, and how many they are.

    Runs of ``span`` keys are joined in tasks of their own; only the digest, which is a chain,
    takes a label's runs one after the other, without holding them.
    """
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ",")
    runs = grouped.groupBy("label", F.floor(F.col(key) / span).alias("run")).agg(values.alias("values"), F.count(F.lit(1)).alias("n"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, digest, n, out = None, None, 0, []
        for batch in batches:
            for own, text, size in zip(*(batch.column(c) for c in ("label", "values", "n")), strict=True):
                own, text, size = own.as_py(), text.as_py().encode(), size.as_py()
                if digest is None or own != label:
                    if digest is not None:
                        out.append((label, digest.hexdigest(), n))
                    label, digest, n = own, hashlib.md5(text), size
                else:
                    digest.update(b"," + text)
                    n += size
        if digest is not None:
            out.append((label, digest.hexdigest(), n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["label", "digest", "n"])

    return runs.repartition("label").sortWithinPartitions("label", "run").select("label", "values", "n").mapInArrow(chained, "label string, digest string, n long")


def segment_texts(found: DataFrame) -> Column:
    """What stands for a segment in a search by meaning: tag, attributes by name, text."""
    pairs = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(" ", "tag", F.array_join(pairs, " "), "text")


def titles_near(found: DataFrame, tag: str = "table", window: int = 5) -> DataFrame:
    """page_id, idx, title: of each segment with the tag, the first heading or caption of more than two words within ``window`` segments, in page order; null if there is none."""
    titles = found.where(F.col("tag").isin("h1", "h2", "h3", "caption") & (F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) > 2)).select("page_id", F.col("idx").alias("_at"), "text")
    # a title is near 2 * window + 1 places: it meets them by an equality
    near = titles.select("page_id", "_at", "text", F.explode(F.sequence(F.col("_at") - window, F.col("_at") + window)).alias("idx"))
    first = near.groupBy("page_id", "idx").agg(F.min_by("text", "_at").alias("title"))
    return found.where(F.col("tag") == tag).select("page_id", "idx").join(first, ["page_id", "idx"], "left")
