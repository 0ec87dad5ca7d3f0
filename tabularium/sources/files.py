"""Readers of lists, delimited text, line text, JSON records and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def listing(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """path, modified, size, hash of the files with that ending; newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash")).orderBy(F.desc("modified"), "path")


def with_preamble(spark: SparkSession, path: str, words: tuple[str, ...], most: int = 10, most_columns: int = 5000) -> DataFrame:
    """CSV files behind lines of notes, each file by itself: its header is the first of its leading lines that holds one of the words, else its first line; what stands above is skipped, whatever it says.

    A line's place counts from the start of its file, in the file's first block, which is read in order by one task.
    Cells that are empty, and columns that a file lacks, are null; rows without any value are dropped.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("first"), F.monotonically_increasing_id().alias("id"))
    begun = lines.where("first").groupBy("file").agg(F.min("id").alias("id0"))
    lines = lines.join(begun, "file").withColumn("place", F.when(F.col("first"), F.col("id") - F.col("id0")))
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("value"), w))
    head = lines.where(F.col("place") < most).groupBy("file").agg(F.min(F.when(hit, F.struct("place", "value"))).alias("named"), F.min(F.struct("place", "value")).alias("top"))
    head = head.select("file", F.coalesce("named.place", "top.place").alias("at"), F.transform(F.split(F.coalesce("named.value", "top.value"), ","), lambda h: F.trim(h)).alias("names"))
    places = head.select(F.posexplode("names").alias("i", "name")).groupBy("name").agg(F.min("i").alias("i")).orderBy("i", "name").limit(most_columns + 1).collect()
    widest = head.agg(F.coalesce(F.max(F.size("names")), F.lit(1))).first()[0]
    if len(places) > most_columns or widest > most_columns:
        raise ValueError(f"more than {most_columns} columns")
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(widest)))
    body = lines.join(head, "file").where("place is null or place > at").select("names", cells.alias("r"))
    body = body.select("names", F.array(*[F.trim(F.col("r")[f"c{i}"]) for i in range(widest)]).alias("cells"))
    cell = lambda name: F.get("cells", F.array_position("names", name).cast("int") - 1)
    return body.where(F.exists("cells", lambda x: F.coalesce(x, F.lit("")) != "")).select(*[cell(r["name"]).alias(r["name"]) for r in places])


# What columns of results are called, by the name they get.
SYNONYMS = {"county": ("county", "jurisdiction", "parish"), "rep": ("rep", "republican", "gop"), "dem": ("dem", "democrat", "democratic"), "total": ("total", "total votes", "sum")}


def interpreted(texts: DataFrame, key: str, text: str, needed: tuple[tuple[str, ...], ...] = (("county",), ("rep", "dem"))) -> DataFrame:
    """key, row, values, error: delimited texts with the mark that their first lines have most of, headers by their synonyms; one row with an error where none of some needed columns is there."""
    from tabularium.functions.text import delimiter

    names = F.create_map(*[F.lit(x) for name, own in SYNONYMS.items() for word in own for x in (word, name)])
    lines = texts.select(key, delimiter(F.col(text)).alias("mark"), F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("lines"))
    parts = lines.select(key, F.transform("lines", lambda x: F.transform(F.split(x, F.concat(F.lit("["), "mark", F.lit("]"))), lambda c: F.trim(c))).alias("rows"))
    heads = parts.withColumn("headers", F.transform(F.get("rows", F.lit(0)), lambda h: F.coalesce(F.element_at(names, F.lower(h)), h)))
    ok = F.lit(True)
    for some in needed:
        ok = ok & F.arrays_overlap("headers", F.array(*map(F.lit, some)))
    wrong = heads.where(~ok).select(key, F.lit(None).cast("int").alias("row"), F.lit(None).cast("map<string, string>").alias("values"), F.lit("essential headers are missing").alias("error"))
    body = heads.where(ok).select(key, "headers", F.posexplode(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).alias("row", "cells"))
    right = body.select(key, "row", F.map_from_entries(F.filter(F.transform("headers", lambda h, i: F.struct(h.alias("k"), F.coalesce(F.get("cells", i), F.lit("")).alias("v"))), lambda e, i: F.array_position("headers", e["k"]) == i + 1)).alias("values"))
    return right.select(key, "row", "values", F.lit(None).cast("string").alias("error")).unionByName(wrong)


def flat_tables(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Table-like text: lines cut at two spaces or more, tabs and bars; those with the most frequent number of cells, if two lines have it and it is over one."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    cells = F.filter(F.split("value", r"\s{2,}|\t|\|"), lambda x: F.trim(x) != "")
    lines = lines.select(key, "line", F.transform(cells, lambda x: F.trim(x)).alias("cells")).withColumn("width", F.size("cells")).where("width > 1")
    widths = lines.groupBy(key, "width").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    modal = widths.groupBy(key).agg(F.max(F.struct("n", "width")).alias("m")).select(key, F.col("m.width").alias("width"))
    return lines.join(modal, [key, "width"]).select(key, "line", "width", "cells")


def text_blocks(texts: DataFrame, key: str, text: str, header: str) -> DataFrame:
    """Groups of lines: one that matches ``header`` opens a group; key, block, line, value, opens."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value")).withColumn("opens", F.regexp_like("value", F.lit(header)))
    block = F.sum(F.col("opens").cast("int")).over(Window.partitionBy(key).orderBy("line"))
    return lines.withColumn("block", block).where("block > 0")


# What opens a contest in a block of text, and what tells a party.
CONTEST_WORDS = ("president", "senate", "congress", "governor")
PARTY_WORDS = ("democratic", "republican", "conservative", "working", "families", "write-in")


def contest_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, contest_no, contest, row_no, candidate, party, percentage, votes: the rows that blocks of text tell.

    A line that names an office opens a contest.  The lines below it, blank ones aside, go
    by fours: a candidate, then three that are a percentage, a number of votes or a party
    by their shape (the last of a kind counts; others are ignored).  A contest without
    lines has no rows.  Fours are counted from the contest's line, so what a line is needs
    no look ahead: a running count and one grouping, both within a text.
    """
    lines = texts.select(key, F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("line", "value")).withColumn("value", F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).where("value <> ''")
    opens = F.exists(F.array(*map(F.lit, CONTEST_WORDS)), lambda w: F.contains(F.lower("value"), w))
    before = Window.partitionBy(key).orderBy("line")
    lines = lines.withColumn("contest_no", F.sum(opens.cast("int")).over(before)).withColumn("start", F.max(F.when(opens, F.struct("line", "value"))).over(before)).withColumn("place", F.row_number().over(before))
    lines = lines.withColumn("first", F.max(F.when(opens, F.col("place"))).over(before)).where(~opens & (F.col("contest_no") > 0))
    lines = lines.withColumn("place", F.col("place") - F.col("first") - 1)
    value, last = F.col("value"), lambda rule: F.max_by("value", F.when(rule & (F.col("place") % 4 > 0), F.col("line")))
    percent, votes = F.contains("value", F.lit("%")), F.regexp_like(F.replace("value", F.lit(","), F.lit("")), F.lit(r"^\d+$"))
    party = F.exists(F.array(*map(F.lit, PARTY_WORDS)), lambda w: F.contains(F.lower(value), w))
    rows = lines.groupBy(key, "contest_no", F.col("start.value").alias("contest"), F.floor(F.col("place") / 4).alias("row_no")).agg(
        F.min_by("value", "line").alias("candidate"), last(party & ~percent & ~votes).alias("party"), last(percent).alias("percentage"), last(votes & ~percent).alias("votes")
    )
    return rows


def manifest(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last entry of each key."""
    from tabularium.operators.tables import last_rows

    return last_rows(entries, keys, order)
