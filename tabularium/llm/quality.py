"""Quality rules: cross-document line frequency, and per-text base figures.  DataFrame functions only.

A line (split at line feeds) is normalised to lower case with single spaces and
hashed together with its host (the ``source`` column).  A line that more than
``most_docs`` different documents of a host hold is boilerplate there and is
removed; a document that keeps less than half of its words is depleted and
rejected.  The count is a partial aggregation on one 64-bit key, so a line that
a third of all rows hold costs one row per task; the keys over the limit are at
most (lines / limit).  Rows that share an id are one document: what they
count too much is taken off, for ids that come more than once alone.  Common
lines meet the lines they are among by a join in ``salts`` parts of each key.

Base figures: ``n_repeat_words`` marks, in the list of a text's 3-word windows
sorted by hash, those equal to a neighbour, word by word, and counts the words
they cover; should another window have the same hash, it looks at all windows.

Defined results: a null or empty text has zeros and fails the base; a very long
text is judged whole, within its row; a null source is one host; a null id is a
document for each row, any other id one for all its rows, which are judged one
by one; an empty table has no rows; other columns are ignored (kept as they are
in ``without_common_lines``), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, dealt

_SPACES = "\t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _SPACES, "     "), " "), lambda w: w != "")


def _figures(docs: DataFrame) -> DataFrame:
    """One row per document: row, doc_id, base figures, and its lines' keys and words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.col("source").cast("string").alias("host"), text.alias("text"))
    base = base.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    base = base.withColumn("windows", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), window)).otherwise(F.array().cast("array<bigint>")))
    base = base.withColumn("some", F.size(F.array_distinct("windows")) < F.size("windows"))
    base = base.withColumn("ranked", F.when(F.col("some"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))))
    equal = lambda a, b: (F.get("words", a) == F.get("words", b)) & (F.get("words", a + 1) == F.get("words", b + 1)) & (F.get("words", a + 2) == F.get("words", b + 2))
    by_all = lambda a: F.exists(F.sequence(F.lit(0), F.size("windows") - 1), lambda b: (a != b) & equal(a, b))

    def again(x: Column, i: Column) -> Column:
        before, behind = F.get("ranked", i - 1), F.get("ranked", i + 1)
        same, other = x["hash"] == before["hash"], x["hash"] == behind["hash"]
        found = F.coalesce(same & equal(x["at"], before["at"]), F.lit(False)) | F.coalesce(other & equal(x["at"], behind["at"]), F.lit(False))
        return F.when(found, x["at"]).when(F.coalesce(same, F.lit(False)) | F.coalesce(other, F.lit(False)), F.when(by_all(x["at"]), x["at"]))

    base = base.withColumn("places", F.when(F.col("some"), F.sort_array(F.array_compact(F.transform("ranked", again)))))
    three = F.lit(3)
    covered = F.aggregate(F.transform("places", lambda x, i: F.least(three, F.coalesce(F.get("places", i + 1) - x, three))), F.lit(0).cast("long"), lambda a, x: a + x)
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""))
    base = base.withColumn("normal", F.transform("lines", lambda x: F.array_join(words_of(F.lower(x)), " ")))
    spaces = lambda x: F.length(x) - F.length(F.translate(x, " ", ""))
    return base.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_words",
        F.length(F.translate("text", " " + _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.transform("normal", lambda x: F.struct(F.xxhash64("host", x).alias("key"), (spaces(x) + 1).alias("n"))).alias("lines"),
    )


def _line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(host, F.array_join(words_of(F.lower(line)), " "))


def _common(rows: DataFrame, most_docs: int) -> DataFrame:
    """key: the lines, by host, that more than ``most_docs`` documents hold; rows (row, doc_id, lines)."""
    own = rows.select("doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x.key))).alias("key"))
    held = own.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > most_docs)
    # rows of one id are one document: for ids that come again, what a line's rows are too many
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    extra = own.join(again, "doc_id", "left_semi").groupBy("key", "doc_id").agg((F.count(F.lit(1)) - 1).alias("extra")).groupBy("key").agg(F.sum("extra").alias("extra"))
    return held.join(extra, "key", "left").where(F.col("docs") - F.coalesce("extra", F.lit(0)) > most_docs).select("key")


def judged(docs: DataFrame, most_docs: int = 20, least_words: int = 50, salts: int = 32) -> DataFrame:
    """doc_id, the base figures, base_failed, left_words, kept."""
    rows = cut(_figures(dealt(docs.select("doc_id", "text", "source"))), "figures")
    common = _common(rows, most_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a line of a third of all rows is met in ``salts`` parts
    lines = rows.select("row", F.inline("lines")).withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
    removed = lines.join(common, ["key", "salt"], "left_semi").groupBy("row").agg(F.sum("n").alias("removed"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return (
        rows.drop("lines")
        .join(removed, "row", "left")
        .withColumn("base_failed", failed)
        .withColumn("left_words", left)
        .withColumn("kept", ~F.col("base_failed") & (2 * left >= F.col("n_words")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_words")
    )


def without_common_lines(docs: DataFrame, most_docs: int = 20, least_left: float = 0.5) -> DataFrame:
    """``docs`` with the common lines taken out of ``text``; documents that keep less than ``least_left`` of their words go."""
    columns = docs.columns
    own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own")
    base = cut(dealt(docs).select(own, F.monotonically_increasing_id().alias("row")), "lines")
    text = F.coalesce(F.col("own")["text"].cast("string"), F.lit(""))
    host = F.col("own")["source"].cast("string")
    said = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " " + _SPACES, "") != "")
    keyed = base.select("row", F.col("own")["doc_id"].alias("doc_id"), F.transform(said, lambda x: F.struct(_line_key(host, x).alias("key"))).alias("lines"))
    common = _common(keyed, most_docs)
    found = keyed.select("row", F.explode(F.array_distinct(F.transform("lines", lambda x: x.key))).alias("key")).join(common, "key").groupBy("row").agg(F.collect_set("key").alias("gone"))
    stays = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", _line_key(host, x)))
    rows = base.join(found, "row", "left").withColumn("left", F.when(F.col("gone").isNull(), F.col("own")["text"]).otherwise(F.array_join(stays, "\n")))
    kept = F.size(words_of(F.coalesce("left", F.lit("")))) >= least_left * F.size(words_of(text))
    return rows.where(F.col("gone").isNull() | kept).select(*[F.col("left").alias(c) if c == "text" else F.col("own")[c].alias(c) for c in columns])
