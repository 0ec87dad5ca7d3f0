"""Where patterns and words of a vocabulary stand in texts: spans in code points, ends exclusive.

A pattern's matches and what is between them come from two built-in functions; their
lengths, added up, are the places.  Words of a vocabulary are rows of a table: they are
found by an equality on their first three letters, so the table has no limit, and a new
row changes what is found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPANS = "array<struct<start:int,end:int,label:string>>"

# Patterns of headers, whatever the case, and the labels they give, in order.
HEADER_RULES = (
    (r"\b(19|20)\d{2}\b", "YEAR"),
    (r"\b(?:president|senate|governor|mayor|school board|proposition|referendum|assembly|council|trustee|justice|clerk)\b", "OFFICE"),
    (r"\b(democratic|republican|libertarian|green|independent|conservative|working families|write-in|other)\b", "PARTY"),
    (r"\b(absentee|early voting|mail|provisional|affidavit|other|void)\b", "VOTE_METHOD"),
    (r"\b(precinct|ward|district|area|city|municipal|location)\b", "PRECINCT"),
    (r"\btotal|sum|votes|overall|all\b", "TOTAL"),
    (r"\bpercent\b|\b% precincts reporting\b|\b% reporting\b|\bpercent reporting\b", "PERCENT"),
    (r"\bcounty\b", "COUNTY"),
    (r"\bstate\b", "STATE"),
    (r"\bgeneral|primary|special\b", "ELECTION_TYPE"),
    (r"\b(overvote|undervote|scattering|write-in|blank|spoiled)\b", "MISC"),
    (r"\b(proposition|amendment|measure|referendum|initiative)\b", "BALLOT_MEASURE"),
    (r"\b(city|town|village|borough|municipality|community|district)\b", "LOCATION"),
    (r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b \d{1,2}, \d{4}", "DATE"),
    (r"\bincumbent\b", "INCUMBENT"),
    (r"\bwinner\b", "WINNER"),
    (r"\bloser\b", "LOSER"),
    (r"\bwrite[- ]?in\b", "WRITE_IN"),
    (r"\bunopposed\b", "UNOPPOSED"),
    (r"\bproposition \d+\b", "PROPOSITION"),
    (r"\bamendment \d+\b", "AMENDMENT"),
    (r"\b(jurisdiction|authority|agency|department)\b", "JURISDICTION"),
    (r"\belection official\b", "ELECTION_OFFICIAL"),
    (r"\b(results|outcome|tally|count)\b", "RESULTS"),
    (r"\b(vote count|vote total|vote tally)\b", "VOTE_COUNT"),
    (r"\b(?:election|vote|poll|referendum|plebiscite)\b", "ELECTION_TYPE"),
    (r"\b(?:candidate|nominee|aspirant|hopeful)\b", "CANDIDATE"),
    (r"\b(?:election official|poll worker|election judge|inspector)\b", "ELECTION_OFFICIAL"),
)

#: Entities by the shape of their words, where no tagger is at hand; of overlapping ones the first, then the longest, then the first rule's stays.
ENTITY_RULES = (
    (r"https?://[^\s<>\"]+", "URL"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "EMAIL"),
    (r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}\b", "DATE"),
    (r"\b\d{1,2}:\d{2}(?::\d{2})?\b", "TIME"),
    (r"[$€£]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)? (?:dollars|euros|pounds)\b", "MONEY"),
    (r"\b\d+(?:\.\d+)?\s?%", "PERCENT"),
    (r"\b(?:[A-Z][a-z]+ )+(?:Inc|Corp|Ltd|LLC|Department|University|Committee|Party|Board|Council)\b", "ORG"),
    (r"\b(?:[A-Z][a-z]+ )+(?:County|City|Township|Village|District)\b|\b(?:Precinct|Ward|District) \d+\b", "LOCATION"),
    (r"\b[A-Z][a-z]+ (?:[A-Z]\. )?[A-Z][a-z]+\b", "PERSON"),
    (r"\b\d[\d,]*(?:\.\d+)?\b", "NUMBER"),
)


def spans(text: Column, pattern: Column | str, label: Column | str) -> Column:
    """start, end, label of every match, leftmost and without overlap."""
    pattern, label = (F.lit(x) if isinstance(x, str) else x for x in (pattern, label))
    between, hits = F.split(text, pattern, F.lit(-1)), F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.transform(F.arrays_zip(between.alias("gap"), hits.alias("hit")), lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit")))
    state = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, z: Column) -> Column:
        start, end = s["at"] + z["gap"], s["at"] + z["gap"] + z["hit"]
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end"), label.alias("label"))).alias("out"))

    return F.aggregate(F.filter(sizes, lambda z: z["hit"].isNotNull()), state, step)["out"]


def rule_spans(texts: DataFrame, text: str, rules: Sequence[tuple[str, str]], any_case: bool = True) -> DataFrame:
    """text, start, end, label of every rule's matches in the distinct texts, each once; rules are rows that every text meets."""
    table = F.array(*[F.struct(F.lit(("(?i)" if any_case else "") + p).alias("pattern"), F.lit(label).alias("of")) for p, label in rules])
    met = texts.select(text).where(F.col(text).isNotNull()).distinct().select(text, F.inline(table))
    return met.select(text, F.inline(spans(F.col(text), F.col("pattern"), F.col("of")))).distinct()


def entities(text: Column, rules: Sequence[tuple[str, str]] = ENTITY_RULES) -> Column:
    """Spans of all rules without overlaps: by start, the longest, then the first rule's."""
    said = F.coalesce(text, F.lit(""))
    ranked = [_ranked(spans(said, p, label), n) for n, (p, label) in enumerate(rules)]
    ordered = F.array_sort(F.concat(*ranked))
    state = F.struct(F.lit(0).alias("end"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        own = F.struct(x["start"].alias("start"), (x["start"] - x["less"]).alias("end"), x["label"].alias("label"))
        return F.when(x["start"] >= s["end"], F.struct(own["end"].alias("end"), F.array_append(s["out"], own).alias("out"))).otherwise(s)

    return F.aggregate(ordered, state, step)["out"]


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("less"), F.lit(rank).alias("rank"), s["label"].alias("label")))


def vocabulary_spans(texts: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """text, start, end, label of every place where a row (label, value) of the vocabulary stands in a distinct text, whatever the case; a value's places do not overlap."""
    words = vocabulary.select("label", F.lower("value").alias("_word")).where("_word <> ''").distinct().withColumn("_size", F.length("_word")).withColumn("_key", F.substring("_word", 1, 3))
    sizes = [r[0] for r in words.select(F.least("_size", F.lit(3))).distinct().collect()]  # three numbers at most
    own = texts.select(text).where(F.col(text).isNotNull()).distinct().withColumn("_low", F.lower(text)).where("_low <> ''")
    starts = own.select(text, "_low", F.explode(F.sequence(F.lit(1), F.length("_low"))).alias("_at"))
    keys = starts.withColumn("_key", F.explode(F.array(*[F.substring(F.col("_low"), F.col("_at"), F.lit(n)) for n in sorted(sizes)]))) if sizes else starts.withColumn("_key", F.lit(None).cast("string"))
    met = keys.join(words, "_key").where((F.length("_key") == F.least("_size", F.lit(3))) & (F.substring(F.col("_low"), F.col("_at"), F.col("_size")) == F.col("_word")))
    places = met.groupBy(text, "label", "_word", "_size").agg(F.array_sort(F.collect_set(F.col("_at") - 1)).alias("_places"))
    state = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("out"))
    kept = F.aggregate("_places", state, lambda s, p: F.when(p >= s["end"], F.struct((p + F.col("_size")).alias("end"), F.array_append(s["out"], p).alias("out"))).otherwise(s))["out"]
    return places.select(text, F.explode(kept).alias("start"), "_size", "label").select(text, "start", (F.col("start") + F.col("_size")).alias("end"), "label").distinct()


def header_labels(headers: DataFrame, name: str, vocabulary: DataFrame) -> DataFrame:
    """name, start, end, label of every distinct header: spans of the rules and of the vocabulary, each once."""
    own = headers.select(name).where(F.col(name).isNotNull()).distinct()
    return rule_spans(own, name, HEADER_RULES).union(vocabulary_spans(own, name, vocabulary)).distinct()
