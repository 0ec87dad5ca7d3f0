"""Reviews of labelled segments and of what was found odd, from tables of corrections.

A correction (seq, id, action, label) is of one entry; later ones (greater seq) count.
``edit`` labels the entry and its pattern; ``edit_similar`` also every entry whose markup is
more than ``least`` alike; ``edit_pattern`` every entry of the entry's pattern, and the
pattern; ``remove`` takes the entry away, whatever else is said of it.  Alike markup is
found through the index of character bags, among distinct markups.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.session import cut

from . import similar


def _labels(told: DataFrame, key: str) -> DataFrame:
    return told.groupBy(key).agg(F.max_by("label", "seq").alias("_label"))


def reviewed_segments(entries: DataFrame, corrections: DataFrame, least: float = 0.9) -> DataFrame:
    """entries (id, html, label, pattern_id, ...) with the labels that hold after all corrections; removed ones are gone."""
    own = corrections.join(entries.select("id", "html", "pattern_id"), "id")
    edits = own.where(F.col("action").startswith("edit"))
    by_id = edits.select("seq", "label", "id")
    # of a pattern's edits the last, before its entries are met
    last = edits.where("action = 'edit_pattern'").groupBy("pattern_id").agg(F.max(F.struct("seq", "label")).alias("t"))
    by_pattern = last.join(entries.select("id", "pattern_id"), "pattern_id").select("t.seq", "t.label", "id")
    asked = edits.where("action = 'edit_similar'").groupBy("html").agg(F.max(F.struct("seq", "label")).alias("t"))
    pairs = similar.close_pairs(asked, "html", entries.select(F.col("html").alias("_like")), "_like", math.nextafter(least, 2))
    like = pairs.join(asked, "html").select("t.seq", "t.label", F.col("_like").alias("html")).groupBy("html").agg(F.max(F.struct("seq", "label")).alias("t"))
    by_markup = like.join(entries.select("id", "html"), "html").select("t.seq", "t.label", "id")
    labels = _labels(by_id.union(by_pattern).union(by_markup), "id")
    kept = entries.join(corrections.where("action = 'remove'").select("id").distinct(), "id", "left_anti").join(labels, "id", "left")
    return kept.withColumn("label", F.coalesce("_label", "label")).select(entries.columns)


def reviewed_patterns(patterns: DataFrame, entries: DataFrame, corrections: DataFrame) -> DataFrame:
    """patterns (pattern_id, label, ...) with the labels that edits of their entries give them."""
    edits = corrections.where(F.col("action").startswith("edit")).join(entries.select("id", "pattern_id"), "id")
    return patterns.join(_labels(edits, "pattern_id"), "pattern_id", "left").withColumn("label", F.coalesce("_label", "label")).select(patterns.columns)


def resolved(anomalies: DataFrame, corrections: DataFrame) -> DataFrame:
    """anomalies (id, details, ...) with the details of the last edit, and whether one was resolved."""
    told = corrections.groupBy("id").agg(F.max_by("label", F.when(F.col("action") == "edit", F.col("seq"))).alias("_details"), F.bool_or(F.col("action") == "resolve").alias("_resolved"))
    return anomalies.join(told, "id", "left").withColumn("details", F.coalesce("_details", "details")).select(*anomalies.columns, F.coalesce("_resolved", F.lit(False)).alias("resolved"))


def merged_patterns(patterns: DataFrame, corrections: DataFrame) -> DataFrame:
    """patterns (pattern_id, label, features: map) after corrections (seq, pattern_id, action, label, target) in the order of seq.

    ``edit`` labels a pattern; ``remove`` takes it away; ``merge`` gives its features and
    its label, where it has them, to the target, and takes it away, unless the target is
    unknown or gone by then.  Of several corrections of a pattern the last counts; one
    merged with itself goes.

    A merge holds unless an earlier one took its target away, so what holds alternates
    along the chain of earlier targets; both that and the way to the pattern which a
    merged one ends in are found by doubling, in as many written rounds as the chain's
    length has bits.  What was written last is the greatest path of seqs, target first.
    """
    ids = patterns.select("pattern_id")
    last = corrections.groupBy("pattern_id").agg(F.max_by(F.struct("seq", "action", "label", "target"), "seq").alias("_c")).select("pattern_id", "_c.*").join(ids, "pattern_id")
    last = last.withColumn("action", F.when((F.col("action") == "merge") & (F.col("target") == F.col("pattern_id")), "remove").otherwise(F.col("action")))
    merges = last.where("action = 'merge'").select("pattern_id", "seq", "target").join(ids.select(F.col("pattern_id").alias("target")), "target")
    going = last.where("action = 'remove'").select("pattern_id", "seq", F.lit(False).alias("merge")).union(merges.select("pattern_id", "seq", F.lit(True))).select(F.col("pattern_id").alias("target"), F.col("seq").alias("_seq"), "merge")
    step = merges.join(going, "target", "left").withColumn("_earlier", F.coalesce(F.col("_seq") < F.col("seq"), F.lit(False)))
    # holds = flip, or the other way round than that of ``at``
    state = step.select("pattern_id", "seq", "target", F.when(F.col("_earlier") & F.col("merge"), F.col("target")).alias("at"), (~F.col("_earlier") | F.col("merge")).alias("flip"))
    state = cut(state.withColumn("flip", F.when(F.col("at").isNotNull(), F.lit(True)).otherwise(F.col("flip"))), "merges")
    while not state.where("at is not null").isEmpty():
        there = state.select(F.col("pattern_id").alias("at"), F.col("at").alias("_at"), F.col("flip").alias("_flip"))
        state = cut(state.join(there, "at", "left").select("pattern_id", "seq", "target", F.col("_at").alias("at"), F.when(F.col("at").isNull(), F.col("flip")).otherwise(F.col("flip") != F.col("_flip")).alias("flip")), "merges")
    ways = cut(state.where("flip").select("pattern_id", F.col("target").alias("into"), F.array("seq").alias("path"), F.lit(True).alias("open")), "ways")
    while not ways.where("open").isEmpty():
        there = ways.select(F.col("pattern_id").alias("into"), F.col("into").alias("_into"), F.col("path").alias("_path"))
        met = ways.join(there, "into", "left").withColumn("open", F.col("_into").isNotNull())
        ways = cut(met.select("pattern_id", F.coalesce("_into", "into").alias("into"), F.when(F.col("open"), F.concat("_path", "path")).otherwise(F.col("path")).alias("path"), "open"), "ways")

    every = patterns.join(ways.select("pattern_id", "into", "path"), "pattern_id", "left").withColumn("into", F.coalesce("into", "pattern_id")).withColumn("path", F.coalesce("path", F.array().cast("array<bigint>")))
    edits = last.where("action = 'edit'").select(F.col("pattern_id").alias("into"), "label", F.array(F.col("seq").cast("bigint")).alias("path"))
    labels = every.select("into", "label", "path").union(edits).where("label is not null").groupBy("into").agg(F.max_by("label", "path").alias("label"))
    told = every.select("into", "path", F.explode("features").alias("key", "value")).groupBy("into", "key").agg(F.max_by("value", "path").alias("value"))
    features = told.groupBy("into").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("features"))
    gone = last.where("action = 'remove'").select("pattern_id").union(ways.select("pattern_id"))
    kept = ids.join(gone, "pattern_id", "left_anti").withColumn("into", F.col("pattern_id"))
    kept = kept.join(labels, "into", "left").join(features, "into", "left")
    return kept.select("pattern_id", "label", F.coalesce("features", F.create_map().cast("map<string,string>")).alias("features"))
