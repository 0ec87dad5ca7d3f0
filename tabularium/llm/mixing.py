"""Mixing sources to target weights by blocks.  DataFrame functions only.

Targets: sources in ascending order of their names (null last) weigh 1, 2, 3,
repeating; together they take as many words as there are, but none more than
``most_epochs`` times its own: what a source cannot take goes to the others by
weight.  In closed form, target = min(cap, level * weight), the level found
among the sources sorted by cap / weight.

Blocks: each source's documents, in a pseudorandom order (a hash of the id),
make one stream of words, cut into blocks of ``block`` words.  Places in that
stream are two-level sums (4,096 hash ranges of a source, then within a range),
so that a source with a third of all rows is no single task's work.

Draws: the output is shards of ``shard`` slots of a block each (by default a sixteenth of
all, 65,536 at most).  A shard's slots draw their sources independently, by target, so a
shard's counts of sources are one multinomial draw.  A source's slots are numbered through
the shards in order; slot s takes block perm(s mod n) of epoch s div n, where perm is a
four-round Feistel network over the source's n blocks, another one in each epoch.  So an
epoch takes every block once, and no document is taken more often than there are epochs.
Left alone, sums of draws miss a target of m slots by about sqrt(m): 8 % for the lightest
sources of sf0.01.  So the last shards are a correction: what each source's target still
asks for is dealt to them by a permutation.  They are 3 / sqrt(m) of all shards, m being
the lightest source's slots, between a sixteenth and a half; a source whose draws pass its
target is cut there (three standard deviations off), its shard being short by that much.
Each source thus gets its target within half a block and the block at its stream's end.
Sources are rows throughout; per source, numbers run over one row for each shard.

Defined results: null texts have size 0 and are taken 0 times; a very long text
lies in many blocks; repeated rows are separate documents; sources of equal room
are taken in the order of their names; reruns, on any partitioning, give the
same mix; an empty table gives an empty mix; other columns are ignored (kept as
they are in ``mixed_documents``), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import words_of
from .scratch import cut, running

RANGES = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most_epochs: int = 3) -> DataFrame:
    """sizes (source, source_size) -> with number and target; one row for each source throughout."""
    rows = running(sizes, [F.col("source").asc_nulls_last()], number=F.lit(1).cast("long"))
    rows = rows.withColumn("weight", F.pmod("number", F.lit(3)) + 1).withColumn("cap", most_epochs * F.col("source_size"))
    room = F.col("cap") / F.col("weight")
    rows = cut(running(rows, [room, F.col("number")], capped=F.col("cap"), lighter=F.col("weight")), "rooms")
    words, weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(words) - F.col("capped")) / (F.lit(weights) - F.col("lighter"))
    level = rows.where(level <= room).agg(F.min_by(level, F.struct(room, "number"))).first()[0] if weights else None
    target = F.least(F.col("cap").cast("double"), F.lit(float(level or 0)) * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_size", "number", "target")


def _permuted(place: Column, n: Column, side: Column, *key: Column) -> Column:
    """A bijection of 0..n-1: Feistel rounds on a side-by-side square that holds it, walked until inside."""

    def network(x: Column) -> Column:
        left, right = F.floor(x / side).cast("long"), F.pmod(x, side)
        for r in range(4):
            left, right = right, F.pmod(left + F.pmod(F.xxhash64(*key, F.lit(r), right), side), side)
        return left * side + right

    # at most 2 * side + 1 places of the square are outside, so 64 steps do for sides up to 31, and miss with probability 1e-76 beyond
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), network(place), lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(network(place) < n, network(place)).otherwise(walked)


class Mix:
    """The parts of a mix: ``docs`` (row, doc_id, size, source_size, target, number, start), ``draws`` (shard, number, count: of the shards before the correction), ``slots`` (shard, slot, number, epoch, block), ``spans`` (row, number, block, from, words)."""

    def __init__(self, documents: DataFrame, block: int = 64, shard: int | None = None, most_epochs: int = 3, seed: int = 1, row: str | None = None, spread: int = 4096):
        """row: a column of unique numbers, if ``documents`` has one."""
        spark = documents.sparkSession
        sized = documents.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"),
            (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        )
        sized = cut(sized, "sizes")
        sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most_epochs), "sources")
        self.sources = sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))

        # places in the sources' streams
        part = F.shiftrightunsigned("order", 64 - RANGES.bit_length() + 1).cast("int")
        dealt = sized.join(sources.select(F.col("source").alias("name"), "number", "source_size", "target"), F.col("source").eqNullSafe(F.col("name"))).withColumn("range", part)
        before = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = dealt.groupBy("number", "range").agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
        own = Window.partitionBy("number", "range").orderBy("order", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
        docs = dealt.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0))).join(ranges.select("number", "range", "base"), ["number", "range"])
        self.docs = cut(docs.withColumn("start", F.col("base") + F.col("within")).select("row", "doc_id", "size", "source_size", "target", "number", "start"), "places")

        # the sources' slots, end to end
        slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), most_epochs * F.col("blocks"))).otherwise(0).cast("long")
        laid = running(sources.select("number", "blocks", slots.alias("slots")).where("slots > 0"), [F.col("number")], low=F.col("slots"))
        laid = cut(laid, "laid")
        places, lightest, count = laid.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.min("slots"), F.count(F.lit(1))).first()
        self.shard = shard = shard or max(1, min(65_536, places // 16))
        shards = -(-places // shard)
        self.drawn = drawn = shards - math.ceil(shards * min(0.5, max(1 / 16, 3 / math.sqrt(lightest or 1))))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

        # a draw is a place among all slots laid end to end; cells of equal width find its source by an equality
        width = -(-places // max(4096, count)) or 1
        low, high = F.col("low"), F.col("low") + F.col("slots")
        cells = cut(laid.select("number", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.floor(low / width), F.floor((high - 1) / width))).alias("cell")), "cells")
        draws = spark.range(0, max(drawn, 0) * shard, 1, tasks).select(F.floor(F.col("id") / shard).alias("shard"), F.pmod("id", F.lit(shard)).alias("at"))
        draws = draws.select("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", "at"), F.lit(max(places, 1))).alias("place"))
        met = draws.withColumn("cell", F.floor(F.col("place") / width)).join(cells, "cell").where("place >= low and place < high")
        counts = cut(met.groupBy("shard", "number").agg(F.count(F.lit(1)).alias("count")), "draws")
        before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).join(laid.select("number", "blocks", "slots"), "number")
        counts = cut(counts.withColumn("end", F.least(F.col("first") + F.col("count"), "slots")).where("first < end"), "counts")
        self.draws = counts.select("shard", "number", (F.col("end") - F.col("first")).alias("count"))

        # what the draws have left of the targets goes to the last shards
        ends = counts.groupBy("number").agg(F.max("end").alias("end"))
        rest = laid.join(ends, "number", "left").withColumn("first", F.coalesce("end", F.lit(0)))
        rest = cut(running(rest.select("number", "blocks", "slots", "first").where("first < slots"), [F.col("number")], lower=F.col("slots") - F.col("first")), "rest")
        left = rest.agg(F.coalesce(F.sum(F.col("slots") - F.col("first")), F.lit(0))).first()[0]

        # a few rows become all slots: runs of them are dealt to the tasks before they are opened
        taken = counts.select("number", "blocks", "shard", F.lit(None).cast("long").alias("lower"), F.col("first").alias("base"), "first", "end")
        runs = rest.select("number", "blocks", F.lit(None).cast("long").alias("shard"), "lower", F.col("first").alias("base"), "first", F.col("slots").alias("end"))
        runs = taken.union(runs).withColumn("run", F.explode(F.sequence("first", F.col("end") - 1, F.lit(spread).cast("long"))))
        runs = runs.repartition(tasks, "number", "run").withColumn("slot", F.explode(F.sequence("run", F.least("end", F.col("run") + spread) - 1)))
        place = _permuted(F.col("lower") + F.col("slot") - F.col("base"), F.lit(left), F.lit(math.isqrt(max(left - 1, 0)) + 1), F.lit(seed), F.lit("place"))
        opened = runs.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")).cast("int")).withColumn("side", F.ceil(F.sqrt("blocks")).cast("long"))
        own = _permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.col("side"), F.lit(seed), F.col("number"), F.col("epoch"))
        self.slots = opened.select(F.coalesce("shard", drawn + F.floor(place / shard)).alias("shard"), "slot", "number", "epoch", own.alias("block"))

        # which words of which document are in which block
        first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
        spans = self.docs.where("size > 0").select("row", "number", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        begin = F.greatest(F.col("start"), F.col("block") * block)
        self.spans = spans.select("row", "number", "block", (begin - F.col("start")).alias("from"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - begin).alias("words"))

    def counts(self) -> DataFrame:
        """shard, number, count: how many of a shard's slots go to which source."""
        return self.slots.groupBy("shard", "number").agg(F.count(F.lit(1)).alias("count"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, first_shard (the least shard with words of the document; null if none has)."""
        times = self.slots.groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
        # Spark takes the slots for as few rows as they are made from, so the join's way is said here
        met = self.spans.join(times.hint("merge"), ["number", "block"])
        taken = met.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
        return self.docs.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``documents``: one row for each document and epoch that takes words of it.

    A document taken whole keeps its text; otherwise the text is the words taken, in order, with single spaces.
    """
    # a document's own columns are one field meanwhile, so that their names do not matter
    columns = documents.columns
    base = cut(documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), F.monotonically_increasing_id().alias("row")), "mixed")
    mix = Mix(base.select("row", F.col("own")["doc_id"].alias("doc_id"), F.col("own")["source"].alias("source"), F.col("own")["text"].alias("text")), row="row", **options)
    parts = mix.spans.join(mix.slots.select("number", "block", "epoch").hint("merge"), ["number", "block"])
    parts = parts.groupBy("row", "epoch").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("from", "words"))).alias("parts"))
    parts = parts.join(mix.docs.select("row", "size"), "row").withColumn("parts", F.when(F.col("taken") < F.col("size"), F.col("parts")))
    rows = base.join(parts, "row")
    text = F.col("own")["text"]
    # the words are bound to a name, so that they are split once for a text and not for each of its parts
    taken = lambda words: F.array_join(F.flatten(F.transform("parts", lambda x: F.slice(words, x["from"].cast("int") + 1, x["words"].cast("int")))), " ")
    own = F.get(F.transform(F.array(words_of(text.cast("string"))), taken), F.lit(0))
    text = F.when(F.col("parts").isNull(), text).otherwise(own)
    return rows.select(*[text.alias(c) if c == "text" else F.col("own")[c].alias(c) for c in columns])
