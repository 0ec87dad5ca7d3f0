"""Exact top-k by Hamming distance: incremental multi-index hashing.

Vectors become 64-bit codes (bit i: component i above 0), cut into ``segments``
segments, equal up to a bit (None: as many as give a segment about as many bits as
the number of codes has, so that a bucket of the index holds few codes at any
size, for more probes of a query).  Two codes at distance d agree in some segment within
floor(d / segments) bits.  Step by step, the index is probed with the values
that differ in exactly r bits from a query's segment: radius r in the first
segments, then in the others, then r + 1.  Every code found is verified on all
64 bits.  With radius r done in a segments and r - 1 in the others, every code
within segments * r + a - 1 bits has been seen; a query whose k-th verified
distance is no more than that is closed, the others go on.  At the radius of a
whole segment all codes have been seen.

A bucket of the index is an array of codes (several arrays of about ``chunk``, if
it is large), so a probe is one row however full the bucket is, and only the
nearest k + 1 codes of it leave the row.  Equal codes are one entry with its
k + 1 least ids, which is all that k nearest with ties by id can take of it; so
a code that a third of all rows share is one entry and one query.

Defined results: neighbours of a query are all other rows, by distance, then
id; fewer than k if there are no more; vectors that are null or not of the
code's length have no code and are left out; repeated rows of one id count once;
a null component, or NaN, is a 0 bit.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


def code(vector: Column, bits: int = 64) -> Column:
    """Bit i of a long: component i is above 0 (NaN is not)."""
    flags = F.transform(vector, lambda x: F.when((x > 0) & ~F.isnan(x), F.lit("1")).otherwise(F.lit("0")))
    half = lambda a: F.conv(F.array_join(F.slice(flags, a, bits // 2), ""), 2, 10).cast("long")
    whole = F.shiftleft(half(1), bits // 2).bitwiseOR(half(bits // 2 + 1))
    return F.when(F.size(vector) == bits, whole)


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(width), radius)]


def _cuts(bits: int, segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    widths = [bits // segments + (s < bits % segments) for s in range(segments)]
    return [(sum(widths[:s]), w) for s, w in enumerate(widths)]


def _steps(segments: int, width: int) -> list[tuple[int, list[int], int]]:
    """(radius, segments, distance covered afterwards)."""
    out = []
    for radius in range(width + 1):
        for part in [range(segments)] if radius < 2 else [range(segments // 2), range(segments // 2, segments)]:
            if len(part):
                out.append((radius, list(part), segments * radius + part[-1]))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, segments: int | None = 8, chunk: int = 1024) -> DataFrame:
    """vectors and queries (vec_id, embedding) -> query_id, rank, neighbour_id, distance."""
    coded = cut(vectors.select("vec_id", code(F.col("embedding"), bits).alias("code")).where("vec_id is not null and code is not null").distinct(), "codes")
    ranked = coded.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = cut(ranked.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    segments = segments or max(1, round(bits / max(4, entries.count().bit_length() - 1)))
    cuts = _cuts(bits, segments)
    width = cuts[0][1]
    pieces = F.array(*[F.shiftright("code", at).bitwiseAND((1 << w) - 1) for at, w in cuts])
    spread = entries.select("code", F.element_at("ids", 1).alias("first"), F.posexplode(pieces).alias("segment", "value"))
    parts = spread.groupBy("segment", "value").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    index = spread.join(parts, ["segment", "value"]).groupBy("segment", "value", F.pmod(F.xxhash64("code"), F.col("chunks")).alias("chunk"))
    index = cut(index.agg(F.collect_list(F.struct("first", "code")).alias("codes")), "index")
    asked = cut(queries.select(F.col("vec_id").alias("query_id"), code(F.col("embedding"), bits).alias("code")).where("query_id is not null and code is not null").distinct(), "queries")

    open_, results = asked.select("code", F.lit(bits).alias("bound")).distinct(), []
    found = None
    for radius, part, covered in _steps(segments, width):
        # the masks of each width, from a small table: at radius 4 of 16 bits they are 1,820
        masks = open_.sparkSession.createDataFrame([(s, m) for s in part for m in _masks(cuts[s][1], radius)], "segment int, mask long")
        own = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), pieces[s].alias("own")) for s in part])).alias("p")
        probes = open_.select(F.col("code").alias("query"), "bound", own).select("query", "bound", "p.segment", "p.own").join(F.broadcast(masks), "segment")
        probes = probes.select("query", "bound", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        verified = F.transform("codes", lambda c: F.struct(F.bit_count(F.col("query").bitwiseXOR(c.code)).alias("distance"), c["first"].alias("first"), c.code.alias("code")))
        near = F.slice(F.array_sort(F.filter(verified, lambda c: c.distance <= F.col("bound"))), 1, k + 1)
        # Spark takes the probes for as few rows as the queries they come from, so the join's way is said here
        hits = probes.hint("merge").join(index, ["segment", "value"]).select("query", F.inline(near))
        if found is not None:
            hits = hits.union(found.join(open_.select(F.col("code").alias("query")), "query", "left_semi"))
        place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "first"))
        found = cut(hits.distinct().withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "hits")
        state = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        state = open_.join(state.withColumnRenamed("query", "code"), "code", "left").withColumn("bound", F.when(F.col("n") >= k + 1, F.col("far")).otherwise(F.lit(bits)))
        state = cut(state.select("code", "bound", (F.lit(radius == width and part[-1] == segments - 1) | (F.col("bound") <= covered)).alias("closed")), "open")
        results.append(found.join(state.where("closed").select(F.col("code").alias("query")), "query", "left_semi"))
        open_ = state.where("not closed").select("code", "bound")
        if open_.isEmpty():
            break
    done = reduce(DataFrame.union, results)
    pairs = asked.join(done.select(F.col("query").alias("code"), F.col("code").alias("other"), "distance"), "code").join(entries.select(F.col("code").alias("other"), "ids"), "other")
    pairs = pairs.select("query_id", "distance", F.explode("ids").alias("neighbour_id")).where("neighbour_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")
