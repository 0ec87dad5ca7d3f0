"""Shards under a byte limit by extendible hashing.

A document's address is the first 60 bits of the md5 of its id.  The directory
starts with one bucket; a bucket over the limit, and only such a one, splits on
the next address bit.  Since a bucket's bytes are the sum of its halves, the
splits are decided on sums: documents are summed once in cells (``cell_bits``
address bits more than the mean needs), and the cells at all depths above in one
aggregation.  Rows of cells that still do not fit, alone, are summed at all depths
below in another one.  A prefix is a bucket if it fits, or no bit is left, and its
parent does not fit.  So the jobs are as many whatever the depth.  A row finds its
bucket through its cell; only rows of cells that do not fit try the depths below.

What no bit can split (rows with one and the same id, or 60 equal bits) is an
overflow chain: runs of rows, in order of size and text hash, that each fit.  The
chains' running sums are made over ranges of all their rows, so that an id with
a third of all rows is no single task's work.  A single document over the limit
has a shard of its own: it cannot be split.

Defined results: null texts have no bytes; a very long text over the limit is a
shard; a null id has the address of the empty string; repeated rows are rows of
one chain, if their bucket does not fit; an empty table has no shard; other
columns are ignored (kept as they are by ``write_shards``), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, free_name, running

ADDRESS_BITS = 60


def address(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: int, name: str = "address") -> Column:
    return F.shiftright(name, ADDRESS_BITS - bits)


def _at(depths: range) -> Column:
    return F.explode(F.array(*[F.lit(d) for d in depths])) if depths else F.explode(F.expr("cast(array() as array<int>)"))


def _summed(rows: DataFrame, bits: int, value: str, depths: range) -> DataFrame:
    """depth, prefix, bytes at all depths; rows: prefix (of ``bits`` bits) and value."""
    opened = rows.select("prefix", value, _at(depths).alias("depth"))
    return opened.groupBy("depth", F.expr(f"shiftright(prefix, {bits} - depth)").alias("prefix")).agg(F.sum(value).alias("bytes"))


def shards(docs: DataFrame, limit: int = 16 << 20, cell_bits: int = 6, row: str | None = None) -> DataFrame:
    """row, doc_id, n_bytes, depth, prefix, link (place in an overflow chain, else 0), shard (text), shard_bytes: one row for each row.

    row: a column of unique numbers, if ``docs`` has one.
    """
    text = F.col("text").cast("string")
    number = F.col(row) if row else F.monotonically_increasing_id()
    sized = docs.select(number.alias("row"), "doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), address(F.col("doc_id")).alias("address"), F.md5(text.cast("binary")).alias("hash"))
    rows = cut(sized, "addresses")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = min(ADDRESS_BITS, max(1, -(-total // limit)).bit_length() + cell_bits)
    cells = cut(rows.groupBy(_prefix(bits).alias("prefix")).agg(F.sum("n_bytes").alias("bytes")), "cells")
    upper, lower = range(bits + 1), range(bits + 1, ADDRESS_BITS + 1)
    crowded = cells.where(F.col("bytes") > limit).select(F.col("prefix").alias("cell"))
    rows = rows.withColumn("cell", _prefix(bits))
    below = rows.join(crowded, "cell", "left_semi").select(F.col("address").alias("prefix"), "n_bytes")
    sums = cut(_summed(cells, bits, "bytes", upper).union(_summed(below, ADDRESS_BITS, "n_bytes", lower)), "sums")
    over = sums.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    ends = sums.where((F.col("bytes") <= limit) | (F.col("depth") == ADDRESS_BITS)).withColumn("up", F.shiftright("prefix", 1))
    directory = cut(ends.where("depth = 0").unionByName(ends.where("depth > 0").join(over, ["depth", "up"], "left_semi").select(ends.columns)).drop("up"), "directory")

    # a cell's bucket, if that is not below it
    homes = cells.select(F.col("prefix").alias("cell"), _at(upper).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)")).join(directory, ["depth", "prefix"])
    own = ["row", "doc_id", "n_bytes", "hash"]
    placed = rows.join(homes, "cell").select(*own, "depth", "prefix", "bytes")
    tried = rows.join(crowded, "cell", "left_semi").select(*own, "address", _at(lower).alias("depth")).withColumn("prefix", F.expr(f"shiftright(address, {ADDRESS_BITS} - depth)"))
    placed = placed.union(tried.join(directory, ["depth", "prefix"]).select(placed.columns))

    fits = placed.where(F.col("bytes") <= limit).withColumn("link", F.lit(0).cast("long")).withColumnRenamed("bytes", "shard_bytes")
    chain = ["depth", "prefix"]
    rest = placed.where(F.col("bytes") > limit)
    single = F.col("n_bytes") * 2 > limit  # such rows have a link each
    summed = cut(running(rest, [F.col(c) for c in (*chain, "n_bytes", "hash", "row")], sum=F.col("n_bytes"), number=F.lit(1).cast("long")), "chains")
    of = summed.groupBy(*chain).agg(F.max(F.when(~single, F.col("n_bytes"))).alias("largest"), F.min("sum").alias("sum0"), F.min("number").alias("number0"))
    rest = summed.join(of, chain)
    # rows that start within one stretch of (limit - largest) bytes end within limit bytes
    stretch = F.floor((F.col("sum") - F.col("sum0")) / (F.lit(limit) - F.coalesce("largest", F.lit(0))))
    rest = rest.withColumn("link", F.when(single, -(F.col("number") - F.col("number0") + 1)).otherwise(stretch))
    rest = rest.join(rest.groupBy(*chain, "link").agg(F.sum("n_bytes").alias("shard_bytes")), [*chain, "link"])
    both = fits.unionByName(rest.select(fits.columns))
    bits_text = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr(f"right(lpad(conv(cast(prefix as string), 10, 2), {ADDRESS_BITS}, '0'), depth)"))
    return both.select("row", "doc_id", "n_bytes", "depth", "prefix", "link", F.concat(bits_text, F.when(F.col("link") != 0, F.concat(F.lit("+"), F.abs("link").cast("string"))).otherwise("")).alias("shard"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes ``docs``, all columns, as Parquet with a folder ``shard=...`` for each shard; returns what ``shards`` says of its rows."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    base = cut(docs.select(own, F.monotonically_increasing_id().alias("row")), "documents")
    found = cut(shards(base.select("row", F.col("own")["doc_id"].alias("doc_id"), F.col("own")["text"].alias("text")), row="row", **options), "shards")
    name = free_name(docs.columns, "shard")
    rows = base.join(found.select("row", "shard"), "row").select("own.*", F.concat(F.lit("s"), "shard").alias(name))
    rows.repartition(name).write.partitionBy(name).parquet(path)
    return found
