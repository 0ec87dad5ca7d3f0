"""Deep merges of nested values, as VARIANT, level by level.

Both sides' objects are opened one level at a time, whatever they hold: keys meet by a full
outer join on (row, path, key).  Where both sides have an object under a key, the pair goes
to the next level; everywhere else the second side's value stands, if it has the key, null
values too, else the first side's; arrays and scalars are never merged.  Then objects are
put together again from the deepest level up.  Rounds are as many as objects are nested
in both sides, each a few joins of what is still open; no row is opened in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.session import cut


def _is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def _opened(pairs: DataFrame, side: str) -> DataFrame:
    """row, path, key and the side's value of every key of its objects."""
    rows = pairs.where(F.col(side).isNotNull()).select("row", "path", F.parse_json(side).alias("own"))
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("own").outer())).select("row", "path", "key", F.to_json("value").alias(side))


def deep_merged(rows: DataFrame, row: str, first: str, second: str) -> DataFrame:
    """row, merged: objects as JSON text, the second merged into the first; ``row`` has a value of its own for each row.

    A null side is an empty object; a side that is no object is replaced, or replaces, as a whole.
    """
    own = rows.select(F.col(row).alias("row"), F.lit("").alias("path"), F.coalesce(F.col(first), F.lit("{}")).alias("a"), F.coalesce(F.col(second), F.lit("{}")).alias("b"))
    both = _is_object(F.parse_json("a")) & _is_object(F.parse_json("b"))
    own = cut(own.select("*", both.alias("both")), "nested")
    pairs, levels = own.where("both").select("row", "path", "a", "b"), []
    while not pairs.isEmpty():
        met = _opened(pairs, "a").join(_opened(pairs, "b"), ["row", "path", "key"], "full_outer")
        deeper = F.col("a").isNotNull() & F.col("b").isNotNull() & _is_object(F.parse_json("a")) & _is_object(F.parse_json("b"))
        level = cut(met.select("row", "path", "key", "a", "b", F.coalesce(deeper, F.lit(False)).alias("both")), "nested")
        levels.append((pairs.select("row", "path"), level))
        # a key's length stands before it, so that no two paths are the same text
        pairs = level.where("both").select("row", F.concat("path", F.lit("/"), F.length("key").cast("string"), F.lit(":"), "key").alias("path"), "a", "b")
    made = None
    for objects, level in reversed(levels):
        values = level.withColumn("under", F.concat("path", F.lit("/"), F.length("key").cast("string"), F.lit(":"), "key"))
        if made is None:
            values = values.withColumn("value", F.coalesce("b", "a"))
        else:
            below = made.select("row", F.col("path").alias("under"), F.col("value").alias("deep"))
            values = values.join(below, ["row", "under"], "left").withColumn("value", F.when(F.col("both"), F.col("deep")).otherwise(F.coalesce("b", "a")))
        entries = F.map_from_entries(F.collect_list(F.struct("key", F.parse_json("value").alias("value"))))
        filled = values.groupBy("row", "path").agg(F.to_json(F.to_variant_object(entries)).alias("value"))
        made = objects.join(filled, ["row", "path"], "left").select("row", "path", F.coalesce("value", F.lit("{}")).alias("value"))
    whole = own.where("not both").select("row", F.col("b").alias("merged"))
    if made is not None:
        whole = whole.union(made.select("row", "value"))
    return whole.withColumnRenamed("row", row)
