"""A Merkle tree over a dataset, and proofs of its rows by looked-up coordinates.  DataFrame functions only.

A leaf is the digest of a document's fields.  Per language, leaves ascend by doc_id; every
``group`` consecutive nodes of a level (fewer in the last run, even one) become their
digest, while several are left.  What is left is the language's subroot; the subroots, by
language, are the leaves of the tree whose root stands for the dataset.

Building: leaves get their places by sums over sorted ranges.  Blocks of ``group`` to the
``LEVELS`` leaves are an array each, of which all their levels are made at once; their
tops are the next round's leaves, so 64 leaves, 4,096, 262,144 ... take one round more.

Proofs: a node that starts a stretch of ``LEVELS`` levels explodes the coordinates (tree,
level, index) of its siblings there, from its index, the group size and the number of
leaves alone; they meet the node table by a shuffle on the coordinate, and the digests
found are collected for the node in order, dealt by its block.  Leaves do so for the
lowest levels only: what is above is common to their block, is found once for it, and
joins them where they are.  Then a row has its whole proof, and folds it.  Coordinates
spread a language with most rows evenly.

Defined results: a null is ``-``, whatever the column; null ids come first, rows of one id
by their leaf; equal rows are leaves of their own; a null language comes before the empty
one; a lone leaf is its subroot, a lone subroot the root, and the proof of one row alone is
the digest of nothing; an empty table has no root and no rows; very long texts are
digested whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, running

LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(**other: Column) -> Column:
    """The digest of a document's fields, ``other`` in the place of some."""
    return F.sha2(F.concat(*[_field(other.get(c, F.col(c))) for c in FIELDS]), 256)


def leaves(documents: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and tampered: the leaf of a row with one more in n_chars, where 7 divides the id's crc32."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return documents.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf().alias("leaf"), F.when(chosen, leaf(n_chars=F.col("n_chars") + 1)).alias("tampered"))


def placed(rows: DataFrame) -> DataFrame:
    """``leaves`` with tree (the language's number), index and n: the leaf's place in its language, and how many leaves that has."""
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    numbered = cut(running(rows, order, place=F.lit(1).cast("long")), "numbered")
    trees = running(numbered.groupBy("lang").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), [F.col("lang").asc_nulls_first()], tree=F.lit(1).cast("long"))
    trees = cut(trees.withColumnRenamed("lang", "name"), "trees")
    both = numbered.join(trees, numbered["lang"].eqNullSafe(trees["name"]))
    return cut(both.select("tree", (F.col("place") - F.col("first")).alias("index"), "n", "doc_id", "leaf", "tampered"), "placed")


def height(n: Column, group: int) -> Column:
    """Levels above the leaves: digits of n - 1, written in base ``group``."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, group))).otherwise(0)


def _div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long") if b > 1 else a


def _runs_digests(nodes: Column, group: int) -> Column:
    runs = F.sequence(F.lit(0), _div(F.size(nodes) - 1, group).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * group + 1, F.lit(group)), ""), 256))


def _numbered(nodes: Column, level: int, first: Column) -> Column:
    return F.transform(nodes, lambda x, i: F.struct(F.lit(level).alias("level"), (first + i).alias("index"), x.alias("hash")))


def _siblings(own: Column, count: Column, level: int, group: int) -> Column:
    """Coordinates of the other nodes of the run of ``group`` that node ``own`` of a level of ``count`` is in."""
    first = own - F.pmod(own, F.lit(group))
    others = F.filter(F.sequence(first, F.least(first + group, count) - 1), lambda j: j != own)
    return F.transform(others, lambda j: F.struct(F.lit(level).alias("level"), j.alias("wanted")))


class Trees:
    """The levels of many trees at once.

    leaves: tree, index (from 0, without gaps), n (leaves of the tree), hash; further columns come along to ``proofs``.
    ``nodes``: tree, level (0: leaves), index, hash.  ``tops``: tree, hash.
    """

    def __init__(self, leaves: DataFrame, group: int = 2):
        self.group, self.block = group, group**LEVELS
        tall = leaves.agg(F.max(height(F.col("n"), group))).first()[0]
        self.rounds: list[tuple[DataFrame, DataFrame]] = []
        base = leaves
        for low in range(0, (tall or 0) + 1, LEVELS):
            blocks = cut(self._levels(base, low), "levels")
            self.rounds.append((base, blocks))
            tops = blocks.where(height(F.col("n"), group) >= low + LEVELS)
            base = tops.select("tree", F.col("block").alias("index"), "n", F.col(f"_{LEVELS}")[0].alias("hash"))

    def _levels(self, base: DataFrame, low: int) -> DataFrame:
        """tree, block, n, and arrays _0 to _6 of the digests of a block at levels low to low + 6; null beyond the tree's top."""
        rows = base.groupBy("tree", _div(F.col("index"), self.block).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("index", "hash"))).alias("_0"))
        rows = rows.withColumn("_0", F.transform("_0", lambda x: x["hash"]))
        for k in range(1, LEVELS + 1):
            rows = rows.withColumn(f"_{k}", F.when(height(F.col("n"), self.group) >= low + k, _runs_digests(F.col(f"_{k - 1}"), self.group)))
        return rows

    def _opened(self, number: int) -> DataFrame:
        """The nodes of one round: those at its lowest level and all above, but the next round's."""
        rows, low = self.rounds[number][1], number * LEVELS
        found = []
        for k in range(LEVELS):
            nodes = _numbered(F.col(f"_{k}"), low + k, F.col("block") * self.group ** (LEVELS - k))
            found.append(F.when(F.col(f"_{k}").isNotNull(), nodes).otherwise(F.array()))
        return rows.select("tree", "n", F.explode(F.flatten(F.array(*found))).alias("node")).select("tree", "n", "node.*")

    @property
    def nodes(self) -> DataFrame:
        rows = self._opened(0)
        for number in range(1, len(self.rounds)):
            rows = rows.union(self._opened(number))
        return rows.select("tree", "level", "index", "hash")

    @property
    def tops(self) -> DataFrame:
        found = None
        for number in range(len(self.rounds)):
            rows = self._opened(number).where(F.col("level") == height(F.col("n"), self.group)).select("tree", "hash")
            found = rows if found is None else found.union(rows)
        return found

    def _coordinates(self, number: int) -> DataFrame:
        """tree, index of each node at a round's lowest level, and level, wanted of each sibling of it and of those above it in the round."""
        g, low = self.group, number * LEVELS
        stretch = []
        for k in range(LEVELS):
            own, count = _div(F.col("index"), g**k), _div(F.col("n") - 1, g ** (low + k)) + 1
            stretch.append(F.when(count > 1, _siblings(own, count, low + k, g)).otherwise(F.array()))
        return self.rounds[number][0].select("tree", "index", F.inline(F.flatten(F.array(*stretch))))

    def proofs(self) -> DataFrame:
        """The leaves, with all their columns, and path: their siblings up to the tree's top, as (place, hash) in order.

        place: level * group + the sibling's place in its run; hash: 32 bytes.
        """
        above = None
        for number in reversed(range(len(self.rounds))):
            nodes = self._opened(number).select("tree", "level", F.col("index").alias("wanted"), F.unhex("hash").alias("hash"))
            block = _div(F.col("index"), self.block).alias("block")
            met = self._coordinates(number).join(nodes, ["tree", "level", "wanted"])
            place = (F.col("level") * self.group + F.pmod("wanted", F.lit(self.group))).cast("int")
            base = self.rounds[number][0]
            own = F.struct(*[c for c in base.columns if c not in ("tree", "index")])
            met = met.select("tree", block, "index", F.struct(place.alias("place"), "hash").alias("at"), F.lit(None).cast(base.select(own.alias("own")).schema["own"].dataType).alias("own"))
            # a node's own row comes along, so that it meets its siblings, and then its block's, in one shuffle
            met = met.union(base.select("tree", block, "index", F.lit(None).cast(met.schema["at"].dataType), own)).repartition("tree", "block")
            path = met.groupBy("tree", "block", "index").agg(F.array_sort(F.collect_list("at")).alias("path"), F.first("own", ignorenulls=True).alias("own"))
            if above is not None:
                higher = above.select("tree", F.col("index").alias("block"), F.col("path").alias("higher"))
                path = path.join(higher, ["tree", "block"], "left")
                path = path.withColumn("path", F.when(F.col("higher").isNull(), F.col("path")).otherwise(F.concat("path", "higher")))
            path = path.select("tree", "index", "own.*", "path")
            above = cut(path.select("tree", "index", "path"), "paths") if number else path
        return above


def steps(path: Column, levels: Column, index: Column, group: int) -> Column:
    """A proof as what stands before and after the own digest at each level; at a level without siblings, nothing does."""
    powers = F.array(*[F.lit(group**k) for k in range(int(62 / math.log2(group)))])

    def side(level: Column, left: bool) -> Column:
        own = F.pmod(F.floor(index / F.get(powers, level)), F.lit(group))
        place = lambda x: F.pmod(x["place"], F.lit(group))
        chosen = F.filter(path, lambda x: (F.floor(x["place"] / group) == level) & ((place(x) < own) if left else (place(x) > own)))
        return F.array_join(F.transform(chosen, lambda x: F.lower(F.hex(x["hash"]))), "")

    made = F.transform(F.sequence(F.lit(0), levels - 1), lambda level: F.struct(side(level, True).alias("before"), side(level, False).alias("after")))
    return F.when(levels > 0, made).otherwise(F.array())


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof make."""
    return F.aggregate(proof, start, lambda own, x: F.sha2(F.concat(x["before"], own, x["after"]), 256))


def siblings_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def verified(documents: DataFrame, group: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    rows = placed(cut(leaves(documents), "leaves")).withColumnRenamed("leaf", "hash")
    own = Trees(rows, group)
    counted = cut(own.tops.withColumnRenamed("hash", "subroot"), "subroots")
    count = counted.count()
    whole = Trees(counted.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(count).cast("long").alias("n"), F.col("subroot").alias("hash")), group)
    root = whole.tops.first()
    over = whole.proofs().select(F.col("index").alias("tree"), F.col("hash").alias("subroot"), steps(F.col("path"), height(F.col("n"), group), F.col("index"), group).alias("over"))
    found = own.proofs().join(cut(over, "over"), "tree")
    found = found.withColumn("proof", F.concat(steps(F.col("path"), height(F.col("n"), group), F.col("index"), group), "over"))
    found = found.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(root["hash"] if root else None).cast("string").alias("root"), siblings_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("tampered", "hash"), F.col("proof")).alias("folded_root")
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
