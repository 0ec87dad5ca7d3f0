"""Near-duplicate detection by circulant MinHash, confirmed on full shingle sets.

Signature.  Shingles are hashed into a universe of 2**32 places.  One fixed
permutation scatters the places; a second one, applied after a circular shift
by k, gives signature coordinate k as its minimum: two permutations for all
coordinates.  ``bands`` bands of ``rows`` coordinates become bucket keys; at a
similarity of 0.75 a pair shares none of 32 bands of 4 with probability 5e-6.

Plan.  (1) One map over the texts makes, per document, the set's size, a
128-bit fingerprint of the set and the band keys.  (2) Equal fingerprints are
one *class*; from here on a class stands for all its copies.  (3) Classes are
hashed into buckets, and buckets of one are dropped.  (4) Each class is
compared with the least and the greatest class of its bucket: a linear number
of pairs that finds nearly all links.  (5) Connected components of these links;
only classes of different components in one bucket can still hold an unseen link
that matters.  (6) Those buckets are searched inside tasks, large ones in parts of
about ``block`` classes: the classes outside the bucket's largest component go to
all its parts, the others stay in their own.  Each pair is looked at in its first
common band, and what passes on 32-bit hashed sets is confirmed on the full sets
like every other link.  (7) Documents get their class's component by a join on the
fingerprint; those of at most 10,000 fingerprints, each shared by more than one in
10,000 documents, by a broadcast of these.
No pair list of a whole group is ever made, and no partner is capped.

Defined results: null or blank texts have no shingles, size 0, and link with
nothing; a very long text is worked on by itself; a null ``doc_id`` is kept and in
no component (null); repeated rows are separate documents with the same id; an
empty table has no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import cut, dealt, let_go, ship_package
from .textcore import list_array, mix64, release, shingles, slices, tidy, word_hashes

_KEY = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(16)], np.uint64)


def _mixed(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of 32-bit integers, in place: shifts and two odd multipliers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation: places of the shingles."""
    return _mixed(x, 0x85EBCA6B, 0xC2B2AE35)


def _shifted(x: np.ndarray) -> np.ndarray:
    """The second one, with multipliers of its own: every coordinate is its minimum over places shifted around the circle of 2 ** 32."""
    return _mixed(x, 0x9E3779B1, 0x21F0AAAD)


def signature(sets: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of minima for each non-empty set; sets: concatenated 64-bit shingle hashes."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), coordinates), np.uint32)
    # blocks of whole sets that stay in cache
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 15))))
        stop = starts[end] if end < len(starts) else len(sets)
        place = _scatter((sets[starts[at] : stop] >> np.uint64(32)).astype(np.uint32))
        for k in range(coordinates):
            out[at:end, k] = np.minimum.reduceat(_shifted(place + np.uint32(k)), starts[at:end] - starts[at])
        at = end
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket key of each band; the band is part of what is hashed."""
    wide = sig.astype(np.uint64)
    keys = np.empty((len(sig), bands), np.uint64)
    own = np.arange(bands, dtype=np.uint64) * _KEY[-1]
    for b in range(bands):
        keys[:, b] = mix64(wide[:, b * rows : (b + 1) * rows] @ _KEY[:rows] + own[b])
    return keys.view(np.int64)


def _fingerprints(sets: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    size = np.diff(offsets)
    starts = offsets[:-1][size > 0]
    if not len(starts):
        return [None] * len(size)
    one = np.add.reduceat(mix64(sets ^ np.uint64(0x2545F4914F6CDD1D)), starts)
    two = np.add.reduceat(mix64(sets + np.uint64(0x9E6C63D0876A9A47)), starts)
    both = np.stack([one, two], 1).tobytes()
    found = iter(range(0, len(both), 16))
    return [both[i : i + 16] if n and (i := next(found)) is not None else None for n in size]


def _sketch(bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1), 1 << 19):
                sets, at = shingles(*word_hashes(data, offsets), words)
                keys = band_keys(signature(sets, at, bands * rows), bands, rows)
                ends = np.zeros(b - a + 1, np.int64)
                np.cumsum((np.diff(at) > 0) * bands, out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(_fingerprints(sets, at), pa.binary()), list_array(keys.ravel(), ends)],
                    ["row", "doc_id", "n_shingles", "print", "keys"],
                )
                row += b - a

    return tidy(run)


def _sets(words: int):
    """The set of each text that has the fingerprint asked for; a repeated id also brings other texts, and the same one again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        last = None
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                sets, at = shingles(*word_hashes(data, offsets), words)
                nodes, asked, keep = batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a).to_pylist(), []
                for i, found in enumerate(_fingerprints(sets, at)):
                    if found == asked[i] != last:
                        keep.append(i)
                        last = found
                out = pa.RecordBatch.from_arrays([nodes, list_array(sets.view(np.int64), at)], ["node", "shingles"])
                yield out if len(keep) == b - a else out.take(pa.array(keep, pa.int32()))

    return tidy(run)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in a sorted partition."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            change |= column[1:] != column[:-1]
        at = 0
        for end in np.flatnonzero(change) + 1:
            yield table.slice(at, end - at)
            at = int(end)
        rest = table.slice(at)
    if rest is not None and rest.num_rows:
        yield rest


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    offsets = array.offsets.to_numpy()
    return array.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _search(percent: int):
    """Pairs of different components in one part of a bucket whose hashed sets reach the similarity, at their first common band.

    The rows of ``home`` are the part's own; those ``outside`` the bucket's largest
    component, of this part or another one, are compared with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in _groups(batches, ["key", "part"]):
            nodes = table.column("node").to_numpy()
            comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
            if comp.max() == 0:
                continue
            home, outside = (table.column(c).to_numpy() for c in ("home", "outside"))
            values, at = _lists(table.column("small"))
            keys = _lists(table.column("keys"))[0].reshape(len(nodes), -1)
            keys = keys[:, : np.flatnonzero(keys[0] == table.column("key")[0].as_py())[0]]
            size = np.diff(at)
            owner = np.repeat(np.arange(len(nodes)), size)
            order = np.argsort(values, kind="stable")
            term = np.empty(len(values), np.int64)
            fresh = np.r_[True, values[order][1:] != values[order][:-1]]
            term[order] = np.cumsum(fresh) - 1
            postings = owner[order]
            starts = np.r_[np.flatnonzero(fresh), len(values)]
            found_a, found_b = [], []
            for x in np.flatnonzero(outside):
                mine = term[at[x] : at[x + 1]]
                length = starts[mine + 1] - starts[mine]
                gather = np.repeat(starts[mine] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
                both = np.bincount(postings[gather], minlength=len(nodes))
                close = 100 * both >= (percent - 1) * (size + size[x] - both)
                close &= home & (comp != comp[x])
                for y in np.flatnonzero(close):
                    if not (keys[x] == keys[y]).any():
                        found_a.append(min(nodes[x], nodes[y]))
                        found_b.append(max(nodes[x], nodes[y]))
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return tidy(run)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("both", both)
        .where(100 * F.col("both") >= percent * (F.size("left") + F.size("right") - F.col("both")))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, block: int = 2048, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id linked with it, directly or through others), kept."""
    ship_package(docs.sparkSession)
    texts = dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    sketch = cut(texts.mapInArrow(_sketch(bands, rows, words), "row long, doc_id long, n_shingles long, print binary, keys array<long>"), "sketch")

    # A class is named by the least row that has its set.
    named = sketch.where("doc_id is not null and print is not null").select("row", "doc_id", "print")
    classes = cut(named.groupBy("print").agg(F.min(F.struct("row", "doc_id")).alias("z"), F.min("doc_id").alias("least")).select("print", F.col("z.row").alias("node"), F.col("z.doc_id").alias("first"), "least"), "classes")
    keyed = cut(sketch.select(F.col("row").alias("node"), "keys").join(classes.select("node"), "node", "left_semi"), "keys")
    spread = keyed.select("node", F.explode("keys").alias("key"))
    buckets = spread.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = cut(spread.join(buckets, "key"), "members")
    pairs = cut(members.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b")))).alias("p")).select("p.*").where("a <> b").distinct(), "stars")

    # The full sets of the classes that share a bucket with another one.
    wanted = cut(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("first").alias("doc_id"), "print"), "wanted")
    few = wanted.count() <= broadcast_rows
    full = texts.join(F.broadcast(wanted) if few else wanted, "doc_id").select("node", "text", "print").mapInArrow(_sets(words), "node long, shingles array<long>")
    sets = cut(full, "sets")

    links = cut(_confirmed(pairs, sets, percent), "links")
    let_go(pairs, wanted)
    comp = components(links)

    # What those links leave open: buckets that hold more than one component.
    labelled = members.select("key", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    opened = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("comps"))
    opened = opened.where("comps > 1").select("key", F.col("main.comp").alias("main"), F.ceil(F.col("m") / block).cast("int").alias("parts"))
    small = sets.select("node", F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("small"))
    blocks = (
        labelled.join(opened, "key")
        .withColumn("outside", F.col("comp") != F.col("main"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("part", F.explode(F.when(F.col("outside"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
        .withColumn("home", F.col("own") == F.col("part"))
        .join(keyed.join(small, "node"), "node")
        .select("key", "part", "home", "outside", "node", "comp", "keys", "small")
        .repartition("key", "part")
        .sortWithinPartitions("key", "part")
    )
    more = _confirmed(cut(blocks.mapInArrow(_search(percent), "a long, b long").distinct(), "found"), sets, percent)
    comp = components(cut(links.union(more), "links"))
    let_go(members, keyed, sets, links)

    # Components are named by their classes, linked ones only; every document then meets its class once.
    linked = comp.join(classes.select("node", "least"), "node")
    linked = linked.join(linked.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id")
    names = classes.join(linked, "node", "left").select("print", F.coalesce("component_id", "least").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    copies = named.groupBy("print").agg(F.count(F.lit(1)).alias("copies"))
    hot = cut(names.join(copies.where(F.col("copies") * 10_000 > F.lit(named.count())), "print").select("print", "component_id"), "hot")
    rows = sketch.select("doc_id", "n_shingles", "print")
    few = rows.join(F.broadcast(hot), "print", "left_anti").join(names, "print", "left")
    found = few.unionByName(rows.join(F.broadcast(hot), "print")).withColumn("component_id", own)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
