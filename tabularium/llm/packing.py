"""Best-fit packing of token pieces into fixed-length sequences, hierarchically.

Each text becomes ids plus an end id; only texts longer than a sequence are
cut, into full-length pieces and a rest.  Full pieces are sequences already.
The others are dealt into groups of about ``group`` items; each group is packed
by itself (longest first, each into the fullest open bin that has room).  Bins
with no more than ``slack`` tokens free are done; the underfull ones become
items of the next round, in ever fewer groups (a tree).  A group leaves at most
one bin that is no more than half full, and two bins over half do not fit
together; so the bins up to half meet in one group of the next round, and the
tree ends with the round that leaves one group, or at most one such bin: then no
two bins fit together but maybe with that one.  A task never holds more than a
group, and those bins, one of each group.

Defined results: a null or empty text is its end id; a very long text becomes
many full pieces; null ids and repeated rows are packed row by row (``row`` tells
them apart); items of one length are taken in the order of their numbers; the
same input partitions give the same packing; an empty table has no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, ship_package
from .scratch import dealt as spread
from .textcore import tidy
from .tokens import token_bytes


def _pieces(path: str, most: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                out: list[tuple] = []
                held: list[bytes] = []
                for i, ids in enumerate(token_bytes(part.column(1), path)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * most)):
                        own = ids[at : at + 4 * most]
                        out.append((row + i, i, k, at // 4, len(own) // 4))
                        held.append(own)
                row += part.num_rows
                rows, index, piece, start, length = (np.array(x, np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column(0).take(pa.array(index)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(held, pa.binary())], ["row", "doc_id", "piece", "start", "length", "ids"]
                )

    return tidy(run)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items in the order given: bin and offset of each; and what each bin holds."""
    bin_of, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []  # the free sizes there are, ascending
    for i, n in enumerate(lengths.tolist()):
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b, free = len(used), capacity
            used.append(0)
        else:
            free = rooms[at]
            own = open_bins[free]
            b = own.pop()
            if not own:
                del open_bins[free], rooms[at]
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        if free > n:
            own = open_bins.setdefault(free - n, [])
            if not own:
                insort(rooms, free - n)
            own.append(b)
    return bin_of, offset, np.array(used, np.int64)


def _round(capacity: int, number: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        items, lengths = table.column("item").to_numpy(), table.column("length").to_numpy()
        order = np.lexsort((items, -lengths))
        bins, offset, used = best_fit(lengths[order], capacity)
        return pa.table({"item": items[order], "bin": (number << 56) + (group << 24) + bins, "place": offset, "used": used[bins]})

    return run


def pack(lengths: DataFrame, capacity: int, slack: int = 4, group: int = 100_000) -> DataFrame:
    """lengths (item long, length long, 1 to capacity) -> item, bin, place."""
    half = F.col("length") <= capacity // 2
    todo, number, maps = lengths.where(F.col("length") < capacity), 0, []
    left = todo.count()
    while left:
        number += 1
        groups = -(-left // group)
        group_of = F.pmod(F.xxhash64("item", F.lit(number)), F.lit(groups))
        dealt = todo.withColumn("group", group_of if number == 1 else F.when(half, F.lit(0).cast("long")).otherwise(group_of))
        placed = cut(dealt.groupBy("group").applyInArrow(_round(capacity, number), "item long, bin long, place long, used long"), "packed")
        maps.append(placed)
        todo = placed.where(F.col("used") < capacity - slack).select(F.col("bin").alias("item"), F.col("used").alias("length")).distinct()
        left, small = todo.agg(F.count(F.lit(1)), F.count_if(half)).first()
        if groups == 1 or small < 2:
            break
    # a bin's own place in the rounds after its own
    found = None
    for placed in reversed(maps):
        step = placed.select("item", "bin", "place")
        if found is not None:
            up = found.select(F.col("item").alias("bin"), F.col("bin").alias("above"), F.col("place").alias("shift"))
            step = step.join(up, "bin", "left").select("item", F.coalesce("above", "bin").alias("bin"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"))
        found = step
    full = lengths.where(F.col("length") == capacity).select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("place"))
    return full if found is None else full.union(found)


def pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """item, row, doc_id, piece, start, length, ids (little-endian, four bytes each), written to the shared folder: one row for each piece."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = spread(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    found = texts.mapInArrow(_pieces(tokenizer, most, end_id), f"row long, doc_id {kind}, piece int, start long, length long, ids binary")
    # an item's number: its row has 33 bits within its partition, of which pieces take the place above
    return cut(found.select(F.monotonically_increasing_id().alias("item"), "*"), "pieces")


def packed_documents(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece; its ids are in ``pieces``."""
    items = pieces(docs, tokenizer, most, end_id)
    placed = pack(items.select("item", "length"), most, **options)
    digest = items.select("item", "row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digest.join(placed, "item").select("row", "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))


def sequences(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """sequence_id, ids (little-endian, four bytes each), n_ids: the packed sequences themselves."""
    items = pieces(docs, tokenizer, most, end_id)
    placed = pack(items.select("item", "length"), most, **options)
    parts = items.select("item", "length", "ids").join(placed, "item").groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("parts"), F.sum("length").alias("n_ids"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x.ids))
    return parts.select(F.col("bin").alias("sequence_id"), joined.alias("ids"), "n_ids")
