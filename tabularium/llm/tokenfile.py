"""Fixed-width bit-packed token files.

Layout of a file: ``TBP1``; then blocks, each ``block`` ids (the last one maybe
fewer) of ``bits`` bits, most significant bit first, padded to a byte; then the
index (little-endian): block offsets (u64 each, one more than blocks), rows'
ids (i64) and their numbers of token ids (u64); then six u64: bits, block, ids,
blocks, rows, and the index's place.  A block unpacks without its neighbours,
so any range of ids is read with a seek and one vectorised call.

Files are written by tasks, in the shared folder, under the name of the task's
partition and attempt; the manifest that comes back lists only files of tasks
that succeeded, so a lost executor or a second attempt leaves no wrong data.

Defined results: rows are in ascending order of doc_id (nulls first; equal ids
by the text's hash); a null or empty text is its end id; a very long text is
written and read in pieces of ``_READ`` ids; an id that needs more bits than the
vocabulary's is an error; an empty table has no files and no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, new_path, ship_package
from .textcore import tidy
from .tokens import id_bits, token_bytes

MAGIC = b"TBP1"
_READ = 1 << 18  # ids that a task reads at a time


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} needs more than {bits} bits")
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> shifts) & np.uint32(1)).astype(np.uint8).ravel()).tobytes() if bits != 16 else ids.astype(">u2").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    out = np.zeros(n, np.uint32)
    for i in range(bits):
        out = (out << np.uint32(1)) | flags[:, i]
    return out


class Writer:
    def __init__(self, sink, bits: int, block: int):
        self.sink, self.bits, self.block = sink, bits, block
        self.pending: list[bytes] = []
        self.waiting = self.total = 0
        self.offsets, self.rows, self.sizes = [len(MAGIC)], [], []
        sink.write(MAGIC)

    def add(self, row: int | None, ids: bytes) -> None:
        """ids: four bytes each, little-endian."""
        self.rows.append(np.iinfo(np.int64).min if row is None else row)
        self.sizes.append(len(ids) // 4)
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= 16 * self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        end = len(ids) if all_ else len(ids) // self.block * self.block
        for a in range(0, end, self.block):
            packed = pack_bits(ids[a : min(a + self.block, end)], self.bits)
            self.sink.write(packed)
            self.offsets.append(self.offsets[-1] + len(packed))
        self.total += end
        self.pending, self.waiting = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        for values, kind in ((self.offsets, "<u8"), (self.rows, "<i8"), (self.sizes, "<u8"), ((self.bits, self.block, self.total, len(self.offsets) - 1, len(self.rows), self.offsets[-1]), "<u8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.close()


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 48)
        self.bits, self.block, self.total, blocks, rows, at = map(int, np.frombuffer(source.read(48), "<u8"))
        source.seek(at)
        index = source.read(size - 48 - at)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        self.rows = np.frombuffer(index, "<i8", rows, 8 * (blocks + 1))
        self.sizes = np.frombuffer(index, "<u8", rows, 8 * (blocks + 1 + rows)).astype(np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file; only the blocks that hold them are read."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        base, parts = self.offsets[first], []
        for b in range(first, last + 1):
            n = min(self.block, self.total - b * self.block)
            parts.append(unpack_bits(data[self.offsets[b] - base : self.offsets[b + 1] - base], self.bits, n))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]


def _write(uri: str, tokenizer: str, end_id: int, bits: int, block: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer = TaskContext.get(), None
        where, folder = fs.FileSystem.from_uri(uri)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.tbp"
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                if writer is None:
                    where.create_dir(folder, recursive=True)
                    writer = Writer(where.open_output_stream(f"{folder}/{name}"), bits, block)
                for row, ids in zip(part.column(0).to_pylist(), token_bytes(part.column(1), tokenizer), strict=True):
                    writer.add(row, ids + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "file": [f"{uri}/{name}"], "n_ids": [writer.total], "n_rows": [len(writer.rows)]})

    return tidy(run)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, block: int = 1 << 14) -> DataFrame:
    """Files of all texts' ids in ascending doc_id order; returns the manifest part, file, n_ids, n_rows, start."""
    spark = docs.sparkSession
    ship_package(spark)
    bits = max(id_bits(tokenizer), int(end_id).bit_length())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of one id are dealt by their texts, equal ones by their numbers, so that an id with many rows is many tasks' work
    order = ["doc_id", "hash", "number"]
    ordered = texts.withColumns({"hash": F.xxhash64("text"), "number": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    parts = cut(ordered.mapInArrow(_write(new_path(spark, "tokens"), tokenizer, end_id, bits, block), "part long, file string, n_ids long, n_rows long"), "manifest")
    # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            where, path = fs.FileSystem.from_uri(file)
            with where.open_input_file(path) as source:
                reader = Reader(source)
                a = 0
                while a < len(reader.rows):
                    # the rows of at most _READ ids, or a longer one by itself, piece by piece
                    b = max(a + 1, int(np.searchsorted(reader.starts, reader.starts[a] + _READ, "right")) - 1)
                    rows, lo, hi = reader.rows[a:b], int(reader.starts[a]), int(reader.starts[b])
                    if b == a + 1:
                        sums = [0]
                        for x in range(lo, hi, _READ):
                            sums[0] = zlib.crc32(reader.ids(x, min(x + _READ, hi)).astype("<u4").tobytes(), sums[0])
                    else:
                        raw = reader.ids(lo, hi).astype("<u4").tobytes()
                        at = (4 * (reader.starts[a : b + 1] - lo)).tolist()
                        sums = [zlib.crc32(raw[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rows, mask=rows == np.iinfo(np.int64).min),
                            pa.array(start + reader.starts[a:b]),
                            pa.array(reader.sizes[a:b]),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    a = b


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the files."""
    ship_package(manifest.sparkSession)
    # a few rows stand for large files: an explicit number of partitions, which Spark does not merge by their bytes
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(tasks, "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
