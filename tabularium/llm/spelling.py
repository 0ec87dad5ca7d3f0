"""Grouping of spelling variants: each word's whole neighbourhood is made and looked up in the vocabulary.

Words are runs of Latin letters of whole texts, with A-Z lower-cased; the vocabulary has
those that are long and frequent enough.  Two words are near if one inserted, deleted or
replaced code point makes one of the other.

Neighbourhood: all distinct deletions, replacements and insertions over the alphabet that
the vocabulary is written in (at most 90 letters, by the pattern of words).  For words of
one length, numpy makes the 64-bit hashes of all their edits from prefix sums, some
thousand words at a time.  An edit of a run of equal letters is made once.  A hash is
first looked up in a Bloom filter of the vocabulary (three bits a word; a bit for each 64
words' worth, up to ``most_bits``), which lets all words through and few others; only what
passes is spelt out, and joined with the vocabulary as a string.  What the filter lets
through by chance finds no partner there, so results do not depend on its size, and no
distance is computed.  The filter is made in segments by tasks, and read by workers from
the shared folder; nothing of it passes the driver.

Candidates meet the vocabulary under the candidate's spelling with the maker's count, and
are summed there before the shuffle: being near is mutual, so what makes a word are its
near words.  Forms point to words at least ``ratio`` times as frequent, so chains are
short; roots are found by doubling steps.

Defined results: null texts have no words; a null id counts as an empty one in the hash
that chooses where to delete; repeated rows count again; ties of a form go to the smallest
word in code-point order; words without near words have no form and are their own root;
very long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, let_go, ship_package
from .textcore import kept, mix64, tidy

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Candidates that are made at once.
_AT_ONCE = 1 << 20
#: Bits of the filter in one row of its table.
_SEGMENT = 20
_SPREAD = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, shortest: int = 7, modulus: int = 31) -> DataFrame:
    """One row for each word of at least ``shortest`` letters: word.

    Where ``modulus`` divides h, the crc32 of ``<doc_id>:<run>``, the run loses letter h % length.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    rows = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    rows = rows.withColumn("h", F.crc32(F.concat("id", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    rows = rows.select(F.when(F.col("h") % modulus == 0, less).otherwise(F.col("run")).alias("word"))
    return rows.where(F.length("word") >= shortest)


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2, modulus: int = 31) -> DataFrame:
    """word, n."""
    return occurrences(docs, shortest, modulus).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def alphabet(words: DataFrame) -> str:
    """The letters of all words, in order."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()
    return "".join(sorted(r["letter"] for r in letters.collect()))


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their code points as a matrix) for each length of words."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield rows, points[starts[rows][:, None] + np.arange(n)]


def _values(points: np.ndarray) -> np.ndarray:
    return mix64(points.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _BASE, np.uint64)))


def hashes(points: np.ndarray) -> np.ndarray:
    """The hash of each row of code points: a polynomial in which an edit moves what is behind it by one power."""
    return (_values(points) * _powers(points.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def places(hashed: np.ndarray, bits: int, number: int) -> np.ndarray:
    """Bit ``number`` (of three) of each hash in a filter of 2 ** bits bits."""
    if number:
        hashed = mix64(hashed + _SPREAD[number])
    return ((hashed * _SPREAD[number]) >> np.uint64(64 - bits)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, points in _by_length(batch.column(0)) if batch.num_rows else ():
            own = hashes(points)
            at = np.unique(np.concatenate([places(own, bits, k) for k in range(3)]))
            yield pa.RecordBatch.from_arrays([pa.array((at >> _SEGMENT).astype(np.int32)), pa.array((at & (1 << _SEGMENT) - 1).astype(np.int32))], ["segment", "bit"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits, sorted by segment -> segment, bits (little-endian) of each."""
    now, flags = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()])], ["segment", "bits"])
    for batch in batches:
        segments, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for s in np.unique(segments).tolist():
            if s != now:
                if now is not None:
                    yield out()
                now, flags = s, np.zeros(1 << _SEGMENT, bool)
            flags[bits[segments == s]] = True
    if now is not None:
        yield out()


def _opened(uri: str, bits: int) -> np.ndarray:
    where, path = fs.FileSystem.from_uri(uri)
    table = ds.dataset(path, filesystem=where, format="parquet").to_table()
    out = np.zeros(1 << max(bits, _SEGMENT) - 3, np.uint8)
    for segment, raw in zip(table.column("segment").to_pylist(), table.column("bits"), strict=True):
        own = np.frombuffer(raw.as_buffer(), np.uint8)
        out[segment * len(own) : segment * len(own) + len(own)] = own
    return out


def _told(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def edits(points: np.ndarray, letters: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """The hashes of all distinct edits of words of one length, place by place.

    (kind, place, hashes (words, letters; words, 1 for deletions), which of them to leave
    out).  In a run of equal letters only its last one is deleted, and a letter is put in
    behind equal ones only; no letter is replaced by itself.
    """
    n, length = points.shape
    power = _powers(length)
    values, put = _values(points), _values(letters)
    terms = values * power[:length]
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    for i in range(length + 1):
        here, rest = before[:, i : i + 1], whole - before[:, i : i + 1]
        added = put[None, :] * power[i]
        if i < length:
            own = points[:, i : i + 1]
            last = points[:, i : i + 1] == points[:, i + 1 : i + 2] if i + 1 < length else np.zeros((n, 1), bool)
            yield "delete", i, here + (rest - terms[:, i : i + 1]) * _BACK, last
            same = own == letters[None, :]
            yield "replace", i, (whole - terms[:, i : i + 1]) + added, same
            yield "insert", i, here + rest * _BASE + added, same
        else:
            yield "insert", i, whole + added, np.zeros((n, len(letters)), bool)


def _near(uri: str, bits: int, letters: str):
    table = np.array([ord(c) for c in letters], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = kept(uri, lambda: _opened(uri, bits))
        for batch in batches:
            if not batch.num_rows:
                continue
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for rows, points in _by_length(batch.column(0)):
                step = max(1, _AT_ONCE // max(1, len(table)))
                for a in range(0, len(rows), step):
                    own = rows[a : a + step]
                    near, makers = [], []
                    for kind, i, hashed, skip in edits(points[a : a + step], table):
                        live = _told(filter_, places(hashed, bits, 0))
                        row, letter = np.nonzero(live & ~skip)
                        left = hashed[row, letter]
                        for k in (1, 2):
                            hit = _told(filter_, places(left, bits, k))
                            row, letter, left = row[hit], letter[hit], left[hit]
                        makers.append(own[row])
                        behind = i if kind == "insert" else i + 1
                        for r, x in zip(own[row].tolist(), letter.tolist(), strict=True):
                            w = words[r]
                            near.append(w[:i] + ("" if kind == "delete" else letters[x]) + w[behind:])
                    made = np.concatenate(makers)
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.string()), batch.column(0).take(pa.array(made)), pa.array(counts[made])], ["near", "word", "n"])

    return tidy(run)


def candidates(words: DataFrame, most_bits: int = 30, each: int = 20_000) -> DataFrame:
    """vocabulary (word, n), written -> near, word, n: the edits of all words that a filter of the vocabulary lets through."""
    spark = words.sparkSession
    ship_package(spark)
    count = words.count()
    bits = min(most_bits, max(_SEGMENT, (64 * count).bit_length()))
    rows = words.select("word").mapInArrow(lambda b: _bits(b, bits), "segment int, bit int")
    filter_ = cut(rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(_segments, "segment int, bits binary"), "filter")
    # a small table stands for much work: it is dealt to an explicit number of tasks
    tasks = max(spark.sparkContext.defaultParallelism, count // each + 1)
    return words.repartition(tasks, "word").select("word", "n").mapInArrow(_near(filter_._written, bits, alphabet(words)), "near string, word string, n long")


def forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """vocabulary (word, n), written -> word, form, n, n_near, form_n."""
    found = candidates(words).groupBy("near").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "word")).alias("most"))
    both = words.join(found.withColumnRenamed("near", "word"), "word", "left")
    told: Column = -F.col("most.less") >= ratio * F.col("n")
    return both.select(
        "word", F.when(told, F.col("most.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(told, -F.col("most.less")).alias("form_n")
    )


def roots(found: DataFrame) -> DataFrame:
    """word, root of every word that has a form: the end of its chain, by doubling steps."""
    steps = cut(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = cut(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        let_go(steps)
        steps = far.select("word", "root")
        steps._written = far._written
        if far.where("moved").isEmpty():
            return steps


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = cut(vocabulary(docs, shortest, least), "vocabulary")
    found = cut(forms(words, ratio), "forms")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
