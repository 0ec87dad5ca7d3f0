"""Language-model scoring by prediction by partial matching over bytes.

The text as the model sees it: words (see textcore) in lower case, each
followed by one space, then one line feed as the end.  A trie of byte contexts
up to ``order`` bytes holds how often each byte followed each context.  A byte
is coded in its longest known context; if it never followed there, an escape
is coded and the next
shorter context is tried with the bytes already ruled out excluded; below the
empty context, the bytes left are equally likely.  Estimate D: where n bytes
followed, d of them different, one that came c times has (2c - 1) / 2n and the
escape d / 2n.  So each text's
probabilities add up to one over all texts in that normal form.

Plan.  One map counts, per task, the (order + 1)-grams and the words of the
training texts; one shuffle sums them.  The trie is built in shards: grams are
dealt by the last two bytes of their contexts, where every context from order 2
on is whole (orders 0 and 1 have 65,792 entries at most and go everywhere), and
each shard writes what its entries and contexts cost.  Scoring tasks open the
tables of common contexts, those seen 2**``least`` times or more: at most
``most_entries`` entries, in files of the shared folder, which the workers of a
machine map and share.  What they hold is whole, as a context's suffixes are at
least as frequent; a gram whose longest context is not there costs nothing there
and is priced by the trie's shards, which its distinct grams meet by shuffle, and
the costs are joined back.  The word table is bounded likewise by ``most_words``
and the rarer words' counts are joined by a shuffle.  So the bounds only save
joins, both scores are those of all counts at any size, and nothing but the
orders 0 and 1 passes the driver.

Defined results: a null or blank text is one end token; a null ``doc_id`` takes
part in scoring and training (its text key is ''); repeated rows are scored
one by one; a very long text is worked on by itself; other columns are ignored,
whatever their names; an empty table has no rows; without training rows every byte costs log10(256) and the base has
N = V = 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import Lookup, write_table
from .scratch import cut, dealt, new_path, ship_package
from .textcore import LOWER, kept, mix64, release, slices, tidy, word_bounds, word_hashes

END = 10
END_WORD = np.uint64(0x0A0A0A0A0A0A0A0A)
_HOLD = 1 << 20  # entries that a task holds of each kind before it sends what it has counted
_SLICE = 1 << 18


def held_out(ids: pa.Array, modulus: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus == 0 for i in ids.to_pylist()], bool)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the normal form, itself in the low byte and the ``order`` bytes before it above; and the rows' offsets."""
    starts, ends, first = word_bounds(data, offsets)
    length, rows = ends - starts, len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    place = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length + 1, out=place[1:])
    at = np.append(place[:-1] + row, place[-1] + rows)
    out = np.full(int(at[-1]), 32, np.uint8)
    shift = np.repeat(starts - at[:-1], length)
    begun = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length, out=begun[1:])
    to = np.arange(begun[-1]) + np.repeat(at[:-1] - begun[:-1], length)
    out[to] = LOWER[data[to + shift]]
    ends = place[first[1:]] + np.arange(rows)
    out[ends] = END
    rows_at = np.append(0, ends + 1)
    code = out.astype(np.uint64)
    for j in range(1, order + 1):
        before = np.full(len(out), END, np.uint64)
        before[j:] = out[:-j]
        for s in range(min(j, len(out))):
            edge = rows_at[:-1] + s
            before[edge[edge < len(out)]] = END
        code |= before << np.uint64(8 * j)
    return code, rows_at


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _count(order: int, modulus: int):
    """Per task, (kind, key, n): kind 0 grams, 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = held[kind].pop()
            for a in range(0, len(keys), 50_000):
                k = keys[a : a + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[a : a + 50_000])], ["kind", "key", "n"])

        release()
        for batch in batches:
            test = held_out(batch.column(0), modulus)
            for a, b, data, offsets in slices(batch.column(1), _SLICE):
                code, rows_at = grams(data, offsets, order)
                words, first = word_hashes(data, offsets)
                learn = ~test[a:b]
                held[0].append(_runs(code[np.repeat(learn, np.diff(rows_at))]))
                own = words[np.repeat(learn, np.diff(first))]
                held[1].append(_runs(np.append(own, np.full(learn.sum(), END_WORD))))
                for kind in (0, 1):
                    if sum(len(x[0]) for x in held[kind]) > (_HOLD if len(held[kind]) < 2 else len(held[kind][0][0]) + _HOLD // 2):
                        held[kind] = [_tally(held[kind])]
                        if len(held[kind][0][0]) > _HOLD:
                            yield from out(kind)
        for kind in (0, 1):
            if held[kind]:
                held[kind] = [_tally(held[kind])]
                yield from out(kind)

    return tidy(run)


class Trie:
    """Per order: entries (context, byte) and contexts, with the cost of coding there and of leaving."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        """orders[k]: keys (k context bytes above the coded byte) and counts, whole contexts only; order 0 first."""
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # of each order's entries and contexts, by key: log2 of what the context was seen
        self.order = len(orders) - 1
        self.cost: list[Lookup] = []
        self.leave: list[Lookup] = []
        self.novel = 256
        above: tuple = ()
        for k, (keys, n) in enumerate(orders):
            by = np.argsort(keys)
            keys, n = keys[by], n[by].astype(np.int64)
            context = keys >> np.uint64(8)
            at = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(at, len(keys)))
            total = np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(at)), kinds)
            # what remains of the next shorter context once this one's bytes are excluded
            rest, rest_kinds = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            if k == 0:
                self.novel = 256 - len(keys)
            else:
                low_keys, low_n, low_context, low_total, low_kinds = above
                own = np.searchsorted(low_keys, keys & np.uint64((1 << 8 * k) - 1))
                gone = np.bincount(owner, low_n[own], minlength=len(at)).astype(np.int64)
                parent = np.searchsorted(low_context, context[at] & np.uint64((1 << 8 * (k - 1)) - 1))
                rest, rest_kinds = low_total[parent] - gone, low_kinds[parent] - kinds
            base = np.log10(2 * total)
            log = np.log10(2 * n - 1)
            values = {"cost": (base[owner] - log).astype(np.float32)}
            if k < self.order:
                values["log"] = log.astype(np.float32)
            level = np.log2(np.maximum(total, 1)).astype(np.int32)
            self.levels.append((level[owner], level))
            self.keys.append((keys, context[at]))
            self.cost.append(Lookup(keys, **values))
            # once this context is left: the shorter one's log of what remains, and the cost of leaving that (nothing, if nothing remains)
            whole = np.log10(np.maximum(2 * rest, 1))
            onward = np.where(rest + rest_kinds > 0, whole - np.log10(np.maximum(rest_kinds, 1)), 0.0)
            leave = base - np.log10(np.maximum(kinds, 1))
            self.leave.append(Lookup(context[at], cost=leave.astype(np.float32), whole=whole.astype(np.float32), onward=onward.astype(np.float32)))
            above = keys, n, context[at], total, kinds

    def code_length(self, code: np.ndarray, away: np.ndarray | None = None) -> np.ndarray:
        """Cost in log10 units of each byte, given its gram; with ``away``, marks there the grams whose longest context is not in the trie, which cost 0."""
        out = np.zeros(len(code), np.float64)
        found = self.cost[-1].find(code)
        hit = found >= 0
        out[hit] = self.cost[-1].values["cost"][found[hit]]
        todo = np.flatnonzero(~hit)
        if away is not None:
            known = self.leave[-1].find(code[todo] >> np.uint64(8)) >= 0
            away[todo[~known]] = True
            todo = todo[known]
        left = np.full(len(todo), -1, np.int64)  # the context that was left last, at the order above
        for k in range(self.order, -1, -1):
            gram = code[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            entry = self.cost[k].find(gram)
            context = self.leave[k].find(gram >> np.uint64(8))
            hit, known, came = entry >= 0, context >= 0, left >= 0
            # in the first known context, nothing is excluded yet
            out[todo[hit & ~came]] += self.cost[k].values["cost"][entry[hit & ~came]]
            out[todo[known & ~hit & ~came]] += self.leave[k].values["cost"][context[known & ~hit & ~came]]
            if k < self.order and came.any():
                above = self.leave[k + 1].values
                x = hit & came
                out[todo[x]] += above["whole"][left[x]] - self.cost[k].values["log"][entry[x]]
                x = ~hit & came & known
                out[todo[x]] += above["onward"][left[x]]
            left = np.where(known, context, left)[~hit]
            todo = todo[~hit]
        out[todo] += np.log10(self.novel)
        return out


#: The values of a table of entries and of one of contexts.
ENTRY, CONTEXT, WORD = {"cost": "<f4", "log": "<f4"}, {"cost": "<f4", "whole": "<f4", "onward": "<f4"}, {"n": "<i8"}


def _shard(suffix: int, top: tuple[np.ndarray, np.ndarray], low: list[tuple[np.ndarray, np.ndarray]], order: int) -> Trie:
    """The trie below the contexts that end with ``suffix`` (two bytes).

    All grams of a suffix are in ``top``, so orders 2 and up are whole sums; ``low`` has
    orders 0 and 1, at most 65,792 entries.
    """
    own = low[1][0] >> np.uint64(8) == suffix & 0xFF
    shorter = [_tally([(top[0] & np.uint64((1 << 8 * (k + 1)) - 1), top[1])]) for k in range(2, order)]
    return Trie([low[0], (low[1][0][own], low[1][1][own]), *shorter, top])


def _shards(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of equal (suffix, kind) of sorted batches with columns suffix, kind and ``of`` more: a run that goes on in the next batch comes in several parts."""
    for batch in batches:
        suffix, kind, *rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(of + 2))
        edges = np.flatnonzero((suffix[1:] != suffix[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(suffix)).tolist(), strict=True):
            if a < b:
                yield int(suffix[a]), int(kind[a]), [x[a:b] for x in rest]


def _built(order: int, low: list[tuple[np.ndarray, np.ndarray]]):
    """Entries and contexts of orders 2 and up, suffix by suffix, with their costs: (what, key, level, a, b, c); what: 2k for entries of order k, 2k + 1 for contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            top = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            trie = _shard(now, top, low, order)
            for k in range(2, order + 1):
                for part, (table, kinds) in enumerate(((trie.cost[k], ENTRY), (trie.leave[k], CONTEXT))):
                    level = np.empty(len(table.mixed), np.int32)
                    level[table.find(trie.keys[k][part])] = trie.levels[k][part]
                    none = np.zeros(len(level), np.float32)
                    values = [table.values.get(v, none) for v in kinds] + [none] * (3 - len(kinds))
                    for a in range(0, len(level), 50_000):
                        b = min(a + 50_000, len(level))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(b - a, 2 * k + part, np.int32)), pa.array(table.mixed[a:b].view(np.int64)), pa.array(level[a:b]), *(pa.array(v[a:b]) for v in values)], ["what", "key", "level", "a", "b", "c"]
                        )

        for suffix, _, (key, n) in _shards(batches, 2):
            if suffix != now and held:
                yield from out()
                held = []
            now = suffix
            held.append((key.view(np.uint64), n))
        if held:
            yield from out()

    return tidy(run)


def _written(uri: str, sizes: dict[int, int]):
    """Writes sorted rows (what, key, values...) as a table of files for each ``what``, -1 being the words; returns the folders of those it has written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        attempt = TaskContext.get().taskAttemptId()
        parts = _runs_of(batches)
        for what, own in parts:
            kinds = WORD if what < 0 else CONTEXT if what % 2 else ENTRY
            folder = f"{uri}/{what}-{attempt}"
            write_table(folder, sizes[what], (pa.RecordBatch.from_arrays(list(b.columns[1 : 2 + len(kinds)]) if what >= 0 else [b.column(1), b.column(5)], ["key", *kinds]) for b in own), kinds)
            yield pa.RecordBatch.from_arrays([pa.array([what], pa.int32()), pa.array([folder])], ["what", "folder"])

    return tidy(run)


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(what, its batches) of batches sorted by the first column."""

    def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            what = batch.column(0).to_numpy()
            edges = np.flatnonzero(what[1:] != what[:-1]) + 1
            for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(what)).tolist(), strict=True):
                if a < b:
                    yield int(what[a]), batch.slice(a, b - a)

    for what, own in groupby(parts(), lambda x: x[0]):
        yield what, (b for _, b in own)


def _priced(order: int, low: list[tuple[np.ndarray, np.ndarray]]):
    """The cost of each gram asked for; rows (suffix, asked, key, n) come sorted, counted grams before those asked for.  One suffix at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, held, trie = None, [], None
        for suffix, asked, (key, n) in _shards(batches, 2):
            if suffix != now:
                now, held, trie = suffix, [], None
            if not asked:
                held.append((key.view(np.uint64), n))
                continue
            if trie is None:
                top = tuple(np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                trie, held = _shard(now, top, low, order), []
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(trie.code_length(key.view(np.uint64)))], ["key", "cost"])

    return tidy(run)


def _by_suffix(rows: DataFrame) -> DataFrame:
    """rows (kind, key, n), by the last two context bytes of the key."""
    rows = rows.select(F.shiftright("key", 8).bitwiseAND(0xFFFF).cast("int").alias("suffix"), "kind", "key", "n")
    return rows.repartition("suffix").sortWithinPartitions("suffix", "kind")


def _costs(asked: DataFrame, counts: DataFrame, low: list[tuple[np.ndarray, np.ndarray]], order: int) -> DataFrame:
    """asked (key), counts (key, n): key and cost, as ``Trie.code_length`` of a trie of all counts has it."""
    rows = counts.select(F.lit(0).alias("kind"), "key", "n").union(asked.select(F.lit(1), "key", F.lit(0).cast("long")))
    return _by_suffix(rows).mapInArrow(_priced(order, low), "key long, cost double")


def _model(name: str, low: list[tuple[np.ndarray, np.ndarray]], order: int, tables: dict[int, tuple[str, int]]) -> tuple[Trie, Lookup]:
    def make() -> tuple[Trie, Lookup]:
        trie = Trie(low)
        trie.order = order
        for k in range(2, order + 1):
            trie.cost.append(_table(tables, 2 * k, ENTRY))
            trie.leave.append(_table(tables, 2 * k + 1, CONTEXT))
        # order 1 is no longer the top one, whose entries need no ``log``
        keys, n = low[1]
        trie.cost[1] = Lookup(keys, cost=trie.cost[1].values["cost"][trie.cost[1].find(keys)], log=np.log10(2 * n - 1).astype(np.float32))
        return trie, _table(tables, -1, WORD)

    return kept(("ppm", name), make)


def _table(tables: dict[int, tuple[str, int]], what: int, kinds: dict[str, str]) -> Lookup:
    if what in tables:
        return Lookup.opened(*tables[what], kinds)
    return Lookup(np.zeros(0, np.uint64), **{k: np.zeros(0, v) for k, v in kinds.items()})


def _score(model: tuple, order: int, modulus: int, total: int, distinct: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, table = _model(*model)
        norm = np.log10(total + 0.1 * (distinct + 1))
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            test = held_out(batch.column(0), modulus)
            for a, b, data, offsets in slices(batch.column(1), _SLICE):
                rows = b - a
                code, rows_at = grams(data, offsets, order)
                away = np.zeros(len(code), bool)
                score = -np.add.reduceat(trie.code_length(code, None if whole else away), rows_at[:-1])
                aways = np.zeros(rows + 1, np.int64)
                np.cumsum(np.add.reduceat(away.astype(np.int64), rows_at[:-1]), out=aways[1:])
                words, first = word_hashes(data, offsets)
                words = np.insert(words, first[1:], END_WORD)
                first = first + np.arange(rows + 1)
                found = table.find(words)
                hit = found >= 0
                n = np.where(hit, table.values["n"][found] if len(table.mixed) else 0, 0)
                base = np.add.reduceat(np.where(hit, np.log10(n + 0.1) - norm, 0.0), first[:-1])
                ends = np.zeros(rows + 1, np.int64)
                np.cumsum(np.add.reduceat(~hit, first[:-1]), out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + rows)),
                        batch.column(0).slice(a, rows),
                        pa.array(test[a:b]),
                        pa.array(np.diff(first)),
                        pa.array(np.add.reduceat(hit.astype(np.int64), first[:-1])),
                        pa.array(base),
                        pa.array(score),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words[~hit].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(aways.astype(np.int32)), pa.array(code[away].view(np.int64))),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "away"],
                )
                number += rows

    return tidy(run)


def _cutoff(sizes: DataFrame, most: int) -> int:
    """sizes (level, entries): the least power of two by which what is at that level or above has at most ``most`` entries."""
    level, kept = 62, 0
    for r in sizes.orderBy(F.desc("level")).collect():  # 64 rows at most
        if kept + r["entries"] > most:
            break
        kept, level = kept + r["entries"], r["level"]
    else:
        level = 0
    return 1 << level


def _cutoff(sizes: list[tuple[int, int]], most: int) -> int:
    """sizes (level, entries), in any order: the least level from which on there are at most ``most`` entries; 0 if all are."""
    found = Counter()
    for level, entries in sizes:
        found[level] += entries
    kept_, least = 0, max(found, default=-1) + 1
    for level in sorted(found, reverse=True):
        kept_ += found[level]
        if kept_ > most:
            return least
        least = level
    return 0


def _mixed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix64(batch.column(0).to_numpy().astype(np.uint64)).view(np.int64)), batch.column(1)], ["key", "n"])


def score(docs: DataFrame, order: int = 6, modulus: int = 10, most_entries: int = 16_000_000, most_words: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows whose crc32(doc_id) mod ``modulus`` is not 0.

    order: 2 to 7.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = dealt(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")))
    parts = texts.mapInArrow(_count(order, modulus), "kind int, key long, n long")
    counts = cut(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    top, words = counts.where("kind = 0"), counts.where("kind = 1").select("key", "n")

    def shorter(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Order 0 or 1: at most 65,536 rows."""
        found = top.groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
        return found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()

    low = [shorter(0), shorter(1)]
    trie = cut(_by_suffix(top).mapInArrow(_built(order, low), "what int, key long, level int, a float, b float, c float"), "trie")
    level = F.floor(F.log2("n")).cast("int").alias("level")
    sizes = trie.groupBy("what", "level").agg(F.count(F.lit(1)).alias("entries")).collect()  # 64 levels at most of each table
    least = _cutoff([(r["level"], r["entries"]) for r in sizes if r["what"] % 2 == 0], most_entries)
    word_sizes = words.groupBy(level).agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("n")).collect()
    total, distinct = sum(r["n"] for r in word_sizes), sum(r["entries"] for r in word_sizes)
    common = _cutoff([(r["level"], r["entries"]) for r in word_sizes], most_words)

    # the tables that the scoring tasks open: each one is streamed, sorted, through a task of its own
    kept_ = Counter({-1: sum(r["entries"] for r in word_sizes if r["level"] >= common)})
    for r in sizes:
        kept_[r["what"]] += r["entries"] * (r["level"] >= least)
    none = [F.lit(0.0).cast("float").alias(c) for c in "abc"]
    wanted = trie.where(F.col("level") >= least).select("what", "key", "a", "b", "c", F.lit(0).cast("long").alias("n"))
    wanted = wanted.union(words.where(F.col("n") >= 1 << common).mapInArrow(_mixed_words, "key long, n long").select(F.lit(-1).alias("what"), "key", *none, "n"))
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    rows = wanted.repartition(2 * order + 3, "what").sortWithinPartitions("what", unsigned)
    name = new_path(spark, "model")
    tables = {r["what"]: (r["folder"], kept_[r["what"]]) for r in cut(rows.mapInArrow(_written(name, dict(kept_)), "what int, folder string"), "tables").collect()}
    rows = cut(
        texts.mapInArrow(
            _score((name, low, order, tables), order, modulus, total, distinct, least == 0), "row long, doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, away array<long>"
        ),
        "scores",
    )
    rare = words.where(F.col("n") < 1 << common)
    norm = F.log10(F.lit(total + 0.1 * (distinct + 1)))
    tail = rows.select("row", F.explode("rare").alias("key")).join(rare, "key", "left")
    tail = tail.select("row", F.col("n").isNotNull().cast("long").alias("more"), (F.log10(F.coalesce("n", F.lit(0)) + 0.1) - norm).alias("rest"), F.lit(0.0).alias("cost"))
    if least > 0:
        away = rows.select("row", F.explode("away").alias("key"))
        costs = _costs(away.select("key").distinct(), top, low, order)
        tail = tail.union(away.join(costs, "key").select("row", F.lit(0).cast("long"), F.lit(0.0), "cost"))
    tail = tail.groupBy("row").agg(F.sum("more").alias("more"), F.sum("rest").alias("rest"), F.sum("cost").alias("cost"))
    return rows.join(tail, "row", "left").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") - F.coalesce("cost", F.lit(0.0))).alias("score"),
    )
