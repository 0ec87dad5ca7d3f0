"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct words (runs of letters, digits and other
characters without the ASCII punctuation around them, lower-cased) and the
first 3 to 6 bytes of each, hashed into 2**``bits`` places; the value of a term
is its presence, so one insult counts the same in a short and in a long text.
The score is sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>): the pair term gives
weight to terms that are harmful, or harmless, only together.

Training.  At most ``train_rows`` labelled rows (default 12,000: those with the
least hash of their id; a bound, so that the fit is one task of known size)
of those whose crc32(doc_id) mod 5 is not 0.  The machine's inputs are the
``width`` places whose presence separates the classes best by itself
(likelihood-ratio statistic), and the places of pairs that tell more together
than the two do alone, even if each alone tells nothing: all pairs of the
``pairs`` places (default 2,048) whose presence varies most are looked at, and
up to ``width`` / 16 places come in for their pairs.
The others have weight 0: with every place as an input, held-out toxic rows of
sf0.1 are missed six times as often.  Then AdaGrad over shuffled mini-batches,
fixed seed, with rows of the rarer class weighted up to a half.

Defined results: null and blank texts score the bias alone; rows without an id
or a label are never learnt from; repeated labels of an id count as their
maximum; without labelled rows of both classes every score is the (smoothed)
share of class 1.  A very long text is worked on by itself and gives its terms
once; repeated rows get the same score; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are not looked at, whatever their names.
Only the text enters a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dealt, ship_package
from .textcore import _BASE, _INV, _VALUE, WS, _power, mix64, release, slices, tidy

PREFIXES = (3, 4, 5, 6)
FACTORS = 4
_SLICE = 1 << 18  # bytes of text at a time: a slice's terms take some hundred times as much

# ASCII characters that are no letter or digit stand between terms, as white space does
_BETWEEN = WS.copy()
_BETWEEN[[i for i in range(128) if not chr(i).isalnum()]] = True
_TERM_VALUE = np.where(_BETWEEN, np.uint64(0), _VALUE)


def terms(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashed terms, and the row offsets."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    inside = ~_BETWEEN[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begins[cut] = inside[cut]
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = inside
    stops[1:-1] &= begins[1:] | ~inside[1:]
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_TERM_VALUE[data], _power("up", _BASE, len(data)), out=sums[1:])
    np.cumsum(sums, out=sums)
    down = _power("down", _INV, len(data))[begins]
    row = np.searchsorted(offsets, begins, "right") - 1
    # distinct words of each row first
    whole = mix64((sums[stops] - sums[begins]) * down)
    key = (whole >> np.uint64(64 - 40)) | (row.astype(np.uint64) << np.uint64(40))
    order = np.unique(key, return_index=True)[1]
    begins, stops, down, row, whole = begins[order], stops[order], down[order], row[order], whole[order]
    found, owner = [whole >> np.uint64(64 - bits)], [row]
    for p in PREFIXES:
        long = stops - begins > p
        start = begins[long]
        found.append(mix64((sums[start + p] - sums[start]) * down[long] + np.uint64(p)) >> np.uint64(64 - bits))
        owner.append(row[long])
    both = np.unique(np.concatenate(found) | (np.concatenate(owner).astype(np.uint64) << np.uint64(bits)))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(both, np.arange(rows + 1, dtype=np.uint64) << np.uint64(bits))


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2), _SLICE):
                found, at = terms(data, offsets, bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32)))], ["doc_id", "label", "terms"]
                )

    return tidy(run)


def _statistic(cells: list[tuple[np.ndarray, np.ndarray]], share: float) -> np.ndarray:
    """Likelihood-ratio statistic of (rows, those of class 1) of each cell against the share of class 1."""
    out = 0.0
    for n, one in cells:
        for part, expected in ((one, n * share), (n - one, n * (1 - share))):
            out = out + 2 * part * np.log(np.where(part > 0, part, 1) / np.maximum(expected, 1e-9))
    return out


def _single(found: np.ndarray, row: np.ndarray, label: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that three rows have, and their statistic of presence against label."""
    one = np.bincount(found[label[row] == 1], minlength=1 << bits).astype(float)
    both = np.bincount(found, minlength=1 << bits).astype(float)
    n, n1 = len(label), label.sum()
    place = np.flatnonzero(both >= 3)
    a, t = one[place], both[place]
    return place, _statistic([(t, a), (n - t, n1 - a)], n1 / n)


def _paired(found: np.ndarray, row: np.ndarray, label: np.ndarray, place: np.ndarray, alone: np.ndarray, most: int, gain: float = 50.0) -> np.ndarray:
    """Gain of each place's best pair among the ``most`` places of most varied presence, where it is above ``gain`` (50: p below 1e-3 over all pairs); else 0."""
    n, n1 = len(label), int(label.sum())
    count = np.bincount(found, minlength=int(place[-1]) + 1 if len(place) else 1)[place]
    top = np.sort(np.lexsort((place, -(count * (n - count))))[:most])
    k, out = len(top), np.zeros(len(place))
    column = np.full(int(found.max(initial=0)) + 1, -1)
    column[place[top]] = np.arange(k)
    use = column[found] >= 0
    r, c = row[use], column[found[use]]
    at = np.searchsorted(r, np.arange(0, n + 512, 512))
    both, ones = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        x = np.zeros((512, k), np.float32)
        x[r[a:b] - 512 * i, c[a:b]] = 1
        both += x.T @ x
        x = x[: min(512, n - 512 * i)][label[512 * i : 512 * i + 512] == 1]
        ones += x.T @ x
    t, t1 = np.diag(both).astype(float), np.diag(ones).astype(float)
    for a in range(0, k, 128):
        b = min(a + 128, k)
        n11, o11 = both[a:b].astype(float), ones[a:b].astype(float)
        n10, o10, n01, o01 = t[a:b, None] - n11, t1[a:b, None] - o11, t - n11, t1 - o11
        cells = [(n11, o11), (n10, o10), (n01, o01), (n - n11 - n10 - n01, n1 - o11 - o10 - o01)]
        more = _statistic(cells, n1 / n) - alone[top[a:b], None] - alone[top]
        out[top[a:b]] = more.max(1)
    return np.where(out > gain, out, 0.0)


def _select(found: np.ndarray, row: np.ndarray, label: np.ndarray, bits: int, width: int, pairs: int) -> np.ndarray:
    """Up to ``width`` places that tell most about the label by themselves, and a sixteenth as many that do so in a pair."""
    place, alone = _single(found, row, label, bits)
    alone_ = np.where(alone > 12, alone, 0.0)  # 12: p below 0.001
    best = np.lexsort((place, -alone_))[:width]
    chosen = place[best[alone_[best] > 0]]
    if len(place) and pairs:
        gain = _paired(found, row, label, place, alone, pairs)
        best = np.lexsort((place, -gain))[: width // 16]
        chosen = np.append(chosen, place[best[gain[best] > 0]])
    return np.unique(chosen)


def fit(label: np.ndarray, found: np.ndarray, at: np.ndarray, bits: int, width: int, pairs: int = 2048, epochs: int = 25, seed: int = 5) -> dict:
    """places (ascending), w, v, b."""
    n, n1 = len(label), int(label.sum())
    model = {"places": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros((0, FACTORS)), "b": float(np.log((n1 + 0.5) / (n - n1 + 1.5)))}
    if not 0 < n1 < n:
        return model
    row = np.repeat(np.arange(n), np.diff(at))
    places = _select(found, row, label, bits, width, pairs)
    slot = np.full(1 << bits, -1, np.int64)
    slot[places] = np.arange(len(places))
    used = slot[found] >= 0
    x, row = slot[found[used]], row[used]
    at = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(places)), rng.normal(0, 0.02, (len(places), FACTORS)), model["b"]
    gw, gv, gb = np.full(len(places), 1e-2), np.full((len(places), FACTORS), 1e-2), 1e-2
    share = np.where(label == 1, min(0.5 * n / n1, 10), 1.0)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // 256)):
            length = at[part + 1] - at[part]
            own = np.repeat(np.arange(len(part)), length)
            i = x[np.repeat(at[part] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())]
            summed = np.stack([np.bincount(own, v[i, f], len(part)) for f in range(FACTORS)], 1)
            square = np.bincount(own, (v[i] ** 2).sum(1), len(part))
            z = b + np.bincount(own, w[i], len(part)) + 0.5 * ((summed**2).sum(1) - square)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) * share[part] / len(part)
            dw = np.bincount(i, error[own], len(w)) + 1e-5 * w
            dv = np.stack([np.bincount(i, error[own] * (summed[own, f] - v[i, f]), len(w)) for f in range(FACTORS)], 1) + 1e-5 * v
            db = error.sum()
            gw += dw**2
            gv += dv**2
            gb += db**2
            w -= 0.2 * dw / np.sqrt(gw)
            v -= 0.05 * dv / np.sqrt(gv)
            b -= 0.2 * db / np.sqrt(gb)
    return {"places": places, "w": w, "v": v, "b": float(b)}


def _fit(bits: int, width: int, pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int32()))]))
        if table.num_rows:
            table = table.sort_by("doc_id")
            lists = table.column("terms").combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            at = lists.offsets.to_numpy()
            m = fit(table.column("label").to_numpy().astype(int), lists.values.to_numpy()[at[0] : at[-1]].astype(np.int64), at - at[0], bits, width, pairs)
        else:
            m = fit(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(1, np.int64), bits, width, pairs)
        flat = np.concatenate([[m["b"]], m["w"], m["v"].ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([m["places"].tolist()], pa.list_(pa.int64())), pa.array([flat.tolist()], pa.list_(pa.float64()))], ["places", "weights"])

    return tidy(run)


def train(docs: DataFrame, labels: DataFrame, bits: int = 20, width: int = 4096, pairs: int = 2048, train_rows: int = 12_000, modulus: int = 5) -> dict:
    """The machine for ``score``: a few hundred kilobytes at most."""
    ship_package(docs.sparkSession)
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(F.crc32(F.col("doc_id").cast("string")) % modulus != 0)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = texts.join(F.broadcast(rows), "doc_id").select("doc_id", "label", "text").mapInArrow(_features(bits), "doc_id long, label int, terms array<int>")
    found = seen.repartition(1).mapInArrow(_fit(bits, width, pairs), "places array<long>, weights array<double>").first()
    places, flat = np.array(found["places"], np.int64), np.array(found["weights"])
    n = len(places)
    return {"bits": bits, "places": places, "b": flat[0], "w": flat[1 : n + 1], "v": flat[n + 1 :].reshape(n, FACTORS)}


def _scored(model: dict, batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their scores."""
    release()
    bits, w, v = model["bits"], model["w"], model["v"]
    slot = np.full(1 << bits, -1, np.int32)
    slot[model["places"]] = np.arange(len(w))
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(text_at), _SLICE):
            rows = b - a
            found, at = terms(data, offsets, bits)
            owner = np.repeat(np.arange(rows), np.diff(at))
            i = slot[found]
            owner, i = owner[i >= 0], i[i >= 0]
            summed = np.stack([np.bincount(owner, v[i, f], rows) for f in range(FACTORS)], 1)
            z = model["b"] + np.bincount(owner, w[i], rows) + 0.5 * ((summed**2).sum(1) - np.bincount(owner, (v[i] ** 2).sum(1), rows))
            yield batch.slice(a, rows), 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _score(model: dict, modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(model, batches, 1):
            test = [i is not None and zlib.crc32(str(i).encode()) % modulus == 0 for i in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(test, pa.bool_()), pa.array(found)], ["doc_id", "held_out", "score"])

    return tidy(run)


def _keep(model: dict, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(model, batches, text_at):
            yield part.filter(pa.array(found < 0.5))

    return tidy(run)


def score(docs: DataFrame, model: dict, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    ship_package(docs.sparkSession)
    texts = dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return texts.mapInArrow(_score(model, modulus), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs``, unchanged, whose ``text`` scores below 0.5."""
    ship_package(docs.sparkSession)
    return dealt(docs).mapInArrow(_keep(model, docs.columns.index("text")), docs.schema)
