"""A read-only map from 64-bit keys to numbers, probed for whole arrays at once, in memory or in files of the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs

from .textcore import mix64


def _bits(n: int) -> int:
    return max(1, min(24, int(n).bit_length() - 1))


class Lookup:
    """Keys are mixed and sorted; the top bits of a mixed key say where its few candidates start."""

    def __init__(self, keys: np.ndarray, **values: np.ndarray):
        mixed = mix64(keys.astype(np.uint64, copy=True))
        order = np.argsort(mixed)
        self.mixed = mixed[order]
        self.values = {k: v[order] for k, v in values.items()}
        self.bits = _bits(len(keys))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.start = np.append(np.searchsorted(self.mixed, edges), len(keys)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)

    @classmethod
    def opened(cls, folder: str, n: int, kinds: dict[str, str]) -> Lookup:
        """What ``write_table`` has written to ``folder``: n keys with values of these kinds."""
        out = cls.__new__(cls)
        out.bits = _bits(n)
        out.mixed = _mapped(f"{folder}/key", "<u8")
        out.start = _mapped(f"{folder}/start", "<i8")
        out.values = {k: _mapped(f"{folder}/{k}", kind) for k, kind in kinds.items()}
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions in the values, -1 for keys that are absent."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.mixed) or not len(keys):
            return out
        want = mix64(keys.astype(np.uint64, copy=True))
        top = (want >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[top].astype(np.int64), self.start[top + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.mixed[at[live]] == want[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


def _mapped(uri: str, kind: str) -> np.ndarray:
    """The array in a file: mapped, so that the workers of a machine share it, where the folder is one of the machine's own; else read."""
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_file(path) as source:
        if not source.size():
            return np.zeros(0, kind)
        if urlparse(uri).scheme in ("", "file"):
            return np.memmap(unquote(urlparse(uri).path), kind, "r")
        return np.frombuffer(source.read(), kind)


def write_table(folder: str, n: int, batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> None:
    """Batches of (mixed key, values...), sorted by the unsigned key, to files of ``folder``; one batch is held at a time."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    bits = _bits(n)
    counts = np.zeros((1 << bits) + 1, np.int64)
    sinks = [where.open_output_stream(f"{path}/{name}") for name in ("key", *kinds)]
    for batch in batches:
        keys = batch.column(0).to_numpy().view(np.uint64)
        counts[1:] += np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        for sink, column, kind in zip(sinks, batch.columns, ("<u8", *kinds.values()), strict=True):
            values = column.to_numpy()
            sink.write((values.view(np.uint64) if kind == "<u8" else values.astype(kind)).tobytes())
    for sink in sinks:
        sink.close()
    with where.open_output_stream(f"{path}/start") as sink:
        sink.write(np.cumsum(counts).astype("<i8").tobytes())
