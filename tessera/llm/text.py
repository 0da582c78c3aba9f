"""Shared kernels for texts that arrive in Arrow batches: word spans, rolling hashes, sliding minima.

All of them work on one slice of a batch at a time, so memory follows the slice and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The six ASCII white-space bytes that separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: The same rule as a regular expression for Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a multiply-and-shift finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any segment of an integer sequence from one running sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of about `most` bytes of text: (rows, bytes, offsets); a null text is empty."""
    for batch in batches:
        texts = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(texts):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            part = texts.slice(at, to - at)
            data = b"".join(x.as_buffer() for x in part if x.is_valid) if part.null_count else _bytes(part)
            yield batch.slice(at, to - at), np.frombuffer(data, dtype=np.uint8), np.concatenate(([0], ends[at:to] - done))
            at = to


def _bytes(texts: pa.Array) -> memoryview:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    where = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1]
    return memoryview(data)[where[0] : where[-1]] if data is not None else memoryview(b"")


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each row's first word (one more entry closes the last)."""
    inside = ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    starts[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:-1]
    last = last[last > 0] - 1
    ends[last] = inside[last]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return a, b, np.searchsorted(a, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by running minima over blocks from both sides."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values
    pad = -len(values) % width
    blocks = np.concatenate((values, np.full(pad, np.iinfo(values.dtype).max, dtype=values.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of the ranges that begin at starts and hold sizes numbers, one range after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
