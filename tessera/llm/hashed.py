"""Hashed text features and the training samples of the two classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import Rolling, slices, words

#: Code points below this are lower-cased by table.
_CASED = 0x590
_LOWER = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(_CASED)], dtype=np.uint32)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points and their offsets by row."""
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return np.where(points < _CASED, _LOWER[np.minimum(points, _CASED - 1)], points), first[offsets]


#: Buckets have so many bits: hardly two n-grams of a corpus sample share one.
BITS = 30
_COARSE = 20


class Wanted:
    """Chosen buckets: a coarse table turns nearly all others away before the exact search."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = np.sort(buckets)
        self.coarse = np.zeros(1 << _COARSE, dtype=bool)
        self.coarse[self.buckets & ((1 << _COARSE) - 1)] = True

    def among(self, buckets: np.ndarray) -> np.ndarray:
        """Positions of the chosen ones."""
        at = np.flatnonzero(self.coarse[buckets & np.uint32((1 << _COARSE) - 1)])
        place = np.minimum(np.searchsorted(self.buckets, buckets[at]), max(len(self.buckets) - 1, 0))
        return at[self.buckets[place] == buckets[at]] if len(self.buckets) else at[:0]


def bucket_of(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def features(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], with_words: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bucket, first position, offsets of the rows, length) of all n-grams of the given orders, which may cross rows, and, if asked for, of all words."""
    points, where = code_points(data, offsets)
    h = np.zeros(len(points), dtype=np.uint32)
    for n in range(1, max(orders, default=0) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :]
        if n in orders:
            yield bucket_of(h + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)), np.arange(len(h)), where, n
    if with_words:
        a, b, first = words(data, offsets)
        yield (Rolling(data)(a, b) >> np.uint64(64 - BITS)).astype(np.uint32), np.arange(len(a)), first, 1


def present(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], with_words: bool, wanted: Wanted | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), each pair once; with `wanted` only chosen buckets."""
    keys = []
    for bucket, at, where, n in features(data, offsets, orders, with_words):
        if wanted is not None:
            at = wanted.among(bucket)
        row = np.searchsorted(where, at, side="right") - 1 if wanted is not None else np.repeat(np.arange(len(where) - 1), np.diff(where))[: len(at)]
        inside = at + n <= where[row + 1]
        keys.append((row[inside].astype(np.int64) << BITS) | bucket[at[inside]])
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def held_out(doc_id):
    """Rows that no model of this query has learned from; a null id is held out, too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: Column, keep, most: int) -> DataFrame:
    """(text, target) of about `most` labelled documents at the most, chosen by a hash of the id.

    The label side is counted first, so the share that is taken shrinks as labels grow and the sample's ids are few
    enough to broadcast. Rows without an id, a label or a text teach nothing and are left out. Several labels of one
    document stay several rows.
    """
    known = labels.select(F.col("doc_id").alias("_id"), target.cast("int").alias("target")).filter(F.col("_id").isNotNull() & F.col("target").isNotNull() & keep(F.col("_id")))
    share = most / max(known.count(), 1)
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "target")


def counts(sample: DataFrame, orders: tuple[int, ...], with_words: bool) -> DataFrame:
    """(bucket, target, n): in how many sample rows of a target each bucket is present."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text", 1 << 20):
            row, index = present(data, offsets, orders, with_words)
            key, n = np.unique((rows.column("target").to_numpy()[row].astype(np.int64) << BITS) | index, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key & ((1 << BITS) - 1), pa.int32()), pa.array(key >> BITS, pa.int32()), pa.array(n, pa.int64())], names=["bucket", "target", "n"])

    return sample.mapInArrow(run, "bucket int, target int, n long").groupBy("bucket", "target").agg(F.sum("n").alias("n"))


def strongest(by_target: DataFrame, strength: Column, targets: list[int], least: int, most: int) -> np.ndarray:
    """The `most` buckets of the highest strength, an expression over n_<target> and n, among those in `least` rows or more."""
    wide = by_target.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("target") == t, F.col("n"))), F.lit(0)).alias(f"n_{t}") for t in targets), F.sum("n").alias("n"))
    top = wide.filter(F.col("n") >= least).orderBy(strength.desc(), "bucket").limit(most).select("bucket")
    return np.sort(np.array([r.bucket for r in top.collect()], dtype=np.int64))


def lists(sample: DataFrame, buckets: np.ndarray, orders: tuple[int, ...], with_words: bool) -> DataFrame:
    """(target, features): which of the chosen buckets, by their place among them, each sample row has."""
    held = sample.sparkSession.sparkContext.broadcast(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(held.value)
        for rows, data, offsets in slices(batches, "text", 1 << 20):
            row, index = present(data, offsets, orders, with_words, wanted)
            where = np.searchsorted(row, np.arange(rows.num_rows + 1))
            got = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(np.searchsorted(held.value, index), pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("target"), got], names=["target", "features"])

    return sample.mapInArrow(run, "target int, features array<int>")


class Sample:
    """The training rows: presence of `size` features by row, and the targets."""

    def __init__(self, table: pa.Table, size: int):
        table = table.combine_chunks()
        self.target = table.column("target").to_numpy()
        features = table.column("features")
        self.row = np.repeat(np.arange(len(self.target)), pc.list_value_length(features).to_numpy())
        self.column = pc.list_flatten(features).to_numpy()
        self.size = size

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], minlength=len(self.target))

    def back(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, residual[self.row], minlength=self.size)


def descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero; gradient(x) gives the gradient at x."""
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sums(batches, column: str, orders: tuple[int, ...], with_words: bool, buckets: np.ndarray, weights: np.ndarray):
    """(rows, sum of the weights of all chosen buckets, in rising order, that are present in each row's text)."""
    wanted = Wanted(buckets)
    for rows, data, offsets in slices(batches, column, 1 << 20):
        row, bucket = present(data, offsets, orders, with_words, wanted)
        yield rows, np.bincount(row, weights[np.searchsorted(wanted.buckets, bucket)], minlength=rows.num_rows)
