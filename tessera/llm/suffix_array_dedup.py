"""Suffix-array dedup: byte strings of a minimum length that stand anywhere else go.

The bodies of one anchor group are one text. Its Burrows-Wheeler transform is searched breadth-first by backward
extension: from the intervals of strings of one length come those of all strings one byte longer, and every interval
that ends at a boundary not seen before sets this boundary's common prefix. Common prefixes appear in rising order, so
the search stops at the minimum length; suffixes that no boundary parts by then share that many bytes.

Defined results: columns named like the new ones are replaced; null texts are empty; matches never cross documents; overlapping occurrences and those in one
document count; repeated rows are occurrences of their own; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.frames import shield, unshield
from tessera.llm.repeats import Bodies, Kind, alone, expanded, gone_mask, with_spans
from tessera.llm.text import Rolling, spread

LENGTH = 400
KIND = Kind(by_words=False, length=LENGTH, gram=32, split=64, by_order=False, growth=3.7)
#: Bytes of bodies that are transformed at once.
TEXT = 1 << 20
_PACK = 7


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` symbols at least, by prefix doubling, and the packed first seven symbols of each place."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(_PACK, dtype=text.dtype))).astype(np.int64)
    packed = np.zeros(n, dtype=np.int64)
    for k in range(_PACK):
        packed = (packed << 9) | padded[k : k + n]
    rank, have = np.unique(packed, return_inverse=True)[1], _PACK
    while have < depth and rank.max() < n - 1:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - have] = rank[have:] + 1
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1]
        have *= 2
    return np.argsort(rank, kind="stable"), packed


def parted(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of a text (0 ends each body), and which places of it begin a new class: `length` symbols not shared with the suffix before."""
    order, packed = suffix_order(text, length)
    n = len(text)
    where = np.empty(n, dtype=np.int64)
    where[order] = np.arange(n)
    last = text[order - 1]
    back = where[order - 1]
    first = packed[order]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = first[1:] != first[:-1]
    depth = min(_PACK, length)
    if depth < _PACK:
        edge[1:n] = (first[1:] >> 9 * (_PACK - depth)) != (first[:-1] >> 9 * (_PACK - depth))
        return order, edge[:n]
    all_edges = np.flatnonzero(edge)
    fresh = np.flatnonzero(edge[1:n] & ((first[1:] >> 9) == (first[:-1] >> 9))) + 1
    high = fresh - 1
    low = all_edges[np.searchsorted(all_edges, high, side="right") - 1]
    for _ in range(depth + 1, length + 1):
        if not len(low):
            break
        size = high - low + 1
        rows = spread(low, size)
        key = np.repeat(np.arange(len(low)) << 9, size) | last[rows]
        if len(rows) > len(low):
            by = np.argsort(key, kind="stable")
            rows, key = rows[by], key[by]
        begins = np.ones(len(rows), dtype=bool)
        begins[1:] = key[1:] != key[:-1]
        begins = np.flatnonzero(begins)
        # The sorted suffixes are compared no further than needed, so equal ones may stand in any order: take the bounds.
        a, b = np.minimum.reduceat(back[rows], begins), np.maximum.reduceat(back[rows], begins)
        good = ((key[begins] & 511) != 0) & ~edge[b + 1]
        low, high = a[good], b[good]
        edge[high + 1] = True
    return order, edge[:n]


def recurring(b: Bodies, some: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Those bodies in which the hash of a window recurs: others cannot hold a repeated window and need no transform."""
    joined = np.frombuffer(b"".join([b.text[x:y] for x, y in zip(start[some].tolist(), (start + b.size)[some].tolist(), strict=True)]), dtype=np.uint8)
    at = spread(np.cumsum(b.size[some]) - b.size[some], count[some])
    body = np.repeat(np.arange(len(some)), count[some])
    h = np.sort(hashes := Rolling(joined)(at, at + LENGTH))
    twice = h[1:][h[1:] == h[:-1]]
    return some[np.unique(body[np.isin(hashes, twice)])]


def solve(b: Bodies) -> tuple[np.ndarray, np.ndarray]:
    """By body the number of windows and, for each, whether it occurs twice."""
    count = b.size - LENGTH + 1
    out = np.repeat(b.twice, count)
    base, start = np.cumsum(count) - count, np.cumsum(b.size) - b.size
    order = np.argsort(b.key, kind="stable")
    order = order[~alone(b.key)[order]]
    ends = np.flatnonzero(np.diff(b.key[order]) != 0) + 1
    # Groups of one key, as many as fill a text, are transformed at once.
    full = np.cumsum(b.size[order])
    at = 0
    while at < len(order):
        to = min(int(np.searchsorted(full, (full[at - 1] if at else 0) + TEXT)), len(order) - 1)
        k = np.searchsorted(ends, to, side="right")
        to = int(ends[k]) if k < len(ends) else len(order)
        some = recurring(b, order[at:to], start, count)
        at = to
        if not len(some):
            continue
        raw = np.frombuffer(b"".join([b.text[x:y] + b"\0" for x, y in zip(start[some].tolist(), (start + b.size)[some].tolist(), strict=True)]), dtype=np.uint8)
        text = raw.astype(np.int64) + 1
        close = np.cumsum(b.size[some] + 1) - 1
        text[close] = 0
        suffixes, edge = parted(text, LENGTH)
        group = np.empty(len(text), dtype=np.int64)
        group[suffixes] = np.cumsum(edge) - 1
        group = group[spread(close - b.size[some], count[some])]
        weight = np.repeat(1 + b.twice[some], count[some])
        out[spread(base[some], count[some])] = np.bincount(group, weight)[group] > 1
    return count, out


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns of docs, with kept (binary: the remaining bytes), n_bytes, n_removed and n_spans."""
    added = [T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))]
    original, docs = docs.columns, shield(docs, "doc_id", "text")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                rows = whole.slice(at, 512)
                gone, out, texts = rows.column("gone"), ([], [], [], []), list(expanded(rows.column("text")))
                for k, text in enumerate(texts):
                    raw = text or b""
                    mask = gone_mask(gone, k, len(raw))
                    if mask is None:
                        row = raw, len(raw), 0, 0
                    else:
                        row = np.frombuffer(raw, dtype=np.uint8)[~mask].tobytes(), len(raw), int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else rows.column(n) for n in names), pa.array(out[0], pa.binary()), *(pa.array(o, pa.int64()) for o in out[1:])], names=schema.names)

    return unshield(with_spans(docs, KIND, solve).select(*names, "gone").mapInArrow(run, schema), original, "kept", "n_bytes", "n_removed", "n_spans")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    return deduplicated(docs.select("doc_id", "text")).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as kept_sha256")
