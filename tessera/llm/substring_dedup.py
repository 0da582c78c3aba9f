"""Substring dedup: word windows that also start in an earlier document go, found in prefix-partitioned suffix trees.

The suffixes that enter trees are those at sampled words (about one of six): each window has one, its anchor, at a place
that depends on its words only. They are dealt out by a prefix of three words; prefixes that are frequent in the corpus
are lengthened to the whole window, so every group fits into one task's memory. The suffixes of a group in their order,
with the number of words that neighbours share, are its suffix tree: an inner node is a stretch of suffixes between
which no fewer words are shared. A window that starts k words before the anchor repeats (as a part of some maximal
repeat) where suffixes meet in a node of 13 - k words or deeper and have the k words before in common; its smallest
document decides.

Defined results: columns named like the new ones are replaced; null texts have no words; a null doc_id counts as larger than all others; rows with one doc_id are
no earlier documents for each other; texts shorter than a window stay whole; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.frames import shield, unshield
from tessera.llm.repeats import Bodies, Kind, alone, expanded, gone_mask, with_spans

WINDOW = 13
KIND = Kind(by_words=True, length=WINDOW, gram=3, split=1, by_order=True, growth=3.6)


def numbered(b: Bodies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of the bodies as numbers (equal words, equal numbers), the first word of each body, and how many it has."""
    data = np.frombuffer(b.text, dtype=np.uint8)
    ends = np.flatnonzero(data == 32) + 1
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    number = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(b.text)).dictionary_encode().indices.to_numpy().astype(np.int64)
    edges = np.searchsorted(ends, np.cumsum(b.size)) + 1
    first = np.concatenate(([0], edges[:-1]))
    return number, first, edges - first


def depths(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes (rows of `words`, beyond their end -1) in the tree of their key, and how many words each shares with the one before: the depth of the inner node that parts them (-1: another tree)."""
    order = np.lexsort((*words.T[::-1], key))
    same = words[order][1:] == words[order][:-1]
    shared = np.cumprod(same & (words[order][1:] >= 0), axis=1).sum(axis=1)
    shared[key[order][1:] != key[order][:-1]] = -1
    return order, np.concatenate(([-1], shared))


def nodes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """By suffix the node of the tree in which it is `depth` words deep: suffixes with no inner node of less depth between them."""
    node = np.empty(len(order), dtype=np.int64)
    node[order] = np.cumsum(shared < depth)
    return node


def solve(b: Bodies) -> tuple[np.ndarray, np.ndarray]:
    """By body the number of windows and, for each, the smallest id that has it."""
    number, first, n = numbered(b)
    count = n - WINDOW + 1
    base = np.cumsum(count) - count
    least = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(least, b.body, b.id)
    out = np.repeat(least, count)
    prefix = number[first + b.anchor]
    for k in range(1, KIND.gram):
        prefix = np.unique(prefix * (number.max() + 1) + number[first + b.anchor + k], return_inverse=True)[1]
    some = np.flatnonzero(~alone(prefix))
    if not len(some):
        return count, out
    first, n, anchor, least, base = first[some], n[some], b.anchor[some], least[some], base[some]
    key = np.unique(prefix[some], return_inverse=True)[1]
    ahead, behind = anchor[:, None] + np.arange(WINDOW), anchor[:, None] - 1 - np.arange(WINDOW - 1)
    right = np.where(ahead < n[:, None], number[np.minimum(first[:, None] + ahead, len(number) - 1)], -1)
    left = np.where(behind >= 0, number[np.maximum(first[:, None] + behind, 0)], -1)
    order, shared = depths(key, right)
    # A window that starts k words before the anchor repeats if node and k words on the left are the same.
    past = key
    for k in range(WINDOW - KIND.gram + 1):
        if k:
            past = np.unique(past * (number.max() + 2) + left[:, k - 1] + 1, return_inverse=True)[1]
        has = np.flatnonzero((anchor >= k) & (anchor - k + WINDOW <= n))
        if not len(has):
            continue
        node = nodes(order, shared, WINDOW - k)[has]
        class_ = np.unique(node * len(key) + past[has], return_inverse=True)[1]
        smallest = np.full(class_.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, class_, least[has])
        out[base[has] + anchor[has] - k] = smallest[class_]
    return count, out


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns of docs, text reduced to the kept words joined by one space where words went (and as it was elsewhere), with n_words, n_removed and kept_sha256 (of the kept words joined by one space)."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    original, docs = docs.columns, shield(docs, "doc_id", "text")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                rows = whole.slice(at, 512)
                gone, texts, facts = rows.column("gone"), [], ([], [], [])
                for k, text in enumerate(expanded(rows.column("text"))):
                    some = (text or b"").split()
                    mask = gone_mask(gone, k, len(some))
                    kept = some if mask is None else [w for w, g in zip(some, mask.tolist(), strict=True) if not g]
                    joined = b" ".join(kept)
                    texts.append(text if mask is None else joined)
                    for f, x in zip(facts, (len(some), len(some) - len(kept), hashlib.sha256(joined).hexdigest()), strict=True):
                        f.append(x)
                columns = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else rows.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(facts[0], pa.int64()), pa.array(facts[1], pa.int64()), pa.array(facts[2])], names=schema.names)

    return unshield(with_spans(docs, KIND, solve).select(*names, "gone").mapInArrow(run, schema), original, "n_words", "n_removed", "kept_sha256")


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM d),
k AS (SELECT doc_id, p, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k, count(*) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM x),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) < doc_id AS gone FROM k WHERE n = 13),
g AS (SELECT x.doc_id, x.p, x.w, coalesce(bool_or(f.gone) OVER (PARTITION BY x.doc_id ORDER BY x.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM x LEFT JOIN f ON x.doc_id = f.doc_id AND x.p = f.p),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
