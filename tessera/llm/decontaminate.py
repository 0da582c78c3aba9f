"""Benchmark decontamination: BM25 retrieval with block-max WAND bounds, then a check of question and answer.

The index holds the test items; every passage of every document queries it. Impacts are divided by the item's score
for itself, so a score is the share of the item's weight that the passage holds, and all items at THRESHOLD or more
are retrieved. As in WAND an item is looked at only if terms it cannot reach the threshold without occur, and a block
of items only if the block's maxima allow it; no item over the threshold is missed. A retrieved item counts as leaked
if enough word n-grams of both its question and its answer stand in the passage.

Items are indexed in blocks of about ITEM_BYTES of text; each block is broadcast and queried in a pass of its own.

Defined results: null or empty texts match nothing; items without an id or without words are left out; repeated
documents with one id are reported once with their best score; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.frames import cut
from tessera.llm.text import Rolling, slices, spread

THRESHOLD = 0.6
MIN_OVERLAP = 0.5
GRAM = 5
K1, B = 1.2, 0.75
ITEM_BYTES = 4 << 20
#: Items in a block of the index that shares its maxima.
BLOCK = 16

#: Bytes of words: ASCII letters and digits and everything beyond ASCII.
_INSIDE = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
#: Capitals of two bytes in UTF-8: the first byte, the range of the second, and what is added to both.
_CAPITALS = [(0xC3, 0x80, 0x96, 0, 32), (0xC3, 0x98, 0x9E, 0, 32), (0xCE, 0x91, 0x9F, 0, 32), (0xCE, 0xA0, 0xA9, 1, -32), (0xD0, 0x90, 0x9F, 0, 32), (0xD0, 0xA0, 0xAF, 1, -32), (0xD0, 0x80, 0x8F, 1, 16)]
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words without case (ASCII, Latin-1, Greek, Cyrillic), and the index of each row's first word."""
    data = _LOWER[data]
    for lead, low, high, more_lead, more in _CAPITALS:
        at = np.flatnonzero(data[:-1] == lead)
        at = at[(data[at + 1] >= low) & (data[at + 1] <= high)]
        data[at] += more_lead
        data[at + 1] = data[at + 1].astype(np.int64) + more
    inside = _INSIDE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge], ends[edge - 1] = inside[edge], inside[edge - 1]
    a = np.flatnonzero(starts)
    return Rolling(data)(a, np.flatnonzero(ends) + 1).view(np.int64), np.searchsorted(a, offsets)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    at = np.arange(max(len(words) - n + 1, 0))
    return Rolling(words.view(np.uint64))(at, at + n)


def item_words(items: DataFrame) -> DataFrame:
    """(item, words, n_question): the word hashes of question and answer, from items of (item, question, answer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [terms(d, o) for c in ("question", "answer") for _, d, o in slices([batch], c, 1 << 40)]
            (q, qs), (a, as_) = got
            words = [np.concatenate((q[qs[k] : qs[k + 1]], a[as_[k] : as_[k + 1]])).tolist() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(words, pa.list_(pa.int64())), pa.array(np.diff(qs), pa.int32())], names=["item", "words", "n_question"])

    return items.mapInArrow(run, "item long, words array<long>, n_question int").filter("size(words) > 0")


class Index:
    """One block of items with impacts, maxima by block and the n-grams for the check."""

    def __init__(self, rows, idf: dict[int, float], mean_length: float):
        self.items = np.array([r["item"] for r in rows], dtype=np.int64)
        self.parts = [(np.array(r["words"][: r["n_question"]], dtype=np.int64), np.array(r["words"][r["n_question"] :], dtype=np.int64)) for r in rows]
        self.longest = max(len(r["words"]) for r in rows)
        vocabulary = np.unique(np.concatenate([np.array(r["words"], dtype=np.int64) for r in rows]))
        self.vocabulary = vocabulary
        item, term, impact = [], [], []
        for k, r in enumerate(rows):
            words = np.array(r["words"], dtype=np.int64)
            t, tf = np.unique(words, return_counts=True)
            w = np.array([idf[x] for x in t.tolist()]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
            item.append(np.full(len(t), k))
            term.append(np.searchsorted(vocabulary, t))
            impact.append(w / w.sum())
        self.item, self.term, self.impact = (np.concatenate(x) for x in (item, term, impact))
        self.item_first = np.searchsorted(self.item, np.arange(len(rows) + 1))
        frequency = np.bincount(self.term, minlength=len(vocabulary))
        # Dispensable terms of an item are its commonest ones, as long as all of them together stay under the threshold.
        order = np.lexsort((self.impact, -frequency[self.term], self.item))
        total = np.cumsum(self.impact[order])
        total -= np.repeat(np.concatenate(([0.0], total))[self.item_first[:-1]], np.diff(self.item_first))
        dispensable = np.zeros(len(order), dtype=bool)
        dispensable[order] = total < THRESHOLD - 1e-9
        self.rest = np.bincount(self.item[dispensable], self.impact[dispensable], minlength=len(rows))
        need = np.flatnonzero(~dispensable)
        need = need[np.argsort(self.term[need], kind="stable")]
        self.need_item, self.need_impact = self.item[need], self.impact[need]
        self.need_first = np.searchsorted(self.term[need], np.arange(len(vocabulary) + 1))
        block = self.item // BLOCK
        self.block_rest = np.zeros(block.max() + 1)
        np.maximum.at(self.block_rest, np.arange(len(rows)) // BLOCK, self.rest)
        keys, where = np.unique(self.term[need] * (block.max() + 1) + block[need], return_inverse=True)
        self.block_of, self.block_max = keys % (block.max() + 1), np.zeros(len(keys))
        np.maximum.at(self.block_max, where, self.need_impact)
        self.block_first = np.searchsorted(keys // (block.max() + 1), np.arange(len(vocabulary) + 1))
        self.term_max = np.zeros(len(vocabulary))
        np.maximum.at(self.term_max, self.term, self.impact)

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, item, score) of all passages and items at the threshold or above; passages are 2 * longest words, one begins every `longest` words."""
        step = self.longest
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == words)
        row = np.searchsorted(first, known, side="right") - 1
        piece_first = np.concatenate(([0], np.cumsum(-(-np.diff(first) // step))))
        piece = piece_first[row] + (known - first[row]) // step
        size = len(self.vocabulary)
        # A word lies in the passage that begins in its own piece and in the one before, if that is of the same row.
        before = piece > piece_first[row]
        pairs = np.unique(np.concatenate((piece * size + at[known], (piece[before] - 1) * size + at[known][before])))
        passage, term = pairs // size, pairs % size
        bound = np.bincount(passage, self.term_max[term], minlength=piece_first[-1] + 1)
        some = bound[passage] >= THRESHOLD - 1e-9
        p, t = passage[some], term[some]
        n_blocks = len(self.block_rest)
        width = self.block_first[t + 1] - self.block_first[t]
        e = spread(self.block_first[t], width)
        key, where = np.unique(np.repeat(p, width) * n_blocks + self.block_of[e], return_inverse=True)
        good = np.bincount(where, self.block_max[e], minlength=len(key)) + self.block_rest[key % n_blocks] >= THRESHOLD - 1e-9
        key = key[good]
        width = self.need_first[t + 1] - self.need_first[t]
        e = spread(self.need_first[t], width)
        rp = np.repeat(p, width)
        mine = _in(key, rp * n_blocks + self.need_item[e] // BLOCK)
        e, rp = e[mine], rp[mine]
        n = len(self.items)
        key, where = np.unique(rp * n + self.need_item[e], return_inverse=True)
        key = key[np.bincount(where, self.need_impact[e], minlength=len(key)) + self.rest[key % n] >= THRESHOLD - 1e-9]
        p, i = key // n, key % n
        width = self.item_first[i + 1] - self.item_first[i]
        e = spread(self.item_first[i], width)
        hit = _in(pairs, np.repeat(p, width) * size + self.term[e])
        score = np.bincount(np.repeat(np.arange(len(key)), width), self.impact[e] * hit, minlength=len(key))
        good = score >= THRESHOLD - 1e-9
        p, i, score = p[good], i[good], score[good]
        row = np.searchsorted(piece_first, p, side="right") - 1
        return row, first[row] + (p - piece_first[row]) * step, i, score

    def overlap(self, passage: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the question's and of the answer's n-grams that the passage holds; a part without words is held."""
        out = []
        for part in self.parts[item]:
            n = min(GRAM, len(part))
            out.append(float(np.isin(grams(part, n), grams(passage, n)).mean()) if n else 1.0)
        return out[0], out[1]


def _in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted


def split_answer(benchmark: DataFrame) -> DataFrame:
    """item, question and answer from item_id and text: the answer is the last sentence if there are several."""
    text = F.coalesce("text", F.lit(""))
    pattern = r"(?s)^(.*[.!?])\s+(\S.*)$"
    return benchmark.filter("item_id is not null").select(
        F.col("item_id").cast("long").alias("item"), F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text).alias("question"), F.regexp_extract(text, pattern, 2).alias("answer")
    )


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item, score, question_overlap, answer_overlap, leaked) of all retrieved pairs of a document and an item (the passage with the best overlaps)."""
    words = item_words(items)
    total = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.sum(F.size("words")).alias("words")).first()
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL("item long, score double, question_overlap double, answer_overlap double").fields])
    parts = []
    blocks = max(1, -(-(total.words or 0) * 8 // ITEM_BYTES))
    frequency = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for block in range(blocks):
        mine = words.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = [r.asDict() for r in mine.orderBy("item").collect()]
        if not rows:
            continue
        used = mine.select(F.explode(F.array_distinct("words")).alias("term")).distinct()
        idf = {r.term: float(np.log(1 + (total.n - r.df + 0.5) / (r.df + 0.5))) for r in frequency.join(used, "term", "left_semi").collect()}
        held = docs.sparkSession.sparkContext.broadcast(Index(rows, idf, total.mean))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for rows, data, offsets in slices(batches, "text", 4 << 20):
                words, first = terms(data, offsets)
                if not len(words):
                    continue
                best: dict[tuple[int, int], tuple] = {}
                for row, start, item, score in zip(*(x.tolist() for x in index.search(words, first)), strict=True):
                    q, a = index.overlap(words[start : min(start + 2 * index.longest, first[row + 1])], item)
                    best[row, item] = max(best.get((row, item), (-1.0,)), (min(q, a), score, q, a))
                at = [k for k, _ in best]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(key).take(pa.array(at, pa.int64())), pa.array(index.items[[i for _, i in best]], pa.int64()), *(pa.array([v[c] for v in best.values()], pa.float64()) for c in (1, 2, 3))],
                    names=schema.names,
                )

        found = docs.select(key, "text").mapInArrow(run, schema)
        if blocks > 1:  # one index at a time
            found = cut(found)
            held.unpersist()
        parts.append(found)
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], schema)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.groupBy(key, "item").agg(F.max(F.struct(F.least("question_overlap", "answer_overlap").alias("low"), "score", "question_overlap", "answer_overlap")).alias("b")).select(
        key, "item", "b.score", "b.question_overlap", "b.answer_overlap", (F.col("b.low") >= MIN_OVERLAP).alias("leaked")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and item_id of verified leaks, with the scores."""
    return leaks(docs, split_answer(benchmark)).filter("leaked").select("doc_id", F.col("item").alias("item_id"), F.round("score", 6).alias("score"), "question_overlap", "answer_overlap")
