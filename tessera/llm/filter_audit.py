"""Filter interaction audit: what five filters remove, alone and after one another, in all 120 orders, for each part of a corpus.

A table-driven transducer reads the UTF-8 bytes of a slice of texts once. Every byte has a class (CLASSES), and what a
byte emits (EMITS) follows from its state, the class of the byte before it, and its own class: begin of a word, end of
a word, capital, code point, symbol. Since the state is only the class of the last byte, all bytes of a slice look up
their emission at once. The spans of words go into a hash table with open addressing (distinct()): a word that meets an
entry of its own document is compared with it byte by byte, so no hash decides that two words are equal.

What leaves the texts is a row of a few numbers and a digest for each document. Texts equal to one of a smaller doc_id
are found by digest: rows are counted by (digest, doc_id), and the smallest doc_id of a digest by partial aggregates, so
a group of copies of any size is never in one place. Every document then is one of 32 patterns of failures; patterns are
counted by part, and all orders are read off the counts.

Defined results: a null text is empty; a null source is the part ''; a null doc_id is larger than every other and has no
labels; rows that share text and doc_id fail E together or not at all; a document with several rows of labels has a
label if one of them has it; labels other than 1 count as not set; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import cut
from tessera.llm.text import Rolling, mix, slices

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"
ORDERS = ["".join(x) for x in permutations(FILTERS)]

#: Classes of bytes: white space, capitals, symbols, continuation bytes of UTF-8, all else.
BLANK, CAPITAL, SYMBOL, INNER, OTHER, BORDER = range(6)
CLASSES = np.full(256, OTHER, dtype=np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = BLANK
CLASSES[0x41:0x5B] = CAPITAL
CLASSES[list(SYMBOLS)] = SYMBOL
CLASSES[0x80:0xC0] = INNER

#: What a byte emits, by the class before it (BORDER between texts) and its own: bits for a word's begin, a word's end before this byte, a capital, a code point, a symbol.
BEGIN, END, UPPER, POINT, MARK = 1, 2, 4, 8, 16
EMITS = np.zeros((6, 6), dtype=np.uint8)
for _state in range(6):
    for _class in range(6):
        _outside, _blank = _state in (BLANK, BORDER), _class in (BLANK, BORDER)
        EMITS[_state, _class] = (
            BEGIN * (_outside and not _blank) + END * (_blank and not _outside) + UPPER * (_class == CAPITAL) + POINT * (_class not in (INNER, BORDER)) + MARK * (_class == SYMBOL)
        )

SCHEMA = "doc_id bigint, part string, n_words bigint, n_distinct bigint, n_capitals bigint, n_points bigint, n_symbols bigint, digest binary"


def transduce(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """One pass over the bytes of many texts: begin and end of every word, the text of every word, and the counts of each text."""
    n = len(offsets) - 1
    # A border stands behind each text, so that no word reaches over it.
    tape = np.full(len(data) + n, BORDER, dtype=np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    tape[np.arange(len(data)) + row] = CLASSES[data]
    before = np.empty_like(tape)
    before[:1], before[1:] = BORDER, tape[:-1]
    out = EMITS[before, tape]
    begins, ends = np.flatnonzero(out & BEGIN), np.flatnonzero(out & END)
    borders = offsets[1:] + np.arange(n)
    of = np.searchsorted(borders, begins)
    place = np.concatenate((offsets[:-1] + np.arange(n), [len(tape)]))
    total = {}
    for name, bit in (("n_words", BEGIN), ("n_capitals", UPPER), ("n_points", POINT), ("n_symbols", MARK)):
        sums = np.concatenate(([0], np.cumsum((out & bit) != 0)))
        total[name] = sums[place[1:]] - sums[place[:-1]]
    return begins - of, ends - of, of, total


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros stand behind the end."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out


def equal(chunks: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans that begin at a and b and are `length` bytes long are equal, eight bytes a step."""
    same = np.ones(len(a), dtype=bool)
    live, done = np.arange(len(a)), 0
    while len(live):
        left = length[live] - done
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        differ = (chunks[a[live] + done] ^ chunks[b[live] + done]) & keep != 0
        same[live[differ]] = False
        done += 8
        live = live[~differ & (left > 8)]
    return same


def distinct(data: np.ndarray, begin: np.ndarray, end: np.ndarray, of: np.ndarray, n: int, bits: int | None = None) -> np.ndarray:
    """The number of different words of each of n texts, by a hash table whose entries are compared with what meets them.

    All words that are not placed yet probe their next slot at once. A free slot is taken by one of those that want it;
    whoever finds an entry of its own text with the same bytes is a repeat; all others go on to the slot behind.
    """
    count = np.zeros(n, dtype=np.int64)
    if not len(begin):
        return count
    size = 1 << (bits or max(4, int(2 * len(begin) - 1).bit_length()))
    if len(begin) >= size:
        raise ValueError("the table has no free slot")
    chunks, length = eights(data), end - begin
    slot = (mix(Rolling(data)(begin, end) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(size - 1)).astype(np.int64)
    owner = np.full(size, -1, dtype=np.int64)
    live = np.arange(len(begin))
    while len(live):
        at = slot[live]
        free = owner[at] < 0
        owner[at[free]] = live[free]
        found = owner[at]
        own = found == live
        count += np.bincount(of[live[own]], minlength=n)
        rest, found = live[~own], found[~own]
        like = (of[rest] == of[found]) & (length[rest] == length[found])
        like[like] = equal(chunks, begin[rest[like]], begin[found[like]], length[rest[like]])
        live = rest[~like]
        slot[live] = (slot[live] + 1) & (size - 1)
    return count


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, part, the counts of each text and its digest; memory follows the slices of a batch, not the partition."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            begin, end, of, total = transduce(data, offsets)
            words = distinct(data, begin, end, of, rows.num_rows)
            raw = memoryview(data)
            digests = [sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            counts = [total["n_words"], words, total["n_capitals"], total["n_points"], total["n_symbols"]]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), *map(pa.array, counts), pa.array(digests, pa.binary())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, pattern, good, toxic, n): documents by part, failed filters (bit k for the k-th of FILTERS) and labels."""
    m = measured(docs)
    alone = [F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), 100 * F.col("n_capitals") > MOST_CAPITALS * F.col("n_points"), F.col("n_symbols") > 0]
    bits = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(alone)), F.lit(0))
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    rows = cut(m.select("doc_id", last.alias("place"), "part", "digest", bits.alias("pattern")))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce((F.col(a) == 1).cast("int"), F.lit(0))).alias(b) for a, b in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.filter("doc_id is not null").join(marks, "doc_id", "left").unionByName(rows.filter("doc_id is null"), allowMissingColumns=True)
    rows = rows.select("part", "pattern", "digest", "place", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    kinds = ["part", "pattern", "good", "toxic"]
    # By digest: how many rows of each kind there are, and how many of them are of the smallest doc_id, which do not fail E.
    kept = rows.groupBy("digest", "place", *kinds).agg(F.count("*").alias("n"))
    least = rows.groupBy("digest").agg(F.min("place").alias("place"))
    first = kept.join(least, ["digest", "place"]).groupBy(*kinds).agg(F.sum("n").alias("n_first"))
    every = rows.groupBy(*kinds).agg(F.count("*").alias("n"))
    both = every.join(first, kinds, "left").withColumn("n_first", F.coalesce("n_first", F.lit(0)))
    copy = F.col("pattern").bitwiseOR(F.lit(1 << FILTERS.index("E")))
    return both.select(*kinds, F.col("n_first").alias("n")).unionByName(both.select("part", copy.alias("pattern"), "good", "toxic", (F.col("n") - F.col("n_first")).alias("n"))).filter("n > 0")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, read off the counts of failure patterns."""
    by_pattern = failures(docs, labels).groupBy("part", "pattern").agg(F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))
    by_part = by_pattern.groupBy("part").agg(F.collect_list(F.struct(F.col("pattern").alias("p"), "n", "good", "toxic")).alias("seen"))  # 32 at most
    pairs = [(k, b) for k in range(5) for b in range(32) if not b >> k & 1]
    ask = F.array(*(F.struct(F.lit(1 << k).alias("f"), F.lit(b).alias("before"), F.lit(factorial(b.bit_count()) * factorial(4 - b.bit_count())).cast("long").alias("orders")) for k, b in pairs))
    put = lambda value, test: f"aggregate(seen, 0L, (s, x) -> s + if({test}, x.{value}, 0L))"
    here, again = "x.p & a.f != 0 AND x.p & a.before = 0", "x.p & a.f != 0 AND x.p & a.before != 0"
    said = {"kept": put("n", "x.p & (a.f | a.before) = 0"), "removed": put("n", here), "redundant": put("n", again), "unique_fails": put("n", "x.p = a.f"), "good_lost": put("good", here), "toxic_lost": put("toxic", here), "orders": "a.orders"}
    answers = by_part.withColumn("ask", ask).select("part", F.expr(f"transform(ask, a -> named_struct('f', a.f, {', '.join(f"'{k}', {v}" for k, v in said.items())}))").alias("answers"))
    # A filter's share over all orders: each set of filters before it stands in |set|! * (4 - |set|)! orders.
    answers = answers.withColumn("shares", F.expr(f"transform(array({', '.join(str(1 << k) for k in range(5))}), f -> aggregate(filter(answers, a -> a.f = f), 0L, (s, a) -> s + a.removed * a.orders))"))
    steps = []
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            k = FILTERS.index(name)
            steps.append(f"named_struct('filter_order', '{order}', 'step', {step}, 'at', {pairs.index((k, before))}, 'k', {k})")
            before |= 1 << k
    out = answers.withColumn("s", F.explode(F.expr(f"array({', '.join(steps)})")))
    return out.select("part", "s.filter_order", F.col("s.step").alias("step"), *(F.expr(f"answers[s.at].{c}").alias(c) for c in said if c != "orders"), F.expr("shares[s.k]").alias("shapley"))


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN first < doc_id THEN 16 ELSE 0 END) AS p
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, p, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, p),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS f, list_sum(bits[1:step - 1]) AS b FROM o, range(1, 6) r(step)),
g AS (SELECT part, filter_order, step, f, coalesce(b, 0)::INT AS b FROM s, (SELECT DISTINCT part FROM c)),
r AS (SELECT g.part, filter_order, step, f, coalesce(sum(n) FILTER (p & (f | b) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (p & f <> 0 AND p & b = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (p & f <> 0 AND p & b <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (p = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (p & f <> 0 AND p & b = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (p & f <> 0 AND p & b = 0), 0)::BIGINT AS toxic_lost
  FROM g JOIN c ON g.part = c.part GROUP BY g.part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
