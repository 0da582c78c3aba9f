"""Finding repeated windows of a fixed length over a whole corpus.

Windows of `length` units (bytes or words) that are equal have the same least gram, their anchor, at the same place.
So consecutive windows of a document with one anchor travel together, as one body of text, to the task that owns the
anchor, and there windows are compared with each other exactly. Bodies whose bytes are equal and that stand in one
slice of input travel once. Anchors that are frequent in the whole corpus are split further, by the place of the window
around the anchor and by the text that all windows of that place share, so that no task gets a hot passage whole.

A slice of input makes COARSE payloads at the most, so their number follows the text and each holds kilobytes. A task gets
one coarse bucket and deals its bodies out to its fine ones itself, which it takes in turn; only where it would have to hold
more than MOST_INSIDE of them does a second exchange deal them out. Texts wait compressed for the ranges that leave them.

What is done with the bodies of one task is up to the operator: `solve` gets them and tells which windows go.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import cut, doc_keyed
from tessera.llm.text import Rolling, mix, sliding_min, slices, spread, words

#: Bytes of text in a slice, of bodies in a bucket, and of packed payloads that the second exchange takes at once.
SLICE = 2 << 20
BUCKET_BYTES = 16 << 20
CHUNK = 24 << 20
#: Payloads of a slice at the most, and coarse buckets at the least where there are as many fine ones.
COARSE, FEWEST = 2048, 256
#: Fine buckets that one task holds, and how many it holds at the most where there are COARSE coarse ones.
INSIDE, MOST_INSIDE = 4, 8
#: An anchor is hot from so many runs on, and there are HOT_MOST hot ones at the most (8 bytes each on the driver).
HOT = 2000
HOT_MOST = 1_000_000
#: Copies of earlier texts are left out of the exchange if there are so many at the most (16 bytes each on the driver).
COPIES_MOST = 2_000_000
#: Bits for the place of an anchor; longer texts are searched in stretches.
PLACE_BITS = 24


@dataclass(frozen=True)
class Kind:
    """What a window is: its units, its length, the length of anchor grams, how far hot anchors are split, and the rough size of all bodies against the text."""

    by_words: bool
    length: int
    gram: int
    split: int
    #: Only windows that also start in a document with a smaller id count (else: that occur anywhere else).
    by_order: bool
    growth: float


@dataclass
class Runs:
    """Consecutive windows with one anchor: first and last start, the anchor's place, the key, the row."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    row: np.ndarray


@dataclass
class Bodies:
    """Different bodies (text, its size, the key, the anchor's unit, whether it stands twice) and who owns them (body, document, place).

    The last exchange of word bodies leaves the keys out: the words at the anchor say as much.
    """

    text: bytes
    size: np.ndarray
    key: np.ndarray
    anchor: np.ndarray
    twice: np.ndarray
    body: np.ndarray
    id: np.ndarray
    hash: np.ndarray
    place: np.ndarray

    def some(self, which: np.ndarray, owners: np.ndarray) -> Bodies:
        """Those bodies (rising numbers) and those owners (of these bodies)."""
        starts = np.cumsum(self.size) - self.size
        text = b"".join([self.text[x:y] for x, y in zip(starts[which].tolist(), (starts + self.size)[which].tolist(), strict=True)])
        return Bodies(text, self.size[which], self.key[which], self.anchor[which], self.twice[which], np.searchsorted(which, self.body[owners]), self.id[owners], self.hash[owners], self.place[owners])

    def pack(self, with_key: bool = True) -> bytes:
        docs, doc = np.unique(np.stack((self.id, self.hash), axis=1), axis=0, return_inverse=True)
        return pickle.dumps((self.text, thin(self.size), self.key if with_key else None, thin(self.anchor), np.packbits(self.twice), thin(self.body), thin(docs[:, 0]), thin(docs[:, 1]), thin(doc.ravel()), thin(self.place)), protocol=5)

    @staticmethod
    def unpack(raw: bytes) -> Bodies:
        text, size, key, anchor, twice, body, ids, hashes, doc, place = pickle.loads(raw)  # noqa: S301
        doc, size = thick(doc), thick(size)
        key = np.zeros(len(size), dtype=np.uint64) if key is None else key
        return Bodies(text, size, key, thick(anchor), np.unpackbits(twice, count=len(size)).astype(bool), thick(body), thick(ids)[doc], thick(hashes)[doc], thick(place))

    @staticmethod
    def joined(parts: list[Bodies]) -> Bodies:
        base = np.cumsum([0, *(len(p.key) for p in parts)])
        out = {f.name: np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Bodies) if f.name not in ("text", "body")}
        return Bodies(text=b"".join(p.text for p in parts), body=np.concatenate([p.body + b for p, b in zip(parts, base, strict=False)]), **out)


def thin(x: np.ndarray) -> np.ndarray:
    """Differences in the smallest integer type that holds them."""
    d = np.diff(x.astype(np.int64), prepend=0)
    low, high = (int(d.min()), int(d.max())) if len(d) else (0, 0)
    return d.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def thick(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.int64)


def units(kind: Kind, data: np.ndarray, offsets: np.ndarray):
    """(values to hash, first unit of each row, start and end byte of each unit, bytes): of words the bytes are the words, one space after each."""
    if not kind.by_words:
        return data, offsets, np.arange(len(data)), np.arange(1, len(data) + 1), data.tobytes()
    a, b, first = words(data, offsets)
    end = np.cumsum(b - a + 1)
    tidy = np.full(end[-1] if len(end) else 0, 32, dtype=np.uint8)
    tidy[spread(end - (b - a + 1), b - a)] = data[spread(a, b - a)]
    return Rolling(data)(a, b), first, end - (b - a + 1), end, tidy.tobytes()


def anchors(h: np.ndarray, width: int, bits: int = PLACE_BITS) -> np.ndarray:
    """The place of the least of each `width` neighbours, the first of equal ones; found in stretches, so that places fit beside the hash."""
    low, step = np.uint64((1 << bits) - 1), (1 << bits) - width
    n = len(h) - width + 1
    out = np.empty(max(n, 0), dtype=np.int64)
    for at in range(0, n, step):
        part = h[at : at + step + width - 1]
        out[at : at + step] = (sliding_min((part & ~low) | np.arange(len(part), dtype=np.uint64), width) & low).astype(np.int64) + at
    return out


def runs(kind: Kind, values: np.ndarray, first: np.ndarray, hot: np.ndarray) -> tuple[Runs, np.ndarray]:
    """The runs of all rows, and the anchors' hashes by run."""
    rolling = Rolling(values)
    start = np.arange(max(len(values) - kind.length + 1, 0))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(start)]
    inside = start + kind.length <= first[row + 1]
    start, row = start[inside], row[inside]
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none), none.astype(np.uint64)
    at = np.arange(len(values) - kind.gram + 1)
    h = rolling(at, at + kind.gram)
    anchor = anchors(h, kind.length - kind.gram + 1)[start]
    part = np.zeros(len(start), dtype=np.int64)
    is_hot = np.isin(h[anchor], hot) if len(hot) else np.zeros(len(start), dtype=bool)
    part[is_hot] = (anchor - start)[is_hot] // kind.split
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (part[1:] != part[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(start)) - 1
    a, p, key = anchor[begin], part[begin], h[anchor[begin]]
    found = key.copy()
    hot_runs = is_hot[begin]
    core = a[hot_runs] - kind.split * p[hot_runs]
    key[hot_runs] = mix(key[hot_runs] ^ mix(rolling(core, core - (kind.split - 1) + kind.length) + p[hot_runs].astype(np.uint64)))
    return Runs(start[begin], start[end], a, key, row[begin]), found


def hot_anchors(docs: DataFrame, kind: Kind) -> np.ndarray:
    """Anchors of HOT runs and more, and of a share of all that lets HOT_MOST pass. They only balance the work; results do not depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.uint64)
        for _, data, offsets in slices(batches, "text", SLICE):
            values, first, *_ = units(kind, data, offsets)
            found, n = np.unique(runs(kind, values, first, none)[1], return_counts=True)
            many = n > 1
            total = pa.array([0], pa.int64()), pa.array([int(n.sum())], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([total[0], pa.array(found[many].view(np.int64))]), pa.concat_arrays([total[1], pa.array(n[many], pa.int64())])], names=["anchor", "n"])

    found = cut(docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")))
    total = found.filter("anchor = 0").first()
    least = max(HOT, (total.n if total else 0) // HOT_MOST)
    return np.sort(np.array([r.anchor for r in found.filter((F.col("anchor") != 0) & (F.col("n") > least)).collect()], dtype=np.int64).view(np.uint64))


def copies(docs: DataFrame, kind: Kind) -> np.ndarray:
    """(id, text hash, 1 if later) of rows whose text is that of a row with a smaller id, and of those first ones, if they are few enough to be sent along; else none.

    The later ones need no comparison: all their windows start in the first one, too, and what they share with third rows that one does.
    """
    rows = docs.filter(F.octet_length("text") >= kind.length).groupBy(F.md5("text").alias("digest"), "key_id", "key_text").agg(F.lit(1).alias("one"))
    first = rows.groupBy("digest").agg(F.min("key_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    found = cut(rows.join(first, "digest").selectExpr("key_id", "key_text", "cast(key_id > least as bigint) as later"))
    if found.limit(COPIES_MOST + 1).count() > COPIES_MOST:
        return np.zeros((0, 3), dtype=np.int64)
    table = found.toArrow()
    known = np.stack([table.column(c).to_numpy() for c in table.column_names], axis=1).astype(np.int64).reshape(-1, 3)
    return known[np.lexsort((known[:, 1], known[:, 0]))]


def is_copy(rows: pa.RecordBatch, known: np.ndarray) -> np.ndarray:
    """By row 2 for a later copy, 1 for the first of several, else 0."""
    out = np.zeros(rows.num_rows, dtype=np.int64)
    if len(known):
        ids, hashes = rows.column("key_id").to_numpy(), rows.column("key_text").to_numpy()
        for k in np.flatnonzero(np.isin(ids, known[:, 0])).tolist():
            low, high = np.searchsorted(known[:, 0], ids[k], side="left"), np.searchsorted(known[:, 0], ids[k], side="right")
            found = known[low:high][known[low:high, 1] == hashes[k]]
            out[k] = 1 + found[0, 2] if len(found) else 0
    return out


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one owner that touch become one."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    base = owner * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(owner), dtype=bool)
    new[1:] = base[1:] + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(owner)) - 1
    return owner[at], start[at], reach[last] - base[last]


def ranges(ids: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows of document and range, ranges of one document that touch made one."""
    docs, doc = np.unique(np.stack((ids, hashes), axis=1), axis=0, return_inverse=True)
    owner, start, end = merged(doc.ravel(), start, end)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs[owner, 0], docs[owner, 1], start, end)], names=["key_id", "key_text", "start", "end"])


def bodies(kind: Kind, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, hot: np.ndarray, copied: np.ndarray) -> tuple[Bodies | None, pa.RecordBatch | None]:
    """The different bodies of a slice, and the ranges that are settled inside it. copied: rows whose text a later row has."""
    values, first, a, b, raw = units(kind, data, offsets)
    r, _ = runs(kind, values, first, hot)
    if not len(r.first):
        return None, None
    ids, hashes = rows.column("key_id").to_numpy(), rows.column("key_text").to_numpy()
    number: dict[bytes, int] = {}
    group = np.array([number.setdefault(raw[x:y], len(number)) for x, y in zip(a[r.first].tolist(), b[r.last + kind.length - 1].tolist(), strict=True)])
    lead = np.full(len(number), len(group))
    np.minimum.at(lead, group, np.arange(len(group)))
    twice = np.bincount(group, 1 + copied[r.row]) > 1
    owner = ids[r.row]
    if kind.by_order:
        # Settled here: what equals a body of a smaller document.
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, group, owner)
        settled = owner > least[group]
    else:
        settled = twice[group]
    place, size = r.first - first[r.row], r.last - r.first + kind.length
    done = ranges(owner[settled], hashes[r.row[settled]], place[settled], (place + size)[settled]) if settled.any() else None
    left = np.flatnonzero(~settled)
    where = np.fromiter(map(len, number), dtype=np.int64, count=len(number))
    return Bodies(b"".join(number), where, r.key[lead], (r.anchor - r.first)[lead], twice, group[left], owner[left], hashes[r.row[left]], place[left]), done


def whole(kind: Kind, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The whole rows as ranges, if they hold a window."""
    n = np.diff(words(data, offsets)[2] if kind.by_words else offsets)
    some = n >= kind.length
    return ranges(rows.column("key_id").to_numpy()[some], rows.column("key_text").to_numpy()[some], np.zeros(int(some.sum()), dtype=np.int64), n[some])


def dealt(b: Bodies, of: np.ndarray) -> Iterator[tuple[int, Bodies]]:
    """The bodies by the number in `of`."""
    order, mine = np.argsort(of, kind="stable"), of[b.body]
    owners = np.argsort(mine, kind="stable")
    buckets, starts = np.unique(of[order], return_index=True)
    at = np.searchsorted(mine[owners], buckets)
    to = np.searchsorted(mine[owners], buckets, side="right")
    for k, bucket in enumerate(buckets.tolist()):
        yield bucket, b.some(order[starts[k] : starts[k + 1] if k + 1 < len(starts) else None], owners[at[k] : to[k]])


def press(found: Iterable[tuple[int, Bodies]], with_key: bool = True) -> pa.RecordBatch:
    squeeze = zstandard.ZstdCompressor(level=3)
    rows = [(k, squeeze.compress(b.pack(with_key))) for k, b in found]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["bucket", "payload"])


def coarse_buckets(buckets: int) -> int:
    return min(COARSE, buckets, max(FEWEST, -(-buckets // INSIDE)))


def exchanged_twice(buckets: int) -> bool:
    return buckets > COARSE * MOST_INSIDE


def coarse(docs: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    """(bucket, payload, key_id, key_text, start, end): bodies by coarse bucket, and settled ranges (without bucket)."""
    hot, known = (docs.sparkSession.sparkContext.broadcast(f(docs, kind)) for f in (hot_anchors, copies))
    schema = pa.schema([("bucket", pa.int64()), ("payload", pa.binary()), *((c, pa.int64()) for c in ("key_id", "key_text", "start", "end"))])
    deal, again = np.uint64(coarse_buckets(buckets)), exchanged_twice(buckets)

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch | None]:
        copy = is_copy(batch, known.value)
        for rows, data, offsets in slices([batch.filter(pa.array(copy > (1 if kind.by_order else 0)))], "text", SLICE):
            yield whole(kind, rows, data, offsets)
        own = copy < 2
        at = 0
        for rows, data, offsets in slices([batch.filter(pa.array(own))], "text", SLICE):
            b, done = bodies(kind, rows, data, offsets, hot.value, copy[own][at : at + rows.num_rows])
            at += rows.num_rows
            if b:
                bucket = b.key % np.uint64(buckets)
                if kind.by_words and not again:  # the fine bucket is all that is still asked for
                    b.key = (bucket // deal).astype(np.uint8)
                yield press(dealt(b, (bucket % deal).astype(np.int64)), again or not kind.by_words or deal < buckets)
            yield done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                if part is not None and part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column(f.name) if f.name in part.schema.names else pa.nulls(part.num_rows, f.type) for f in schema], schema=schema)

    return docs.mapInArrow(run, "bucket long, payload binary, key_id long, key_text long, start long, end long")


Solve = Callable[[Bodies], tuple[np.ndarray, np.ndarray]]
"""From bodies how many windows each has, and for all windows, one body after another, whether they are repeated (by_order: the smallest id that has it)."""


def settle(kind: Kind, solve: Solve, b: Bodies) -> pa.RecordBatch:
    """The ranges that go, from all bodies of one bucket."""
    n, value = solve(b)
    first = np.cumsum(n) - n
    at = spread(first[b.body], n[b.body])
    owner = np.repeat(np.arange(len(b.body)), n[b.body])
    start = np.arange(len(at)) - np.repeat(np.cumsum(n[b.body]) - n[b.body], n[b.body]) + b.place[owner]
    gone = np.flatnonzero(value[at] < b.id[owner] if kind.by_order else value[at])
    return ranges(b.id[owner[gone]], b.hash[owner[gone]], start[gone], start[gone] + kind.length)


def alone(key: np.ndarray) -> np.ndarray:
    """Which bodies have a key that no other has."""
    _, of, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[of] == 1


def spans(docs: DataFrame, kind: Kind, solve: Solve) -> DataFrame:
    """(key_id, key_text, gone): by document the ranges of units that go, from docs with text, key_id and key_text."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(1, round(size * kind.growth / BUCKET_BYTES))

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, held, size = zstandard.ZstdDecompressor(), [], 0

        def out():
            b = Bodies.joined(held)
            return press(dealt(b, (b.key % np.uint64(buckets)).astype(np.int64)), not kind.by_words)

        for batch in batches:
            for p in batch.column("payload"):
                raw = p.as_py()
                held.append(Bodies.unpack(expand.decompress(raw)))
                size += len(raw)
                if size > CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    deal, again = coarse_buckets(buckets), exchanged_twice(buckets)

    def run(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        parts = [Bodies.unpack(expand.decompress(p.as_py())) for p in table.column("payload").drop_null()]
        out = []
        if parts:
            b = Bodies.joined(parts)
            del parts
            if again or deal == buckets:
                out = [settle(kind, solve, b)]
            else:
                out = [settle(kind, solve, some) for _, some in dealt(b, (b.key if kind.by_words else b.key % np.uint64(buckets) // np.uint64(deal)).astype(np.int64))]
        done = table.filter(pc.is_null(table.column("payload"))).select(["key_id", "key_text", "start", "end"])
        return pa.concat_tables([done, *(pa.Table.from_batches([x]) for x in out)])

    found = coarse(docs, kind, buckets)
    if again:
        found = cut(found)
        bodies_ = found.filter("bucket is not null").select("bucket", "payload").repartition(COARSE, "bucket").mapInArrow(finer, "bucket long, payload binary")
        found = bodies_.unionByName(found.filter("bucket is null"), allowMissingColumns=True)
    # Settled ranges are spread over the buckets.
    groups = buckets if again else deal
    found = found.withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64("key_id", "start"), F.lit(groups))))
    found = found.repartition(min(groups, 200_000), "bucket").groupBy("bucket").applyInArrow(run, "key_id long, key_text long, start long, end long")
    return cut(found.groupBy("key_id", "key_text").agg(F.collect_list(F.struct("start", "end")).alias("gone")))


def squeezed(text: Column) -> Column:
    """Texts compressed one by one: they take two thirds of what a shuffle makes of them."""

    @F.arrow_udf("binary")
    def squeeze(texts: pa.Array) -> pa.Array:
        one = zstandard.ZstdCompressor(level=3)
        return pa.array([None if t is None else one.compress(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())

    return squeeze(text)


def expanded(texts: pa.Array) -> Iterator[bytes | None]:
    """Of squeezed() texts their bytes."""
    one = zstandard.ZstdDecompressor()
    return (None if t is None else one.decompress(t) for t in texts.to_pylist())


def with_spans(docs: DataFrame, kind: Kind, solve: Solve) -> DataFrame:
    """All rows and columns of docs, with key_id, key_text and gone (null: nothing goes); text is squeezed()."""
    keyed = doc_keyed(docs)
    return keyed.withColumn("text", squeezed(F.col("text"))).join(spans(keyed.select("text", "key_id", "key_text"), kind, solve), ["key_id", "key_text"], "left")


def gone_mask(gone: pa.Array, k: int, n: int) -> np.ndarray | None:
    """Flags of the units that go in row k, or None."""
    ranges_ = gone[k].as_py()
    if not ranges_:
        return None
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, [r["start"] for r in ranges_], 1)
    np.add.at(edge, [r["end"] for r in ranges_], -1)
    return np.cumsum(edge[:-1]) > 0
