"""Hard negatives: candidate vectors in Hilbert order as Parquet blocks with zone maps, which say which blocks a window reads.

Rows are ordered by label and by their place on a Hilbert curve through all dimensions, cut into blocks of up to BLOCK
rows and written as Parquet, one row a block: its vectors, and the least and greatest value of every dimension (the zone
map). For an anchor a and a block, interval arithmetic bounds every inner product: at most sum(max(a*lo, a*hi)), at
least sum(min(a*lo, a*hi)). Three jobs read from that:

1. In its own block every anchor finds a first POSITIVES-th best score of its label.
2. Blocks with the anchor's label whose upper bound reaches that score are read; they give the exact positives.
3. Each positive opens a window of scores. Blocks with another label whose bounds meet a window are read, greatest bound
   first; one that cannot reach the window's worst of NEGATIVES scores so far is skipped. They give the exact negatives.

Anchors travel in packs (those of one block, so they lie close together). Packs are dealt to tiles of about TILE anchors
and blocks to slices of about SLICE rows, both in the order of the blocks. Zone maps and packs meet for each tile and
ZONES parts of the blocks, so no task sees all of either; only blocks that an anchor of a tile needs are sent to it,
and a task holds one tile and one slice, in which every window again skips the blocks that its own bounds exclude. A
slice gives each window NEGATIVES candidates at most, so the last ranking has few rows for each.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component take no part; a
shorter vector counts as if zeros followed; equal rows are one; different rows that share a vec_id are several, in the
order of the blocks among themselves; scores beyond 2**55 in size count as 2**55; anchors without another row of their
label give no rows, nor do windows without a row; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.frames import cut, shared_folder

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score, in hundredths of the positive's: from LOW to HIGH.
LOW, HIGH = 30, 90
SCALE, FLIP, LABELS = 256, 7, 10
#: Rows of a block, anchors of a tile, rows of a slice. Blocks are written in parts of PART rows, in more if there were more than PARTS; zone maps travel ZONES parts at a time.
BLOCK, TILE, SLICE, PART, PARTS, ZONES = 1024, 200_000, 1 << 20, 1 << 14, 20_000, 256
#: Bits of each dimension on the Hilbert curve.
BITS = 4
MOST, NONE = 1 << 55, -(1 << 62)

CLEAN = "vec_id bigint, label int, vector array<double>"
BLOCKS = "block bigint, low int, high int, n int, width int, ids binary, labels binary, vectors binary, least array<double>, most array<double>"
PACKS = "pack bigint, n int, width int, ids binary, labels binary, orders binary, vectors binary, of array<bigint>, score array<bigint>"
FOUND = "anchor_id bigint, anchor_order bigint, window bigint, score bigint, vec_id bigint, vec_order bigint"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def one_row(schema: str, values: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[c.split()[1]]) for v, c in zip(values, schema.split(", "), strict=True)], names=names(schema))


def clean(rows: DataFrame) -> DataFrame:
    """The rows that take part: vec_id, label (moved on where the id is divisible by FLIP) and the components as whole numbers; equal rows once."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.when(F.col("vec_id") % FLIP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    # floor() gives a long, and a double's floor beyond that is the double.
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 1e15, F.floor(c.cast("double") * SCALE).cast("double")).otherwise(c.cast("double") * SCALE))
    return rows.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), whole.alias("vector")).distinct()


def hilbert(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The place of each row of cells (whole numbers below 2**bits) on the Hilbert curve: a key whose bytes sort as the curve runs.

    The cells are turned into the curve's own axes bit by bit, from the highest: where a bit is set the lower bits of the
    first dimension are inverted, else they change places with that dimension's. Gray decoding then gives the key's bits.
    """
    x = cells.T.astype(np.uint32).copy()
    dims = len(x)
    if not dims:
        return [b""] * len(cells)
    top = np.uint32(1 << (bits - 1))
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, np.uint32(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
        q >>= np.uint32(1)
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint32)
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])  # the highest bits of all dimensions first
    packed = np.packbits(planes.transpose(2, 0, 1).reshape(x.shape[1], -1).astype(np.uint8), axis=1)
    return [r.tobytes() for r in packed]


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; zeros behind the end of a shorter one."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def keyed(rows: DataFrame, width: int, lows: list[float], highs: list[float]) -> DataFrame:
    """rows with `curve`, their place on the Hilbert curve through the box of all rows."""
    low, span = np.array(lows), np.maximum(np.array(highs) - np.array(lows), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.minimum((matrix(b.column("vector"), width) - low) / span * (1 << BITS), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert(cells), pa.binary())], names=[*b.schema.names, "curve"])

    return rows.mapInArrow(run, CLEAN + ", curve binary")


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold all of them; the first byte says how few."""
    most = np.abs(x).max(initial=0)
    kind = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return bytes([kind]) + x.astype(("<i2", "<i4", "<f8")[kind]).tobytes()


def unpacked(row: dict) -> np.ndarray:
    data = row["vectors"]
    return np.frombuffer(data, dtype=("<i2", "<i4", "<f8")[data[0]], offset=1).reshape(row["n"], row["width"]).astype(float)


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows as longs; by whole numbers of any size where doubles would not be exact."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


def bounds(a: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product that each row of a can have with a vector of each box (rounded outwards)."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = 1e-12 * (np.abs(a) @ np.maximum(np.abs(least), np.abs(most)).T)
    return up @ least.T + down @ most.T - slack, up @ most.T + down @ least.T + slack


def blocked(rows: DataFrame, folder: str) -> tuple[DataFrame, int, int]:
    """The blocks as written to `folder`, the number of parts and the rows of a part; without rows there is no part."""
    rows = cut(clean(rows))
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not sizes.n:
        return rows.sparkSession.createDataFrame([], BLOCKS), 0, 0
    width, parts = sizes.width, min(PARTS, -(-sizes.n // PART))
    box = {r.d: r for r in rows.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()}  # one row a dimension
    ordered = keyed(rows, width, [box[d].low for d in range(width)], [box[d].high for d in range(width)])
    ordered = ordered.repartitionByRange(parts, "label", "curve", "vec_id").sortWithinPartitions("label", "curve", "vec_id", "vector")

    def block(t: pa.Table, number: int) -> pa.RecordBatch:
        x, labels = matrix(t.column("vector"), width), t.column("label").to_numpy().astype("<i8")
        ids = t.column("vec_id").to_numpy().astype("<i8")
        return one_row(BLOCKS, [number, int(labels.min()), int(labels.max()), len(labels), width, ids.tobytes(), labels.tobytes(), packed(x), x.min(axis=0).tolist(), x.max(axis=0).tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK:
                t, at = pa.Table.from_batches(held), 0
                while at + BLOCK <= t.num_rows:
                    yield block(t.slice(at, BLOCK), number)
                    number, at = number + 1, at + BLOCK
                held = t.slice(at).to_batches()
        if sum(x.num_rows for x in held):
            yield block(pa.Table.from_batches(held), number)

    ordered.mapInArrow(run, BLOCKS).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder), parts, -(-sizes.n // parts)


def order(block: int, n: int) -> np.ndarray:
    """Numbers that tell all rows apart and follow the blocks."""
    return (block << 12) + np.arange(n)


def packs(blocks: DataFrame) -> DataFrame:
    """The anchors of each block as one row; each asks for scores from the POSITIVES-th best that its own block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            ids, labels, x, orders = longs(r["ids"]), longs(r["labels"]), unpacked(r), order(r["block"], r["n"])
            at = np.flatnonzero(ids % EVERY == 0)
            floors = []
            for a, scores in ((a, s) for part in np.array_split(at, -(-len(at) // 256) or 1) for a, s in zip(part, products(x[part], x), strict=True)):
                others = scores[(labels == labels[a]) & (orders != orders[a])]
                floors.append(int(np.partition(others, -POSITIVES)[-POSITIVES]) if len(others) >= POSITIVES else NONE)
            if len(at):
                yield one_row(PACKS, [r["block"], len(at), r["width"], ids[at].tobytes(), labels[at].tobytes(), orders[at].tobytes(), packed(x[at]), orders[at].tolist(), floors])

    return blocks.select("block", "n", "width", "ids", "labels", "vectors").mapInArrow(run, PACKS)


class Search:
    """The windows of a tile's anchors: the k best rows of the same label, or of another one, with a score from first to last."""

    def __init__(self, tile: list[dict], same: bool):
        join = lambda c: np.concatenate([longs(r[c]) for r in tile])
        self.ids, self.labels, self.orders, self.x = join("ids"), join("labels"), join("orders"), np.concatenate([unpacked(r) for r in tile])
        by_order = np.argsort(self.orders)
        asked = np.array([v for r in tile for v in r["of"]], dtype=np.int64)
        self.of = by_order[np.searchsorted(self.orders[by_order], asked)]
        self.score = np.array([v for r in tile for v in r["score"]], dtype=np.int64)
        self.same, self.k = same, POSITIVES if same else NEGATIVES
        self.first, self.last = (self.score, np.full(len(self.of), 1 << 62)) if same else (-(-LOW * self.score // 100), HIGH * self.score // 100)

    def needed(self, some: np.ndarray, zones: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Which blocks the windows `some` must read, and the upper bounds of their scores there."""
        anchors, back = np.unique(self.of[some], return_inverse=True)
        lower, upper = (b[back] for b in bounds(self.x[anchors], zones["least"], zones["most"]))
        label, first, last = (v[some][:, None] for v in (self.labels[self.of], self.first, self.last))
        fits = (zones["low"] <= label) & (label <= zones["high"]) if self.same else (zones["low"] != label) | (zones["high"] != label)
        return fits & (upper >= first) & (lower <= last) & (first <= last), upper

    def blocks(self, zones: dict[str, np.ndarray]) -> np.ndarray:
        """Which blocks some window of the tile must read."""
        need = np.zeros(len(zones["low"]), dtype=bool)
        for some in np.array_split(np.arange(len(self.of)), -(-len(self.of) // 512) or 1):
            for part in np.array_split(np.flatnonzero(~need), -(-int((~need).sum()) // 1024) or 1):
                need[part] |= self.needed(some, {c: v[part] for c, v in zones.items()})[0].any(axis=0)
        return need

    def best(self, blocks: list[dict]) -> pa.Table:
        """The k best rows of the blocks for each window: higher scores first, ties by smaller vec_id, then by order."""
        out = [np.zeros((6, 0), dtype=np.int64)]
        zones = {c: np.array([b[c] for b in blocks]) for c in ("low", "high", "least", "most")}
        read: dict[int, tuple] = {}
        for some in np.array_split(np.arange(len(self.of)), -(-len(self.of) // 512) or 1):
            need, upper = self.needed(some, zones)
            # scores, ids and orders of the k best so far; NONE - 1 where there is none yet.
            held = np.stack([np.full((len(some), self.k), NONE - 1), np.zeros((len(some), self.k), np.int64), np.zeros((len(some), self.k), np.int64)])
            for b in np.argsort(-upper.max(axis=0), kind="stable"):
                live = np.flatnonzero(need[:, b] & (upper[:, b] >= held[0, :, -1]))
                if not len(live):
                    continue
                if b not in read:
                    ids, orders = longs(blocks[b]["ids"]), order(blocks[b]["block"], blocks[b]["n"])
                    by = np.lexsort((orders, ids))
                    read[b] = ids[by], longs(blocks[b]["labels"])[by], orders[by], by
                ids, labels, orders, by = read[b]
                anchors, back = np.unique(self.of[some[live]], return_inverse=True)
                scores = products(self.x[anchors], unpacked(blocks[b])[by])[back]
                own = self.of[some[live]]
                fits = (labels == self.labels[own][:, None]) & (orders != self.orders[own][:, None]) if self.same else labels != self.labels[own][:, None]
                fits &= (scores >= np.maximum(self.first[some[live]], held[0, live, -1])[:, None]) & (scores <= self.last[some[live]][:, None])
                any_ = np.flatnonzero(fits.any(axis=1))
                scores, live = np.where(fits[any_], scores[any_], NONE - 1), live[any_]
                # The rows of a block stand in the order that decides ties, so a stable sort is the ranking.
                top = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
                new = np.stack([np.take_along_axis(scores, top, 1), ids[top], orders[top]])
                both = np.concatenate((held[:, live], new), axis=2)
                rank = np.lexsort((both[2], both[1], -both[0]), axis=1)[:, : self.k]
                held[:, live] = np.take_along_axis(both, np.broadcast_to(rank, (3, *rank.shape)), 2)
            w, r = np.nonzero(held[0] > NONE)
            own = self.of[some[w]]
            out.append(np.stack([self.ids[own], self.orders[own], self.score[some[w]], *held[:, w, r]]))
        return pa.table(dict(zip(names(FOUND), np.concatenate(out, axis=1), strict=True)))


def searched(anchors: DataFrame, blocks: DataFrame, tiles: list[int], parts_of_slice: int, same: bool) -> DataFrame:
    """FOUND rows: the k best of every slice for every window of the packs. tiles: the tile of each part."""
    spark = anchors.sparkSession
    part = lambda c: F.shiftright(c, 32)
    zone = F.floor(part("block") / ZONES)
    dealt = cut(anchors.join(F.broadcast(spark.createDataFrame(list(enumerate(tiles)), "part bigint, tile bigint")), part("pack") == F.col("part")).drop("part"))  # PARTS rows at most
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    zones = blocks.select("block", "low", "high", "least", "most", zone.alias("zone")).withColumn("tile", every(tiles[-1] + 1))

    def route(key: tuple, tile: pa.Table, seen: pa.Table) -> pa.Table:
        out = np.zeros(0, dtype=np.int64)
        if tile.num_rows and seen.num_rows:
            z = {c: np.array(seen.column(c).to_pylist()) for c in ("block", "low", "high", "least", "most")}
            out = z["block"][Search(tile.to_pylist(), same).blocks(z)]
        return pa.table({"tile": pa.array([key[0].as_py()] * len(out), pa.int64()), "block": pa.array(out, pa.int64())})

    def best(key: tuple, tile: pa.Table, seen: pa.Table) -> pa.Table:
        if not tile.num_rows or not seen.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names(FOUND)})
        return Search(tile.to_pylist(), same).best(seen.to_pylist())

    met = dealt.withColumn("zone", every((len(tiles) - 1) // ZONES + 1)).groupBy("tile", "zone").cogroup(zones.groupBy("tile", "zone"))
    routes = cut(met.applyInArrow(route, "tile bigint, block bigint").withColumn("slice", F.floor(part("block") / parts_of_slice)))
    sent = blocks.join(routes.select("block", F.col("tile").alias("to_tile"), F.col("slice").alias("to_slice")), "block")
    asked = dealt.join(routes.select("tile", "slice").distinct(), "tile")
    return asked.groupBy("tile", "slice").cogroup(sent.groupBy("to_tile", "to_slice")).applyInArrow(best, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window with `rank` from 1."""
    best_first = W.partitionBy("anchor_order", "window").orderBy(F.desc("score"), "vec_id", "vec_order")
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def mined(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    blocks, parts, rows_of_part = blocked(rows, f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}")
    if not parts:
        return spark.createDataFrame([], out)
    anchors = cut(packs(blocks))
    counts = {r.part: r.n for r in anchors.groupBy(F.shiftright("pack", 32).alias("part")).agg(F.sum("n").alias("n")).collect()}  # PARTS rows at most
    sums = np.cumsum([counts.get(p, 0) for p in range(parts)])
    tiles = [int(max(0, v - 1) // TILE) for v in sums]
    parts_of_slice = max(1, SLICE // rows_of_part // 8 if parts < 4 * SLICE // rows_of_part else SLICE // rows_of_part)
    positives = cut(ranked(searched(anchors, blocks, tiles, parts_of_slice, True).withColumn("window", F.lit(0).cast("long")), POSITIVES))
    # Positives of one score share a window.
    windows = positives.groupBy(F.shiftright("anchor_order", 12).alias("pack")).agg(F.collect_set(F.struct(F.col("anchor_order").alias("of"), "score")).alias("w"))
    asking = anchors.drop("of", "score").join(windows, "pack").select("*", F.col("w.of").alias("of"), F.col("w.score").alias("score")).drop("w")
    negatives = ranked(searched(asking, blocks, tiles, parts_of_slice, False), NEGATIVES)
    pairs = positives.select("anchor_order", F.col("score").alias("window"), F.col("vec_id").alias("positive_id"))
    return negatives.join(pairs, ["anchor_order", "window"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE = f"""WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % {FLIP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a, e b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
