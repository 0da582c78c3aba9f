"""Near-duplicates by Order MinHash.

A document is its sequence of five-word shingles, each labelled with how often it occurred before. For each of BANDS
hash functions the KEEP smallest labelled shingles are kept in the order of the text; documents with one such tuple
in common are candidates. So a tuple is shared only if the same shingles stand in the same order, which follows edit
similarity. Where one of the two has SHORT shingles or fewer nothing is left to chance: the rarest labelled shingles of
each text, so many that similar texts must share one of them (a prefix filter), are joined. Candidates are verified by a banded alignment: equal labelled shingles whose places differ by no more than
the band form a longest common subsequence of n shingles, and the pair is linked if n / (n1 + n2 - n) is SIMILARITY
or more.

Equal texts are folded into one before anything else. A candidate group is not expanded into pairs. All its texts are
compared with one pivot. Two texts of the group that are both linked with the pivot are in one class; any other pair is
found by what parts it from the pivot: with shingles that the pivot lacks put first, similar texts must share one of
their first shingles (the prefix filter again, at places that their lengths allow), and shingles that the pivot lacks are
rare in a group however large it is. Texts that share such a shingle are compared with one of them. Those that are not
connected after that go on with another pivot and with what parts them from that one, as long as this halves the pairs
that are left; the last ones are compared with each other. So no link is left out but between texts that are connected anyway. Classes
are the connected components of the links.

Defined results: documents without words are alone; a text of fewer than five words is one shingle; a class is named
by its smallest doc_id (null: after all others); repeated rows and equal texts are in one class; exactly one row of
each class is kept, one with the smallest doc_id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import counted, cut, fitted, shield, unshield
from tessera.llm.text import Rolling, mix, slices, words
from tessera.sources.checkpoints import written

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
KEEP = 6
#: Pairs whose shorter text has so many shingles at the most are found without chance. Both then have no more than LISTED.
SHORT = 30
LISTED = int(SHORT / SIMILARITY)
#: Nodes that one copy of their pivot's text serves.
SHARE = 256
#: Open texts of a group that are compared with all others of it one by one.
FEW = 4


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of all rows, and where each row's begin."""
    a, b, first = words(data, offsets)
    w = Rolling(data)(a, b)
    count = np.diff(first)
    sizes = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    where = np.concatenate(([0], np.cumsum(sizes)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(row)) - where[row] + first[row]
    h = Rolling(w)(start, np.minimum(start + SHINGLE, first[row + 1]))
    # The label: how many equal shingles stand before it in its row.
    order = np.lexsort((np.arange(len(h)), h, row))
    sh, sr = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])
    place = np.arange(len(h))
    label = np.empty(len(h), dtype=np.uint64)
    label[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return mix(h + label * np.uint64(0x9E3779B97F4A7C15)), where


def sketches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of shingles of all rows, and BANDS tuple hashes of each row that has any."""
    h, where = shingles(data, offsets)
    rows = np.flatnonzero(np.diff(where))
    at = where[rows]
    if not len(rows):
        return np.diff(where), np.zeros((0, BANDS), dtype=np.int64)
    size = np.diff(where)[rows]
    place = (np.arange(len(h)) - np.repeat(at, size)).astype(np.uint64)
    low = np.uint64((1 << 26) - 1)
    out = np.empty((len(rows), BANDS), dtype=np.uint64)
    worst = np.uint64((1 << 64) - 1)
    for k in range(BANDS):
        # High bits rank the shingle, low bits hold its place.
        g = (mix(h ^ mix(np.array([k + 1], dtype=np.uint64))) & ~low) | (place & low)
        found = []
        for _ in range(KEEP):
            least = np.minimum.reduceat(g, at)
            found.append(least)
            g[(at + (least & low).astype(np.int64))[least != worst]] = worst
        found = np.stack(found, axis=1)
        where_found = np.where(found == worst, low, found & low)
        in_text = np.take_along_axis(found, np.argsort(where_found, axis=1, kind="stable"), axis=1)
        key = np.full(len(rows), k + 1, dtype=np.uint64)
        for c in range(KEEP):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + (in_text[:, c] & ~low))
        out[:, k] = key
    return np.diff(where), out.view(np.int64)


def aligned(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences without repeats, places within the band that SIMILARITY allows."""
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    band = max(len(x), len(y)) - int(np.ceil(min(len(x), len(y)) * SIMILARITY))
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        return len(j)
    tails: list[int] = []
    for v in j.tolist():
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y) or min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    n = aligned(x, y)
    return n >= SIMILARITY * (len(x) + len(y) - n)


def digest(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def number(doc_id: str = "doc_id"):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int64()))


def keys(docs: DataFrame) -> DataFrame:
    """(id, node, n, sketch, listed) of all rows: the id, the text's digest, its number of shingles, its tuple hashes (more than SHORT shingles) and all its shingles (up to LISTED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text", 2 << 20):
            n, hashes = sketches(data, offsets)
            all_of_them, _ = shingles(data, offsets)
            listed = lists(all_of_them[np.repeat(n <= LISTED, n)].view(np.int64), np.where(n <= LISTED, n, 0))
            sketch = lists(hashes[n[n > 0] > SHORT].ravel(), np.where(n > SHORT, BANDS, 0))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("node"), pa.array(n, pa.int64()), sketch, listed], names=["id", "node", "n", "sketch", "listed"])

    return docs.select(number().alias("id"), digest().alias("node"), "text").mapInArrow(run, "id long, node string, n long, sketch array<long>, listed array<long>")


def comparable(n: str, m: str):
    """Whether two lengths allow SIMILARITY."""
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def first_shingles(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Those of x, shingles that the pivot lacks before the others, of which a similar text must have one."""
    has = np.isin(x, pivot)
    return np.concatenate((np.sort(x[~has]), np.sort(x[has])))[: int(len(x) * (1 - SIMILARITY) + 1e-9) + 1]


def compared(pairs: DataFrame, n: int, texts: DataFrame) -> DataFrame:
    """(node, pivot, linked, n, first) of n pairs (node, pivot, wide): n is the node's length; first (empty unless wide) its first shingles.

    A pivot of many nodes has its text sent once for each SHARE of them.
    """
    parts = fitted(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / SHARE).alias("parts")), n)
    of_pivot = texts.withColumnRenamed("node", "pivot").join(parts, "pivot").select("pivot", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.col("text").alias("y"))
    dealt = fitted(pairs.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")), n)
    both = dealt.join(texts.withColumnRenamed("text", "x"), "node").join(of_pivot, ["pivot", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                once = rows.column("pivot").dictionary_encode()
                of, row = once.indices.to_numpy(), np.unique(once.indices.to_numpy(), return_index=True)[1]
                (x, xs), (y, ys) = (shingles(d, o) for c, some in (("x", rows), ("y", rows.take(pa.array(row)))) for _, d, o in slices([some], c, 1 << 60))
                both = [(x[xs[k] : xs[k + 1]], y[ys[of[k]] : ys[of[k] + 1]]) for k in range(rows.num_rows)]
                linked = pa.array([similar(a, b) for a, b in both])
                first = [first_shingles(a, b) if w else a[:0] for (a, b), w in zip(both, rows.column("wide").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("node"), rows.column("pivot"), linked, pa.array(np.diff(xs), pa.int64()), lists(np.concatenate(first).view(np.int64), np.array([len(f) for f in first]))],
                    names=["node", "pivot", "linked", "n", "first"],
                )

    return both.select("node", "pivot", "wide", "x", "y").mapInArrow(run, "node string, pivot string, linked boolean, n long, first array<long>")


def prefixes(reps: DataFrame) -> DataFrame:
    """(node, key) of the shingles of texts up to LISTED of which similar texts share one: all but ceil(SIMILARITY * n) - 1, rarest first."""
    own = reps.select("node", "n", F.explode("listed").alias("key"))
    often = own.groupBy("key").agg(F.count("*").alias("times"))
    ranked = own.join(often, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("ranked"))
    needed = F.expr(f"cast(n - ceil({SIMILARITY} * n - 1e-9) + 1 as int)")
    return ranked.select("node", F.explode(F.slice("ranked", F.lit(1), needed)).alias("one")).filter("one.times > 1").select("node", "one.key")


def groups(reps: DataFrame) -> DataFrame:
    """(key, node, n, size) of all groups of two and more texts that share a band or, of short ones, a shingle of their prefixes."""
    members = reps.select("node", "n", F.explode("sketch").alias("key")).unionByName(prefixes(reps).join(reps.select("node", "n"), "node").select("node", "n", "key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return members.join(sizes, "key")


def relabelled(labels: DataFrame, nodes: int, found: DataFrame, n: int) -> DataFrame:
    """Every text takes the best label among its neighbours' and its own, twice; so equal labels mean connected."""
    ends = found.unionByName(found.select(F.col("pivot").alias("node"), F.col("node").alias("pivot")))
    for _ in range(2):
        near = fitted(ends.join(labels.select(F.col("node").alias("pivot"), "label"), "pivot"), 2 * n)
        best = fitted(near.groupBy("node").agg(F.max("label").alias("best")), 2 * n)
        labels = fitted(labels.join(best, "node", "left").select("node", "rank", F.greatest("label", F.coalesce("best", "label")).alias("label")), nodes)
    return fitted(written(labels), nodes)


def differences(first: DataFrame) -> DataFrame:
    """(key, node, most, n, open): texts that share one of their first shingles besides a pivot, one of them not linked with it (open). Their partners have `most` shingles at the most."""
    wide = first.filter(F.size("first") > 0)
    rows = wide.join(wide.filter("not linked").select("pivot").distinct(), "pivot", "left_semi")
    rows = rows.select("node", "pivot", "n", (~F.col("linked")).alias("open"), F.posexplode("first").alias("place", "shingle"))
    rows = rows.select(F.xxhash64("pivot", "shingle").alias("key"), "node", "n", "open", F.floor(F.expr(f"(n - place) * {(1 + SIMILARITY) / SIMILARITY} - n + 1e-6")).alias("most"))
    open_most, open_n = (F.when(F.col("open"), F.col(c)) for c in ("most", "n"))
    shared = rows.groupBy("key").agg(F.count("*").alias("times"), F.max(open_most).alias("most_open"), F.min(open_n).alias("least_open"), F.max("most").alias("most_any"), F.min("n").alias("least_any"))
    # Only open texts whose lengths fit any, and others that fit an open one stay; nearly all shingles of the pivot itself go here.
    fits = F.expr("n <= most_open and least_open <= most or open and n <= most_any and least_any <= most")
    return rows.join(shared.filter("times > 1 and most_open is not null"), "key").filter(fits).select("key", "node", "n", "most", "open")


def mixed(known: DataFrame, n: int) -> DataFrame:
    """(key, node, rank, n, label, most, open) of the groups with several labels and an open text; groups of the same texts are one."""
    same = F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64(F.lit(1), "node")))
    of = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("open").alias("any"), same.alias("same")).filter("low != high and any").select("key", "same")
    rows = fitted(known.join(fitted(of, n), "key"), n)
    return fitted(rows.groupBy(F.col("same").alias("key"), "node").agg(*(F.first(c).alias(c) for c in ("rank", "n", "label")), *(F.max(c).alias(c) for c in ("most", "open"))), n)


def links(docs: DataFrame, reps: DataFrame) -> tuple[DataFrame, int]:
    """(node, pivot) of linked texts and their number; reps holds (node, rep, n, sketch, listed) of each text with words."""
    members, n_members = counted(groups(reps))
    scores = fitted(members.groupBy("node").agg(F.sum("size").alias("score"), F.first("n").alias("n")), n_members)
    facts, n_nodes = counted(scores.join(reps.select("node", "rep"), "node"))
    texts = docs.select(number().alias("rep"), digest().alias("node"), "text").join(facts.select("rep", "node"), ["rep", "node"]).dropDuplicates(["node"])
    texts = cut(texts.select("node", "text"))
    labels = facts.select("node", F.struct("score", "node", "n").alias("rank")).withColumn("label", F.col("rank"))

    # All texts of a group with its pivot. In groups of three and more what parts them from it is kept.
    members = fitted(members.select("key", "node", "size").join(labels.select("node", "rank"), "node"), n_members)
    pivots = fitted(members.groupBy("key").agg(F.max("rank").alias("pivot")), n_members)
    star = fitted(members.join(pivots, "key").filter("node != pivot.node"), n_members).groupBy("node", "pivot", "rank.n").agg(F.max(F.col("size") > 2).alias("wide"))
    star, n_star = counted(star.filter(F.col("wide") | comparable("n", "pivot.n")).select("node", F.col("pivot.node").alias("pivot"), "wide"))
    first = cut(compared(star, n_star, texts))
    found = fitted(first.filter("linked").select("node", "pivot"), n_star)
    labels = relabelled(labels, n_nodes, found, n_star)

    # Texts that share a difference with one of them, if they are not connected yet.
    rest, n_rest = counted(differences(first))
    if not n_rest:
        return found, n_star
    known = fitted(rest.join(labels, "node"), n_rest)
    leads = known.groupBy("key").agg(F.max(F.struct("rank", "label")).alias("lead"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key", "lead")
    leads, n_leads = counted(leads)
    star = fitted(known.join(leads, "key").filter((F.col("label") != F.col("lead.label")) & comparable("n", "lead.rank.n")), n_rest).select("node", F.col("lead.rank.node").alias("pivot")).distinct()
    star, n_star_2 = counted(star.withColumn("wide", F.lit(False)))
    second = fitted(cut(compared(star, n_star_2, texts).filter("linked").select("node", "pivot")), n_star_2)
    labels = relabelled(labels, n_nodes, second, n_star_2)

    # What is not connected after that: from one pivot to the next while that halves the pairs that are left, these pair by pair.
    known = fitted(rest.join(labels, "node"), n_rest).join(leads.select("key", F.col("lead.rank.node").alias("lead")), "key").filter("node != lead").drop("lead")
    found, n_found, before = found.unionByName(second), n_star + n_star_2, None
    while True:
        known, n_known = counted(mixed(known, n_rest))
        if not n_known:
            return found, n_found
        sizes = fitted(known.groupBy("key").agg(F.sum(F.col("open").cast("long")).alias("opens"), F.count("*").alias("size"), F.max("rank").alias("lead")), n_known)
        left = sizes.agg(F.sum(F.expr("opens * size")).alias("pairs")).first().pairs
        by_pairs = left <= n_members or before is not None and 2 * left > before
        known = fitted(known.join(sizes.select("key", "lead", (F.lit(by_pairs) | (F.col("opens") <= FEW)).alias("few")), "key"), n_known)
        before = left
        x, y = (known.filter("few").select("key", *(F.col(c).alias(f"{c}_{end}") for c in ("node", "n", "most", "open", "label"))) for end in "xy")
        pairs = x.filter("open_x").join(y, (x.key == y.key) & F.expr("label_x != label_y and n_y <= most_x and n_x <= most_y and not (open_y and node_y > node_x)")).filter(comparable("n_x", "n_y"))
        pairs = fitted(pairs.select(F.col("node_x").alias("node"), F.col("node_y").alias("pivot"), F.lit(False).alias("wide")), n_known)
        star = known.filter("not few and node != lead.node").select("node", F.col("lead.node").alias("pivot"), F.lit(True).alias("wide"))
        both, n_both = counted(pairs.unionByName(star).groupBy("node", "pivot").agg(F.max("wide").alias("wide")))
        first = written(compared(both, n_both, texts))
        more = fitted(first.filter("linked").select("node", "pivot"), n_both)
        found, n_found = found.unionByName(more), n_found + n_both
        labels = relabelled(labels, n_nodes, more, n_both)
        rest, n_rest = counted(differences(first))
        known = fitted(rest.join(labels, "node"), n_rest)


def components(found: DataFrame, n: int) -> DataFrame:
    """(node, label) of all nodes of n links: labels fall to the smallest of the neighbours and of the label's label until nothing changes."""
    found = found.toDF("a", "b")
    edges, n = counted(found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = fitted(cut(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))), n)
    while True:
        near = fitted(fitted(edges.join(labels, edges.b == labels.node), n).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")), n)
        stepped = fitted(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), n)
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = fitted(cut(stepped.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label"))), n)
        labels = new.select("node", "label")
        if new.filter("label != was").isEmpty():
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """(id, node, class_id, class) of every row; `class` tells classes apart that have one doc_id as their smallest."""
    rows = cut(keys(docs))
    reps = cut(rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("listed").alias("listed")))
    labels = components(*links(docs, reps))
    of_text = reps.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = of_text.groupBy("label").agg(F.min("rep").alias("class_id"))
    of_text = of_text.join(smallest, "label").select("node", "class_id", "label")
    alone = F.concat_ws(" ", "node", F.col("id").cast("string"))
    return rows.select("id", "node").join(of_text, "node", "left").select("id", "node", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("label", alone).alias("class"))


def kept(rows: DataFrame) -> DataFrame:
    """(id, node, times) of the one document of each class that stays, and how many equal rows it stands in."""
    same = rows.filter("id = class_id").groupBy("class", "id", "node").agg(F.count("*").alias("times"))
    return same.groupBy("class").agg(F.min(F.struct("node", "id", "times")).alias("one")).select("one.id", "one.node", "one.times")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and whether the row is the one of its class that stays."""
    none = F.lit((1 << 63) - 1)
    rows = cut(classes(docs.select("doc_id", "text")).groupBy("id", "node", "class_id", "class").agg(F.count("*").alias("times")))
    stays = kept(rows).select("id", "node", F.lit(True).alias("stays"))
    each = rows.join(stays, ["id", "node"], "left").select("*", F.explode(F.expr("sequence(1, times)")).alias("copy"))
    return each.select(F.when(F.col("id") != none, F.col("id")).alias("doc_id"), F.when(F.col("class_id") != none, F.col("class_id")).alias("class_id"), (F.col("stays").isNotNull() & (F.col("copy") == 1)).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns; of equal rows that differ in other columns any."""
    original, docs = docs.columns, shield(docs, "doc_id", "text")
    stay = cut(kept(classes(docs))).select(F.col("id").alias("_id"), F.col("node").alias("_node"), "times")
    marked = docs.withColumns({"_id": number(), "_node": digest()})
    single = marked.join(stay.filter("times = 1"), ["_id", "_node"], "left_semi")
    several = marked.join(stay.filter("times > 1"), ["_id", "_node"], "left_semi").dropDuplicates(["_id", "_node"])
    return unshield(single.unionByName(several), original)
