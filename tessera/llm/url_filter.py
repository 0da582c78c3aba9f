"""URL filters by a Bloom filter cascade.

Level 0 is a Bloom filter of the listed keys, level 1 one of those other keys of the corpus that pass level 0, level 2
one of the listed keys that pass level 1, and so on until nothing passes wrongly. Walking down the levels then answers
exactly for every key of the universe, the complete set of keys that occur in the corpus, and needs no join.

Keys are dealt to shards by hash, each small enough for one task to build its cascade; filters are broadcast in blocks
of shards of at most BLOCK_BYTES, one probing pass for each block.

Defined results: a null url, or one without `://`, has empty host and path and no keys; other columns are ignored;
repeated rows are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import cut
from tessera.llm.text import mix

SHARD_KEYS = 500_000
BLOCK_BYTES = 64 << 20

#: The query's rules, and the words that get a host onto its block list.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
BLOCK_WORDS = ["casino", "pills", "spam", "warez"]


def bits_of(keys: np.ndarray, level: int, size: int, hashes: int) -> np.ndarray:
    """Bit positions, one row for each hash, of keys given as two 64-bit hashes each."""
    a, b = mix(keys[:, 0] ^ mix(np.array([level + 1], dtype=np.uint64))), mix(keys[:, 1] + np.uint64(level)) | np.uint64(1)
    return np.stack([(mix(a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64) for i in range(hashes)])


class Bloom:
    def __init__(self, level: int, size: int, hashes: int, data: np.ndarray):
        self.level, self.size, self.hashes, self.data = level, size, hashes, data

    @classmethod
    def build(cls, keys: np.ndarray, level: int, rate: float) -> Bloom:
        hashes = max(1, round(-np.log2(rate)))
        size = max(64, int(np.ceil(-len(keys) * np.log(rate) / np.log(2) ** 2)))
        flags = np.zeros(-(-size // 8) * 8, dtype=bool)
        flags[bits_of(keys, level, size, hashes).ravel()] = True
        return cls(level, size, hashes, np.packbits(flags, bitorder="little"))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = bits_of(keys, self.level, self.size, self.hashes)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


SCHEMA = "shard int, level int, size long, hashes int, data binary"


def as_rows(shard: int, filters: list[Bloom]) -> pa.Table:
    return pa.table({
        "shard": pa.array([shard] * len(filters), pa.int32()),
        "level": pa.array([f.level for f in filters], pa.int32()),
        "size": pa.array([f.size for f in filters], pa.int64()),
        "hashes": pa.array([f.hashes for f in filters], pa.int32()),
        "data": pa.array([f.data.tobytes() for f in filters], pa.binary()),
    })


def pairs(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2")], axis=1)


def first_rate(listed: int, others: int) -> float:
    """The false-positive rate of level 0 that keeps the whole cascade small; deeper levels take 1/2."""
    return min(0.5, max(listed, 1) / max(others, 1) / np.sqrt(2))


def hashed(keys: DataFrame, shards: int) -> DataFrame:
    keys = keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    return keys.withColumn("shard", F.pmod(F.col("h2"), F.lit(shards)).cast("int"))


def blocks(filters: DataFrame) -> list[list[int]]:
    """The shards in groups whose filters have BLOCK_BYTES at most."""
    out, held = [[]], 0
    for r in filters.groupBy("shard").agg(F.sum(F.octet_length("data")).alias("n")).orderBy("shard").toLocalIterator():
        if held + r.n > BLOCK_BYTES and out[-1]:
            out, held = [*out, []], 0
        out[-1].append(r.shard)
        held += r.n
    return [b for b in out if b]


def loaded(filters: DataFrame, shards: list[int]) -> dict[int, list[Bloom]]:
    got: dict[int, list[Bloom]] = {}
    for r in filters.filter(F.col("shard").between(shards[0], shards[-1])).orderBy("shard", "level").toLocalIterator():
        got.setdefault(r.shard, []).append(Bloom(r.level, r.size, r.hashes, np.frombuffer(r.data, dtype=np.uint8)))
    return got


def walk(filters: dict[int, list[Bloom]], keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Whether each key is listed, for the shards at hand (False for others)."""
    out = np.zeros(len(keys), dtype=bool)
    for s in np.unique(shard):
        if s not in filters:
            continue
        mine = np.flatnonzero(shard == s)
        for k, level in enumerate(filters[s]):
            mine = mine[level.has(keys[mine])]
            out[mine] = k % 2 == 0
    return out


def build(listed: DataFrame, universe: DataFrame) -> tuple[DataFrame, int]:
    """The cascade as rows of filters, written once, and the number of shards. Both inputs have distinct keys in `key`; the universe may contain listed keys."""
    n_listed, n_universe = listed.count(), universe.count()
    shards = max(1, -(-n_listed // SHARD_KEYS))
    rate = first_rate(n_listed, n_universe)
    mine = hashed(listed, shards)
    level0 = cut(mine.groupBy("shard").applyInArrow(lambda key, table: as_rows(key[0].as_py(), [Bloom.build(pairs(table), 0, rate)]), SCHEMA))
    others = hashed(universe.join(listed, "key", "left_anti"), shards)
    parts = blocks(level0)
    for block in parts:
        others = passing(others, loaded(level0, block), block)
        others = cut(others) if len(parts) > 1 else others  # one block of filters at a time

    def deeper(key, left: pa.Table, right: pa.Table) -> pa.Table:
        inside, outside = pairs(left), pairs(right)
        filters, level = [], 1
        while len(outside):
            filters.append(Bloom.build(outside, level, 0.5))
            inside, outside = outside, inside[filters[-1].has(inside)]
            level += 1
        return as_rows(key[0].as_py(), filters)

    rest = mine.groupBy("shard").cogroup(others.groupBy("shard")).applyInArrow(deeper, SCHEMA)
    return cut(level0.unionByName(rest)), shards


def passing(keys: DataFrame, level0: dict[int, list[Bloom]], block: list[int]) -> DataFrame:
    """The keys but for those of the block's shards that their level 0 turns down."""
    held = keys.sparkSession.sparkContext.broadcast(level0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            shard = rows.column("shard").to_numpy()
            yield rows.filter(pa.array(walk(held.value, pairs(rows), shard) | ~np.isin(shard, block)))

    return keys.mapInArrow(run, keys.schema)


def member(rows: DataFrame, keys: str, filters: DataFrame, shards: int, out: str = "listed") -> DataFrame:
    """Append for each row the array of flags that says which of its keys (array of strings, all of the universe) are listed."""
    rows = rows.withColumns({"_h1": F.transform(keys, lambda k: F.xxhash64(k)), "_h2": F.transform(keys, lambda k: F.xxhash64(F.lit(7), k)), out: F.transform(keys, lambda k: F.lit(False))})
    parts = blocks(filters)
    for block in parts:
        held = rows.sparkSession.sparkContext.broadcast(loaded(filters, block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                flat = np.stack([pa.compute.list_flatten(batch.column(c)).to_numpy().view(np.uint64) for c in ("_h1", "_h2")], axis=1)
                shard = (flat[:, 1].view(np.int64) % shards).astype(np.int64)
                lists = batch.column(out)
                flags = walk(held.value, flat, shard) | pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False).astype(bool)
                sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
                new = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flags))
                yield pa.RecordBatch.from_arrays([new if n == out else batch.column(n) for n in names], names=names)

        rows = rows.mapInArrow(run, rows.schema)
        if len(parts) > 1:  # one block of filters at a time
            rows = cut(rows)
            held.unpersist()
    return rows.drop("_h1", "_h2")


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def candidates(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """page_id, host, path and keys: every host suffix with every path prefix that is as long as a rule's path, longest first, and the host itself."""
    lengths = sorted({len(r) - r.index("/") for r in rules})
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    suffixes = "transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', i))".replace("substring_index(host, '.', i)", "substring_index(host, '.', -i)")
    prefixes = "filter(array(" + ", ".join(str(n) for n in lengths) + "), n -> n <= char_length(path))"
    keys = f"flatten(transform({suffixes}, h -> transform({prefixes}, n -> concat(h, substring(path, 1, n)))))"
    ordered = f"array_sort({keys}, (a, b) -> if(char_length(a) = char_length(b), if(a < b, -1, if(a > b, 1, 0)), char_length(b) - char_length(a)))"
    return rows.withColumn("keys", F.expr(f"if(host = '', cast(array() as array<string>), concat({ordered}, array(host)))"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, block_words: list[str] = BLOCK_WORDS, hosts: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, the longest rule that fits, and the verdict: the rule's, else block for listed hosts.

    Listed are the rules, those hosts of the corpus that contain a block word, and those that stand in a list of any size (hosts, a column `host`).
    """
    rows = candidates(pages, rules)
    universe = cut(rows.select(F.explode("keys").alias("key")).distinct())
    spec = universe.sparkSession.createDataFrame([(r,) for r in sorted(rules)], "key string")
    words = "|".join(block_words)
    listed = cut(universe.filter(~F.contains("key", F.lit("/")) & F.col("key").rlike(words)).unionByName(spec))
    if hosts is not None:
        named = universe.join(hosts.select(F.lower("host").alias("key")).filter("key is not null"), "key", "left_semi")
        listed = cut(listed.unionByName(named).distinct())
    filters, shards = build(listed, universe)
    found = member(rows, "keys", filters, shards).withColumn("hits", F.expr("filter(keys, (k, i) -> listed[i])"))
    found = found.withColumn("rule", F.expr("get(filter(hits, k -> contains(k, '/')), 0)"))
    actions = F.create_map(*(F.lit(x) for pair in sorted(rules.items()) for x in pair))
    return found.select("page_id", "host", "path", "rule", F.coalesce(F.try_element_at(actions, F.col("rule")), F.when(F.size("hits") > 0, "block").otherwise("allow")).alias("verdict"))


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
p AS (SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, host, path, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host, 'casino|pills|spam|warez') THEN 'block' ELSE 'allow' END) AS verdict FROM m WHERE k = 1
"""
