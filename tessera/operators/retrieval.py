"""Full-text and vector retrieval: postings, BM25, the keyword ladder, exact neighbours, fused ranks, evidence and metrics.

Queries are the benchmark items, a stated set. Their terms are counted before they are broadcast to the texts, so a
common word is no hot key; query vectors are broadcast in blocks and each Arrow batch of vectors keeps its best rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.hashing import embedder, fact_hash
from tessera.functions.text import HAN, TERMS_SQL, han_tokens, rrf, terms
from tessera.operators.containment import contained
from tessera.sources.checkpoints import cut, written
from tessera.sources.tables import table

#: Fixed values of the retrieval rules.
LEG_WINDOW, RRF_K, WEIGHT_SEMANTIC, WEIGHT_KEYWORD = 60, 60, 2.0, 1.0
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
LEAST_PREFIX = 3
#: Query terms that are broadcast, and query vectors in a block.
MOST_BROADCAST, BLOCK_VECTORS = 200_000, 4096
#: Pairs of a word of the corpus and a query term that it starts with, that are broadcast.
MOST_HEADS = 1_000_000
#: Products of a query and a vector that a task holds at once.
CELLS = 1 << 21
#: Scored rows, one for a term of an item in a document, that a task adds up.
SCORED_ROWS = 4_000_000
STAGES = ("precision", "prefix", "bigram", "substring")


@dataclass(frozen=True)
class Legs:
    """Which legs of a hybrid search run, and their weights."""

    semantic: bool = True
    keyword: bool = True
    w_semantic: float = WEIGHT_SEMANTIC
    w_keyword: float = WEIGHT_KEYWORD

    def weights(self) -> tuple[float, float]:
        """The weights in force: 0 for a leg that is off; a leg that is on needs a positive finite one."""
        out = []
        for name, on, w in (("semantic", self.semantic, self.w_semantic), ("keyword", self.keyword, self.w_keyword)):
            if not math.isfinite(w) or on and w <= 0:
                raise ValueError(f"weight of the {name} leg: {w}")
            out.append(w if on else 0.0)
        return out[0], out[1]

    def label(self) -> str:
        s, k = self.weights()
        return f"rrf(k={RRF_K},w_sem={s:g},w_kw={k:g})"

    def disabled(self) -> list[str]:
        return [name for name, on in (("semantic", self.semantic), ("keyword", self.keyword)) if not on]


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has been counted and is small enough."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, dl, tf)."""
    words = docs.select("doc_id", terms(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return words.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


POSTINGS_SQL = f"""toks AS (SELECT doc_id, {TERMS_SQL} AS t FROM documents),
posts AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL)"""


def recallable(term: Column) -> Column:
    """Terms that may match as a prefix: all but ASCII ones of fewer than three characters."""
    return (F.char_length(term) >= LEAST_PREFIX) | ~term.rlike(r"^[\x00-\x7F]*$")


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): all distinct terms of each item."""
    return items.select("item_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


QUERY_SQL = f"q AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark)"


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, t): the words of each document and their number."""
    return docs.select("doc_id", terms(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), "t")


def cut_to(word: str, lengths: list[int]) -> Column:
    """A word cut to those lengths that it has."""
    return F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length(word)), lambda n: F.substring(word, F.lit(1), n))


def term_hits(sized: DataFrame, queries: DataFrame, prefix: bool = False) -> DataFrame:
    """(doc_id, dl, term, tf) of tokens(): how often each query term stands in each document, or how many words start with it; one row with an empty term for every document. Written once."""
    wanted = queries.select("term").distinct()
    words = sized.select("doc_id", "dl", F.explode(F.concat("t", F.array(F.lit("")))).alias("term"))
    ends = queries.sparkSession.createDataFrame([("",)], "term string")
    if prefix:
        # Words are cut to those lengths only that query terms have; each word once, unless too many start with a term.
        lengths = [r.n for r in wanted.select(F.char_length("term").alias("n")).distinct().orderBy("n").collect()]
        wanted = small(cut(wanted))
        heads = cut(words.filter("term != ''").select(F.col("term").alias("word")).distinct().select("word", F.explode(cut_to("word", lengths)).alias("term")).join(wanted, "term"))
        if heads.limit(MOST_HEADS + 1).count() <= MOST_HEADS:
            heads = heads.unionByName(ends.select(F.col("term").alias("word"), "term"))
            found = words.withColumnRenamed("term", "word").join(F.broadcast(heads), "word")
        else:
            cuts = words.filter("term != ''").select("doc_id", "dl", F.explode(cut_to("term", lengths)).alias("term"))
            found = cuts.join(wanted, "term").unionByName(sized.select("doc_id", "dl", F.lit("").alias("term")), allowMissingColumns=True)
    else:
        found = words.join(small(cut(wanted.unionByName(ends))), "term")
    return cut(found.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")))


def scored(hits: DataFrame, queries: DataFrame, whole: bool = False) -> DataFrame:
    """(item_id, doc_id, score, n_terms): BM25 of the query terms that stand tf times in documents; terms in over half of the documents weigh LEAST_IDF.

    Hits are dealt by document to as many tasks as their scored rows need, which are known from the documents that hold each term; so a task's sums are bounded, and need no exchange of their own.
    whole: only documents that hold all terms of the item; they are among those that hold its rarest one, and only these are scored (all are, if documents of different lengths share an id).
    """
    stats = hits.filter("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    held = hits.filter((F.col("term") != "") & (F.col("tf") > 0))
    df = held.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weighed = cut(queries.join(df, "term").select("item_id", "term", idf.alias("idf"), "mean", "df"))
    w = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    total = [F.round(F.sum(w), 9).alias("score"), F.count("*").alias("n_terms")]
    deal = lambda n: max(queries.sparkSession.sparkContext.defaultParallelism, -(-n // SCORED_ROWS))
    if whole and hits.filter("term = ''").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        asked = queries.groupBy("item_id").agg(F.count("*").alias("n"))
        rarest = weighed.groupBy("item_id").agg(F.min(F.struct("df", "term")).alias("r"), F.count("*").alias("known")).join(asked, "item_id").filter("known = n")
        rarest = cut(rarest.select("item_id", "n", F.col("r.term").alias("term"), F.col("r.df").alias("df")))
        parts = deal(rarest.agg(F.sum(F.col("df") * F.col("n")).alias("n")).first().n or 0)
        near = held.join(small(rarest.select("item_id", "n", "term")), "term").select("item_id", "n", "doc_id")
        near = near.join(small(weighed.drop("df")), "item_id").withColumnsRenamed({"doc_id": "of", "term": "word"})
        rows = near.join(held, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("word") == F.col("term")))
        return rows.repartition(parts, "doc_id").groupBy("item_id", "doc_id", "n").agg(*total).filter("n_terms = n").drop("n")
    parts = deal(weighed.agg(F.sum("df").alias("n")).first().n or 0)
    every = held.repartition(parts, "doc_id").join(small(weighed.drop("df")), "term").groupBy("item_id", "doc_id").agg(*total)
    return every.join(small(cut(queries.groupBy("item_id").agg(F.count("*").alias("n")))), "item_id").filter("n_terms = n").drop("n") if whole else every


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    return scored(term_hits(tokens(docs), queries), queries)


def score_sql(count: str, hits: str, name: str) -> str:
    return f"""{name}_df AS (SELECT term, count(*) AS df FROM {hits} GROUP BY term),
{name} AS (SELECT item_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), {LEAST_IDF}) * {count} * {K1 + 1} / ({count} + {K1} * (1 - {B} + {B} * dl / mean))), 9) AS score, count(*) AS n_terms
  FROM q JOIN {hits} USING (term) JOIN {name}_df USING (term), st GROUP BY item_id, doc_id)"""


BM25_SQL = f"""{POSTINGS_SQL},
{QUERY_SQL},
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
{score_sql("tf", "posts", "bm")}"""


def ranked(rows: DataFrame, by: str, order: list, top: int) -> DataFrame:
    """The `top` first rows of each group with their rank from 0; written so that Spark drops the others before the exchange."""
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("place") <= top)
    return rows.withColumn("rank", (F.col("place") - 1).cast("long")).drop("place")


def han_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf) of query terms all in Han, two characters or longer: places where all their character pairs follow each other, found by the first pair."""
    wanted = queries.filter(F.col("term").rlike(f"^{HAN}{{2,}}$")).select("term", F.substring("term", 1, 2).alias("token")).distinct()
    tokens = docs.select("doc_id", "text", han_tokens(F.coalesce("text", F.lit(""))).alias("t")).filter(F.col("text").rlike(HAN))
    near = tokens.select("doc_id", F.size("t").alias("dl"), "text", F.explode(F.array_distinct("t")).alias("token")).join(small(wanted), "token")
    count = F.floor((F.char_length("text") - F.char_length(F.expr("replace(text, term, '')"))) / F.char_length("term"))
    return near.select("doc_id", "dl", "term", count.alias("tf")).filter("tf > 0")


def keyword_stages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, stage, score): the first stage that finds anything for an item, of all its terms, any term as a prefix, Han pairs, and any term as a substring (score 0)."""
    queries = cut(query_terms(items))
    sized = written(tokens(docs))
    precise = cut(scored(term_hits(sized, queries), queries, whole=True).select("item_id", "doc_id", F.lit(STAGES[0]).alias("stage"), "score"))
    open_ = cut(queries.join(precise.select("item_id").distinct(), "item_id", "left_anti"))
    if open_.isEmpty():
        return precise
    recalled = open_.filter(recallable(F.col("term")))
    prefix = cut(scored(term_hits(sized, recalled, prefix=True), recalled).select("item_id", "doc_id", F.lit(STAGES[1]).alias("stage"), "score"))
    open_ = cut(open_.join(prefix.select("item_id").distinct(), "item_id", "left_anti"))
    found = precise.unionByName(prefix)
    if open_.isEmpty():
        return found
    totals = docs.select(F.size(han_tokens(F.coalesce("text", F.lit("")))).alias("dl")).select(F.lit(None).cast("long").alias("doc_id"), "dl", F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"))
    pairs = cut(scored(cut(han_hits(docs, open_).unionByName(totals)), open_).select("item_id", "doc_id", F.lit(STAGES[2]).alias("stage"), "score"))
    found = found.unionByName(pairs)
    open_ = cut(open_.join(pairs.select("item_id").distinct(), "item_id", "left_anti").filter(recallable(F.col("term"))))
    if open_.isEmpty():
        return found
    inside = contained(docs.select(F.col("doc_id").alias("query"), F.lower("text").alias("text")), open_.select(F.col("item_id").alias("id"), F.col("term").alias("name")))
    return found.unionByName(inside.select(F.col("id").alias("item_id"), F.col("query").alias("doc_id"), F.lit(STAGES[3]).alias("stage"), F.lit(0.0).alias("score")))


LADDER_SQL = f"""{BM25_SQL},
size AS (SELECT item_id, count(*) AS n_q FROM q GROUP BY item_id),
precise AS (SELECT item_id, doc_id, 'precision' AS stage, score FROM bm JOIN size USING (item_id) WHERE n_terms = n_q),
heads AS (SELECT DISTINCT p.word, q.term FROM (SELECT DISTINCT term AS word FROM posts) p JOIN q ON starts_with(p.word, q.term) WHERE length(q.term) >= {LEAST_PREFIX} OR NOT regexp_full_match(q.term, '[\\x00-\\x7F]*')),
starts AS (SELECT heads.term, doc_id, dl, sum(tf) AS n_starts FROM posts JOIN heads ON posts.term = word GROUP BY ALL),
{score_sql("n_starts", "starts", "pre")},
prefix AS (SELECT item_id, doc_id, 'prefix' AS stage, score FROM pre WHERE item_id NOT IN (SELECT item_id FROM precise)),
inside AS (SELECT DISTINCT item_id, doc_id, 'substring' AS stage, 0.0::DOUBLE AS score FROM q JOIN documents ON contains(lower(text), term)
  WHERE length(term) >= {LEAST_PREFIX} AND item_id NOT IN (SELECT item_id FROM precise UNION ALL SELECT item_id FROM prefix)),
kw AS (SELECT * FROM precise UNION ALL SELECT * FROM prefix UNION ALL SELECT * FROM inside)"""
KEYWORD_LEG_SQL = f"""{LADDER_SQL},
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM kw) WHERE rank < {LEG_WINDOW})"""


def keyword_leg(docs: DataFrame, items: DataFrame, top: int = LEG_WINDOW) -> DataFrame:
    return ranked(keyword_stages(docs, items), "item_id", [F.desc("score"), "doc_id"], top)


def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest BM25 over all terms of each item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked(bm25(docs, cut(query_terms(items))), "item_id", [F.desc("score"), "doc_id"], 10).select("item_id", "doc_id", "score", "rank")


FTS_SQL = f"""WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bm)
SELECT item_id, doc_id, score, rank FROM r WHERE rank < 10"""


def closest(q: np.ndarray, q_norm: np.ndarray, x: np.ndarray, norm: np.ndarray, top: int, cosine: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries and vectors and their exact values: the `top` best vectors of each query, and those that rounding could put among them; about CELLS products at a time."""
    step, k = max(1, CELLS // len(x)), min(top, len(x)) - 1
    for at in range(0, len(q), step):
        some, some_norm = q[at : at + step], q_norm[at : at + step, None]
        rough = some @ x.T
        rough = -rough / np.sqrt(some_norm * norm) if cosine else some_norm + norm - 2 * rough
        bar = np.partition(rough, k, axis=1)[:, k]
        item, row = np.nonzero(rough <= (bar + 2e-6 * (1 + np.abs(bar)))[:, None])
        item += at
        # Pairs of vectors are wide, and equal vectors may make many of them.
        for to in range(0, len(item), max(1, CELLS // x.shape[1])):
            i, r = (a[to : to + max(1, CELLS // x.shape[1])] for a in (item, row))
            yield i, r, (q[i] * x[r]).sum(axis=1) / np.sqrt(q_norm[i] * norm[r]) if cosine else ((x[r] - q[i]) ** 2).sum(axis=1)


def nearest(vectors: DataFrame, queries: DataFrame, top: int, cosine: bool = False, floor: float | None = None) -> DataFrame:
    """(item_id, vec_id, value, rank): for each query (item_id, q) the `top` vectors of least squared distance, or of greatest cosine (at the floor or above).

    Vectors of another length are skipped, with cosine those of length 0, too. Each batch is multiplied with a block of
    queries, some of them at a time; the best rows of a batch, and those that rounding could put among them, are then computed exactly.
    """
    asked = queries.select("item_id", F.col("q").cast("array<double>").alias("q")).filter("q is not null").orderBy("item_id").toArrow()
    by_size: dict[int, list[int]] = {}
    for k, n in enumerate(pc.list_value_length(asked.column("q")).to_pylist()):
        by_size.setdefault(n, []).append(k)
    out = None
    for size, rows in by_size.items():
        for at in range(0, len(rows), BLOCK_VECTORS):
            some = asked.take(rows[at : at + BLOCK_VECTORS]).combine_chunks()
            ids, matrix = some.column("item_id").to_numpy(), pc.list_flatten(some.column("q")).to_numpy().reshape(-1, size)
            held = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

            def run(batches: Iterator[pa.RecordBatch], held=held, size=size) -> Iterator[pa.RecordBatch]:
                ids, q = held.value
                if cosine:
                    good = np.linalg.norm(q, axis=1) > 0
                    ids, q = ids[good], q[good]
                q_norm = (q * q).sum(axis=1)
                for batch in batches:
                    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), size), False))
                    x, vec = pc.list_flatten(batch.column("embedding")).to_numpy().astype(np.float64).reshape(-1, size), batch.column("vec_id").to_numpy()
                    norm = (x * x).sum(axis=1)
                    if cosine:
                        x, vec, norm = x[norm > 0], vec[norm > 0], norm[norm > 0]
                    if not len(x) or not len(q):
                        continue
                    for item, row, exact in closest(q, q_norm, x, norm, top, cosine):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[item], pa.int64()), pa.array(vec[row], pa.int64()), pa.array(exact)], names=["item_id", "vec_id", "value"])

            part = vectors.select("vec_id", "embedding").mapInArrow(run, "item_id long, vec_id long, value double")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "item_id long, vec_id long, value double")
    out = out.withColumn("value", F.round("value", 6))
    if floor is not None:
        out = out.filter(F.col("value") >= floor)
    return ranked(out, "item_id", [F.desc("value") if cosine else F.asc("value"), "vec_id"], top)


def item_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those with the items' numbers as queries."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = table(spark, sf_dir, "benchmark").select("item_id")
    return vectors, vectors.join(asked, F.col("vec_id") == F.col("item_id")).select("item_id", F.col("embedding").alias("q"))


def vector_leg(spark: SparkSession, sf_dir: str, top: int = LEG_WINDOW) -> DataFrame:
    """(item_id, doc_id, distance, rank) of exact neighbours by squared distance."""
    return nearest(*item_vectors(spark, sf_dir), top).withColumnsRenamed({"vec_id": "doc_id", "value": "distance"})


VECTOR_SQL = """near AS (SELECT q.vec_id AS item_id, e.vec_id AS doc_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS distance
  FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
vec AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) - 1 AS rank FROM near)"""


def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_leg(spark, sf_dir, 10).select("item_id", "doc_id", "distance", "rank")


VECTOR_KNN_SQL = f"WITH {VECTOR_SQL} SELECT item_id, doc_id, distance, rank FROM vec WHERE rank < 10"


def fused(semantic: DataFrame, keyword: DataFrame, legs: Legs = Legs()) -> DataFrame:  # noqa: B008
    """Weighted reciprocal ranks with the evidence of both legs: rank and raw score by leg, stage, and relevance, 1 - distance / background between 0 and 1; a leg that is off adds nothing."""
    w_semantic, w_keyword = legs.weights()
    background = semantic.groupBy("item_id").agg(F.avg("distance").alias("background"))
    s = semantic.select("item_id", "doc_id", F.col("rank").alias("rank_semantic"), "distance").filter(F.lit(legs.semantic))
    k = keyword.select("item_id", "doc_id", F.col("rank").alias("rank_keyword"), F.col("score").alias("bm25"), "stage").filter(F.lit(legs.keyword))
    both = s.join(k, ["item_id", "doc_id"], "full").join(background, "item_id", "left")
    score = F.coalesce(w_semantic * rrf(F.col("rank_semantic"), RRF_K), F.lit(0.0)) + F.coalesce(w_keyword * rrf(F.col("rank_keyword"), RRF_K), F.lit(0.0))
    relevance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("distance") / F.col("background")))
    return both.withColumns({"fused": F.round(score, 9), "relevance": F.when(F.col("distance").isNotNull() & (F.col("background") > 0), F.round(relevance, 4)), "fusion": F.lit(legs.label())})


def search(spark: SparkSession, sf_dir: str, limit: int = 10, legs: Legs = Legs()) -> DataFrame:  # noqa: B008
    """The `limit` best documents of each item with all evidence. Legs are always LEG_WINDOW wide, so a longer page begins like a shorter one."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = fused(cut(vector_leg(spark, sf_dir)), cut(keyword_leg(docs, items)), legs)
    top = ranked(hits, "item_id", [F.desc("fused"), "doc_id"], limit)
    top = cut(top)
    # Of the documents only those found move.
    found = docs.select("doc_id", "source", "text").join(small(top.select("doc_id").distinct()), "doc_id")
    return top.join(found, "doc_id", "left")


def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each item by fused ranks, with evidence by leg, stage, relevance, and the document's source."""
    return search(spark, sf_dir).select("item_id", "doc_id", "rank", "fused", "rank_semantic", "rank_keyword", "stage", "bm25", "relevance", "fusion", "source", F.substring("text", 1, 80).alias("excerpt"))


HYBRID_CTE = f"""{KEYWORD_LEG_SQL},
{VECTOR_SQL},
s AS (SELECT * FROM vec WHERE rank < {LEG_WINDOW}),
bg AS (SELECT item_id, avg(distance) AS background FROM s GROUP BY item_id),
f AS (SELECT item_id, doc_id, s.rank AS rank_semantic, k.rank AS rank_keyword, k.stage, k.score AS bm25, distance, background,
  round(coalesce(2.0 / (61 + s.rank), 0) + coalesce(1.0 / (61 + k.rank), 0), 9) AS fused
  FROM s FULL JOIN k USING (item_id, doc_id) LEFT JOIN bg USING (item_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) - 1 AS rank FROM f)"""
HYBRID_SQL = f"""WITH {HYBRID_CTE}
SELECT item_id, doc_id, rank, fused, rank_semantic, rank_keyword, stage, bm25,
  CASE WHEN distance IS NOT NULL AND background > 0 THEN round(least(1.0, greatest(0.0, 1 - distance / background)), 4) END AS relevance, 'rrf(k=60,w_sem=2,w_kw=1)' AS fusion, source, substr(text, 1, 80) AS excerpt
FROM h LEFT JOIN documents USING (doc_id) WHERE rank < 10"""


def search_evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: hits by leg, hits of both, keyword hits that are no semantic hits, and the stage of the keyword leg."""
    s = vector_leg(spark, sf_dir).select("item_id", "doc_id", F.lit(1).alias("s"))
    k = keyword_leg(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "doc_id", F.lit(1).alias("k"), "stage")
    both = s.join(k, ["item_id", "doc_id"], "full")
    return both.groupBy("item_id").agg(
        F.count("s").alias("n_semantic"), F.count("k").alias("n_keyword"), F.count_if(F.col("s").isNotNull() & F.col("k").isNotNull()).alias("n_both"), F.count_if(F.col("s").isNull()).alias("keyword_new"), F.max("stage").alias("stage")
    )


EVIDENCE_SQL = f"""WITH {KEYWORD_LEG_SQL},
{VECTOR_SQL},
s AS (SELECT item_id, doc_id, 1 AS s FROM vec WHERE rank < 60)
SELECT item_id, count(s) AS n_semantic, count(k.rank) AS n_keyword, count(*) FILTER (s IS NOT NULL AND k.rank IS NOT NULL) AS n_both, count(*) FILTER (s IS NULL) AS keyword_new, max(stage) AS stage FROM s FULL JOIN k USING (item_id, doc_id) GROUP BY item_id"""


def keyword_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the stage of the ladder that answers it and its number of documents."""
    items = table(spark, sf_dir, "benchmark")
    found = keyword_stages(table(spark, sf_dir, "documents"), items).groupBy("item_id").agg(F.max("stage").alias("stage"), F.count("*").alias("n_hits"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("stage", F.lit("none")).alias("stage"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


KEYWORD_LADDER_SQL = f"""WITH {LADDER_SQL}, g AS (SELECT item_id, max(stage) AS stage, count(*) AS n_hits FROM kw GROUP BY item_id)
SELECT item_id, coalesce(stage, 'none') AS stage, coalesce(n_hits, 0) AS n_hits FROM benchmark LEFT JOIN g USING (item_id)"""


def wiki_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the page-like sources (the odd ones), the best of each source and item, as stubs: an excerpt of 80 characters."""
    hits = search(spark, sf_dir, 20).filter("doc_id % 2 = 1")
    first = hits.withColumn("k", F.row_number().over(W.partitionBy("item_id", "source").orderBy("rank"))).filter("k = 1")
    return first.select("item_id", "source", "doc_id", "rank", F.substring("text", 1, 80).alias("stub"))


WIKI_STUBS_SQL = f"""WITH {HYBRID_CTE},
w AS (SELECT item_id, source, doc_id, rank, substr(text, 1, 80) AS stub, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS k FROM h LEFT JOIN documents USING (doc_id) WHERE rank < 20 AND doc_id % 2 = 1)
SELECT item_id, source, doc_id, rank, stub FROM w WHERE k = 1"""


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's terms as one phrase, next to each other; candidates hold its first four terms."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    asked = items.select("item_id", terms(F.col("text")).alias("t")).filter("size(t) > 0").select("item_id", F.array_join("t", " ").alias("phrase"), F.least(F.size("t"), F.lit(4)).alias("n"), "t")
    asked = cut(asked.select("item_id", "phrase", "n", F.array_join(F.slice("t", F.lit(1), F.col("n")), " ").alias("gram")))
    words = docs.select("doc_id", terms(F.col("text")).alias("t"))
    near = None
    for r in asked.select("n").distinct().collect():  # four lengths at the most
        grams = F.expr(f"if(size(t) < {r.n}, array(), transform(sequence(1, size(t) - {r.n - 1}), i -> array_join(slice(t, i, {r.n}), ' ')))")
        part = words.select("doc_id", F.explode(F.array_distinct(grams)).alias("gram")).join(small(asked.filter(F.col("n") == r.n).select("gram", "item_id", "phrase")), "gram").select("doc_id", "item_id", "phrase")
        near = part if near is None else near.unionByName(part)
    if near is None:
        return items.select("item_id").limit(0).crossJoin(docs.select("doc_id").limit(0))
    lines = words.select("doc_id", F.array_join("t", " ").alias("line"))
    return lines.join(small(cut(near)), "doc_id").filter(F.expr("contains(concat(' ', line, ' '), concat(' ', phrase, ' '))")).select("item_id", "doc_id").distinct()


PHRASE_SQL = f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({TERMS_SQL}, ' ') || ' ' AS line FROM documents), i AS (SELECT item_id, ' ' || array_to_string({TERMS_SQL}, ' ') || ' ' AS phrase FROM benchmark)
SELECT item_id, doc_id FROM i JOIN d ON contains(line, phrase) WHERE length(phrase) > 2"""


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1, 5 and 20, reciprocal rank and nDCG at 10 of the keyword leg over items that some document holds whole (the smallest such doc_id is the gold one)."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    stages = cut(keyword_stages(docs, items))
    # Documents that hold an item hold all of its terms.
    held = stages.filter(F.col("stage") == STAGES[0]).select("item_id", "doc_id").join(items, "item_id")
    gold = docs.select("doc_id", F.col("text").alias("body")).join(held, "doc_id").filter(F.contains("body", "text")).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    leg = ranked(stages, "item_id", [F.desc("score"), "doc_id"], LEG_WINDOW)
    rank = gold.join(leg, ["item_id", "doc_id"], "left").select("item_id", "rank")
    hit = lambda n: F.round(F.avg((F.coalesce(F.col("rank"), F.lit(999)) < n).cast("int")), 6)
    return rank.agg(
        F.count("*").alias("n"), hit(1).alias("recall_1"), hit(5).alias("recall_5"), hit(20).alias("recall_20"),
        F.round(F.avg(F.coalesce(1 / (F.col("rank") + 1), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("rank") < 10, 1 / F.log2(F.col("rank") + 2.0)).otherwise(0.0)), 6).alias("ndcg_10"),
    )


METRICS_SQL = f"""WITH {KEYWORD_LEG_SQL},
g AS (SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
r AS (SELECT item_id, rank FROM g LEFT JOIN k USING (item_id, doc_id))
SELECT count(*) AS n, round(avg((coalesce(rank, 999) < 1)::INT), 6) AS recall_1, round(avg((coalesce(rank, 999) < 5)::INT), 6) AS recall_5, round(avg((coalesce(rank, 999) < 20)::INT), 6) AS recall_20,
  round(avg(coalesce(1 / (rank + 1), 0)), 6) AS mrr, round(avg(CASE WHEN rank < 10 THEN 1 / log2(rank + 2) ELSE 0 END), 6) AS ndcg_10 FROM r"""


def distance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the mean distance of its window and the nearest-rank 99th percentile of it."""
    near = vector_leg(spark, sf_dir)
    ordered = near.groupBy("item_id").agg(F.sort_array(F.collect_list("distance")).alias("d"))
    return ordered.select("item_id", F.round(F.expr("aggregate(d, 0D, (s, x) -> s + x) / size(d)"), 4).alias("background"), F.expr("d[int(round((size(d) - 1) * 0.99))]").alias("p99"))


THRESHOLD_SQL = f"""WITH {VECTOR_SQL}, d AS (SELECT item_id, list(distance ORDER BY distance) AS d FROM vec WHERE rank < 60 GROUP BY item_id)
SELECT item_id, round(list_avg(d), 4) AS background, d[1 + round((len(d) - 1) * 0.99)::INT] AS p99 FROM d"""


def cosine_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other vectors than the item's own with a cosine of 0.34 or more to it, the best eight."""
    near = nearest(*item_vectors(spark, sf_dir), 9, cosine=True, floor=0.34).filter("vec_id != item_id")
    return ranked(near.drop("rank"), "item_id", [F.desc("value"), "vec_id"], 8).select("item_id", "vec_id", F.col("value").alias("cosine"), "rank")


COSINE_SQL = """WITH c AS (SELECT q.vec_id AS item_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, vec_id) - 1 AS rank FROM c WHERE cosine >= 0.34)
SELECT item_id, vec_id, cosine, rank FROM r WHERE rank < 8"""


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and total count of every term."""
    return postings(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


TERM_SQL = f"WITH {POSTINGS_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posts GROUP BY term"


def han_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of the pair index each document has, and how many of them are pairs of Han."""
    t = table(spark, sf_dir, "documents").select("doc_id", han_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.filter("t", lambda w: w.rlike(f"^{HAN}{{2}}$"))).cast("long").alias("n_pairs"))


HAN_SQL = r"""WITH r AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[㐀-䶿一-鿿豈-﫿]+'), lambda x: length(x)) AS han, len(regexp_extract_all(coalesce(text, ''), '[^\s\p{P}㐀-䶿一-鿿豈-﫿]+')) AS words FROM documents)
SELECT doc_id, (words + coalesce(list_sum(list_transform(han, lambda n: greatest(n - 1, 1))), 0))::BIGINT AS n_tokens, coalesce(list_sum(list_transform(han, lambda n: n - 1)), 0)::BIGINT AS n_pairs FROM r"""


def fnv_sql(text: str) -> str:
    return f"""list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::UTINYINT::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"""


def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag-of-words vectors of all documents by hashed words, as (doc_id, dim, weight) where they are not 0."""
    v = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(embedder()(F.col("text"))).alias("dim", "w"))
    return v.filter("w > 0").select("doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("w").cast("double"), 5).alias("weight"))


EMBEDDING_SQL = f"""WITH t AS (SELECT doc_id, unnest({TERMS_SQL}) AS w FROM documents), v AS (SELECT w, ({fnv_sql("w")} % 256)::BIGINT AS dim FROM (SELECT DISTINCT w FROM t)), c AS (SELECT doc_id, dim, count(*) AS n FROM t JOIN v USING (w) GROUP BY doc_id, dim)
SELECT doc_id, dim, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS weight FROM c"""


def fact_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fact_hash(F.concat_ws(" is ", "p_name", "p_type")).alias("fact_hash"))


FACT_HASH_SQL = f"""WITH t AS (SELECT p_partkey, lower(p_name || ' is ' || p_type) AS t FROM part) SELECT p_partkey, lower(lpad(to_hex({fnv_sql("t")}::UBIGINT), 16, '0')) AS fact_hash FROM t"""


QUERIES = {
    "hash_embeddings": hash_embeddings, "fact_hashes": fact_hashes, "han_grams": han_grams, "phrase_search": phrase_search, "wiki_stubs": wiki_stubs,
    "hybrid_retrieval": hybrid_retrieval, "fts_bm25_topk": fts_bm25_topk, "vector_knn": vector_knn, "search_evidence_counts": search_evidence_counts,
    "keyword_ladder": keyword_ladder, "retrieval_metrics": retrieval_metrics, "distance_threshold": distance_threshold, "cosine_floor": cosine_floor, "term_frequencies": term_frequencies,
}
ORACLE_SQL = {
    "hybrid_retrieval": HYBRID_SQL, "fts_bm25_topk": FTS_SQL, "vector_knn": VECTOR_KNN_SQL, "search_evidence_counts": EVIDENCE_SQL, "keyword_ladder": KEYWORD_LADDER_SQL, "han_grams": HAN_SQL, "phrase_search": PHRASE_SQL,
    "wiki_stubs": WIKI_STUBS_SQL, "hash_embeddings": EMBEDDING_SQL, "fact_hashes": FACT_HASH_SQL, "retrieval_metrics": METRICS_SQL, "distance_threshold": THRESHOLD_SQL, "cosine_floor": COSINE_SQL, "term_frequencies": TERM_SQL,
}
