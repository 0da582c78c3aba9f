"""The read tools: one function for each, with parameters instead of a fixed question, giving a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import embedder
from tessera.functions.text import rrf
from tessera.operators import entities, graph, notes, records
from tessera.operators.memory import packed
from tessera.operators.relational import optional, visible_to
from tessera.operators.retrieval import Legs, fused, keyword_leg, keyword_stages, nearest, ranked
from tessera.operators.text_rules import candidates, chunks, expanded
from tessera.sources.checkpoints import cut
from tessera.sources.tables import memories, runs, table

#: Page sizes, and the weights of the two legs of memory search.
PAGE, RECALL = 8, 5
RRF_K = 60


def one_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "item_id long, text string")


def memory_search(spark: SparkSession, sf_dir: str, text: str, reader: str = "user", limit: int = PAGE, least_cosine: float = 0.0) -> DataFrame:
    """(memory_id, score, legs, content): memories that the reader may see, by a semantic and a keyword leg with equal weights."""
    m = cut(memories(spark, sf_dir).filter(visible_to(F.col("namespace"), reader)))
    asked = one_query(spark, text)
    vectors = m.select(F.col("memory_id").alias("vec_id"), embedder()(F.col("content")).alias("embedding"))
    semantic = nearest(vectors, asked.select("item_id", embedder()(F.col("text")).alias("q")), 60, cosine=True, floor=least_cosine).select(F.col("vec_id").alias("memory_id"), F.lit("semantic").alias("leg"), "rank")
    found = keyword_stages(m.select(F.col("memory_id").alias("doc_id"), F.col("content").alias("text")), asked)
    keyword = ranked(found, "item_id", [F.desc("score"), "doc_id"], 60).select(F.col("doc_id").alias("memory_id"), F.lit("keyword").alias("leg"), "rank")
    both = semantic.unionByName(keyword).groupBy("memory_id").agg(F.round(F.sum(rrf(F.col("rank"), RRF_K)), 9).alias("score"), F.array_sort(F.collect_set("leg")).alias("legs"))
    return both.join(m.select("memory_id", "content"), "memory_id").orderBy(F.desc("score"), "memory_id").limit(limit)


def memory_get(spark: SparkSession, sf_dir: str, memory_id: int) -> DataFrame:
    return memories(spark, sf_dir).filter(F.col("memory_id") == memory_id)


def memory_rows(spark: SparkSession, sf_dir: str, store: str | None = None, namespace: str | None = None, limit: int = PAGE) -> DataFrame:
    return optional(memories(spark, sf_dir), store=store, namespace=namespace).orderBy(F.desc("memory_id")).limit(limit)


def memory_forget_report(spark: SparkSession, sf_dir: str, content_hash: str) -> DataFrame:
    """On how many rows of every surface a content (by its SHA-256) still stands; backups cannot be looked into."""
    out = None
    for name, rows in (("memories", memories(spark, sf_dir).select("content")), ("documents", table(spark, sf_dir, "documents").select("text")), ("benchmark", table(spark, sf_dir, "benchmark").select("text"))):
        part = rows.toDF("content").agg(F.lit(name).alias("surface"), F.count_if(F.sha2("content", 256) == content_hash).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(spark.createDataFrame([("backups", None)], "surface string, n long"))


def knowledge_search(spark: SparkSession, sf_dir: str, text: str, limit: int = PAGE, legs: Legs = Legs()) -> DataFrame:  # noqa: B008
    """Documents by keywords and hashed bags of words; without a leg that is on, nothing is asked."""
    if not (legs.semantic or legs.keyword):
        return spark.createDataFrame([], "doc_id long, rank long, fused double, relevance double, stage string, fusion string")
    docs, asked = table(spark, sf_dir, "documents").select("doc_id", "text"), one_query(spark, text)
    none = "item_id long, doc_id long, rank long"
    semantic = spark.createDataFrame([], none + ", distance double")
    if legs.semantic:
        near = nearest(docs.select(F.col("doc_id").alias("vec_id"), embedder()(F.col("text")).alias("embedding")), asked.select("item_id", embedder()(F.col("text")).alias("q")), 60)
        semantic = near.withColumnsRenamed({"vec_id": "doc_id", "value": "distance"})
    keyword = keyword_leg(docs, asked) if legs.keyword else spark.createDataFrame([], none + ", score double, stage string")
    return ranked(fused(semantic, keyword, legs), "item_id", [F.desc("fused"), "doc_id"], limit).select("doc_id", "rank", "fused", "relevance", "stage", "fusion")


def knowledge_expand(spark: SparkSession, sf_dir: str, doc_id: int, chunk: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id") == doc_id).select("doc_id", "text")
    return expanded(spark.createDataFrame([(doc_id, chunk)], "doc_id long, chunk long"), docs)


def knowledge_ingest(spark: SparkSession, name: int, content: str) -> DataFrame:
    """The chunk rows of one document."""
    return chunks(spark.createDataFrame([(name, content)], "doc_id long, text string"))


def graph_entity(spark: SparkSession, sf_dir: str, node: str, hops: int = 1) -> DataFrame:
    """Neighbours of an entity by their depth."""
    g = graph.named_facts(spark, sf_dir).filter("invalid_at is null").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    both = cut(g.unionByName(g.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return graph.within(spark.createDataFrame([(node,)], "seed string"), both, hops).select("node", "depth")


def graph_search(spark: SparkSession, sf_dir: str, text: str, limit: int = PAGE) -> DataFrame:
    e = cut(entities.part_entities(spark, sf_dir))
    return entities.seeds(spark.createDataFrame([(0, text)], "query long, text string"), e, entities.part_aliases(e), limit).join(e, "id").select("id", "name", "leg", "score", "rank")


def graph_retrieve(spark: SparkSession, sf_dir: str, nodes: list[str], hops: int = graph.HOPS, as_of: str | None = None, include_superseded: bool = False) -> DataFrame:
    """Evidence paths from the nodes; hops between 1 and 3."""
    seeds = spark.createDataFrame([(0, n, 1.0) for n in nodes], "query long, node string, score double")
    return graph.retrieve(seeds, cut(graph.named_facts(spark, sf_dir)), min(max(hops, 1), 3), as_of=as_of, include_superseded=include_superseded)


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory: fields, degrees and problems of every page."""
    pages = notes.notes(spark, sf_dir)
    bad = notes.problems(pages, notes.cited(spark, sf_dir)).groupBy("slug").agg(F.count("*").alias("n_problems"))
    return notes.frontmatter(pages).drop("content").join(notes.link_graph(pages), "slug").join(bad, "slug", "left").withColumn("n_problems", F.coalesce("n_problems", F.lit(0)))


def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.links(notes.notes(spark, sf_dir))


def distill_session(spark: SparkSession, sf_dir: str, session_id: int) -> DataFrame:
    """The rule tier of one session: its memory candidates."""
    return candidates(table(spark, sf_dir, "conversations").filter(F.col("conv_id") == session_id).select("conv_id", "turn", "role", "text"))


def distill_status(spark: SparkSession, sf_dir: str, session: int) -> DataFrame:
    return records.QUERIES["recorded_outcomes"](spark, sf_dir).filter(F.col("session") == session).orderBy(F.desc("id"))


def pending_pairs(spark: SparkSession, sf_dir: str, dismissed: bool = False) -> DataFrame:
    return records.QUERIES["pending_queue"](spark, sf_dir).filter(F.col("dismissed") == dismissed)


def list_tasks(spark: SparkSession, sf_dir: str, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    tasks = spark.sql(f"WITH {records.TASKS} SELECT * FROM tasks", orders=table(spark, sf_dir, "orders"))
    return optional(tasks, status=status).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def run_get(spark: SparkSession, sf_dir: str, run_id: int) -> DataFrame:
    return runs(spark, sf_dir).filter(F.col("run_id") == run_id)


def agents_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("harness"))


def routing_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.QUERIES["routing"](spark, sf_dir).groupBy("source", "agent").agg(F.count("*").alias("n"))


def memory_recall(spark: SparkSession, sf_dir: str, text: str, strategy: str = "aggressive", limit: int = RECALL) -> DataFrame:
    """(section, item, text) of memories and documents; the conservative strategy gives stubs of 80 characters."""
    if strategy not in ("aggressive", "conservative"):
        raise ValueError(f"strategy: {strategy}")
    m = memory_search(spark, sf_dir, text, limit=limit).select(F.lit("memory").alias("section"), F.col("memory_id").alias("item"), F.col("content").alias("text"))
    k = knowledge_search(spark, sf_dir, text, limit).select("doc_id").join(table(spark, sf_dir, "documents"), "doc_id").select(F.lit("knowledge").alias("section"), F.col("doc_id").alias("item"), "text")
    both = m.unionByName(k)
    return both.withColumn("text", F.substring("text", 1, 80)) if strategy == "conservative" else both


def context(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """What memory_recall finds, packed into the budget of a context."""
    r = memory_recall(spark, sf_dir, text)
    return packed(r.select(F.lit(0).alias("query"), F.struct("section", "item").alias("seq"), F.col("section").alias("tag"), F.lit("").alias("date"), F.col("text").alias("content"), F.lit(False).alias("low")))
