"""Filters, joins, aggregates, ranks and set operations over runs, facts, memories and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.times import INSTANT_SQL, SHAPE, instant, precision
from tessera.plans.query import registry
from tessera.sources.tables import FACTS_SQL, MEMORIES_SQL, RUNS_SQL, facts, memories, runs, table

QUERIES, ORACLE_SQL, query = registry()


def long(c: Column) -> Column:
    return c.cast("long")


# Filters


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Equality on those columns whose wanted value is not None."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


@query(f"WITH {FACTS_SQL} SELECT edge_id, src, dst, relation, valid_at FROM facts WHERE invalid_at IS NULL")
def current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).filter("invalid_at is null").select("edge_id", "src", "dst", "relation", "valid_at")


AS_OF = "1997-01-01 00:00:00"


@query(f"WITH {FACTS_SQL} SELECT edge_id, src, dst, relation FROM facts WHERE valid_at <= TIMESTAMP '{AS_OF}' AND (invalid_at IS NULL OR TIMESTAMP '{AS_OF}' < invalid_at)")
def facts_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open validity: valid_at <= t < invalid_at."""
    t = F.lit(AS_OF).cast("timestamp_ntz")
    return facts(spark, sf_dir).filter((F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (t < F.col("invalid_at")))).select("edge_id", "src", "dst", "relation")


@query(f"WITH {FACTS_SQL}, now AS (SELECT * FROM facts WHERE invalid_at IS NULL) SELECT entity, count(*) AS n_facts FROM (SELECT 's' || src AS entity FROM now UNION ALL SELECT 'p' || dst FROM now) GROUP BY entity")
def incident_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current facts of an entity at either end, by one row for each end instead of an OR join; suppliers and parts are told apart."""
    now = facts(spark, sf_dir).filter("invalid_at is null").select(F.explode(F.array(F.concat(F.lit("s"), "src"), F.concat(F.lit("p"), "dst"))).alias("entity"))
    return now.groupBy("entity").agg(F.count("*").alias("n_facts"))


def visible_to(namespace: Column, viewer: str) -> Column:
    """user and global are seen by all and see all; a project or agent sees itself besides."""
    return F.lit(viewer in ("user", "global")) | namespace.isin("user", "global") | (namespace == viewer)


@query(f"WITH {MEMORIES_SQL} SELECT memory_id, namespace FROM memories WHERE namespace IN ('user', 'global', 'project:p3')")
def visible_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).filter(visible_to(F.col("namespace"), "project:p3")).select("memory_id", "namespace")


#: The namespace kinds that each store may be written to.
ALLOWED = {"profile": ["user", "global"], "observation": ["user", "project", "agent"], "procedure": ["global", "project", "agent"], "lesson": ["global", "project", "agent"]}


@query(f"""WITH {MEMORIES_SQL}, a(store, kind) AS (VALUES ('profile', 'user'), ('profile', 'global'), ('observation', 'user'), ('observation', 'project'), ('observation', 'agent'),
('procedure', 'global'), ('procedure', 'project'), ('procedure', 'agent'), ('lesson', 'global'), ('lesson', 'project'), ('lesson', 'agent'))
SELECT memories.store, split_part(namespace, ':', 1) AS kind, CASE WHEN a.kind IS NULL THEN 'reject' ELSE 'accept' END AS outcome, count(*) AS n
FROM memories LEFT JOIN a ON memories.store = a.store AND split_part(namespace, ':', 1) = a.kind GROUP BY ALL""")
def store_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.substring_index("namespace", ":", 1)
    ok = F.lit(False)
    for store, kinds in ALLOWED.items():
        ok = ok | ((F.col("store") == store) & kind.isin(kinds))
    return memories(spark, sf_dir).groupBy("store", kind.alias("kind"), F.when(ok, "accept").otherwise("reject").alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, strpos(text, 'License') AS at FROM documents WHERE contains(text, 'License')")
def substring_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("License"))).select("doc_id", long(F.instr("text", "License")).alias("at"))


#: The first rule whose needle the lower-cased title contains names the route.
ROUTES = [("license", "legal"), ("the", "english"), ("der", "german"), ("le", "french")]


@query("""SELECT route, count(*) AS n FROM (SELECT CASE WHEN contains(t, 'license') THEN 'legal' WHEN contains(t, 'the') THEN 'english' WHEN contains(t, 'der') THEN 'german' WHEN contains(t, 'le') THEN 'french' ELSE 'default' END AS route
FROM (SELECT lower(text) AS t FROM documents)) GROUP BY route""")
def first_match_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, route = F.lower("text"), None
    for needle, name in ROUTES:
        route = (F if route is None else route).when(F.contains(title, F.lit(needle)), name)
    return table(spark, sf_dir, "documents").groupBy(route.otherwise("default").alias("route")).agg(F.count("*").alias("n"))


@query("SELECT vec_id FROM embeddings LEFT JOIN documents ON vec_id = doc_id WHERE embedding IS NULL OR source IS DISTINCT FROM 'src1'")
def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are missing or were made by another embedder (here: the source of the document)."""
    v, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select("doc_id", "source")
    return v.join(d, v.vec_id == d.doc_id, "left").filter(F.col("embedding").isNull() | ~F.col("source").eqNullSafe("src1")).select("vec_id")


# Joins


@query(f"""WITH {FACTS_SQL} SELECT edge_id, relation, s_name AS supplier, p_name AS part, n_name AS nation FROM facts LEFT JOIN supplier ON src = s_suppkey LEFT JOIN part ON dst = p_partkey LEFT JOIN nation ON s_nationkey = n_nationkey WHERE invalid_at IS NULL""")
def fact_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins keep facts whose ends or origin are unknown."""
    now = facts(spark, sf_dir).filter("invalid_at is null")
    s, p, n = (table(spark, sf_dir, t) for t in ("supplier", "part", "nation"))
    return now.join(s, now.src == s.s_suppkey, "left").join(p, now.dst == p.p_partkey, "left").join(n, s.s_nationkey == n.n_nationkey, "left").select("edge_id", "relation", F.col("s_name").alias("supplier"), F.col("p_name").alias("part"), F.col("n_name").alias("nation"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def covered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join: customers with an open order."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT count(DISTINCT c_custkey) AS n_covered, count(DISTINCT c_custkey) FILTER (o_custkey IS NULL) AS n_isolated FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    joined = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.agg(F.count("*").alias("n_covered"), F.count_if(F.col("o_custkey").isNull()).alias("n_isolated"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT min(doc_id) FROM documents GROUP BY md5(text))")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the first of rows with equal content: digests travel, texts do not."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(first, "h").filter("doc_id != first").select("doc_id")


@query("WITH f AS (SELECT p_name, p_brand, min(p_partkey) AS a FROM part GROUP BY p_name, p_brand) SELECT a, p_partkey AS b FROM part JOIN f ON part.p_name = f.p_name AND part.p_brand = f.p_brand WHERE a < p_partkey")
def same_object_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the same name and brand: each with the first of its class, so the pairs grow with the entities and not with the square of a class."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    first = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("a"))
    return p.join(first, ["p_name", "p_brand"]).filter("a < p_partkey").select("a", F.col("p_partkey").alias("b"))


@query("""WITH d AS (SELECT l_suppkey, count(*) AS degree FROM lineitem GROUP BY 1)
SELECT a, b, d1.degree AS degree_a, d2.degree AS degree_b FROM (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier) LEFT JOIN d d1 ON d1.l_suppkey = a LEFT JOIN d d2 ON d2.l_suppkey = b WHERE b IS NOT NULL""")
def pending_pairs_with_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that await a ruling (here: neighbours of one nation) with both ends' fact counts: counted once and joined twice instead of a subquery for each row."""
    degree = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("degree"))
    next_one = F.lead("s_suppkey").over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), next_one.alias("b")).filter("b is not null")
    for end in "ab":
        pairs = pairs.join(degree.select(F.col("l_suppkey").alias(end), F.col("degree").alias(f"degree_{end}")), end, "left")
    return pairs.select("a", "b", "degree_a", "degree_b")


@query("""WITH w AS (SELECT page_id, lower(unnest(list_distinct(regexp_extract_all(html, '<a href="/([^"/]+)"', 1)))) AS term FROM pages),
t AS (SELECT DISTINCT lower(n_name) AS name FROM nation UNION SELECT 'the' UNION SELECT 'la'),
r AS (SELECT name, page_id, row_number() OVER (PARTITION BY name ORDER BY page_id) AS k FROM (SELECT DISTINCT name, page_id FROM t JOIN w ON term = name)) SELECT name, page_id FROM r WHERE k <= 3""")
def names_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-boundary containment: words are exploded and joined by equality, three pages for each name."""
    words = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a href="/([^"/]+)"'), F.lit(1)))).alias("name")).select("page_id", F.lower("name").alias("name")).distinct()
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).union(spark.createDataFrame([("the",), ("la",)], "name string")).distinct()
    return words.join(F.broadcast(names), "name").withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("page_id"))).filter("k <= 3").select("name", "page_id")


@query("""WITH h AS (SELECT source, min(md5(text)) AS recorded, max(md5(text)) AS live FROM documents GROUP BY source) SELECT source, CASE WHEN recorded = live THEN 'fresh' ELSE 'drift' END AS state FROM h""")
def source_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min(F.md5("text")).alias("recorded"), F.max(F.md5("text")).alias("live"))
    return d.select("source", F.when(F.col("recorded") == F.col("live"), "fresh").otherwise("drift").alias("state"))


# Aggregates


@query(f"WITH {RUNS_SQL} SELECT agent, count(*) AS n_runs, count(*) FILTER (status = 'purchase') AS n_completed, count(*) FILTER (status = 'click') AS n_failed, round(coalesce(sum(cost), 0), 4) AS cost, max(created_at) AS last_at FROM runs GROUP BY agent")
def agent_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("agent").agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("status") == "purchase").alias("n_completed"), F.count_if(F.col("status") == "click").alias("n_failed"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"), F.max("created_at").alias("last_at"),
    )


@query(f"WITH {RUNS_SQL} SELECT status, count(*) AS n FROM runs WHERE status IS NOT NULL GROUP BY status")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).filter("status is not null").groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {MEMORIES_SQL} SELECT store, namespace, count(*) AS n FROM memories GROUP BY ALL")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).groupBy("store", "namespace").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT list(n ORDER BY n) AS v FROM c) SELECT v[1] AS least, v[len(v) // 2 + 1] AS median, v[len(v)] AS most FROM o""")
def facts_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, upper median and most; ranks come from counts of equal values, so no list of all entities is built."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    upto = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    ranked = n.withColumn("upto", F.sum("k").over(upto)).withColumn("all", F.sum("k").over(W.partitionBy()))
    return ranked.agg(F.min("n").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median"), F.max("n").alias("most"))


@query(f"""WITH {RUNS_SQL} SELECT agent, arg_max(cost, (created_at, run_id)) FILTER (cost IS NOT NULL) AS last_cost, arg_max(status, (created_at, run_id)) AS last_status FROM runs GROUP BY agent""")
def usage_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last cost that is known and last status of each agent's stream."""
    at = F.struct("created_at", "run_id")
    return runs(spark, sf_dir).groupBy("agent").agg(F.max_by("cost", F.when(F.col("cost").isNotNull(), at)).alias("last_cost"), F.max_by("status", at).alias("last_status"))


@query("""SELECT source, lang, grouping_id(source, lang) AS level, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (source, lang)""")
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.grouping_id().alias("level"), F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


# Ranks, order, paging


@query("""WITH t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations)
SELECT conv_id, turn FROM t WHERE role = 'assistant' AND next_role = 'user' AND length(next_text) < 120""")
def corrected_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that the next user turn cuts short."""
    w = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.lead(F.char_length("text")).over(w).alias("next"))
    return t.filter("role = 'assistant' and next_role = 'user' and next < 120").select("conv_id", "turn")


@query("""WITH s AS (SELECT conv_id, turn, sum(strlen(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS bytes FROM conversations) SELECT conv_id, min(turn) AS first_turn, count(*) AS n_turns, max(bytes)::BIGINT AS bytes FROM s WHERE bytes <= 2000 GROUP BY conv_id""")
def newest_turns_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns that fit into a byte budget."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.octet_length("text") + 2).over(w).alias("bytes"))
    return t.filter("bytes <= 2000").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n_turns"), F.max("bytes").alias("bytes"))


@query("SELECT role, min(conv_id * 1000000 + turn) AS first_id, md5(text) AS h FROM conversations GROUP BY role, md5(text)")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role", F.md5("text").alias("h")).agg(F.min(F.col("conv_id") * 1000000 + F.col("turn")).alias("first_id")).select("role", "first_id", "h")


@query(f"WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, run_id DESC) AS k FROM runs) SELECT agent, run_id, status FROM r WHERE k = 1 AND status <> 'click'")
def active_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest action of each key, if it is not a release."""
    last = runs(spark, sf_dir).groupBy("agent").agg(F.max(F.struct("created_at", "run_id", "status")).alias("r"))
    return last.filter("r.status != 'click'").select("agent", "r.run_id", "r.status")


@query(f"WITH {FACTS_SQL} SELECT edge_id, src, dst, (SELECT count(*) FROM facts WHERE invalid_at IS NULL) AS total FROM facts WHERE invalid_at IS NULL ORDER BY valid_at DESC, edge_id LIMIT 50 OFFSET 100")
def edge_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 50 edges, newest first, with the total."""
    now = facts(spark, sf_dir).filter("invalid_at is null")
    page = now.orderBy(F.desc("valid_at"), "edge_id").offset(100).limit(50).select("edge_id", "src", "dst")
    return page.crossJoin(F.broadcast(now.agg(F.count("*").alias("total"))))


@query("SELECT l_suppkey, count(*) AS degree FROM lineitem GROUP BY 1 ORDER BY degree DESC, l_suppkey LIMIT 150")
def top_degree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "l_suppkey").limit(150)


@query("""WITH r AS (SELECT doc_id, source, lang = 'en' AS wiki, n_chars, row_number() OVER (PARTITION BY source, lang = 'en' ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT source, doc_id, wiki FROM r WHERE k <= CASE WHEN wiki THEN 2 ELSE 3 END""")
def balanced_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group up to two hits of one kind and three of the other."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", (F.col("lang") == "en").alias("wiki"))
    k = F.row_number().over(W.partitionBy("source", "wiki").orderBy(F.desc("n_chars"), "doc_id"))
    return d.withColumn("k", k).filter((F.col("k") <= 3) & (~F.col("wiki") | (F.col("k") <= 2))).select("source", "doc_id", "wiki")


# Sets


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'A'")
def retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed by the earlier revision and not by the current one."""
    line = table(spark, sf_dir, "lineitem")
    return line.filter("l_quantity > 40 and l_returnflag = 'R'").select("l_partkey").subtract(line.filter("l_quantity > 30 and l_returnflag = 'A'").select("l_partkey"))


@query("""WITH s AS (SELECT c_custkey AS id, 1 AS stage FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_orderpriority = '1-URGENT') SELECT id, min(stage) AS stage FROM s GROUP BY id""")
def staged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of stages; what several stages find counts for the first."""
    one = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("id"), F.lit(1).alias("stage"))
    two = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"), F.lit(2).alias("stage"))
    return one.unionByName(two).groupBy("id").agg(F.min("stage").alias("stage"))


@query("""WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s, list_sort(list(DISTINCT l_partkey)) AS p FROM lineitem GROUP BY 1) SELECT l_orderkey, len(s)::BIGINT AS n_suppliers, len(s) = len(p) AS equal_size FROM l""")
def planned_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.collect_set("l_suppkey"), F.collect_set("l_partkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(long(F.size(s)).alias("n_suppliers"), (F.size(s) == F.size(p)).alias("equal_size"))


#: The times of events as different writers put them down; both engines read this.
SAID_SQL = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN substr(cast(ts AS string), 1, 10) WHEN 1 THEN substr(cast(ts AS string), 1, 19) WHEN 2 THEN replace(substr(cast(ts AS string), 1, 19), ' ', 'T')
  WHEN 3 THEN concat(replace(substr(cast(ts AS string), 1, 19), ' ', 'T'), '.', substr(cast(event_id + 100000 AS string), 2, 5)) WHEN 4 THEN concat(replace(substr(cast(ts AS string), 1, 19), ' ', 'T'), 'Z') WHEN 5 THEN concat(replace(substr(cast(ts AS string), 1, 19), ' ', 'T'), '.25+08:00')
  WHEN 6 THEN concat('  ', substr(cast(ts AS string), 1, 19), '-03:30 ') ELSE CASE WHEN event_id % 16 = 7 THEN 'soon' ELSE concat(substr(cast(ts AS string), 1, 4), '-13-45') END END AS said FROM {events}"""


@query(f"""WITH w AS ({SAID_SQL.format(events="events")}), t AS (SELECT event_id, {INSTANT_SQL} AS moment, CASE WHEN regexp_extract(trim(said), '{SHAPE}', 2) = '' THEN 'day' WHEN regexp_extract(trim(said), '{SHAPE}', 3) = '' THEN 'second' ELSE 'fraction' END AS exact FROM w)
SELECT event_id, moment, CASE WHEN moment IS NOT NULL THEN exact END AS exact, moment <= TIMESTAMP '2024-01-15 00:00:00' AS known_then FROM t""")
def text_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events that were written in several ways as points in time, how exact they are, and which lie before a point in time that is text itself."""
    w = spark.sql(SAID_SQL, events=table(spark, sf_dir, "events"))
    at, then = instant(F.col("said")), instant(F.lit("2024-01-15T08:00:00+08:00"))
    return w.select("event_id", at.cast("timestamp_ntz").alias("moment"), precision(F.col("said")).alias("exact"), (at <= then).alias("known_then"))
