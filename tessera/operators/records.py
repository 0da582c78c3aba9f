"""Rows of tasks, runs, sessions, memories, entities and page builds: lookups, pages, upserts, cascades, ledgers.

A change is a new snapshot: what is written is joined with what was there, and the result replaces it. All of these are
plain relational plans, so they are given as SQL, once for both engines; an upsert of very many keys is dealt by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.query import sql_query
from tessera.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = sql_query(QUERIES, ORACLE_SQL)

#: Written edges that a task folds.
TASK_EDGES = 1_000_000

TASKS = """tasks AS (SELECT o_orderkey AS id, concat('order ', o_orderpriority, ' of ', o_custkey) AS title, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  concat('Project', o_custkey % 7) AS project, CASE WHEN o_custkey % 11 = 0 THEN concat('agent', o_custkey % 5) END AS pinned_agent, o_orderdate AS created_at,
  CASE o_orderkey % 3 WHEN 1 THEN 'human' WHEN 2 THEN 'judge' END AS selected_by FROM {orders})"""
RUNS = """runs AS (SELECT event_id AS id, user_id AS agent, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' WHEN 'click' THEN 'running' ELSE 'interrupted' END AS status, value AS cost, ts FROM {events})"""
SESSIONS = """turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM {conversations}),
sessions AS (SELECT conv_id AS session_id, max(CASE WHEN role = 'user' AND r = 1 THEN text END) AS preview, CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN '<system> set up' ELSE concat('talk ', conv_id) END AS title, count(*) AS n_messages, max(turn) AS updated FROM turns GROUP BY conv_id)"""
MEMORIES = """memories AS (SELECT conv_id * 1000000 + turn AS id, role AS store, concat('p', conv_id % 7) AS namespace, text AS content, (conv_id * 7 + turn) % 11 AS access_count, conv_id AS session_id,
  CASE WHEN turn > 0 AND turn % 2 = 0 THEN conv_id * 1000000 + turn - 1 END AS supersedes, turn % 5 = 4 AS deleted FROM {conversations})"""
ENTITIES = """names AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE concat(' ', p_name) END AS name, CASE WHEN p_size > 25 THEN p_type END AS kind, CASE WHEN p_size % 3 = 0 THEN p_brand END AS summary FROM {part})"""
CURRENT = """current AS (SELECT * FROM (SELECT concat_ws('-', l_suppkey, l_returnflag, l_partkey, row_number() OVER pair) AS edge_id, l_suppkey AS src, l_partkey AS dst, l_returnflag AS relation, l_shipdate AS valid_at, lead(l_shipdate) OVER pair AS invalid_at FROM {lineitem}
  WINDOW pair AS (PARTITION BY l_suppkey, l_partkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus)) x WHERE invalid_at IS NULL)"""

# Tasks, runs, agents

query("task_page", f"WITH {TASKS} SELECT id, title, status, project, (SELECT count(*) FROM tasks WHERE status = 'running') AS total FROM tasks WHERE status = 'running' ORDER BY created_at DESC, id LIMIT 50 OFFSET 50", "The second page of running tasks, newest first, with the total.")
query("task_snapshot", f"""WITH {TASKS}, updates AS (SELECT l_orderkey AS id, CASE max(l_returnflag) WHEN 'R' THEN 'failed' WHEN 'N' THEN 'completed' END AS status, max(l_linenumber) AS selected_run FROM {{lineitem}} GROUP BY l_orderkey)
SELECT tasks.id, coalesce(updates.status, tasks.status) AS status, selected_run, coalesce(selected_by, 'human') AS selected_by FROM tasks LEFT JOIN updates ON tasks.id = updates.id""", "Status and selected run after the newest update; who selected is a person where nothing is noted.")
query("task_edge_upsert", """WITH have AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM {lineitem} WHERE l_linenumber <= 3), new AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM {lineitem} WHERE l_linenumber >= 3)
SELECT src, dst, 'kept' AS op FROM have UNION ALL SELECT src, dst, 'inserted' FROM new n WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.src = n.src AND h.dst = n.dst)""", "Edges are inserted once, however often they are written.")


def task_edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges are inserted once, however often they are written: one exchange of all writes, in as many parts as they need, and one fold of each edge.

    An edge with a null end equals no other, so it is inserted again.
    """
    writes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    parts = max(spark.sparkContext.defaultParallelism, -(-writes.count() // TASK_EDGES))
    edge = writes.repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.coalesce(F.bool_or(F.col("l_linenumber") <= 3), F.lit(False)).alias("have"), F.coalesce(F.bool_or(F.col("l_linenumber") >= 3), F.lit(False)).alias("new"))
    inserted = F.col("new") & (~F.col("have") | F.col("src").isNull() | F.col("dst").isNull())
    return edge.select("src", "dst", F.explode(F.array_compact(F.array(F.when(F.col("have"), "kept"), F.when(inserted, "inserted")))).alias("op"))


QUERIES["task_edge_upsert"] = task_edge_upsert

query("run_outcomes", f"WITH {RUNS} SELECT id, status, status IN ('completed', 'failed', 'cancelled', 'interrupted') AS terminal, status NOT IN ('completed', 'failed', 'cancelled', 'interrupted') AS active, status IN ('failed', 'interrupted', 'cancelled') AS retryable FROM runs", "Predicates of run statuses.")
query("runs_with_agents", f"""WITH {RUNS}, agents AS (SELECT c_custkey AS agent, c_name AS name, c_mktsegment AS harness FROM {{customer}})
SELECT agents.agent, name, harness, count(*) AS n_runs, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS n_completed, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS n_failed, round(coalesce(sum(cost), 0), 4) AS cost, max(ts) AS last_at
FROM runs JOIN agents ON runs.agent = agents.agent GROUP BY agents.agent, name, harness""".replace("sum(CASE", "count(CASE").replace("THEN 1 ELSE 0 END", "THEN 1 END"), "Runs joined with the registered agents, in numbers by agent.")
query("harness_rollup", f"""WITH {RUNS}, agents AS (SELECT c_custkey AS agent, c_mktsegment AS harness FROM {{customer}}) SELECT harness, count(*) AS n_runs, count(DISTINCT runs.agent) AS n_agents, count(CASE WHEN status = 'completed' THEN 1 END) AS n_completed, count(CASE WHEN status = 'failed' THEN 1 END) AS n_failed, round(sum(cost), 3) AS cost FROM runs JOIN agents ON runs.agent = agents.agent GROUP BY harness""", "Runs, outcomes and cost by the harness of the agent.")
query("routing", f"""WITH {TASKS}, rules(rank, project, needle, agent) AS (VALUES (1, 'project1', 'urgent', 'fast'), (2, 'project2', 'low', 'cheap'), (3, 'project1', '', 'one'), (4, 'project3', 'HIGH', 'three')),
hits AS (SELECT id, agent, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM tasks JOIN rules ON lower(tasks.project) = lower(rules.project) WHERE contains(lower(title), lower(needle)))
SELECT tasks.id, coalesce(pinned_agent, hits.agent, 'default') AS agent, CASE WHEN pinned_agent IS NOT NULL THEN 'pin' WHEN hits.agent IS NOT NULL THEN 'rule' ELSE 'default' END AS source FROM tasks LEFT JOIN hits ON tasks.id = hits.id AND k = 1""", "A pinned agent, else that of the first rule of the project whose words the title holds, else the default.")
query("recorded_outcomes", f"WITH {RUNS}, attempts AS (SELECT agent AS session, id, CASE WHEN status <> 'running' THEN status END AS status FROM runs) SELECT session, id, status FROM attempts WHERE status IS NOT NULL", "Attempts whose outcome is recorded.")
query("latest_attempt", f"WITH {RUNS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY id DESC) AS k, count(*) OVER (PARTITION BY agent) AS n_attempts FROM runs) SELECT agent AS session, id, status, n_attempts FROM ranked WHERE k = 1", "The newest attempt of each session, and how many there were.")
query("empty_attempts", f"""WITH {RUNS}, counts AS (SELECT agent, id, status, row_number() OVER (PARTITION BY agent ORDER BY id) AS k FROM runs) SELECT agent AS session, id, CAST(k AS BIGINT) AS attempt, CASE status WHEN 'cancelled' THEN 'refused' ELSE 'nothing to write' END AS reason FROM counts WHERE status IN ('cancelled', 'interrupted')""", "Attempts that wrote nothing have their row and their reason in the ledger, too.")
query("context_fraction", "SELECT event_id AS run_id, round(CASE WHEN length(props) <= 8 THEN 0.0 ELSE least(greatest(value / (length(props) * 2.0), 0.0), 1.0) END, 6) AS fraction FROM {events}", "Used context by context size, between 0 and 1, and 0 where the size is unknown.")

# Sessions and episodes

query("session_list", f"""WITH {SESSIONS}, named AS (SELECT session_id, n_messages, updated, CASE WHEN title IS NULL OR trim(title) = '' OR title LIKE '<system>%' THEN substr(preview, 1, 60) ELSE title END AS title FROM sessions)
SELECT session_id, title, n_messages FROM named ORDER BY updated DESC, session_id LIMIT 50""", "Sessions, newest first; a title that is missing or was injected by the platform gives way to the first words of the user.")
query("session_tombstones", f"""WITH {SESSIONS}, archived AS (SELECT DISTINCT conv_id AS session_id FROM {{conversations}} WHERE conv_id % 9 = 1), deleted AS (SELECT DISTINCT conv_id AS session_id FROM {{conversations}} WHERE conv_id % 10 = 3)
SELECT s.session_id, n_messages, a.session_id IS NOT NULL AS archived FROM sessions s LEFT JOIN archived a ON s.session_id = a.session_id WHERE NOT EXISTS (SELECT 1 FROM deleted d WHERE d.session_id = s.session_id)""", "A new index leaves out deleted sessions and keeps the mark of archived ones: both keys live in tables of their own.")
query("session_lookup", f"""WITH {SESSIONS}, asked AS (SELECT doc_id AS session_id FROM {{documents}} WHERE doc_id % 20 = 0) SELECT a.session_id, CASE WHEN s.session_id IS NULL THEN 'missing' WHEN preview IS NULL THEN 'empty' ELSE 'found' END AS state FROM asked a LEFT JOIN sessions s ON a.session_id = s.session_id""", "Whether sessions that are asked for are found, empty or missing.")
query("session_history", f"""WITH {SESSIONS}, chats AS (SELECT event_id AS chat_id, user_id AS session_id, ts FROM {{events}}) SELECT chat_id, chats.session_id, coalesce(n_messages, 0) AS n_messages, title FROM chats LEFT JOIN sessions ON chats.session_id = sessions.session_id""", "Chats with the message counts and titles of their sessions.")
query("episodes", "SELECT md5(text) AS content_hash, min(conv_id * 1000000 + turn) AS episode_id, count(*) AS n_writes FROM {conversations} GROUP BY md5(text)", "An episode is its content: a second write gives the first one's id.")
query("voided_episodes", f"""WITH {RUNS} SELECT id, CASE WHEN status = 'failed' THEN 'run_turn_failed' ELSE 'run_turn' END AS kind, CASE WHEN status = 'failed' THEN 'write failed' END AS reason FROM runs""", "Episodes of failed writes are relabelled; doing it again changes nothing.")
query("session_memories", f"""WITH {MEMORIES}, episodes AS (SELECT DISTINCT conv_id AS session_id, conv_id * 1000000 AS episode_id FROM {{conversations}} WHERE conv_id % 4 = 0) SELECT m.session_id, episode_id, m.id, store FROM memories m JOIN episodes e ON m.session_id = e.session_id WHERE NOT deleted""", "Current memories that were distilled from a session.")

# Memories

query("memory_rows", f"WITH {MEMORIES} SELECT id, store, namespace, content FROM memories WHERE (CAST(NULL AS STRING) IS NULL OR store = CAST(NULL AS STRING)) AND ('p3' IS NULL OR namespace = 'p3') ORDER BY id DESC LIMIT 200".replace("STRING", "VARCHAR(9)"), "Rows under optional filters: one is not asked for, the other is.")
query("scope_rows", f"WITH {MEMORIES} SELECT id, content FROM memories WHERE store = 'user' AND namespace = 'p2' AND NOT deleted", "Ids and contents of one scope.")
query("memory_points", f"WITH {MEMORIES}, asked AS (SELECT doc_id * 5 AS id FROM {{documents}} WHERE doc_id % 20 = 0) SELECT asked.id, store, content FROM asked LEFT JOIN memories ON asked.id = memories.id", "Rows by their ids; an id that is not there gives nulls.")
query("usage_recorded", f"""WITH {MEMORIES}, uses AS (SELECT user_id * 1000000 + event_id % 4 AS id, count(*) AS n, max(ts) AS last_used_at FROM {{events}} GROUP BY user_id * 1000000 + event_id % 4) SELECT memories.id, access_count + coalesce(n, 0) AS access_count, last_used_at FROM memories LEFT JOIN uses ON memories.id = uses.id""", "Access counts and last use after a batch of uses.")
query("deleted_and_purged", f"""WITH {MEMORIES}, purged AS (SELECT id FROM memories WHERE deleted AND id % 3 = 0), restored AS (SELECT id FROM memories WHERE deleted AND id % 3 = 1)
SELECT m.id, m.deleted AND r.id IS NULL AS deleted, CASE WHEN p.id IS NULL THEN m.supersedes END AS supersedes FROM memories m LEFT JOIN restored r ON m.id = r.id LEFT JOIN purged p ON m.supersedes = p.id WHERE NOT EXISTS (SELECT 1 FROM purged q WHERE q.id = m.id)""", "Some tombstones are lifted, some rows purged for good; a reference to a purged row becomes null.")
query("prefix_migration", f"""WITH {MEMORIES}, old AS (SELECT id, CASE WHEN id % 3 = 0 THEN concat('[distilled] ', content) ELSE content END AS content FROM memories) SELECT id, md5(CASE WHEN content LIKE '[distilled] %' THEN substr(content, 13) ELSE content END) AS h, content LIKE '[distilled] %' AS migrated FROM old""", "The old prefix goes where a row has it, and nothing else changes.")
query("audit_page", f"""WITH {MEMORIES}, diffs AS (SELECT id, CASE WHEN deleted THEN 'delete' WHEN supersedes IS NOT NULL THEN 'supersede' ELSE 'insert' END AS op, supersedes AS before FROM memories) SELECT id, op, before FROM diffs ORDER BY id DESC LIMIT 100""", "The newest audit rows.")
query("merge_targets", """WITH rows AS (SELECT doc_id AS id, lang AS store, md5(lower(text)) AS h FROM {documents}), first AS (SELECT store, h, min(id) AS target FROM rows GROUP BY store, h) SELECT id, target FROM rows JOIN first ON rows.store = first.store AND rows.h = first.h WHERE id > target""", "Without an embedder a write replaces the first row of its scope that says the same in other letters.")
query("governed_pairs", f"""WITH {MEMORIES}, alias(given, store) AS (VALUES ('user', 'profile'), ('assistant', 'procedure'), ('system', 'lesson')), allowed(store, kind) AS (VALUES ('profile', 'user'), ('profile', 'global'), ('observation', 'user'), ('observation', 'project'), ('observation', 'agent'), ('procedure', 'global'), ('procedure', 'project'), ('procedure', 'agent'), ('lesson', 'global'), ('lesson', 'project'), ('lesson', 'agent')),
asked AS (SELECT id, alias.store, CASE id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'global' WHEN 2 THEN 'project' WHEN 3 THEN 'agent' ELSE 'team' END AS kind FROM memories LEFT JOIN alias ON memories.store = given)
SELECT id, asked.store, asked.kind, CASE WHEN asked.store IS NULL THEN 'unknown store' WHEN asked.kind = 'team' THEN 'unknown namespace' WHEN allowed.kind IS NULL THEN 'store cannot write namespace' END AS refusal FROM asked LEFT JOIN allowed ON asked.store = allowed.store AND asked.kind = allowed.kind""", "Pairs of store and namespace after aliases, with the reason of refused ones.")
query("governed_batch", f"""WITH {MEMORIES}, existing AS (SELECT id, store, namespace, md5(content) AS h, deleted, id % 4 = 1 AS superseded FROM memories WHERE id % 2 = 0 OR deleted),
writes AS (SELECT id AS seq, store, namespace, md5(content) AS h, CASE WHEN id % 6 = 1 THEN id - 1 WHEN id % 6 = 3 THEN -5 END AS supersedes FROM memories),
first AS (SELECT w.*, row_number() OVER (PARTITION BY store, namespace, h ORDER BY seq) AS k FROM writes w),
live AS (SELECT store, namespace, h, min(id) AS id FROM existing WHERE NOT deleted AND NOT superseded GROUP BY store, namespace, h),
tomb AS (SELECT store, namespace, h, min(id) AS id, min(CASE WHEN superseded THEN 1 ELSE 0 END) AS blocked FROM existing WHERE deleted GROUP BY store, namespace, h),
judged AS (SELECT f.seq, CASE WHEN f.store = 'system' AND f.namespace = 'p1' THEN 'reject' WHEN live.id IS NOT NULL OR k > 1 THEN 'duplicate' WHEN f.supersedes IS NOT NULL AND t.id IS NULL THEN 'supersede missing'
  WHEN f.supersedes IS NOT NULL AND (t.deleted OR t.superseded OR t.store <> f.store OR t.namespace <> f.namespace) THEN 'supersede refused' WHEN tomb.blocked = 1 THEN 'blocked by tombstone' WHEN tomb.id IS NOT NULL THEN 'revive'
  WHEN f.supersedes IS NOT NULL THEN 'supersede' ELSE 'insert' END AS op, coalesce(live.id, tomb.id, t.id) AS before
FROM first f LEFT JOIN live ON f.store = live.store AND f.namespace = live.namespace AND f.h = live.h LEFT JOIN tomb ON f.store = tomb.store AND f.namespace = tomb.namespace AND f.h = tomb.h LEFT JOIN existing t ON f.supersedes = t.id)
SELECT seq, op, before FROM judged""", "A batch of writes against the store, every outcome as an audit row: refused scope, duplicate, supersession (of nothing, of a row that is not current here, or done), revived or blocking tombstone, insert.")

query("confidence_rule", f"""WITH {MEMORIES}, s AS (SELECT id, CASE WHEN id % 13 = 0 THEN (id % 30) / 20.0 - 0.2 END AS explicit, id % 5 = 1 AS confirmed, id % 7 = 1 AS corrected, id % 3 = 1 AS hedged FROM memories)
SELECT id, round(CAST(CASE WHEN explicit IS NOT NULL THEN greatest(0.0, least(1.0, explicit)) WHEN confirmed OR corrected THEN 1.0 WHEN hedged THEN 0.4 ELSE 0.8 END AS DOUBLE), 6) AS confidence FROM s""", "An explicit value between 0 and 1, else what was confirmed or corrected is sure, what was hedged is not, and the rest fairly.")
query("like_scan", "SELECT page_id, url LIKE '%page=_&ref=%' AS any_page, url LIKE '%!?page=2!&%' ESCAPE '!' AS second_page, html LIKE '%100!%%' ESCAPE '!' AS percent FROM {pages}".replace("!?", "?").replace("!&", "&"), "Patterns with wild cards, and with escaped ones.")

# Entities

query("entity_upsert", f"""WITH {ENTITIES}, k AS (SELECT lower(trim(name)) AS norm_name, trim(name) AS name, kind, summary, seq FROM names)
SELECT norm_name, min(seq) AS entity_id, max_by(name, seq) AS name, max_by(kind, CASE WHEN kind IS NOT NULL THEN seq END) AS kind, max_by(summary, CASE WHEN summary IS NOT NULL THEN seq END) AS summary FROM k GROUP BY norm_name""", "Entities by normalised name after all writes: the newest name, and the newest kind and summary that are known.")
query("alias_insert", f"""WITH {ENTITIES}, a AS (SELECT lower(trim(name)) AS norm_alias, seq AS entity_id FROM names UNION ALL SELECT lower(concat(p_name, ' ', p_brand)), p_partkey FROM {{part}}) SELECT norm_alias, min(entity_id) AS entity_id, count(*) - 1 AS refused FROM a GROUP BY norm_alias""", "An alias belongs to the entity that had it first.")
query("resolved_entity_ids", f"""WITH {ENTITIES}, e AS (SELECT lower(trim(name)) AS norm_name, min(seq) AS id FROM names GROUP BY lower(trim(name))), al AS (SELECT lower(concat(p_brand, ' ', p_name)) AS norm_alias, min(p_partkey) AS id FROM {{part}} GROUP BY lower(concat(p_brand, ' ', p_name))),
asked AS (SELECT p_partkey AS ask, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_brand, ' ', p_name) ELSE concat(p_name, '?') END AS name FROM {{part}}) SELECT ask, coalesce(e.id, al.id) AS entity_id, CASE WHEN e.id IS NOT NULL THEN 'name' WHEN al.id IS NOT NULL THEN 'alias' END AS found_by FROM asked LEFT JOIN e ON lower(trim(name)) = norm_name LEFT JOIN al ON lower(trim(name)) = norm_alias""", "Ids of names, by the normalised name, else by an alias.")
query("fact_upsert", """WITH fam(relation, family) AS (VALUES ('drives_model', 'model_inference'), ('runs_model', 'model_inference'), ('powers', 'model_inference'), ('powered_by', 'model_inference'), ('integrates_runtime', 'runtime_integration'), ('orchestrates', 'runtime_integration'), ('supports', 'runtime_integration'),
  ('uses_model_for_permission_gatekeeping', 'permission_gatekeeper'), ('uses_as_permission_gatekeeper', 'permission_gatekeeper'), ('uses_for_permission_gatekeeping', 'permission_gatekeeper'), ('hosts', 'permission_gatekeeper'), ('uses_protocol', 'protocol_use'), ('uses', 'protocol_use')),
f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS src, l_partkey % 50 AS dst, l_shipdate, md5(concat(l_returnflag, l_linestatus)) AS h, CASE l_linenumber WHEN 1 THEN 'powers' WHEN 2 THEN 'powered_by' WHEN 3 THEN 'supports' WHEN 4 THEN 'must_keep' WHEN 5 THEN 'likes' WHEN 6 THEN 'move_is_planned' ELSE 'uses' END AS relation FROM {lineitem}),
k AS (SELECT f.*, family FROM f LEFT JOIN fam ON f.relation = fam.relation WHERE NOT (f.relation LIKE 'must#_%' ESCAPE '#' OR f.relation LIKE 'should#_%' ESCAPE '#' OR f.relation LIKE 'never#_%' ESCAPE '#' OR f.relation LIKE 'planned#_%' ESCAPE '#' OR f.relation LIKE '%#_is#_planned' ESCAPE '#')),
o AS (SELECT k.*, first_value(relation) OVER (PARTITION BY src, dst, family ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, h) AS first_relation, lag(h) OVER (PARTITION BY src, dst, relation ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, h) AS last_h FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, src, l_shipdate, CASE WHEN family IS NOT NULL AND relation <> first_relation THEN 'duplicate of the family' WHEN last_h IS NULL THEN 'written' WHEN family IS NOT NULL AND h = last_h THEN 'restated' ELSE 'supersedes' END AS outcome FROM o
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, src, l_shipdate, 'refused, no relation' FROM f WHERE relation IN ('must_keep', 'move_is_planned')""", "Facts in the order of their dates: no relation at all is refused; of one pair and family the first spelling stays; the same name supersedes, unless it belongs to a family and says the same.")
query("fact_counts", f"WITH {CURRENT} SELECT s_suppkey AS entity, (SELECT count(*) FROM current WHERE src = s_suppkey) AS n_facts FROM {{supplier}}", "Current facts of each entity: a correlated count, which the planner turns into one aggregate and a join.")
query("entity_delete", f"""WITH {CURRENT}, gone AS (SELECT s_suppkey AS id FROM {{supplier}} WHERE s_suppkey % 20 = 0) SELECT gone.id, count(edge_id) AS n_edges, count(DISTINCT dst) AS n_neighbours FROM gone LEFT JOIN current ON src = gone.id GROUP BY gone.id""", "What goes with each deleted entity.")
query("after_entity_delete", f"""WITH {CURRENT} SELECT relation, count(*) AS n FROM current WHERE NOT EXISTS (SELECT 1 FROM {{supplier}} WHERE s_suppkey = src AND s_suppkey % 20 = 0) GROUP BY relation""", "Facts that stay when entities are deleted.")
query("pending_queue", """WITH w AS (SELECT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b, l_orderkey AS seq, CASE WHEN l_returnflag = 'R' THEN 1 END AS dismissed FROM {lineitem} WHERE l_linenumber = 1 AND l_suppkey <> l_partkey % 100)
SELECT a, b, min(seq) AS first_seq, count(*) AS n_writes, max(dismissed) IS NOT NULL AS dismissed FROM w GROUP BY a, b""", "Pairs that await a ruling, the smaller id first, written once; a dismissed pair stays dismissed.")
query("bundle_merge", """WITH b AS (SELECT 1 AS bundle, p_partkey AS pos, lower(trim(p_name)) AS key, p_name AS name FROM {part} WHERE p_size <= 25 UNION ALL SELECT 2, p_partkey, lower(trim(upper(p_name))), upper(p_name) FROM {part} WHERE p_size > 10), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bundle, pos) AS k, count(*) OVER (PARTITION BY key) AS n FROM b) SELECT key, bundle, name, n FROM r WHERE k = 1""", "Candidates of several bundles by normalised key; the first one stays.")
query("claim_retractions", """WITH claims AS (SELECT doc_id % 100 AS document, CASE WHEN doc_id % 2 = 0 THEN 'previous' ELSE 'current' END AS revision, n_chars % 37 AS fact FROM {documents}), p AS (SELECT DISTINCT document, fact FROM claims WHERE revision = 'previous'), c AS (SELECT DISTINCT document, fact FROM claims WHERE revision = 'current')
SELECT p.document, p.fact, NOT EXISTS (SELECT 1 FROM claims x WHERE x.fact = p.fact AND x.document <> p.document AND x.document % 3 = 0) AS retracted FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.document = p.document AND c.fact = p.fact)""", "Facts that a document claims no longer; they are retracted unless another document claims them.")
query("ingest_sweep", """WITH ledger AS (SELECT doc_id, md5(text) AS h FROM {documents} WHERE doc_id % 3 <> 0), todo AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'changed' END AS why FROM {documents} d LEFT JOIN ledger l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR (d.doc_id % 10 = 1 AND l.h <> md5(concat(d.text, '!')))) SELECT doc_id, why FROM todo ORDER BY doc_id DESC LIMIT 20""", "The 20 newest documents that the ledger does not know as they are.")
query("ingest_totals", """WITH i AS (SELECT source, lang, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'unchanged' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'ingested' END AS outcome FROM {documents}) SELECT source, count(*) AS n_docs, count(CASE WHEN outcome = 'ingested' THEN 1 END) AS n_ingested, count(CASE WHEN outcome = 'failed' THEN 1 END) AS n_failed, CAST(sum(CASE WHEN outcome = 'ingested' THEN n_chars ELSE 0 END) AS BIGINT) AS n_chars FROM i GROUP BY source""", "Reports of an ingest put together.")

# Pages and builds

BUILDS = "builds AS (SELECT page_id AS build_id, page_id % 3 = 0 AS dry_run, CASE WHEN page_id % 4 <> 0 THEN page_id + 10 END AS finished_at, url FROM {pages})"
query("unfinished_plans", f"WITH {BUILDS} SELECT build_id, url FROM builds WHERE dry_run AND finished_at IS NULL", "Plans that were tried but not carried out.")
query("build_rows", f"""WITH {BUILDS}, steps AS (SELECT build_id, CASE WHEN dry_run THEN 'planned' WHEN finished_at IS NULL THEN 'running' WHEN build_id % 5 = 0 THEN 'failed' ELSE 'done' END AS status FROM builds) SELECT status, count(*) AS n_builds, min(build_id) AS first_build, max(build_id) AS last_build FROM steps GROUP BY status""", "Builds by the status that their last step left.")
query("stale_stamps", """WITH prev AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id + 1000 END AS stale_since FROM {pages} WHERE page_id % 5 <> 0), seen AS (SELECT page_id, length(html) % 2 = 0 AS stale FROM {pages}) SELECT seen.page_id, CASE WHEN stale THEN coalesce(stale_since, 2000) END AS stale_since FROM seen LEFT JOIN prev ON seen.page_id = prev.page_id""", "Since when a page is stale: the first time it was seen so, and nothing once it is fresh.")
query("hash_reconciliation", """WITH recorded AS (SELECT page_id, md5(html) AS h FROM {pages}), files AS (SELECT page_id FROM {pages} WHERE page_id % 4 <> 0), indexed AS (SELECT doc_id FROM {documents} WHERE doc_id % 3 <> 0) SELECT page_id, h FROM recorded r WHERE EXISTS (SELECT 1 FROM files f WHERE f.page_id = r.page_id) OR EXISTS (SELECT 1 FROM indexed i WHERE i.doc_id = r.page_id)""", "Recorded hashes stay as long as the page's file or its document is there.")
query("page_scope", """WITH pg AS (SELECT page_id, page_id % 200 AS doc_id, md5(concat('v', page_id % 2)) AS recorded FROM {pages}), live AS (SELECT doc_id, md5(concat('v', n_chars % 2)) AS h FROM {documents}), stale AS (SELECT page_id, pg.doc_id FROM pg JOIN live ON pg.doc_id = live.doc_id WHERE recorded <> h)
SELECT doc_id, 'stale page' AS why FROM stale GROUP BY doc_id UNION ALL SELECT doc_id, 'unrecorded' FROM live WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.doc_id = live.doc_id)""", "Sources to read again: those of stale pages, and those that no page records.")
query("page_renames", """WITH plan AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'create' ELSE 'update' END AS op, md5(concat(page_id % 40, ',', page_id % 40 + 1)) AS sources FROM {pages}) SELECT d.page_id AS old_page, min(c.page_id) AS new_page FROM plan d JOIN plan c ON d.sources = c.sources AND c.op <> 'delete' WHERE d.op = 'delete' GROUP BY d.page_id""", "A deleted page whose sources a new one has was renamed.")
query("page_row_upsert", """WITH old AS (SELECT page_id, md5(url) AS h, page_id % 2 AS stale FROM {pages} WHERE page_id % 3 <> 0), new AS (SELECT page_id, md5(html) AS h, length(html) - length(replace(html, '<b>', '')) AS marks FROM {pages} WHERE page_id % 2 = 0)
SELECT coalesce(new.page_id, old.page_id) AS page_id, coalesce(new.h, old.h) AS h, CASE WHEN new.page_id IS NULL THEN stale END AS stale, CAST(coalesce(marks, 0) AS BIGINT) AS marks FROM new FULL OUTER JOIN old ON new.page_id = old.page_id""", "Page rows after a build: a built page has its new hash and marks and is no longer stale.")
query("corrections", """WITH c AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN concat('reason ', page_id) END AS reason, CASE WHEN page_id % 7 <> 0 THEN 'editor' ELSE ' ' END AS author FROM {pages}) SELECT page_id, CASE WHEN reason IS NULL OR trim(reason) = '' THEN 'no reason' WHEN author IS NULL OR trim(author) = '' THEN 'no author' ELSE 'appended' END AS outcome FROM c""", "A correction needs a reason and an author.")
query("source_inventory", """WITH r AS (SELECT page_id % 300 AS doc_id, count(*) AS n_pages FROM {pages} GROUP BY page_id % 300) SELECT d.doc_id, md5(text) AS h, coalesce(n_pages, 0) AS n_pages FROM {documents} d LEFT JOIN r ON d.doc_id = r.doc_id""", "All sources with their hashes and the number of pages that use them.")
query("recall_sections", f"""WITH {MEMORIES}, s AS (SELECT 'memory' AS section, id AS item_id, access_count AS score FROM memories WHERE NOT deleted UNION ALL SELECT 'knowledge', doc_id, n_chars FROM {{documents}} UNION ALL SELECT 'wiki', page_id, length(html) FROM {{pages}} UNION ALL SELECT 'graph', s_suppkey, 0 FROM {{supplier}}),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, item_id) AS rank FROM s) SELECT section, item_id, CAST(score AS BIGINT) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= CASE section WHEN 'memory' THEN 5 WHEN 'knowledge' THEN 3 WHEN 'wiki' THEN 2 ELSE 3 END""", "Four sections, each with its own budget.")
