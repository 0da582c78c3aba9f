"""Names resolved one after another against a store that grows with them, in rounds of joins.

Taken in the order of their ids, each name is looked up (its own name, then an alias), then judged against every entity,
those made of earlier names included: if it is the same object as one, it becomes an alias of the one of least rank;
else it is created, and if its first term is that of another entity the pair is queued. Entities known before rank ahead
of created ones. So whether a name is created depends on which earlier names were.

A name that no known entity answers to is decided once all earlier names it could be the same as are: created if none of
them was, else resolved. Each round decides all such names at once. Names meet through nodes (a variant, initials, a set
of words), each of which tells only its least created and least open name, so no pairs of names are formed; the links
between nodes are formed once (equal keys, and sets of words within others, found by the rarest word). The rounds are as
many as the longest chain of names that wait for each other, and each reads only what is still open.

Defined results: null and blank names are `unnamed` and belong to no entity; of rows with one id the least name counts;
equal names go with the first of them; without known entities or aliases all rules hold among the new names; an empty
table gives no rows; columns besides the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalised
from tessera.operators.entities import LEAST_NAME, _described, described, judge
from tessera.plans.query import registry
from tessera.sources.checkpoints import cut, written
from tessera.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

#: Rounds after which the created names are written anew, so that plans stay short.
ROUNDS_KEPT = 16


def within(sets: DataFrame) -> DataFrame:
    """(node, other): every set of words (node, words) with every set that holds all of its words, itself included; candidates share the rarest word of the smaller set."""
    each = sets.select("node", "words", F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("often"))
    rarest = each.join(often, "word").groupBy("node").agg(F.min_by("word", F.struct("often", "word")).alias("word"), F.first("words").alias("few"))
    many = each.select(F.col("node").alias("other"), F.col("words").alias("all"), "word")
    return rarest.join(many, "word").filter((F.size("few") <= F.size("all")) & (F.size(F.array_except("few", "all")) == 0)).select("node", "other")


def meetings(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that each name stands at, (id, node), and the nodes that a name at a node is the same object as, (node, other)."""
    d = cut(described(names))
    key = lambda kind, value: F.concat(F.lit(kind), value).alias("node")
    spelled = d.select("id", key("v", F.col("variant")))
    short = d.filter("initials is not null").select("id", key("i", F.col("initials")))
    bags = d.filter(F.char_length("variant") >= LEAST_NAME).select("id", F.array_sort("words").alias("words")).select("id", "words", key("s", F.array_join("words", " ")))
    at = written(spelled.unionByName(short).unionByName(bags.select("id", "node")).distinct())
    turned = lambda df: df.select(F.col("other").alias("node"), F.col("node").alias("other"))
    same = at.filter("node like 'v%'").select("node").distinct().select("node", F.col("node").alias("other"))
    initials = at.filter("node like 'i%'").select("node").distinct().withColumn("other", F.concat(F.lit("v"), F.expr("substring(node, 2)"))).join(same.select("other"), "other", "left_semi").select("node", "other")
    inside = written(within(bags.select("node", "words").dropDuplicates(["node"])))
    return at, written(same.unionByName(initials).unionByName(turned(initials)).unionByName(inside).unionByName(turned(inside)).distinct())


def least_met(at: DataFrame, links: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """For each name, the least value of the columns of `rows` (id, ...) over all names that it is the same object as, itself included."""
    least = [F.min(c).alias(c) for c in columns]
    told = at.join(rows, "id").groupBy("node").agg(*least).withColumnRenamed("node", "other")
    return at.join(links.join(told, "other").groupBy("node").agg(*least), "node").groupBy("id").agg(*least)


def created_in_order(names: DataFrame, at: DataFrame, links: DataFrame) -> DataFrame:
    """(id) of the names that are created: those that are the same object as no created name before them."""
    open_ = written(names.select("id", F.lit(False).alias("new")))
    made, turn = open_.filter("new").select("id"), 0
    while not open_.isEmpty():
        waits = open_.select("id", F.when(F.col("new"), F.col("id")).alias("made"), F.when(~F.col("new"), F.col("id")).alias("open"))
        met = least_met(at, links, waits, "made", "open")
        left = open_.filter("not new").join(met, "id").filter(F.col("made").isNull() | (F.col("made") > F.col("id")))
        open_ = written(left.select("id", (F.col("open") == F.col("id")).alias("new")))
        made, turn = made.unionByName(open_.filter("new").select("id")), turn + 1
        if turn % ROUNDS_KEPT == 0:
            made = written(made)
    return written(made)


def resolve(known: DataFrame, aliases: DataFrame, new: DataFrame) -> DataFrame:
    """(id, outcome, entity, is_known, queued_with, queued_known) of new (id, name) in order against known (id, name) and aliases (id, alias).

    outcome: resolved, created, `created, pair queued` or unnamed. entity: of the known ones if is_known, else the id of the name it was created for.
    """
    rows = cut(new.select("id", "name").groupBy("id").agg(F.min("name").alias("name")).withColumn("norm", normalised(F.coalesce("name", F.lit("")))))
    first = cut(rows.filter("norm != ''").groupBy("norm").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name")))
    spelled = known.groupBy(normalised("name").alias("norm")).agg(F.min("id").alias("spelled"))
    called = aliases.groupBy(normalised("alias").alias("norm")).agg(F.min("id").alias("called"))
    looked = cut(first.join(spelled, "norm", "left").join(called, "norm", "left").select("id", "name", "norm", F.coalesce("spelled", "called").alias("entity")))
    asked = looked.filter("entity is null").select("id", "name")
    judged = cut(judge(known.select("id", "name"), asked))
    rest = cut(asked.join(judged.filter("verdict = 'same'"), "id", "left_anti"))
    at, links = meetings(rest)
    made = created_in_order(rest, at, links)
    found = least_met(at, links, made.withColumn("entity", F.col("id")), "entity").join(made, "id", "left_anti")
    lead = cut(described(rest).filter("first is not null").select("id", "first").distinct().join(made, "id"))
    alike = lead.join(lead.groupBy("first").agg(F.min("id").alias("other")), "first").filter("other < id").select("id", "other")
    queued = made.join(judged.filter("verdict = 'pending'").select("id", "match"), "id", "left").join(alike, "id", "left").select("id", F.coalesce("match", "other").alias("queued_with"), F.when(F.col("match").isNotNull(), True).when(F.col("other").isNotNull(), False).alias("queued_known"))
    outcome = F.when(F.col("queued_with").isNull(), "created").otherwise("created, pair queued")
    none = [F.lit(None).cast("long").alias("queued_with"), F.lit(None).cast("boolean").alias("queued_known")]
    resolved = lambda df, c, is_known: df.select("id", F.lit("resolved").alias("outcome"), F.col(c).alias("entity"), F.lit(is_known).alias("is_known"), *none)
    decided = resolved(looked.filter("entity is not null"), "entity", True).unionByName(resolved(judged.filter("verdict = 'same'"), "match", True)).unionByName(resolved(found, "entity", False))
    decided = cut(decided.unionByName(queued.select("id", outcome.alias("outcome"), F.col("id").alias("entity"), F.lit(False).alias("is_known"), "queued_with", "queued_known")))
    of_name = decided.withColumnRenamed("id", "first_id").join(first.select(F.col("id").alias("first_id"), "norm"), "first_id")
    own = F.col("id") == F.col("first_id")
    return rows.join(of_name, "norm", "left").select(
        "id", F.when(F.col("first_id").isNull(), "unnamed").when(own, F.col("outcome")).otherwise("resolved").alias("outcome"), "entity", "is_known",
        F.when(own, F.col("queued_with")).alias("queued_with"), F.when(own, F.col("queued_known")).alias("queued_known"),
    )


#: The parts under names of five forms, the brands as known entities and another name for each; both engines read these.
NAMES_SQL = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ' (', p_brand, ')') WHEN 1 THEN concat(p_name, ' ', p_type, ' ', p_size) WHEN 2 THEN concat(CASE WHEN p_size % 5 = 0 THEN 'house ' ELSE '' END, p_brand, CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('-', p_size) END)
  WHEN 3 THEN concat(substr(p_name, 1, 1), substr(p_name, instr(p_name, ' ') + 1, 1), substr(p_type, 1, 1), substr(cast(p_size AS varchar(9)), 1, 1)) ELSE concat(p_type, ' ', p_size, ' ', substr(p_name, instr(p_name, ' ') + 1)) END AS name FROM part"""
KNOWN_SQL = "SELECT min(p_partkey) AS id, p_brand AS name FROM part GROUP BY p_brand"
ALIAS_SQL = "SELECT min(p_partkey) AS id, concat('house ', p_brand) AS alias FROM part GROUP BY p_brand"
SAME_SQL = f"(a.variant = b.variant OR a.variant = b.initials OR a.initials = b.variant OR (length(a.variant) >= {LEAST_NAME} AND length(b.variant) >= {LEAST_NAME} AND (list_has_all(b.words, a.words) OR list_has_all(a.words, b.words))))"


@query(f"""WITH RECURSIVE names AS ({NAMES_SQL}), ex AS ({KNOWN_SQL}), al AS ({ALIAS_SQL}),
fi AS MATERIALIZED (SELECT lower(trim(name)) AS norm, min(id) AS id, arg_min(name, id) AS name FROM names WHERE trim(name) <> '' GROUP BY 1),
lk AS MATERIALIZED (SELECT fi.id, coalesce(min(ex.id), min(al.id)) AS entity FROM fi LEFT JOIN ex ON lower(trim(ex.name)) = norm LEFT JOIN al ON lower(trim(alias)) = norm GROUP BY fi.id),
nw AS (SELECT id, name FROM fi JOIN lk USING (id) WHERE entity IS NULL), {_described("ex")}, {_described("nw")},
sm AS MATERIALIZED (SELECT a.id, min(b.id) AS entity FROM nw_d a JOIN ex_d b ON {SAME_SQL} GROUP BY a.id),
un AS MATERIALIZED (SELECT * FROM nw_d WHERE id NOT IN (SELECT id FROM sm)),
pr AS MATERIALIZED (SELECT DISTINCT a.id, b.id AS other FROM un a JOIN un b ON b.id < a.id AND {SAME_SQL}),
od AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k, others FROM (SELECT u.id, list(other) FILTER (WHERE other IS NOT NULL) AS others FROM (SELECT DISTINCT id FROM un) u LEFT JOIN pr ON pr.id = u.id GROUP BY u.id)),
md(k, ids) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT od.k, CASE WHEN list_has_any(ids, coalesce(others, [])) THEN ids ELSE list_append(ids, od.id) END FROM md JOIN od ON od.k = md.k + 1),
cr AS MATERIALIZED (SELECT unnest(ids) AS id FROM (SELECT ids FROM md ORDER BY k DESC LIMIT 1)),
fe AS (SELECT id, first FROM nw_n JOIN cr USING (id)),
qd AS (SELECT cr.id, (SELECT min(e.id) FROM nw_n n JOIN ex_n e ON e.first = n.first WHERE n.id = cr.id) AS k_id, (SELECT min(o.id) FROM fe m JOIN fe o ON o.first = m.first WHERE m.id = cr.id AND o.id < cr.id) AS o_id FROM cr),
de AS (SELECT id, 'resolved' AS outcome, entity, true AS is_known, NULL::BIGINT AS queued_with, NULL::BOOLEAN AS queued_known FROM lk WHERE entity IS NOT NULL UNION ALL SELECT id, 'resolved', entity, true, NULL, NULL FROM sm
  UNION ALL SELECT pr.id, 'resolved', min(other), false, NULL, NULL FROM pr WHERE other IN (SELECT id FROM cr) AND pr.id NOT IN (SELECT id FROM cr) GROUP BY pr.id
  UNION ALL SELECT id, CASE WHEN coalesce(k_id, o_id) IS NULL THEN 'created' ELSE 'created, pair queued' END, id, false, coalesce(k_id, o_id), CASE WHEN k_id IS NOT NULL THEN true WHEN o_id IS NOT NULL THEN false END FROM qd)
SELECT n.id, CASE WHEN fi.id IS NULL THEN 'unnamed' WHEN n.id = fi.id THEN outcome ELSE 'resolved' END AS outcome, entity, is_known, CASE WHEN n.id = fi.id THEN queued_with END AS queued_with, CASE WHEN n.id = fi.id THEN queued_known END AS queued_known
FROM names n LEFT JOIN fi ON lower(trim(n.name)) = fi.norm LEFT JOIN de ON de.id = fi.id""")
def resolved_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part under one of five forms of name, one after another, against the brands and what earlier parts created."""
    part = table(spark, sf_dir, "part")
    return resolve(*(cut(spark.sql(sql.replace("FROM part", "FROM {part}"), part=part)) for sql in (KNOWN_SQL, ALIAS_SQL, NAMES_SQL)))
