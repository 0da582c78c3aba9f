"""Entities by their names: variants, the mechanical judge, resolution of new names, seeds of a question, and entity search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import TERMS_SQL, terms
from tessera.operators.containment import contained
from tessera.operators.retrieval import recallable, small
from tessera.plans.query import registry
from tessera.sources.checkpoints import cut
from tessera.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

#: The legs of seed resolution with their scores, the most seeds, and the entities that a search gives.
LEGS = {"exact_name": 1.0, "alias": 0.9, "name_token": 0.7, "summary": 0.5}
SEED_CAP = 32
MOST_FOUND = 8
LEAST_NAME = 3


def variants(name: Column) -> Column:
    """The name without its last bracketed part, the whole name, and what the brackets hold; trimmed, in lower case; brackets of either width."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    inside = r"(?s)^(.*)[(（]([^(（]*)[)）][^)）]*$"
    outer, inner = F.trim(F.regexp_extract(n, inside, 1)), F.trim(F.regexp_extract(n, inside, 2))
    return F.array_distinct(F.filter(F.array(outer, n, inner), lambda x: x != ""))


def tokens(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda w: w != "")


def acronym(name: Column) -> Column:
    """Initials of two words or more, if all of them begin with a letter or digit; else null."""
    words = tokens(name)
    good = (F.size(words) > 1) & F.forall(words, lambda w: w.rlike(r"^[\p{L}\p{N}]"))
    return F.when(good, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def described(names: DataFrame) -> DataFrame:
    """(id, variant, words, initials, first): a row for each variant of (id, name)."""
    return names.select("id", F.get(terms(F.col("name")), F.lit(0)).alias("first"), F.explode(variants(F.col("name"))).alias("variant")).select("id", "first", "variant", F.array_distinct(tokens(F.col("variant"))).alias("words"), acronym(F.col("variant")).alias("initials"))


def judge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(id, verdict, match) of each new (id, name): same object as, pending with, or different from the existing entities; the match is the one of the least id.

    Same: equal variants, the words of one within the other's (both of three characters or more), or one is the acronym
    of the other. Pending: the first terms are equal. Every rule is an equi-join: on variants, on initials, on first
    terms, and for words on the rarest word of the shorter name.
    """
    old, ask = cut(described(existing)), cut(described(new))
    o = old.select(F.col("id").alias("match"), F.col("variant").alias("v"), F.col("words").alias("w"), F.col("initials").alias("i"), F.col("first").alias("f"))
    least = lambda df, key: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("match").alias("match"))
    pairs = [ask.join(least(o, "v"), ask.variant == F.col("v")), ask.join(least(o, "i"), ask.variant == F.col("i")), ask.join(least(o, "v"), ask.initials == F.col("v"))]
    words = old.select(F.explode("words").alias("word")).unionByName(ask.select(F.explode("words").alias("word"))).groupBy("word").agg(F.count("*").alias("often"))
    long_enough = lambda df, c: df.filter(F.char_length(c) >= LEAST_NAME)
    for short, long, kept in ((ask, old, "id"), (old, ask, "match")):
        rarest = long_enough(short, "variant").select("id", "words", F.explode("words").alias("word")).join(words, "word").groupBy("id", "words").agg(F.min_by("word", F.struct("often", "word")).alias("word"))
        others = long_enough(long, "variant").select(F.col("id").alias("other"), F.col("words").alias("all"), F.explode("words").alias("word"))
        found = rarest.join(others, "word").filter((F.size("words") <= F.size("all")) & (F.size(F.array_except("words", "all")) == 0))
        pairs.append(found.select("id", F.col("other").alias("match")) if kept == "id" else found.select(F.col("other").alias("id"), F.col("id").alias("match")))
    same = None
    for p in pairs:
        p = p.select("id", "match")
        same = p if same is None else same.unionByName(p)
    same = same.groupBy("id").agg(F.min("match").alias("same"))
    pending = ask.select("id", "first").distinct().join(o.filter("f is not null").groupBy("f").agg(F.min("match").alias("pending")), F.col("first") == F.col("f")).select("id", "pending")
    verdict = F.when(F.col("same").isNotNull(), "same").when(F.col("pending").isNotNull(), "pending").otherwise("different")
    return new.select("id").join(same, "id", "left").join(pending, "id", "left").select("id", verdict.alias("verdict"), F.coalesce("same", "pending").alias("match"))


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities named by part and brand, one for each pair: the brand in brackets."""
    return table(spark, sf_dir, "part").filter("p_size <= 25").groupBy(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("name")).agg(F.min("p_partkey").alias("id")).select("id", "name")


def new_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter("p_size > 25")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" "), "p_type")).when(F.col("p_partkey") % 4 == 1, F.col("p_brand")).when(F.col("p_partkey") % 4 == 2, F.concat(F.substring("p_name", 1, 1), F.expr("substring(substring_index(p_name, ' ', -1), 1, 1)"))).otherwise(F.concat(F.expr("substring_index(p_name, ' ', 1)"), F.lit("-"), "p_type", F.lit("x"), F.col("p_size")))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"))


NAMES_SQL = """ex AS (SELECT p_name || ' (' || p_brand || ')' AS name, min(p_partkey) AS id FROM part WHERE p_size <= 25 GROUP BY 1),
nw AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_brand WHEN 2 THEN substr(p_name, 1, 1) || substr(string_split(p_name, ' ')[-1], 1, 1) ELSE string_split(p_name, ' ')[1] || '-' || p_type || 'x' || p_size END AS name FROM part WHERE p_size > 25)"""


def _described(name: str) -> str:
    term = TERMS_SQL.replace("coalesce(text, '')", "coalesce(name, '')")
    return f"""{name}_n AS (SELECT id, {term}[1] AS first, lower(trim(name)) AS n FROM {name}),
{name}_v AS (SELECT DISTINCT id, first, unnest(list_distinct(list_filter([trim(regexp_extract(n, '^(.*)[(（]([^(（]*)[)）][^)）]*$', 1)), n, trim(regexp_extract(n, '^(.*)[(（]([^(（]*)[)）][^)）]*$', 2))], lambda x: x <> ''))) AS variant FROM {name}_n),
{name}_d AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(variant, '\\s+'), lambda w: w <> '')) AS words, CASE WHEN len(regexp_split_to_array(variant, '\\s+')) > 1 AND len(list_filter(regexp_split_to_array(variant, '\\s+'), lambda w: NOT regexp_matches(w, '^[\\p{{L}}\\p{{N}}]'))) = 0
  THEN array_to_string(list_transform(regexp_split_to_array(variant, '\\s+'), lambda w: substr(w, 1, 1)), '') END AS initials FROM {name}_v)"""


JUDGE_SQL = f"""{NAMES_SQL}, {_described("ex")}, {_described("nw")},
same AS (SELECT a.id, min(b.id) AS same FROM nw_d a JOIN ex_d b ON a.variant = b.variant OR a.variant = b.initials OR a.initials = b.variant
  OR (length(a.variant) >= 3 AND length(b.variant) >= 3 AND (list_has_all(b.words, a.words) OR list_has_all(a.words, b.words))) GROUP BY a.id),
pend AS (SELECT a.id, min(b.id) AS pending FROM nw_n a JOIN ex_n b ON a.first = b.first GROUP BY a.id),
verdicts AS (SELECT id, CASE WHEN same IS NOT NULL THEN 'same' WHEN pending IS NOT NULL THEN 'pending' ELSE 'different' END AS verdict, coalesce(same, pending) AS match FROM nw LEFT JOIN same USING (id) LEFT JOIN pend USING (id))"""


@query(f"WITH {JUDGE_SQL} SELECT * FROM verdicts")
def entity_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(known_names(spark, sf_dir), new_names(spark, sf_dir))


@query(f"WITH {JUDGE_SQL} SELECT CASE verdict WHEN 'same' THEN 'resolved' WHEN 'pending' THEN 'created, pair queued' ELSE 'created' END AS outcome, count(*) AS n, count(DISTINCT match) AS n_matches, count(DISTINCT CASE WHEN verdict <> 'same' THEN lower(trim(name)) END) AS n_created FROM verdicts JOIN nw USING (id) GROUP BY 1")
def resolve_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a batch of names: resolved to an entity, created, or created with a pair queued for a ruling; equal new names are created once."""
    names = new_names(spark, sf_dir)
    v = judge(known_names(spark, sf_dir), names).join(names, "id")
    outcome = F.when(F.col("verdict") == "same", "resolved").when(F.col("verdict") == "pending", "created, pair queued").otherwise("created")
    return v.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("match").alias("n_matches"), F.count_distinct(F.when(F.col("verdict") != "same", F.lower(F.trim("name")))).alias("n_created"))


def seeds(asked: DataFrame, entities: DataFrame, aliases: DataFrame, cap: int = SEED_CAP) -> DataFrame:
    """(query, id, leg, score, rank): the entities that each text (query, text) names, by the best leg.

    exact_name: the whole text is the name; alias: the text or a term of it is an alias; name_token: a word of the name
    begins with a term, or the text contains the name; summary: a word of the summary begins with a term.
    """
    t = cut(asked.select("query", F.lower(F.trim("text")).alias("low"), F.array_distinct(terms(F.col("text"))).alias("terms")).filter("low != ''"))
    each = t.select("query", F.explode("terms").alias("term"))
    names = entities.select("id", F.lower(F.trim("name")).alias("norm"))
    heads = lambda c: F.flatten(F.transform(terms(F.col(c)), lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda k: F.substring(w, F.lit(1), k))))
    probes = small(cut(each.filter(recallable(F.col("term")))))
    floor = (F.char_length("norm") >= LEAST_NAME) | ~F.col("norm").rlike(r"^[\x00-\x7F]*$")
    legs = {
        "exact_name": t.join(names, t.low == names.norm).select("query", "id"),
        "alias": t.select("query", F.explode(F.array_union(F.array("low"), "terms")).alias("probe")).join(aliases.select("id", F.lower(F.trim("alias")).alias("probe")), "probe").select("query", "id"),
        "name_token": entities.select("id", F.explode(F.array_distinct(heads("name"))).alias("term")).join(probes, "term").select("query", "id").unionByName(contained(t.select("query", F.col("low").alias("text")), names.filter(floor).select("id", F.col("norm").alias("name")))),
        "summary": entities.filter("summary is not null").select("id", F.explode(F.array_distinct(heads("summary"))).alias("term")).join(probes, "term").select("query", "id"),
    }
    found = None
    for order, (leg, rows) in enumerate(legs.items()):
        part = rows.distinct().select("query", "id", F.lit(order).alias("order"), F.lit(leg).alias("leg"), F.lit(LEGS[leg]).alias("score"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("query", "id").agg(F.min(F.struct("order", "leg", "score")).alias("b")).select("query", "id", "b.*")
    place = F.row_number().over(W.partitionBy("query").orderBy("order", F.desc("score"), "id"))
    return best.withColumn("place", place).filter(F.col("place") <= cap).select("query", "id", "leg", "score", (F.col("place") - 1).cast("long").alias("rank"))


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, summary) of the parts by name, brand and type."""
    return table(spark, sf_dir, "part").groupBy(F.concat("p_name", F.lit(" "), "p_type").alias("name")).agg(F.min("p_partkey").alias("id"), F.min("p_brand").alias("summary")).select("id", "name", "summary")


ENTITIES_SQL = """en AS (SELECT p_name || ' ' || p_type AS name, min(p_partkey) AS id, min(p_brand) AS summary FROM part GROUP BY 1), al AS (SELECT id, string_split(name, ' ')[1] || string_split(name, ' ')[-1] AS alias FROM en)"""


def part_aliases(entities: DataFrame) -> DataFrame:
    return entities.select("id", F.concat(F.expr("substring_index(name, ' ', 1)"), F.expr("substring_index(name, ' ', -1)")).alias("alias"))


def _leg_sql(term: str) -> str:
    norm = "lower(trim(name))"
    return f"""pr AS (SELECT query, unnest(terms) AS term FROM tx), rc AS (SELECT * FROM pr WHERE length(term) >= 3 OR NOT regexp_full_match(term, '[\\x00-\\x7F]*')),
nt AS (SELECT id, unnest({term.replace("coalesce(text, '')", "coalesce(name, '')")}) AS w FROM en), sm AS (SELECT id, unnest({term.replace("coalesce(text, '')", "coalesce(summary, '')")}) AS w FROM en),
lg AS (SELECT query, id, 0 AS o, 'exact_name' AS leg, 1.0::DOUBLE AS score FROM tx JOIN en ON low = {norm}
UNION ALL SELECT query, al.id, 1, 'alias', 0.9 FROM tx JOIN al ON low = lower(alias) OR list_contains(terms, lower(alias))
UNION ALL SELECT query, id, 2, 'name_token', 0.7 FROM rc JOIN nt ON starts_with(w, term) UNION ALL SELECT query, id, 2, 'name_token', 0.7 FROM tx JOIN en ON contains(low, {norm}) AND length({norm}) >= 3
UNION ALL SELECT query, id, 3, 'summary', 0.5 FROM rc JOIN sm ON starts_with(w, term)),
bs AS (SELECT query, id, min(o) AS o, arg_min(leg, o) AS leg, arg_min(score, o) AS score FROM lg GROUP BY query, id), rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY o, score DESC, id) - 1 AS rank FROM bs)"""


@query(f"""WITH {ENTITIES_SQL}, q0 AS (SELECT p_partkey AS query, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN 'Where is the ' || p_name || ' ' || p_type || ' kept?' ELSE string_split(p_name, ' ')[1] || p_type || ' or ' || p_brand END AS text FROM part WHERE p_partkey % 20 = 0),
tx AS (SELECT query, lower(trim(text)) AS low, list_distinct({TERMS_SQL}) AS terms FROM q0), {_leg_sql(TERMS_SQL)} SELECT query, id, leg, score, rank FROM rk WHERE rank < 32""")
def seed_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of a question about every part whose key is divisible by 20."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" "), "p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Where is the "), "p_name", F.lit(" "), "p_type", F.lit(" kept?"))).otherwise(F.concat(F.expr("substring_index(p_name, ' ', 1)"), "p_type", F.lit(" or "), "p_brand"))
    e = cut(part_entities(spark, sf_dir))
    return seeds(p.select(F.col("p_partkey").alias("query"), text.alias("text")), e, part_aliases(e))


def with_all_terms(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(text, id) of asked (text, terms) and the entities whose name and summary hold all its terms: candidates hold its rarest one. A text without terms is held by all entities, of which the first MOST_FOUND are given."""
    words = cut(entities.select("id", F.array_distinct(F.concat(terms(F.col("name")), terms(F.coalesce("summary", F.lit(""))))).alias("words")))
    each = words.select("id", "words", F.explode("words").alias("term"))
    often = each.groupBy("term").agg(F.count("*").alias("often"))
    rarest = asked.select("text", "terms", F.explode("terms").alias("term")).join(often, "term").groupBy("text", "terms").agg(F.min_by("term", F.struct("often", "term")).alias("term"))
    held = rarest.join(each, "term").filter(F.size(F.array_except("terms", "words")) == 0).select("text", "id")
    return held.unionByName(asked.filter(F.size("terms") == 0).select("text").crossJoin(F.broadcast(entities.select("id").orderBy("id").limit(MOST_FOUND))))


def firstly(found: DataFrame, by: str) -> DataFrame:
    """The MOST_FOUND first entities (id, stage) of each group with their place."""
    place = F.row_number().over(W.partitionBy(by).orderBy("stage", "id"))
    return found.withColumn("place", place).filter(F.col("place") <= MOST_FOUND)


@query(f"""WITH {ENTITIES_SQL}, q0 AS (SELECT p_partkey AS query, CASE p_partkey % 2 WHEN 0 THEN p_name ELSE p_name || ' ' || p_type END AS text FROM part WHERE p_partkey % 20 IN (0, 1)),
tx AS (SELECT query, lower(trim(text)) AS low, list_distinct({TERMS_SQL}) AS terms FROM q0), nm AS (SELECT id, lower(name) AS norm, {TERMS_SQL.replace("coalesce(text, '')", "coalesce(name, '')")} AS w, {TERMS_SQL.replace("coalesce(text, '')", "coalesce(summary, '')")} AS s FROM en),
st AS (SELECT query, id, 0 AS stage FROM tx JOIN nm ON low = norm UNION ALL SELECT query, al.id, 1 FROM tx JOIN al ON low = lower(alias) UNION ALL SELECT query, id, 2 FROM tx JOIN nm ON list_has_all(list_concat(w, s), terms)),
bs AS (SELECT query, id, min(stage) AS stage FROM st GROUP BY query, id), rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY stage, id) - 1 AS rank FROM bs) SELECT query, id, stage::BIGINT AS stage, rank FROM rk WHERE rank < 8""")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities in stages: the exact name, an exact alias, all terms in name and summary; what several stages find counts for the first."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 20 in (0, 1)")
    asked = cut(p.select(F.col("p_partkey").alias("query"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), "p_type")).alias("text")))
    # Equal texts find the same, so each text is looked up once, and only its first MOST_FOUND entities go to those who asked.
    t = cut(asked.select("text").distinct().select("text", F.lower(F.trim("text")).alias("low"), F.array_distinct(terms(F.col("text"))).alias("terms")))
    e = cut(part_entities(spark, sf_dir))
    stages = [t.join(e, F.col("low") == F.lower("name")), t.join(part_aliases(e), F.col("low") == F.lower("alias")), with_all_terms(t, e)]
    found = None
    for k, rows in enumerate(stages):
        part = rows.select("text", "id", F.lit(k).cast("long").alias("stage"))
        found = part if found is None else found.unionByName(part)
    firsts = firstly(found.groupBy("text", "id").agg(F.min("stage").alias("stage")), "text").withColumnRenamed("text", "of")
    per_query = asked.join(small(cut(firsts)), F.col("text").eqNullSafe(F.col("of"))).groupBy("query", "id").agg(F.min("stage").alias("stage"))
    return firstly(per_query, "query").select("query", "id", "stage", (F.col("place") - 1).cast("long").alias("rank"))
