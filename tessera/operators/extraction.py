"""Graph candidates of documents by rules: entities out of headings, links, code, capitalised phrases and Han runs, and relations between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import HAN
from tessera.operators.entities import variants
from tessera.operators.text_rules import collapsed, marked, pieces, stripped
from tessera.plans.query import registry
from tessera.sources.checkpoints import cut, written
from tessera.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

#: Limits of one document, rules in their priority, words that are no names, and relation patterns.
MOST_TEXT, MOST_NAME, MOST_CANDIDATES, MOST_PHRASE, MOST_HAN, MOST_SUMMARY = 256 * 1024, 60, 96, 4, 12, 400
RULES = ["heading_entity", "wiki_link", "inline_code_identifier", "proper_noun_phrase", "chinese_term_run"]
STOP_HEADINGS = [
    "overview", "overview and background", "introduction", "intro", "介绍", "简介", "概览", "背景", "notes", "note", "summary", "总结", "参考", "reference", "附录", "appendix", "目录", "contents",
    "todo", "see also", "说明",
]
STOP_CODE = [
    "true", "false", "null", "none", "let", "fn", "impl", "async", "await", "if", "else", "for", "while", "return", "mut", "pub", "use", "self", "match", "struct", "enum", "const", "var",
    "def", "int", "str", "bool", "void", "new", "type",
]
STOP_WORDS = [
    "the", "this", "that", "these", "those", "there", "here", "if", "when", "then", "note", "see", "also", "and", "or", "but", "for", "with", "from", "into", "onto", "over", "under", "not",
    "are", "was", "were", "is", "be", "been", "has", "have", "had", "will", "would", "can", "could", "should", "may", "might", "must", "all", "any", "each", "every", "some", "what",
    "which", "who", "how", "why", "where", "it", "its", "a", "an", "to", "of", "in", "on", "as", "at", "by", "we", "you", "they", "he", "she", "my", "our", "your", "their", "no", "yes",
    "only", "more", "most", "much", "many", "new", "used", "using", "uses", "first", "second", "third", "example", "both", "either", "neither", "one", "two", "three", "instead", "however",
]
STOP_HAN = ["的", "是", "我们", "这个", "可以", "如果", "因为", "所以", "以及", "一个", "没有", "就是", "不是"]
EXEC = ["run", "install", "execute", "执行", "安装", "启动", "配置", "deploy", "部署", "build", "编译"]
EXTENSIONS = [".sh", ".md", ".json", ".toml", ".rs", ".ts", ".tsx", ".py", ".exe", ".dll"]
RELATIONS = [
    ("is_a", ["是一种", "是", " is an ", " is a "], 1), ("uses", ["使用", "依赖", " uses ", " depends on "], 2), ("runs_on", ["运行在", "部署在", " runs on ", " is deployed on "], 2),
    ("includes", ["包含", "由", "组成", " includes ", " consists of "], 2),
]
IDENTIFIER = r"^[A-Za-z][A-Za-z0-9_.:/-]{2,60}$"


def windowed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, skipped): texts over MOST_TEXT bytes end after the last blank line within them, else at the last whole character; skipped bytes are told."""
    # Latin-1 characters stand for bytes, so an unfinished last character is seen; it is written back byte by byte.
    raw = F.encode(F.regexp_replace(F.decode(F.substring(F.encode("text", "UTF-8"), 1, MOST_TEXT), "ISO-8859-1"), r"(?:[\xC0-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xFF][\x80-\xBF]{0,2})$", ""), "ISO-8859-1")
    head = F.decode(raw, "UTF-8")
    part = F.when(F.contains(head, F.lit("\n\n")), F.regexp_extract(head, r"(?s)^(.*\n\n)", 1)).otherwise(head)
    text = F.when(F.octet_length("text") > MOST_TEXT, part).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"), (F.octet_length("text") - F.octet_length(text)).cast("long").alias("skipped"))


def usable(name: Column, stops: list[str]) -> Column:
    return ~F.lower(name).isin(stops) & (F.char_length(name) <= MOST_NAME)


HEADING = r"^\s*#{1,6}(\s|$)"


def seen(docs: DataFrame) -> DataFrame:
    """(doc_id, at, sentence, exec, in_heading) of texts (doc_id, text), split and written once for all rules; `exec` if a marker of EXEC stands in a sentence with links or code."""
    # A heading begins with its line, and nothing in front of its first blank ends a piece.
    heading = F.col("opens") & F.regexp_replace("raw", r"\n\z", "").rlike(HEADING)
    s = pieces(docs).select("doc_id", F.col("start").alias("at"), collapsed(F.col("raw")).alias("sentence"), (F.contains("raw", F.lit("#")) & heading).alias("in_heading")).filter("char_length(sentence) >= 2")
    named = F.contains("sentence", F.lit("`")) | F.contains("sentence", F.lit("[["))
    return written(s.withColumn("low", F.lower("sentence")).withColumn("exec", F.when(named, marked("low", EXEC)).otherwise(False)).drop("low"))


def found(docs: DataFrame, s: DataFrame) -> DataFrame:
    """(doc_id, rule, key, name, at, place, later, tool): every occurrence that a rule sees in texts and their sentences s; `later` if a phrase does not begin its sentence."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    # Of lines that are no headings only the lengths travel.
    is_heading = F.contains("line", F.lit("#")) & F.regexp_replace("line", r"^\s+", "").rlike(r"^#{1,6}(\s|$)")
    lines = lines.select("doc_id", "k", F.octet_length("line").alias("n"), F.when(is_heading, F.col("line")).alias("line"))
    at = F.coalesce(F.sum(F.col("n") + 1).over(W.partitionBy("doc_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("at", at.cast("long"))
    title = stripped(F.regexp_extract(stripped(F.col("line")), r"^#{1,6}(?:\s+(.*))?$", 1))
    title = stripped(F.regexp_replace(F.regexp_replace(stripped(F.regexp_replace(F.regexp_replace(title, "^`", ""), "`$", "")), r"^[0-9.]+\)?\s+", ""), "[:：]+$", ""))
    head = lines.filter("line is not null").select("doc_id", F.lit(RULES[0]).alias("rule"), title.alias("key"), title.alias("name"), "at", F.lit(0).alias("place"), F.lit(False).alias("later"), title.rlike(IDENTIFIER).alias("tool"))
    head = head.filter((F.char_length("name") >= 2) & usable(F.col("name"), STOP_HEADINGS) & ~F.get(variants(F.col("name")), F.lit(0)).isin(STOP_HEADINGS))
    tool = lambda c: F.contains(c, F.lit("/")) | F.lower(c).rlike("(" + "|".join(x.replace(".", r"\.") for x in EXTENSIONS) + ")$") | F.col("exec")
    each = lambda pattern, held: s.filter(held).select("doc_id", "at", "exec", F.posexplode(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(1))).alias("place", "raw"))
    link = F.trim(F.substring_index(F.substring_index("raw", "|", 1), "#", 1))
    wiki = each(r"\[\[(.*?)\]\]", F.contains("sentence", F.lit("[["))).select("doc_id", F.lit(RULES[1]).alias("rule"), link.alias("key"), link.alias("name"), "at", "place", F.lit(False).alias("later"), tool(link).alias("tool")).filter((F.char_length("name") >= 2) & (F.char_length("name") <= MOST_NAME))
    raw = F.col("raw")
    code = each("`([^`]*)`", F.contains("sentence", F.lit("`"))).filter(raw.rlike(IDENTIFIER) & usable(raw, STOP_CODE)).select("doc_id", F.lit(RULES[2]).alias("rule"), raw.alias("key"), raw.alias("name"), "at", "place", F.lit(False).alias("later"), tool(raw).alias("tool"))
    # Words lose what is no letter or digit at their ends (but those that begin in lower case are not looked at); a phrase goes on, not the words of its sentence.
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    words = F.transform(F.split("sentence", " "), lambda w: F.when((w >= "a") & (w < "{"), F.lit("")).otherwise(bare(w)))
    w = s.filter(~F.col("in_heading")).select("doc_id", "at", words.alias("w"))
    cap = lambda k: F.coalesce((F.get("w", k) >= "A") & (F.get("w", k) < "[") & F.get("w", k).rlike("^[A-Z][A-Za-z0-9]+$"), F.lit(False))
    take = lambda k: F.when(~cap(k + 1), 1).when(~cap(k + 2), 2).when(~cap(k + 3), 3).otherwise(MOST_PHRASE)
    firsts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), cap)
    phrase = w.select("doc_id", "at", F.explode(F.transform(firsts, lambda k: F.struct(k.alias("place"), F.slice("w", k + 1, take(k)).alias("p")))).alias("x")).select("doc_id", "at", "x.*")
    phrase = phrase.filter(~F.exists("p", lambda x: F.lower(x).isin(STOP_WORDS))).select("doc_id", F.lit(RULES[3]).alias("rule"), F.lower(F.array_join("p", " ")).alias("key"), F.array_join("p", " ").alias("name"), "at", "place", (F.col("place") > 0).alias("later"), F.lit(False).alias("tool")).filter(F.char_length("name") <= MOST_NAME)
    han = each(f"({HAN}+)", F.octet_length("sentence") > F.char_length("sentence")).filter((F.char_length("raw") >= 2) & (F.char_length("raw") <= MOST_HAN) & ~raw.isin(STOP_HAN)).select("doc_id", F.lit(RULES[4]).alias("rule"), raw.alias("key"), raw.alias("name"), "at", "place", F.lit(False).alias("later"), F.lit(False).alias("tool"))
    return head.unionByName(wiki).unionByName(code).unionByName(phrase).unionByName(han)


def entities(docs: DataFrame, s: DataFrame | None = None, most: int | None = MOST_CANDIDATES) -> DataFrame:
    """(doc_id, name, rule, kind, df, score, first): candidates of each document (doc_id, text); s are its sentences, if they have been seen().

    Phrases count if they stand twice and not only at the beginning of sentences, Han runs from three times on. Of
    candidates with one base name the rule of highest priority wins; the best `most` stay (None: all).
    """
    order = F.struct("at", "place")
    by_key = found(docs, seen(docs) if s is None else s).groupBy("doc_id", "rule", F.when(F.col("rule") == RULES[0], F.concat_ws(" ", "key", "at")).otherwise(F.col("key")).alias("key"))
    t = by_key.agg(F.count("*").alias("df"), F.count_if("later").alias("n_later"), F.min_by("name", order).alias("name"), F.min("at").alias("first"), F.max("tool").alias("tool"))
    t = t.filter((F.col("rule") != RULES[3]) | (F.col("df") >= 2) & (F.col("n_later") > 0)).filter((F.col("rule") != RULES[4]) | (F.col("df") >= 3))
    score = F.col("df") / (F.col("df") + 3)
    t = t.withColumns({"score": F.round(F.when(F.col("rule") == RULES[0], F.lit(0.5)).otherwise(score), 6), "priority": F.array_position(F.array(*map(F.lit, RULES)), F.col("rule")), "base": F.get(variants(F.col("name")), F.lit(0))})
    first = F.row_number().over(W.partitionBy("doc_id", "base").orderBy("priority", "key"))
    t = t.withColumn("k", first).filter("k = 1")
    if most is not None:
        best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "first", "name"))
        t = t.withColumn("k", best).filter(F.col("k") <= most)
    return t.select("doc_id", "name", "rule", F.when(F.col("tool"), "tool").otherwise("concept").alias("kind"), "df", "score", "first")


def relations(docs: DataFrame, of_docs: DataFrame, s: DataFrame | None = None) -> DataFrame:
    """(doc_id, src, relation, dst, support, score): pairs of candidate entities on both sides of a connector, the longest name that ends before and begins after it, in as many sentences as the pattern asks for; s are the sentences, if they have been seen()."""
    s = (seen(docs) if s is None else s).select("doc_id", F.col("at").alias("start"), "sentence")
    known = F.array(*(F.struct(F.lit(relation).alias("relation"), F.lit(least).alias("least"), F.lit(m).alias("m")) for relation, connectors, least in RELATIONS for m in connectors))
    c = s.select("doc_id", "start", "sentence", F.explode(F.filter(known, lambda x: F.contains("sentence", x["m"]))).alias("x")).select("doc_id", "start", "sentence", "x.*")
    parts = F.split(F.col("sentence"), F.concat(F.lit("\\Q"), "m", F.lit("\\E")), -1)
    at = c.withColumn("parts", parts).select("doc_id", "start", "relation", "least", "m", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    before, after = F.expr("array_join(slice(parts, 1, k), m)"), F.expr("array_join(slice(parts, k + 1, size(parts)), m)")
    edge = "[\\s\\p{P}`]+"
    # Sides hold as much as the longest name; names have two characters at least and meet only the sides that share the two at the connector.
    l, r = F.substring(F.regexp_replace(before, f"{edge}$", ""), -MOST_NAME, MOST_NAME), F.substring(F.regexp_replace(after, f"^{edge}", ""), 1, MOST_NAME)
    all_cuts = at.select("doc_id", "start", "relation", "least", l.alias("l"), r.alias("r"))
    all_cuts = cut(all_cuts.withColumn("cut", F.xxhash64("doc_id", "start", "relation", "l", "r")))
    two = lambda c, k: F.substring(c, k, 2).alias("two")
    side = lambda s, k, keep, name: all_cuts.select("doc_id", "cut", s, two(s, k)).join(of_docs.select("doc_id", "name", two("name", k)), ["doc_id", "two"]).filter(keep).groupBy("doc_id", "cut").agg(F.max(F.struct(F.char_length("name"), "name"))["name"].alias(name))
    left, right = side("l", -2, F.endswith("l", "name"), "src"), side("r", 1, F.startswith("r", "name"), "dst")
    pairs = all_cuts.select("doc_id", "cut", "start", "relation", "least").distinct().join(left, ["doc_id", "cut"]).join(right, ["doc_id", "cut"]).filter("src != dst")
    one = pairs.groupBy("doc_id", "src", "relation", "dst", "least").agg(F.count_distinct("start").alias("support")).filter("support >= least")
    return one.select("doc_id", "src", "relation", "dst", "support", F.round(F.least(F.lit(1.0), 0.5 * F.col("support")), 3).alias("score"))


LEAD = """concat('# ', doc_id % 50, '. Topic', doc_id % 9, ' (T', doc_id % 9, ')', chr(10), chr(10), 'Here `tool_', doc_id % 6, '` uses `x', doc_id % 4, '.py` with [[Page ', doc_id % 5, '|that]]. ', 'The Alpha', doc_id % 3, ' Beta is a `tool_', doc_id % 6, '`. ',
  'Then Alpha', doc_id % 3, ' Beta again. See `tool_', doc_id % 6, '` uses `x', doc_id % 4, '.py` and 知识图谱 or 知识图谱 and 知识图谱.', chr(10), '## Overview', chr(10), text)"""


def sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents, each after a heading, code, links and names, of which they have none."""
    return spark.sql(f"SELECT doc_id, {LEAD} AS text FROM {{documents}} WHERE text IS NOT NULL", documents=table(spark, sf_dir, "documents"))


@query()
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(windowed(sample_documents(spark, sf_dir)))


@query()
def relation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations out of whole texts, between all their candidates."""
    docs = sample_documents(spark, sf_dir)
    s = seen(docs)
    return relations(docs, cut(entities(docs, s, most=None)), s)


@query(f"""WITH d AS (SELECT doc_id, {LEAD} AS text FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id % 50 AS topic, doc_id % 6 AS tool, doc_id % 4 AS file, count(*) AS n FROM d GROUP BY ALL) SELECT tool, file, sum(n)::BIGINT AS n_documents FROM n GROUP BY tool, file""")
def graph_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents say that a tool uses a file, out of the relation candidates of all documents."""
    pairs = relation_pairs(spark, sf_dir).filter("relation = 'uses'").filter(F.col("src").rlike(r"^tool_\d$") & F.col("dst").rlike(r"^x\d\.py$"))
    return pairs.groupBy(F.regexp_extract("src", r"(\d)", 1).cast("long").alias("tool"), F.regexp_extract("dst", r"(\d)", 1).cast("long").alias("file")).agg(F.count_distinct("doc_id").alias("n_documents"))
