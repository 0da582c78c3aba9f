"""Windows of turns under a byte budget, and the tolerant reading of what an extraction over them returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.plans.query import registry
from tessera.sources.checkpoints import written
from tessera.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

#: Bytes between two turns, and the budget of a window.
SEPARATOR, BUDGET = 2, 4096


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, bytes) with `place` from 1 in the order of the turns, and `upto`, all bytes up to here with a separator behind each turn."""
    w = W.partitionBy("conv").orderBy("turn", "bytes")
    return turns.select("conv", "turn", "bytes", F.row_number().over(w).alias("place"), F.sum(F.col("bytes") + SEPARATOR).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))


def following(turns: DataFrame, budget: int) -> DataFrame:
    """(conv, place, next): where the next window starts if one starts here; null where this one reaches the end.

    The turns from `place` up to j fit if upto(j) is at most what stands before `place` + budget + one separator. So each
    turn asks for the first place whose `upto` is greater: asks and places are put in one falling order of bytes, where the
    last place seen is the answer. A turn is never left out, so the next window starts behind this turn at the least.
    """
    ask = turns.select("conv", F.col("place").alias("asked"), F.lit(None).cast("int").alias("place"), (F.col("upto") - F.col("bytes") + budget).alias("at"), F.lit(0).alias("kind"))
    both = ask.unionByName(turns.select("conv", F.lit(None).cast("int").alias("asked"), "place", F.col("upto").alias("at"), F.lit(1).alias("kind")))
    falling = W.partitionBy("conv").orderBy(F.desc("at"), "kind", F.desc("place")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("first", F.last("place", True).over(falling)).filter("kind = 0")
    last = F.max("asked").over(W.partitionBy("conv"))
    return found.withColumn("last", last).select("conv", F.col("asked").alias("place"), F.greatest("first", F.when(F.col("first").isNotNull(), F.col("asked") + 1)).alias("next"), "last").select("conv", "place", F.when(F.col("next") <= F.col("last"), F.col("next")).alias("next"))


def starts(nexts: DataFrame) -> DataFrame:
    """(conv, place) of all places that are reached from place 1, in as many rounds as twice the last one's reach takes: each round doubles the jumps."""
    jump = written(nexts.filter("next is not null"))
    seen = written(nexts.filter("place = 1").select("conv", "place"))
    while not jump.isEmpty():
        seen = written(seen.unionByName(seen.join(jump, ["conv", "place"]).select("conv", F.col("next").alias("place"))).distinct())
        jump = written(jump.join(jump.select("conv", F.col("place").alias("next"), F.col("next").alias("after")), ["conv", "next"]).select("conv", "place", F.col("after").alias("next")))
    return seen


def windows(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(conv, turn, bytes, window): turns (conv, turn, bytes) packed greedily, window by window from the first turn on; a turn greater than the budget has one of its own."""
    rows = written(numbered(turns))
    begin = starts(following(rows, budget)).withColumn("begins", F.lit(1))
    order = W.partitionBy("conv").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(begin, ["conv", "place"], "left").select("conv", "turn", "bytes", (F.sum(F.coalesce("begins", F.lit(0))).over(order) - 1).alias("window"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", "User: ").otherwise("Agent: "), F.coalesce(text, F.lit("")))


SIZES_SQL = f"""t AS (SELECT conv_id, turn, strlen(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Agent: ' END || coalesce(text, '')) AS n FROM conversations),
s AS (SELECT conv_id, turn, n, row_number() OVER o AS r, sum(n + {SEPARATOR}) OVER (PARTITION BY conv_id ORDER BY turn, n ROWS UNBOUNDED PRECEDING) AS e FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, n)),
x AS (SELECT i.conv_id, i.r, min(j.r) AS nxt FROM s i JOIN s j ON i.conv_id = j.conv_id AND j.r > i.r AND j.e - {SEPARATOR} - (i.e - i.n - {SEPARATOR}) > {BUDGET} GROUP BY i.conv_id, i.r),
st AS (SELECT DISTINCT conv_id, 1::BIGINT AS r FROM s UNION ALL SELECT st.conv_id, nxt FROM st JOIN x USING (conv_id, r)),
w AS (SELECT s.*, count(st.r) OVER (PARTITION BY s.conv_id ORDER BY s.r) - 1 AS pack FROM s LEFT JOIN st ON s.conv_id = st.conv_id AND s.r = st.r)"""


@query(f"WITH RECURSIVE {SIZES_SQL} SELECT conv_id, pack, min(turn) AS first_turn, count(*) AS n_turns, (sum(n) + {SEPARATOR} * (count(*) - 1))::BIGINT AS bytes, sum(n) > {BUDGET} AS truncated FROM w GROUP BY conv_id, pack")
def turn_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns of each conversation in windows of at most BUDGET bytes; a single greater turn is one that is cut."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", F.octet_length(rendered(F.col("role"), F.col("text"))).cast("long").alias("bytes"))
    n = F.count("*")
    packs = windows(c).groupBy(F.col("conv").alias("conv_id"), F.col("window").alias("pack")).agg(F.min("turn").alias("first_turn"), n.alias("n_turns"), (F.sum("bytes") + SEPARATOR * (n - 1)).alias("bytes"))
    return packs.withColumn("truncated", F.col("bytes") > BUDGET)


#: What an extraction returns, as typed arrays; fields that it leaves out are null.
EXTRACTION = "candidates array<struct<store string, content string, confidence double>>, entities array<struct<name string, kind string, summary string>>, relations array<struct<src string, dst string, relation string, fact string>>"


def parsed(raw: Column) -> Column:
    """The struct (status, value) of an answer that may stand in a fence or between sentences: what lies from the first opening to the last closing brace.

    status: no json (no opening brace), no closing brace, malformed (not JSON, or no object), parsed. value has the arrays of
    EXTRACTION; a part of another type than it should have is null, and so are its elements.
    """
    text = F.coalesce(raw, F.lit(""))
    opened = F.locate("{", text)
    body = F.regexp_extract(F.substring(text, opened, F.char_length(text)), r"(?s)^(\{.*\})", 1)
    # The parser stops behind the first value; as the first of two elements it must end where the body does.
    both = F.concat(F.lit("["), body, F.lit(', "end"]'))
    fine = F.coalesce(F.try_parse_json(body).isNotNull() & (F.json_array_length(both) == 2) & (F.get_json_object(both, "$[1]") == "end"), F.lit(False))
    status = F.when(opened == 0, "no json").when(body == "", "no closing brace").when(fine, "parsed").otherwise("malformed")
    return F.struct(status.alias("status"), F.when(fine, F.from_json(body, EXTRACTION)).alias("value"))


#: Answers written out of the turns, one form for each remainder of conv_id + turn: plain, fenced, between sentences, cut off, none, malformed.
FORMS = 6


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    one = F.struct(F.col("role").alias("store"), F.col("text").alias("content"), F.lit(0.5).alias("confidence"))
    body = F.to_json(F.struct(F.array(one).alias("candidates"), F.array(F.struct(F.concat(F.lit("e"), "conv_id").alias("name"))).alias("entities")))
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(FORMS))
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Is that all?"))).when(k == 3, F.regexp_replace(body, r"\}.*$", "")).when(k == 4, F.translate("text", "{}", "")).otherwise(F.concat(body, F.lit(", {}")))
    return c.select("conv_id", "turn", raw.alias("raw"))


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, (conv_id + turn) % 6 AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k < 3 THEN 'parsed' WHEN k = 4 THEN 'no json' WHEN k = 5 THEN 'malformed' ELSE 'no closing brace' END AS status, CASE WHEN k < 3 THEN 1 ELSE 0 END AS n_candidates,
  CASE WHEN k < 3 THEN md5(text) END AS content_hash, CASE WHEN k < 3 THEN role END AS store, CASE WHEN k < 3 THEN 'e' || conv_id END AS entity FROM c""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read out of answers of all forms: state, and the first candidate and entity."""
    p = answers(spark, sf_dir).select("conv_id", "turn", parsed(F.col("raw")).alias("p"))
    first = F.get("p.value.candidates", F.lit(0))
    return p.select("conv_id", "turn", "p.status", F.coalesce(F.size("p.value.candidates"), F.lit(0)).alias("n_candidates"), F.md5(first["content"]).alias("content_hash"), first["store"].alias("store"), F.get("p.value.entities", F.lit(0))["name"].alias("entity")).withColumn("n_candidates", F.greatest("n_candidates", F.lit(0)))
