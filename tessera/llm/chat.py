"""Chat formatting in token-budgeted windows, in DataFrame functions only.

Running sums of turn tokens cut a conversation at turn boundaries. A window holds the turns whose first token falls
into one stride of that sum; a turn longer than a stride stands alone, so nothing is cut, and only such a turn, or a
system turn that leaves no room, can pass the budget. Each window repeats the conversation's first system turn and a limited number of tokens of the
turns before it; the loss mask covers the texts of assistant turns once, in the window where they are new.

Rendered turns are marked by control strings; a control string inside a text gets one more backslash after its first
character, so reading back is exact.

Defined results: null role or text is the empty string; null conv_id is one conversation of its own; turns are
ordered by (turn, role, text) with null turns first, and repeated rows stay repeated; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUDGET = 1024
HISTORY = 256
#: Running sums are taken in two steps, over blocks of so many turn numbers and inside them, so that no task holds a whole long conversation.
BLOCK = 256

TOKEN = r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]"
#: `<s>`, `[INST]` and so on, with any number of backslashes after the first character.
CONTROL = r"([<\[])(\\*)(/?(?:s>|(?:INST|SYS|ROLE|TURN)\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|(?:INST|SYS|ROLE|TURN)\]))"
TURN = r"(?s)\[SYS\].*?\[/SYS\]|\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\]\[TURN\].*?\[/TURN\]"


def escape(c: str) -> str:
    return f"regexp_replace({c}, r'{CONTROL}', '$1\\\\\\\\$2$3')"


def unescape(c: str) -> str:
    return f"regexp_replace({c}, r'{ESCAPED}', '$1$2$3')"


def spans(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Each turn with its place: conv_id, turn, role, text, start and end (running token sums), stride, window (bucket, lone)."""
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"),
    ).withColumn("tokens", F.greatest(F.lit(1), F.regexp_count("text", F.lit(TOKEN))).cast("long"))
    sums = turns.groupBy("conv_id", "block").agg(
        F.sum("tokens").alias("tokens"),
        F.min(F.when(F.col("role") == "system", F.struct("turn", "text", "tokens"))).alias("system"),
    )
    whole = W.partitionBy("conv_id")
    sums = sums.select(
        F.col("conv_id").alias("_conv"),
        F.col("block").alias("_block"),
        (F.sum("tokens").over(whole.orderBy("block")) - F.col("tokens")).alias("before"),
        F.min("system").over(whole).alias("system"),
    )
    inside = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    turns = turns.join(sums, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    end = F.col("before") + F.sum("tokens").over(inside)
    turns = turns.select("conv_id", "turn", "role", "text", "tokens", "system", (end - F.col("tokens")).alias("start"), end.alias("end"), F.greatest(F.lit(1), F.floor((budget - history - F.coalesce("system.tokens", F.lit(0))) / 2)).alias("stride"))
    return turns.withColumns({"bucket": F.floor(F.col("start") / F.col("stride")), "lone": F.col("tokens") > F.col("stride")})


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, bucket, lone (windows of a conversation are ordered by these two), n_new, formatted, new_from (code points in front of the new turns), loss (array of [from, to) in code points)."""
    turns = spans(conversations, budget, history)
    item = F.struct("start", "end", "turn", "role", "text")
    # A turn is new in one window, and may be history of those that begin between its end and its start plus the allowance.
    places = f"""concat(array(struct(bucket, lone, true as new)), if(tokens > {history}, array(), flatten(transform(
        sequence(floor(end / stride), floor((start + {history}) / stride)), b -> array(struct(b as bucket, false as lone, false as new), struct(b as bucket, true as lone, false as new))))))"""
    placed = turns.select("conv_id", F.explode(F.expr(places)).alias("to"), item.alias("item"), "system")
    groups = placed.groupBy("conv_id", "to.bucket", "to.lone").agg(
        F.sort_array(F.collect_list(F.when(F.col("to.new"), F.col("item")))).alias("fresh"),
        F.sort_array(F.collect_list(F.when(~F.col("to.new"), F.col("item")))).alias("earlier"),
        F.first("system").alias("system"),
    )
    groups = groups.filter(F.size("fresh") > 0).withColumn("first", F.get("fresh", F.lit(0)))
    groups = groups.withColumn("earlier", F.expr(f"filter(earlier, x -> x.end <= first.start and first.start - x.start <= {history})"))
    groups = groups.withColumn("next", F.expr("coalesce(get(earlier, 0), first)")).withColumn("earlier", F.expr("""if(system is not null and struct(system.turn as turn, 'system' as role, system.text as text) < struct(next.turn as turn, next.role as role, next.text as text),
        concat(array(named_struct('start', 0L, 'end', 0L, 'turn', system.turn, 'role', 'system', 'text', system.text)), earlier), earlier)"""))
    render = f"""case x.role when 'system' then concat('[SYS]', {escape('x.text')}, '[/SYS]') when 'user' then concat('[INST]', {escape('x.text')}, '[/INST]')
        when 'assistant' then concat('<s>', {escape('x.text')}, '</s>') else concat('[ROLE]', {escape('x.role')}, '[/ROLE][TURN]', {escape('x.text')}, '[/TURN]') end"""
    groups = groups.select(
        "conv_id",
        "bucket",
        "lone",
        F.size("fresh").alias("n_new"),
        F.expr(f"concat_ws('', transform(earlier, x -> {render}))").alias("head"),
        F.expr(f"transform(fresh, x -> struct(x.role as role, {render} as text))").alias("parts"),
    ).withColumn("new_from", F.char_length("head"))
    loss = """aggregate(parts, named_struct('at', new_from, 'loss', cast(array() as array<struct<from: int, to: int>>)),
        (a, x) -> named_struct('at', a.at + char_length(x.text), 'loss', if(x.role = 'assistant', concat(a.loss, array(named_struct('from', a.at + 3, 'to', a.at + char_length(x.text) - 4))), a.loss)),
        a -> a.loss)"""
    return groups.select("conv_id", "bucket", "lone", "n_new", F.concat("head", F.array_join("parts.text", "")).alias("formatted"), "new_from", F.expr(loss).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per window the new turns, parsed from the formatted text: array of (role, text), and the unmasked texts in order."""
    parsed = windows.withColumn("_turns", F.expr(f"regexp_extract_all(substring(formatted, new_from + 1), r'{TURN}', 0)"))
    body = """case when startswith(x, '[SYS]') then struct('system' as role, substring(x, 6, char_length(x) - 11) as text)
        when startswith(x, '[INST]') then struct('user' as role, substring(x, 7, char_length(x) - 13) as text)
        when startswith(x, '<s>') then struct('assistant' as role, substring(x, 4, char_length(x) - 7) as text)
        else struct(substring_index(substring(x, 7), '[/ROLE]', 1) as role, substring_index(substring(x, 1, char_length(x) - 7), '[/ROLE][TURN]', -1) as text) end"""
    parsed = parsed.withColumn("turns", F.expr(f"transform(transform(_turns, x -> {body}), x -> struct({unescape('x.role')} as role, {unescape('x.text')} as text))"))
    return parsed.withColumn("loss_texts", F.expr(f"transform(loss, s -> {unescape('substring(formatted, s.from + 1, s.to - s.from)')})")).drop("_turns")


def digest(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Per conversation the digests of what its windows hold, read back from the formatted texts."""
    back = read_back(format_windows(conversations, budget, history)).select(
        "conv_id",
        F.struct(
            "bucket",
            "lone",
            F.size("turns").alias("n"),
            F.expr("concat_ws('', transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')))").alias("turns"),
            F.array_join("loss_texts", "").alias("loss"),
            F.char_length("formatted").alias("chars"),
        ).alias("w"),
    )
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return whole.select(
        "conv_id",
        F.expr("aggregate(w.n, 0L, (a, x) -> a + x)").alias("n_turns"),
        F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
        F.char_length(F.array_join("w.loss", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("w.loss", ""), 256).alias("loss_sha256"),
        F.expr("aggregate(w.chars, 0L, (a, x) -> a + x)").alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose two texts are made of control strings."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t AS (SELECT *, greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]'))) AS n,
  length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|(?:INST|SYS|ROLE|TURN)\]))', '\1\\\2\3', 'g')) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 26 + length(role) END AS chars FROM c),
u AS (SELECT *, sum(n) OVER w AS e, sum(n) OVER w - n AS s FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
y AS (SELECT conv_id, min(s) AS ys, arg_min(n, s) AS yn, arg_min(chars, s) AS yc FROM u WHERE role = 'system' GROUP BY conv_id),
v AS (SELECT u.*, ys, yc, greatest(1, (1024 - 256 - coalesce(yn, 0)) // 2) AS stride FROM u LEFT JOIN y USING (conv_id)),
w AS (SELECT conv_id, s // stride AS b, n > stride AS lone, min(s) AS f, sum(chars) AS chars, any_value(ys) AS ys, any_value(yc) AS yc FROM v GROUP BY ALL),
h AS (SELECT w.conv_id, b, lone, sum(v.chars) AS hc, min(v.s) AS hs FROM w JOIN v ON w.conv_id = v.conv_id AND v.e <= f AND f - v.s <= 256 AND v.n <= 256 GROUP BY ALL),
z AS (SELECT conv_id, sum(chars + coalesce(hc, 0) + CASE WHEN ys < coalesce(hs, f) THEN yc ELSE 0 END)::BIGINT AS formatted_chars, count(*) AS n_windows FROM w LEFT JOIN h USING (conv_id, b, lone) GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars, n_windows FROM g JOIN z USING (conv_id)
"""
