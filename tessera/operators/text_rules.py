"""Deterministic text rules: chunks, sentences, dates, entity and relation candidates, packing of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import HAN, TERMS_SQL, terms
from tessera.plans.query import registry
from tessera.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

#: Fixed values of the chunker and of the candidate rules.
TARGET, OVERLAP = 800, 100
LEAST_DF = 3


#: White space as Unicode has it, for both engines.
BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{BLANK}+", ""), f"{BLANK}+$", "")


#: What all other white space than single spaces matches, and little else: most texts need no more than a look at this.
OTHER_BLANK = r"[\x09\x0A\x0B\x0C\x0D\x85\xA0\x{1680}-\x{3000}]|  "


def collapsed(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.when(text.rlike(OTHER_BLANK), F.regexp_replace(text, f"{BLANK}+", " ")).otherwise(text))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, section, start, body): trimmed parts between blank lines with their first byte; a heading begins a section."""
    raw = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\n")).alias("paragraph", "raw"))
    before = W.partitionBy("doc_id").orderBy("paragraph")
    at = F.coalesce(F.sum(F.octet_length("raw") + 2).over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lead = F.octet_length("raw") - F.octet_length(F.regexp_replace("raw", f"^{BLANK}+", ""))
    full = raw.select("doc_id", "paragraph", (at + lead).alias("start"), stripped(F.col("raw")).alias("body")).filter("body != ''")
    return full.withColumn("section", F.sum(F.startswith("body", F.lit("#")).cast("int")).over(before))


def chunks(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, section, chunk, start, end, text): paragraphs over `target` characters are cut every target - overlap, and neighbours of one section packed, two line feeds between, as long as `target` holds; start and end are bytes."""
    step = target - overlap
    starts = F.expr(f"if(char_length(body) <= {target}, array(0), transform(sequence(0, int(ceil((char_length(body) - {target}) / {step}))), k -> k * {step}))")
    cut_ = paragraphs(docs).select("doc_id", "section", "paragraph", "start", "body", F.explode(starts).alias("at"))
    piece = F.substring("body", F.col("at") + 1, target)
    first = F.col("start") + F.octet_length(F.expr("substring(body, 1, at)"))
    pieces = cut_.select("doc_id", "section", F.struct("paragraph", "at", first.alias("start"), (first + F.octet_length(piece)).alias("end"), piece.alias("text"), F.char_length(piece).alias("n")).alias("p"))
    in_order = pieces.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list("p")).alias("p"))
    # The chunk of each piece: a fold over their lengths.
    fold = f"""aggregate(p, named_struct('chunk', 0, 'n', -2, 'of', cast(array() as array<int>)),
      (s, x) -> if(s.n >= 0 and s.n + x.n + 2 > {target}, named_struct('chunk', s.chunk + 1, 'n', x.n, 'of', concat(s.of, array(s.chunk + 1))), named_struct('chunk', s.chunk, 'n', s.n + x.n + 2, 'of', concat(s.of, array(s.chunk)))), s -> s.of)"""
    each = in_order.select("doc_id", "section", F.explode(F.arrays_zip("p", F.expr(fold).alias("of"))).alias("z")).select("doc_id", "section", F.col("z.of").alias("chunk"), "z.p")
    one = each.groupBy("doc_id", "section", "chunk").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return one.select("doc_id", "section", F.col("chunk").cast("long").alias("chunk"), F.expr("p[0].start").cast("long").alias("start"), F.expr("p[size(p) - 1].end").cast("long").alias("end"), F.array_join("p.text", "\n\n").alias("text"))


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ''), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '') AS body, strlen(text) - strlen(regexp_replace(text, '^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '')) AS lead FROM documents),
s AS (SELECT doc_id, body, lead, unnest(range(0, greatest(ceil((length(body) - 800) / 700.0)::INT, 0) + 1)) AS k FROM p WHERE body <> '')
SELECT doc_id, k AS chunk, (lead + strlen(substr(body, 1, k * 700)))::BIGINT AS start, (lead + strlen(substr(body, 1, k * 700)) + strlen(substr(body, k * 700 + 1, 800)))::BIGINT AS "end", md5(substr(body, k * 700 + 1, 800)) AS h FROM s""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks; no document of the given tables has a blank line, so the SQL need not pack."""
    return chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk", "start", "end", F.md5("text").alias("h"))


def expanded(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits (doc_id, chunk) with the text of the section that the chunk stands in, or of the chunk where there is no section."""
    all_chunks = chunks(docs)
    wanted = all_chunks.join(hits.select("doc_id", "chunk").distinct(), ["doc_id", "chunk"], "left_semi").withColumnRenamed("text", "own")
    whole = all_chunks.join(wanted.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_semi").groupBy("doc_id", "section").agg(F.min("start").alias("from"), F.max("end").alias("to"))
    sections = whole.join(docs, "doc_id").select("doc_id", "section", F.expr("decode(substring(encode(text, 'UTF-8'), int(from) + 1, int(to - from)), 'UTF-8')").alias("parent"))
    return wanted.join(sections, ["doc_id", "section"], "left").select("doc_id", "chunk", F.coalesce("parent", "own").alias("text"))


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ''), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '') AS body FROM documents WHERE doc_id % 20 = 0) SELECT doc_id, 0::BIGINT AS chunk, md5(body) AS h FROM p WHERE body <> ''""")
def expanded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section around the first chunk of every document whose id is divisible by 20."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0").select("doc_id", "text")
    return expanded(d.select("doc_id", F.lit(0).cast("long").alias("chunk")), d).select("doc_id", "chunk", F.md5("text").alias("h"))


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, start, raw, opens): all parts of a text, which end after ! ? line feeds and full-width stops always, after . and ; in front of white space; start is a byte; `opens` if a line begins with it."""
    marked = F.regexp_replace("text", rf"([!?。！？\n]|[.;](?={BLANK}))", "$1\u0001")
    raw = docs.filter("text is not null").select("doc_id", F.posexplode(F.split(marked, "\u0001")).alias("k", "raw"))
    before = W.partitionBy("doc_id").orderBy("k")
    start = F.coalesce(F.sum(F.octet_length("raw")).over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return raw.select("doc_id", start.cast("long").alias("start"), "raw", F.coalesce(F.lag(F.endswith("raw", F.lit("\n"))).over(before), F.lit(True)).alias("opens"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, start, sentence): pieces with white space collapsed; two characters at least."""
    return pieces(docs).select("doc_id", "start", collapsed(F.col("raw")).alias("sentence")).filter("char_length(sentence) >= 2")


@query(r"""WITH m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([!?。！？\n])', '\1' || chr(1), 'g'), '([.;])([\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS k FROM m), s AS (SELECT doc_id, k, raw, coalesce(sum(strlen(raw)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r),
c AS (SELECT doc_id, start, trim(regexp_replace(raw, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS x FROM s) SELECT doc_id, start, md5(x) AS h FROM c WHERE length(x) >= 2""")
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents")).select("doc_id", "start", F.md5("sentence").alias("h"))


#: The first date that is not part of a longer number, with the time, fraction and zone that follow it.
DATE = r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)?)(?![0-9])"


@query(r"""WITH t AS (SELECT event_id, 'n' || (event_id % 3) || '12345-01-01 at ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 4 WHEN 0 THEN '.250Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '' ELSE 'Z' END || ' ' || props AS t FROM events)
SELECT event_id, regexp_extract(t, '[^0-9]([0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)?)', 1) AS found FROM t""")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("event_id") % 4 == 0, ".250Z").when(F.col("event_id") % 4 == 1, "+02:00").when(F.col("event_id") % 4 == 2, "").otherwise("Z")
    text = F.concat(F.lit("n"), F.col("event_id") % 3, F.lit("12345-01-01 at "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone, F.lit(" "), "props")
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract(text, DATE, 1).alias("found"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]{2,})', 1)) AS name FROM documents), c AS (SELECT name, count(DISTINCT doc_id) AS df, min(doc_id) AS first_doc FROM w GROUP BY name) SELECT name, df, first_doc, round(df / (df + 3), 6) AS score FROM c WHERE df >= 2""")
def proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words inside sentences, in two documents or more."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z,] ([A-Z][a-z]{2,})"), F.lit(1))).alias("name")).distinct()
    c = w.groupBy("name").agg(F.count("*").alias("df"), F.min("doc_id").alias("first_doc")).filter("df >= 2")
    return c.select("name", "df", "first_doc", F.round(F.col("df") / (F.col("df") + LEAST_DF), 6).alias("score"))


@query(f"""WITH t AS (SELECT doc_id, {TERMS_SQL} AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM t), r AS (SELECT DISTINCT doc_id, t[i] AS src, t[i + 2] AS dst, i FROM p WHERE t[i + 1] IN ('of', 'de', 'von'))
SELECT src, dst, count(*) AS n, round(least(1.0, 0.5 * count(*)), 3) AS score FROM r GROUP BY src, dst HAVING count(*) >= 2""")
def relation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms on both sides of a connector, found twice or more."""
    t = table(spark, sf_dir, "documents").select(terms(F.col("text")).alias("t"))
    near = F.expr("filter(transform(slice(t, 1, greatest(size(t) - 2, 0)), (x, i) -> struct(x as src, t[i + 1] as connector, t[i + 2] as dst)), r -> r.connector in ('of', 'de', 'von'))")
    r = t.select(F.explode(near).alias("r")).groupBy("r.src", "r.dst").agg(F.count("*").alias("n"))
    return r.filter("n >= 2").select("src", "dst", "n", F.round(F.least(F.lit(1.0), 0.5 * F.col("n")), 3).alias("score"))


#: The marker words of each rule.
PREF = [
    "记住", "以后", "下次", "不要再", "别用", "我喜欢", "我不喜欢", "我偏好", "统一用", "我的", "我要", "需要", "应该用", "不能用", "不要用", "我不认可",
    "remember that", "from now on", "always use", "never use", "i prefer", "i like", "i don't like", "don't use", "call it",
]
CORRECT = ["不对", "不是", "不这样", "应该是", "纠正", "不是这样", "no, actually", "that's wrong", "actually,", "correction:"]
CONFIRM = ["对", "就是这样", "没错", "正确", "perfect", "exactly", "yes that's right"]
DECISION = ["决定", "就用", "选", "定下来", "以后都用", "let's go with", "we'll use", "decided", "final answer"]
TOOLISH = [
    "工具", "命令", "脚本", "配置", "安装", "部署", "插件", "服务", "框架", "tool", "command", "script", "config", "install", "deploy", "plugin", "service", "cli", "api", "sdk", "mcp",
    "skill", "cargo", "npm", "pnpm", "docker", "postgres", "sqlite",
]
PROC = ["步骤", "首先要", "然后", "否则", "需要先", "配置", "安装", "执行", "step 1", "first,", "then,", "otherwise,", "note that", "requires", "run the"]
LESSON = ["坑", "踩坑", "注意", "很容易", "会导致", "失败是因为", "教训", "pitfall", "gotcha", "lesson", "because it fails"]
HEDGE = ["可能", "我觉得", "好像", "不确定", "大概", "i think", "maybe", "not sure", "probably"]
FIRST_PERSON = ["我", "我的", "我们", "my ", "i ", "i'"]
REPORTING = ["他说", "她说", "他们说", "同事说", "对方说", "别人说", "文档里说", "文档说", "书里说", "文章说", "作者说", "原文", "readme", "据说", "引用"]
CONDITIONAL = ["如果", "假如", "要是", "假设", "万一", "是否"]
BOILERPLATE = ["说明", "指出", "强调", "注明"]
NEGATIONS, NEGATION_WORDS = ["不", "没", "別", "别", "未", "勿"], ["not ", "no, ", "n't ", "never "]
MOST_BYTES = 400


def _strings(words: list[str]) -> str:
    return "array(" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in words) + ")"


def marked(text: str, markers: list[str], *guards: str) -> Column:
    """Whether the lower-cased column holds a marker at a place that no guard refuses; guards are SQL over p (what stands before), m and q (what follows). A negation just before always refuses."""
    negated = f"exists({_strings([*NEGATIONS, *NEGATION_WORDS])}, w -> endswith(p, w))"
    refused = " or ".join(["(" + g + ")" for g in (negated, *guards)])
    at = f"transform(sequence(1, size(split({text}, concat('\\\\Q', m, '\\\\E'), -1))), k -> array_join(slice(split({text}, concat('\\\\Q', m, '\\\\E'), -1), 1, k), m))"
    each = f"exists(slice({at}, 1, size({at}) - 1), p -> not ({refused}))"
    each = each.replace("<q>", f"substring({text}, char_length(p) + char_length(m) + 1)").replace("<text>", text)
    return F.expr(f"exists({_strings(markers)}, m -> contains({text}, m) and {each})")


#: What else refuses a requirement: A-not-A, quotation, someone else's words, a condition, an introduction.
REQUIREMENT = (
    "startswith(m, '不') and substring(m, 2, 1) != '' and endswith(p, substring(m, 2, 1))",
    "char_length(translate(p, '”」』', '')) > char_length(translate(p, '“「『', '')) or (char_length(p) - char_length(replace(p, '\"', ''))) % 2 = 1 or startswith(ltrim(<text>), '>')",
    f"exists({_strings(REPORTING)}, f -> contains(substring(p, greatest(char_length(p) - 11, 1)), f))",
    f"exists({_strings(CONDITIONAL)}, f -> contains(substring(p, greatest(char_length(p) - 2, 1)), f))",
    f"exists({_strings(BOILERPLATE)}, f -> startswith(<q>, f))",
)
STATIVE = "char_length(m) = 1 and endswith(p, '可')"


def candidates(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, rule, store, confidence, content): what marker rules find in the sentences of turns, in order; what a user's correction follows is left out, and of equal contents of one store in a conversation the first stays.

    Sentences over 400 bytes, questions, and sentences without three ASCII letters or digits or two Han in a row say nothing.
    """
    by_turn = W.partitionBy("conv_id").orderBy("turn")
    t = turns.select("conv_id", "turn", F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"), "text", F.lower("text").alias("low"))
    t = t.withColumns({"corrects": (F.col("role") == "user") & marked("low", CORRECT), "has_confirm": marked("low", CONFIRM), "has_hedge": marked("low", HEDGE)})
    t = t.withColumn("dropped", (F.col("role") == "assistant") & F.coalesce(F.lead("corrects").over(by_turn), F.lit(False))).filter("not dropped")
    s = sentences(t.select(F.struct("conv_id", "turn", "role", "has_confirm", "has_hedge").alias("doc_id"), "text")).select("doc_id.*", "start", "sentence", F.lower("sentence").alias("low"))
    s = s.filter((F.octet_length("sentence") <= MOST_BYTES) & ~F.col("sentence").rlike("[?？]$") & F.col("sentence").rlike(f"[A-Za-z0-9]{{3}}|{HAN}{{2}}"))
    user, hedge = F.col("role") == "user", F.when(F.col("has_hedge"), "hedged").otherwise("unconfirmed")
    confirms, prefers = marked("low", CONFIRM), marked("low", PREF, *REQUIREMENT)
    rules = [
        (user & (prefers | confirms), "user_preference", F.when(confirms | marked("low", FIRST_PERSON), "profile").otherwise("observation"), F.when(F.col("has_confirm"), "confirmed").otherwise("unconfirmed")),
        (user & marked("low", CORRECT), "user_correction", F.lit("observation"), F.lit("corrected")),
        (user & marked("low", DECISION, STATIVE), "user_decision", F.when(marked("low", TOOLISH), "procedure").otherwise("observation"), F.lit("unconfirmed")),
        (~user & marked("low", PROC), "procedure_note", F.lit("procedure"), hedge),
        (~user & marked("low", LESSON), "lesson_learned", F.lit("lesson"), hedge),
        (user & marked("low", HEDGE), "hedged_statement", F.lit("observation"), F.lit("hedged")),
    ]
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(rule).alias("rule"), store.alias("store"), sure.alias("confidence"))) for c, rule, store, sure in rules)))
    found = s.select("conv_id", "turn", "start", "sentence", F.explode(hits).alias("h")).select("conv_id", "turn", "start", "h.*", F.col("sentence").alias("content"))
    first = F.row_number().over(W.partitionBy("conv_id", "store", F.lower(F.regexp_replace("content", "[.。]$", ""))).orderBy("turn", "rule", "start"))
    return found.withColumn("k", first).filter("k = 1").drop("k", "start")


#: Sentences that stand in front of given turns, so that every rule and guard has rows: fixed samples.
SAMPLES = [
    "I prefer tabs.", "No, actually it is red.", "We decided to install docker.", "Maybe it works.", "Perfect.", "Note that the server requires root.", "A gotcha is the cache.", "I don't always use it.",
    "He said \"i prefer spaces\" there.", "> from now on use it", "Do you like it? Call it blue.", "记住用简体中文。", "如果需要的话。", "我觉得可能不对。",
]


def sampled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    sample = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(len(SAMPLES))) + 1).cast("int"))
    return c.select("conv_id", "turn", "role", F.concat(sample, F.lit(" "), "text").alias("text"))


def _has(markers: list[str], *guards: str) -> str:
    """The SQL twin of marked()."""
    lists = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
    refused = " OR ".join([f"len(list_filter({lists([*NEGATIONS, *NEGATION_WORDS])}, lambda w: ends_with(p, w))) > 0", *guards])
    return f"len(list_filter({lists(markers)}, lambda m: contains(low, m) AND len(list_filter(list_transform(range(1, len(string_split(low, m))), lambda k: list_reduce(string_split(low, m)[1:k], lambda x, y: x || m || y)), lambda p: NOT ({refused}))) > 0)) > 0"


def _candidates_sql() -> str:
    lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    requirement = (
        "(starts_with(m, '不') AND substr(m, 2, 1) <> '' AND ends_with(p, substr(m, 2, 1)))",
        "length(translate(p, '”」』', '')) > length(translate(p, '“「『', '')) OR (length(p) - length(replace(p, '\"', ''))) % 2 = 1 OR starts_with(ltrim(low), '>')",
        f"len(list_filter({lists(REPORTING)}, lambda f: contains(substr(p, greatest(length(p) - 11, 1)), f))) > 0", f"len(list_filter({lists(CONDITIONAL)}, lambda f: contains(substr(p, greatest(length(p) - 2, 1)), f))) > 0",
        f"len(list_filter({lists(BOILERPLATE)}, lambda f: starts_with(substr(low, length(p) + length(m) + 1), f))) > 0",
    )
    samples = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in SAMPLES) + "]"
    blank = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    confirms, prefers = _has(CONFIRM), _has(PREF, *requirement)
    return rf"""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, {samples}[(conv_id * 5 + turn) % {len(SAMPLES)} + 1] || ' ' || text AS text FROM conversations),
    u AS (SELECT *, lower(text) AS low FROM t), v AS (SELECT *, role = 'user' AND {_has(CORRECT)} AS corrects, {_has(CONFIRM)} AS has_confirm, {_has(HEDGE)} AS has_hedge FROM u),
    w AS (SELECT *, role = 'assistant' AND coalesce(lead(corrects) OVER (PARTITION BY conv_id ORDER BY turn), false) AS dropped FROM v),
    m AS (SELECT * EXCLUDE (low), string_split(regexp_replace(regexp_replace(text, '([!?。！？\n])', '\1' || chr(1), 'g'), '([.;])({blank})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM w WHERE NOT dropped),
    r AS (SELECT conv_id, turn, role, has_confirm, has_hedge, unnest(l) AS raw, generate_subscripts(l, 1) AS k FROM m),
    s AS (SELECT *, trim(regexp_replace(raw, '{blank}+', ' ', 'g')) AS sentence FROM r), x AS (SELECT *, lower(sentence) AS low FROM s WHERE length(sentence) >= 2 AND strlen(sentence) <= 400 AND NOT regexp_matches(sentence, '[?？]$') AND regexp_matches(sentence, '[A-Za-z0-9]{{3}}|[㐀-䶿一-鿿豈-﫿]{{2}}')),
    h AS (SELECT conv_id, turn, k, sentence, 'user_preference' AS rule, CASE WHEN {confirms} OR {_has(FIRST_PERSON)} THEN 'profile' ELSE 'observation' END AS store, CASE WHEN has_confirm THEN 'confirmed' ELSE 'unconfirmed' END AS confidence FROM x WHERE role = 'user' AND (({prefers}) OR ({confirms}))
     UNION ALL SELECT conv_id, turn, k, sentence, 'user_correction', 'observation', 'corrected' FROM x WHERE role = 'user' AND {_has(CORRECT)}
     UNION ALL SELECT conv_id, turn, k, sentence, 'user_decision', CASE WHEN {_has(TOOLISH)} THEN 'procedure' ELSE 'observation' END, 'unconfirmed' FROM x WHERE role = 'user' AND {_has(DECISION, "(length(m) = 1 AND ends_with(p, '可'))")}
     UNION ALL SELECT conv_id, turn, k, sentence, 'procedure_note', 'procedure', CASE WHEN has_hedge THEN 'hedged' ELSE 'unconfirmed' END FROM x WHERE role = 'assistant' AND {_has(PROC)}
     UNION ALL SELECT conv_id, turn, k, sentence, 'lesson_learned', 'lesson', CASE WHEN has_hedge THEN 'hedged' ELSE 'unconfirmed' END FROM x WHERE role = 'assistant' AND {_has(LESSON)}
     UNION ALL SELECT conv_id, turn, k, sentence, 'hedged_statement', 'observation', 'hedged' FROM x WHERE role = 'user' AND {_has(HEDGE)}),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, store, lower(regexp_replace(sentence, '[.。]$', '')) ORDER BY turn, rule, k) AS first FROM h)
    SELECT conv_id, turn, rule, store, confidence, sentence AS content FROM o WHERE first = 1"""


@query(_candidates_sql())
def memory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all conversations, each turn led by a sample sentence."""
    return candidates(sampled_turns(spark, sf_dir))
