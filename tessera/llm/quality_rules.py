"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets measures of its own and a base verdict. Base failures are counted by host, each host's rate is
shrunk towards the corpus with a beta prior estimated from all hosts, and a document goes if it fails itself or its
host's shrunk rate is over the limit.

Defined results: a null text has no words and fails; a null host counts as the host ''; repeated rows are judged
each for itself and all count for their host; an empty table gives no rows. Columns of the input other than the
ones named as arguments are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import cut, shield, unshield
from tessera.llm.text import WORD

MIN_WORDS = 20
#: Percent of the words that may stand in repeated windows.
MAX_REPEAT = 30
WINDOW = 8
#: A host goes if more than this share of its documents fails, after shrinking.
MAX_HOST_RATE = 0.9
#: Verdicts on up to so many rejected hosts are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 50_000

SPACES = r"[\x20\x09-\x0D]+"


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append _text (null: empty) and _words."""
    docs = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn("_words", F.array_remove(F.split("_text", SPACES), ""))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Append n_words and n_repeat_words to what with_words() gives.

    Texts whose windows all have different hashes repeat nothing; only the others have their windows sorted,
    by the words themselves, and the words under equal neighbours counted.
    """
    n = "greatest(size(_words) - " + str(WINDOW - 1) + ", 0)"
    docs = docs.withColumn("_windows", F.expr("arrays_zip(" + ", ".join(f"slice(_words, {k + 1}, {n})" for k in range(WINDOW)) + ")"))
    docs = docs.withColumn("_hashes", F.expr("transform(_windows, w -> xxhash64(w))"))
    docs = docs.withColumn("_sorted", F.expr("if(size(array_distinct(_hashes)) = size(_hashes), null, sort_array(arrays_zip(_windows, sequence(1, size(_windows)))))"))
    docs = docs.withColumn("_at", F.expr("sort_array(filter(transform(_sorted, (x, i) -> if((i > 0 and _sorted[i - 1]['0'] = x['0']) or (i + 1 < size(_sorted) and _sorted[i + 1]['0'] = x['0']), x['1'], null)), p -> p is not null))".replace("['0']", "._windows").replace("['1']", "['1']")))
    return docs.select(
        *[c for c in docs.columns if c not in ("_windows", "_hashes", "_sorted", "_at", "n_words", "n_repeat_words")],
        F.size("_words").cast("long").alias("n_words"),
        F.expr(f"coalesce(aggregate(transform(_at, (p, i) -> if(i + 1 < size(_at), least({WINDOW}, _at[i + 1] - p), {WINDOW})), 0L, (a, x) -> a + x), 0L)").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def measures(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and all measures of each document."""
    docs = docs.select("doc_id", F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("_input"))
    docs = with_repeats(with_words(docs, "_input"))
    docs = docs.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)))
    return docs.select(
        "doc_id",
        "host",
        "n_words",
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        base_failed().alias("base_failed"),
    )


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n_docs, n_failed and the shrunk failure rate, from rows of (host, base_failed).

    The prior's mean is the corpus rate; its strength follows from the spread between hosts beyond what
    counting noise explains (method of moments), within [1, 1e6] documents.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    total = hosts.agg(
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("f"),
        F.count("*").alias("h"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("q"),
    )
    mean = F.col("f") / F.col("n")
    noise = mean * (1 - mean)
    between = F.col("q") / F.col("n") - mean * mean - noise * F.col("h") / F.col("n")
    strength = F.when(between > 0, F.least(F.greatest(noise / between - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
    prior = total.select(mean.alias("mean"), strength.alias("strength"))
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", ((F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))).alias("rate"))


def rejected_hosts(judged: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> tuple[DataFrame, bool]:
    """The hosts over the limit, written once, and whether they are few enough to broadcast."""
    found = cut(host_rates(judged).filter(F.col("rate") > max_host_rate).select("host"))
    few = found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return found, few


def verdicts(docs: DataFrame) -> DataFrame:
    """Every document's measures, base verdict and final verdict."""
    judged = cut(measures(docs))
    bad, few = rejected_hosts(judged)
    bad = bad.withColumn("_bad", F.lit(True))
    return judged.join(F.broadcast(bad) if few else bad, "host", "left").select(*[c for c in judged.columns if c != "host"], (~F.col("base_failed") & F.col("_bad").isNull()).alias("kept"))


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with all their columns; measured in a first pass for the hosts and again for the rows."""
    original, docs = docs.columns, shield(docs, text, host)
    columns = docs.columns
    judged = with_repeats(with_words(docs.select(*columns, F.coalesce(F.col(host), F.lit("")).alias("_host")), text))
    # Without the row number the filter would be pushed below the measures, and their nested expressions copied into it many times over.
    judged = judged.select(*columns, "_host", base_failed().alias("_failed"), F.monotonically_increasing_id().alias("_row"))
    bad, few = rejected_hosts(judged.select(F.col("_host").alias("host"), F.col("_failed").alias("base_failed")))
    passed = judged.filter(~F.col("_failed") & (F.col("_row") >= 0))
    bad = bad.withColumnRenamed("host", "_host")
    return unshield(passed.join(F.broadcast(bad) if few else bad, "_host", "left_anti"), original)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
x AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM w),
k AS (SELECT r, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o || ' ' || lead(w, 6) OVER o || ' ' || lead(w, 7) OVER o AS k FROM x WINDOW o AS (PARTITION BY r ORDER BY p)),
c AS (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM k WHERE k IS NOT NULL),
g AS (SELECT r, least(8, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 8)) AS x FROM c WHERE c > 1),
s AS (SELECT r, sum(x)::BIGINT AS x FROM g GROUP BY r),
m AS (SELECT w.r, doc_id, host, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(x, 0) AS n_repeat_words
  FROM w LEFT JOIN s ON w.r = s.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY host),
a AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q, count(*) / sum(n) AS e FROM h),
z AS (SELECT m, CASE WHEN q - m * m - m * (1 - m) * e > 0 THEN least(greatest(m * (1 - m) / (q - m * m - m * (1 - m) * e) - 1, 1), 1e6) ELSE 1e6 END AS k FROM a),
v AS (SELECT host, (f + m * k) / (n + k) AS rate FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.9 AS kept
FROM b JOIN v USING (host)
"""
