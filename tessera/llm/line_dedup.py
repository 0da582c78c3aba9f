"""Line dedup: hashes of lines, range-partitioned and sorted by document and position; bitmaps of lines come back, not texts.

A line counts by its key: the line without ASCII white space at both ends, A-Z lower-cased. A key of at least LEAST_CHARS
code points in at least LEAST_DOCS documents keeps its lines only in the largest doc_id that holds it. Lines travel as
128-bit hashes of their keys with document and position. They are dealt by ranges of the hash and sorted within it by
document (largest first) and position, so the first row of a run names the keeper and the rest of the run is judged as it
streams by. What comes back for each document is its drop bitmap, run-length encoded: sorted (first, last) positions.

A hash that holds more than one HOT-th of a sample of the lines is dealt by hash and document part; the parts' counts and
keepers (at most HOT * PARTS rows, as a hash needs a HOT-th of the sample) are added up and broadcast. The sample
decides only how rows are dealt, never what is kept.

Bitmaps of up to MOST_BROADCAST runs are broadcast to the texts; beyond that both sides are shuffled by document.

Defined results: a null or empty text is one empty line; rows are told apart by doc_id and text, so equal rows are one
document and get equal results, and different texts of one doc_id are several; a null doc_id is smaller than every other;
all texts of the largest doc_id keep their lines; empty tables give no rows; other columns are carried on unless their
names are those of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.frames import counted, cut, shield, unshield

LEAST_CHARS, LEAST_DOCS = 40, 5
#: A hash with more than one HOT-th of the sampled lines, and SAMPLED of them at least, is dealt in PARTS; the sample are the documents whose hash is divisible by SAMPLE.
HOT, SAMPLED, SAMPLE, PARTS = 1 << 14, 16, 32, 256
#: Runs of dropped lines (about 50 bytes each) that are broadcast.
MOST_BROADCAST = 500_000

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded(text: Column) -> Column:
    """A-Z in lower case and nothing else; lower() does that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def named(docs: DataFrame, text: str) -> DataFrame:
    """docs with `row_id` (the document's number, null: the smallest), `row_a` and `row_b` (128 bits of its text) and `body` (a null text is empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"body": body, "row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "row_a": F.xxhash64(body), "row_b": F.xxhash64(F.lit("b"), body)})


def keyed(docs: DataFrame) -> DataFrame:
    """(key_a, key_b, row_id, row_a, row_b, pos): every line whose key is long enough, by 128 bits of its key; equal rows give one."""
    lines = docs.select("row_id", "row_a", "row_b", F.posexplode(F.split(folded(F.col("body")), "\n")).alias("pos", "line"))
    lines = lines.filter(F.octet_length("line") >= LEAST_CHARS).select("row_id", "row_a", "row_b", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).filter(F.char_length("key") >= LEAST_CHARS)
    return lines.select(F.xxhash64("key").alias("key_a"), F.xxhash64(F.lit("b"), "key").alias("key_b"), "row_id", "row_a", "row_b", "pos")


def hot_keys(lines: DataFrame) -> list[tuple[int, int]]:
    """The hashes that hold a HOT-th or more of the sampled lines: HOT of them at most."""
    sample = lines.filter(F.pmod("row_a", F.lit(SAMPLE)) == 0)
    least = max(SAMPLED, sample.count() / HOT)
    return [(r.key_a, r.key_b) for r in sample.groupBy("key_a", "key_b").count().filter(F.col("count") >= least).collect()]


def drops(docs: DataFrame) -> DataFrame:
    """(row_id, row_a, row_b, runs): the sorted runs (first, last) of lines that go, of each document that loses any."""
    lines = cut(keyed(docs))
    hot = docs.sparkSession.createDataFrame(hot_keys(lines), "key_a long, key_b long").withColumn("split", F.lit(True))
    lines = lines.join(F.broadcast(hot), ["key_a", "key_b"], "left")
    lines = lines.withColumn("part", F.when(F.col("split"), F.pmod("row_a", F.lit(PARTS))).otherwise(F.lit(-1).cast("long"))).drop("split")
    dealt = lines.repartitionByRange("key_a", "key_b", "part")
    run = W.partitionBy("key_a", "key_b", "part").orderBy(F.desc("row_id"), "row_a", "row_b", "pos")
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    begins = F.lag("pos").over(run).isNull() | ~F.struct("row_id", "row_a", "row_b").eqNullSafe(F.lag(F.struct("row_id", "row_a", "row_b")).over(run))
    seen = dealt.withColumn("begins", begins.cast("long")).withColumns({"n_docs": F.sum("begins").over(whole), "keeper": F.first("row_id").over(whole)})
    # The parts of hot hashes are added up: one row of each part at most goes on.
    parts = seen.filter("part >= 0").groupBy("key_a", "key_b").agg(F.sum("begins").alias("all_docs"), F.max("keeper").alias("all_keeper"))
    judged = seen.join(F.broadcast(parts), ["key_a", "key_b"], "left")
    gone = judged.filter((F.coalesce("all_docs", "n_docs") >= LEAST_DOCS) & (F.col("row_id") < F.coalesce("all_keeper", "keeper")))
    row = ["row_id", "row_a", "row_b"]
    gone = gone.select(*row, "pos").repartition(*row).distinct()
    islands = gone.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy(*row).orderBy("pos")))
    runs = islands.groupBy(*row, "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def deduplicated(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with `text` cut and n_lines, n_dropped and kept_sha256 added; without keep_text only doc_id and those."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_sha256")]
    base = named(shield(docs.select(*(f"`{c}`" for c in names)), "doc_id", text), text)
    bitmaps, n = counted(drops(base))
    out = base.join(F.broadcast(bitmaps) if n <= MOST_BROADCAST else bitmaps, ["row_id", "row_a", "row_b"], "left")
    out = out.withColumn("lines", F.split("body", "\n")).withColumns({"n_lines": F.size("lines").cast("long"), "n_dropped": F.expr("coalesce(aggregate(runs, 0L, (s, r) -> s + r.last - r.first + 1), 0L)")})
    # What stays lies between the runs: slices from behind one run to the front of the next.
    stays = F.expr("""transform(concat(runs, array(named_struct('first', size(lines), 'last', size(lines)))), (r, i) ->
      slice(lines, if(i = 0, 0, runs[greatest(i - 1, 0)].last + 1) + 1, r.first - if(i = 0, 0, runs[greatest(i - 1, 0)].last + 1)))""")
    kept = F.when(F.col("runs").isNull(), F.col("body")).otherwise(F.array_join(F.flatten(stays), "\n"))
    out = out.withColumn("kept", kept).withColumn("kept_sha256", F.sha2("kept", 256))
    if not keep_text:
        return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    out = out.withColumn(text, F.when(F.col(text).isNotNull(), F.col("kept")))
    return unshield(out, names, "n_lines", "n_dropped", "kept_sha256")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return deduplicated(docs, keep_text=False)


ORACLE = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper > doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper <= doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""
