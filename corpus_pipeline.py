"""A corpus pipeline over `documents`: quality rules, near-duplicates, substring dedup, decontamination, BPE round trip.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows
as Parquet and reads them again for the next one. All stages but the last return the columns of `documents`.

Defined results: a null text has no words and passes no quality rule, so it goes in the first stage; of repeated rows
one stays; a null doc_id is kept and encoded like any other; columns besides those of `documents` are passed on; empty
tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, near_dup, quality_rules, substring_dedup
from tessera.llm.frames import cut, shared_folder, shield, table, unshield
from tessera.llm.queries import vocabulary

#: Up to so many leaked rows (about 50 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 500_000

#: The steps are too different from SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return quality_rules.keep(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dup.keep(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that an earlier document has, too, are cut out; n_chars follows, and documents without words left go."""
    cleaned = substring_dedup.deduplicated(docs)
    left = cleaned.filter((F.col("n_words") > F.col("n_removed")) | (F.col("n_words") == 0))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold question and answer of a test item go; rows are told apart by id and text, so a row without id goes, too, and others of a shared id stay."""
    row = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    marked = shield(docs, "doc_id", "text").withColumn("row", row)
    items = decontaminate.split_answer(table(spark, sf_dir, "benchmark"))
    leaked = cut(decontaminate.leaks(marked.select("row", "text"), items, key="row").filter("leaked").select("row").distinct())
    few = leaked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return unshield(marked.join(F.broadcast(leaked) if few else leaked, "row", "left_anti"), docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of ids and decoded text."""
    return bpe.digest(docs, vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]


def drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has read is deleted once its own rows are written, but for the cleaned documents that the last stage reads."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before and name != STAGES[-1][0]:
            drop(spark, before)
        before = f"{folder}/{name}"
    return docs
