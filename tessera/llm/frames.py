"""What the operators share on the side of Spark: reading tables, unclashing columns, cutting lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.checkpoints import cut, ensure_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only where nothing is set, as in tests."""
    ensure_folder(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Thin rows that one task takes without trouble.
TASK_ROWS = 150_000


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than `rows` thin rows need: steps over little data then write few files, or none."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) of thin rows in as many partitions as they need, and their number."""
    out = cut(df)
    n = out.count()
    return fitted(out, n), n


def shield(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in one struct, so that no name of theirs can clash with a working column."""
    rest = [c for c in docs.columns if c not in used]
    return docs.select(*(f"`{c}`" for c in docs.columns if c in used), *([F.struct(*(f"`{c}`" for c in rest)).alias("_rest")] if rest else []))


def unshield(docs: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The columns as they were before shield(), and more ones."""
    inside = docs.schema["_rest"].dataType.names if "_rest" in docs.columns else []
    return docs.select(*(F.col("_rest").getField(c).alias(c) if c in inside else F.col(f"`{c}`") for c in names if c not in more), *more)


def text_hash(seed: int, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), text)


def doc_keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with two longs that tell rows of different ids or texts apart: key_id, the id (null: the largest), and key_text.

    Where no id comes twice key_text is 0. Else it is a hash of the text for which a digest of 256 bits has shown that no two
    different texts of one id share it; if some do, the next seed is tried.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("key_id", F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)))
    if docs.groupBy("key_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return docs.withColumn("key_text", F.lit(0).cast("long"))
    seed = 0
    while True:
        out = docs.withColumn("key_text", text_hash(seed, body))
        digests = out.select("key_id", "key_text", F.sha2(body, 256).alias("digest")).groupBy("key_id", "key_text").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
        if digests.filter("a != b").isEmpty():
            return out
        seed += 1
