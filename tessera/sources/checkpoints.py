"""Where operators write what they go on from."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """The shared folder of spark.checkpoint.dir; one of our own only where nothing is set and all runs on one machine, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and go on from the files."""
    ensure_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table with a size of its own: for loops of many joins, as a checkpoint hands on the estimated size, which joins multiply until planning takes longer than running."""
    spark = df.sparkSession
    ensure_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def in_parts(spark: SparkSession, parts: int) -> Iterator[None]:
    """What is run inside deals its rows to so many partitions. A join of two sides dealt to fewer than the session's number would deal both again."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def dropped(*tables: DataFrame) -> None:
    """Delete the folders of written() tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("rounds-"):
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is run inside removes its shuffle files when it ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)
