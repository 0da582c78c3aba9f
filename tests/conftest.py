from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    """Values of both engines in one form."""
    import math

    if hasattr(x, "item") and not isinstance(x, (list, tuple)):
        x = x.item() if getattr(x, "size", 1) == 1 else x.tolist()
    if x is None or str(x) in ("NaT", "<NA>") or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(round(float(x), 6) + 0.0)
    return str([plain(v) for v in x]) if isinstance(x, (list, tuple)) else str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(x) for x in r) for r in df[names].values.tolist())
