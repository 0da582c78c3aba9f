"""Text as points in time, in sessions of any zone."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.times import instant, precision

CASES = {
    "2024-02-29": (1709164800000000, "day"), "2024-02-29 01:02:03": (1709168523000000, "second"), "2024-02-29T01:02:03": (1709168523000000, "second"), " 2024-02-29t01:02:03z ": (1709168523000000, "second"),
    "2024-02-29T09:02:03+08:00": (1709168523000000, "second"), "2024-02-29T01:02:03.5": (1709168523500000, "fraction"), "2024-02-29 01:02:03.123456789Z": (1709168523123456, "fraction"), "2024-02-28T21:32:03.000001-03:30": (1709168523000001, "fraction"),
    "2023-02-29": (None, None), "2024-13-01": (None, None), "2024-02-29T25:00:00": (None, None), "2024-02-29T01:02": (None, None), "2024-2-9": (None, None), "": (None, None), "yesterday": (None, None), "2024": (None, None), None: (None, None),
}


def test_instants(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(k,) for k in CASES], "said string").select("said", F.unix_micros(instant(F.col("said"))).alias("at"), precision(F.col("said")).alias("exact"))
    try:
        for zone in ("UTC", "Asia/Shanghai"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert {r.said: (r.at, r.exact) for r in df.collect()} == CASES
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
