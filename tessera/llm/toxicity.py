"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of a hashed n-gram counts log((p / |p|) / (q / |q|)) of its smoothed counts in toxic and other texts; a
logistic regression on these scaled features gives the score. It is fitted in one task on a sample whose bound is the
parameter MOST_ROWS and applied to all rows by a broadcast of the fixed-size weights.

Defined results: null and empty texts get the score of no features, that of the bias alone; without labelled rows of
both classes every score is 0; labels other than 0 and 1 are ignored; repeated rows get equal scores; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.hashed import Sample, counts, descend, held_out, labelled_sample, lists, strongest, sums

MOST_ROWS = 12_000
ORDERS = (5, 6, 7)
#: Features that may have a weight, and the sample rows that each must be in.
MOST_FEATURES, LEAST_ROWS = 1 << 12, 6
THRESHOLD = 0.7


def fit(table: pa.Table, size: int) -> pa.Table:
    """(feature, weight) by logistic regression on the scaled features; feature `size` is the bias."""
    s = Sample(table, size)
    y, n = s.target.astype(float), len(s.target)
    p, q = s.back(y) + 1.0, s.back(1 - y) + 1.0
    r = np.log(p / (y.sum() + 2.0) / (q / (n - y.sum() + 2.0)))

    def gradient(x: np.ndarray) -> np.ndarray:
        miss = (1 / (1 + np.exp(-np.clip(s.times(x[:-1] * r) + x[-1], -40, 40))) - y) / n
        return np.append(s.back(miss) * r + 1e-3 * x[:-1], miss.sum())

    x = descend(gradient, size + 1, 200, 0.02)
    return pa.table({"feature": pa.array(np.arange(size + 1), pa.int32()), "weight": pa.array(np.append(x[:-1] * r, x[-1]))})


def train(docs: DataFrame, labels: DataFrame, keep=lambda doc_id: F.lit(True)) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with a weight, their weights and the bias."""
    sample = labelled_sample(docs, labels, F.when(F.col("toxic").isin(0, 1), F.col("toxic")), keep, MOST_ROWS)
    rows = {r.target: r.n for r in sample.groupBy("target").agg(F.count("*").alias("n")).collect()}
    if len(rows) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -40.0
    ratio = F.log((F.col("n_1") + 1) / (rows[1] + 2) / ((F.col("n_0") + 1) / (rows[0] + 2)))
    buckets = strongest(counts(sample, ORDERS, False), F.abs(ratio) * F.sqrt("n"), [0, 1], LEAST_ROWS, MOST_FEATURES)
    size = len(buckets)
    model = lists(sample, buckets, ORDERS, False).groupBy().applyInArrow(lambda table: fit(table, size), "feature int, weight double").toPandas().sort_values("feature")
    return buckets, model["weight"].to_numpy()[:-1], float(model["weight"].iloc[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """Append `score`, the probability of a toxic label."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "score"]
    docs = docs.select(*(f"`{c}`" for c in names))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, known, bias = held.value
        for rows, z in sums(batches, text, ORDERS, False, buckets, known):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(1 / (1 + np.exp(-np.clip(z + bias, -40, 40))))], names=[*names, "score"])

    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, lambda doc_id: ~held_out(doc_id))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
