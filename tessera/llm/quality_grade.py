"""Quality grades by ordinal regression with cumulative links.

All grades share one weight vector over hashed n-grams and words; ordered thresholds t1 <= t2 <= ... turn the one
score z into tail probabilities P(grade >= k) = sigmoid(z - t_k), and these into the expected grade. The model is
fitted in one task on a sample whose bound is the parameter MOST_ROWS and applied to all rows by a broadcast of the
fixed-size weights.

Defined results: null and empty texts get the grade of no features; without labelled rows of two grades at least
nothing is known and every document gets the tail probabilities 1 and is kept; repeated rows get equal grades; a
document with several labels teaches each; columns named like the new ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.hashed import Sample, counts, descend, held_out, labelled_sample, lists, strongest, sums

MOST_ROWS = 12_000
ORDERS = (1, 2, 3)
#: Features that may have a weight, and the sample rows that each must be in.
MOST_FEATURES, LEAST_ROWS = 1 << 12, 6
#: Documents with P(grade >= SELECT) of MIN_TAIL or more are selected.
SELECT, MIN_TAIL = 1, 0.5


def rating() -> Column:
    """Graded ratings out of the label table: 0 bad, 1 good but toxic, 2 good."""
    return F.col("quality") * (2 - F.coalesce(F.col("toxic"), F.lit(0)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(table: pa.Table, size: int, grades: list[int]) -> pa.Table:
    """(feature, weight) of the shared weights; features from `size` on are the thresholds of the second grade, the third and so on."""
    s = Sample(table, size)
    grades = np.array(grades)
    k, n = len(grades) - 1, len(s.target)
    rank = np.searchsorted(grades, s.target)
    rows = np.arange(n)

    def thresholds(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x[:1], x[:1] + np.cumsum(np.exp(x[1:]))))

    def gradient(x: np.ndarray) -> np.ndarray:
        t = thresholds(x[-k:])
        tail = np.concatenate((np.ones((n, 1)), sigmoid(s.times(x[:-k])[:, None] - t), np.zeros((n, 1))), axis=1)
        p = np.maximum(tail[rows, rank] - tail[rows, rank + 1], 1e-9)
        slope = tail * (1 - tail)
        high, low = slope[rows, rank] / p, slope[rows, rank + 1] / p
        by_t = np.zeros((n, k + 2))
        by_t[rows, rank] += high
        by_t[rows, rank + 1] -= low
        g_t = by_t[:, 1:-1].sum(axis=0) / n
        g_raw = np.concatenate(([g_t.sum()], [g_t[j:].sum() * np.exp(x[-k + j]) for j in range(1, k)]))
        return np.concatenate((s.back((low - high) / n) + 1e-3 * x[:-k], g_raw))

    x = descend(gradient, size + k, 200, 0.02)
    return pa.table({"feature": pa.array(np.arange(size + k), pa.int32()), "weight": pa.array(np.concatenate((x[:-k], thresholds(x[-k:]))))})


def train(docs: DataFrame, labels: DataFrame, target: Column | None = None, keep=lambda doc_id: F.lit(True)) -> tuple[np.ndarray, np.ndarray, list[tuple[int, float]]]:
    """Buckets with a weight, their weights, and (grade, threshold) in rising order, the lowest grade first with threshold -inf."""
    sample = labelled_sample(docs, labels, rating() if target is None else target, keep, MOST_ROWS)
    rows = {r.target: r.n for r in sample.groupBy("target").agg(F.count("*").alias("n")).collect()}
    grades = sorted(rows)
    if len(grades) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0), []
    total = sum(rows.values())
    spread = sum((F.abs(F.col(f"n_{g}") - F.col("n") * rows[g] / total) for g in grades), F.lit(0.0)) / F.sqrt(F.col("n") + 1)
    buckets = strongest(counts(sample, ORDERS, True), spread, grades, LEAST_ROWS, MOST_FEATURES)
    size = len(buckets)
    model = lists(sample, buckets, ORDERS, True).groupBy().applyInArrow(lambda table: fit(table, size, grades), "feature int, weight double").toPandas().sort_values("feature")
    weights = model["weight"].to_numpy()
    return buckets, weights[:size], [(grades[0], float("-inf")), *zip(grades[1:], weights[size:].tolist(), strict=True)]


def grade(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """Append expected_grade and tail (map of grade to the probability of that grade or a higher one)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("expected_grade", "tail")]
    docs = docs.select(*(f"`{c}`" for c in names))
    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.MapType(T.IntegerType(), T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, known, steps = held.value
        grades = [g for g, _ in steps]
        for rows, z in sums(batches, text, ORDERS, True, buckets, known):
            tails = np.stack([sigmoid(z - t) if np.isfinite(t) else np.ones(len(z)) for _, t in steps], axis=1) if steps else np.ones((len(z), 0))
            expected = grades[0] + tails[:, 1:] @ np.diff(grades) if steps else np.zeros(len(z))
            maps = pa.array([list(zip(grades, row, strict=True)) for row in tails.tolist()], pa.map_(pa.int32(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(expected, pa.float64()), maps], names=[*names, "expected_grade", "tail"])

    return docs.mapInArrow(run, schema)


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of SELECT or higher) and kept; held-out rows, a third by the hash of doc_id, teach nothing.

    The label table has no graded ratings: rating() makes them out of quality and toxic.
    """
    tail = F.coalesce(F.try_element_at("tail", F.lit(SELECT)), F.lit(1.0))
    return grade(docs.select("doc_id", "text"), train(docs, labels, keep=lambda doc_id: ~held_out(doc_id))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", tail.alias("tail_probability"), (tail >= MIN_TAIL).alias("kept"))
