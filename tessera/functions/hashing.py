"""FNV-1a hashes of strings and the bag-of-words embedding made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import terms

#: Fixed values of FNV-1a with 64 bits, and the embedding's default and least dimensions.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
DIMENSIONS, LEAST_DIMENSIONS = 256, 8


def fnv1a(words: list[bytes]) -> np.ndarray:
    """The hashes of all words, byte place by byte place."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    data, first, ordered = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64), (np.cumsum(size) - size)[order], size[order]
    h = np.full(len(words), OFFSET, dtype=np.uint64)
    for at in range(int(size.max()) if len(words) else 0):
        n = int(np.searchsorted(-ordered, -at, side="left"))  # words longer than `at` come first
        h[:n] = (h[:n] ^ data[first[:n] + at]) * np.uint64(PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def fact_hash(text: Column | str) -> Column:
    """Hex FNV-1a of the text in lower case with white space collapsed."""

    @F.pandas_udf(T.StringType())
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{x:016x}" for x in fnv1a([t.encode() for t in texts]).tolist()])

    text = F.col(text) if isinstance(text, str) else text
    return hashed(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")))


def embedder(dimensions: int = DIMENSIONS):
    """A column function: counts of words by hash modulo the dimensions, at unit length; a text without words is all zeros."""
    size = max(dimensions, LEAST_DIMENSIONS)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(words: pd.Series) -> pd.Series:
        count = words.map(len).to_numpy()
        code, different = pd.factorize(np.concatenate(words.to_list())) if count.sum() else (np.zeros(0, dtype=np.int64), [])
        place = (fnv1a([w.encode() for w in different]) % np.uint64(size)).astype(np.int64)
        row = np.repeat(np.arange(len(words)), count)
        v = np.bincount(row * size + place[code], minlength=len(words) * size).reshape(len(words), size).astype(np.float64)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return pd.Series(list((v / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return lambda text: embed(terms(text))
