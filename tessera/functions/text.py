"""Column expressions for tokens, norms and ranks that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


#: The same rule for the DuckDB twins, as a select list item over `text`.
TERMS_SQL = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def normalised(name: Column) -> Column:
    return F.lower(F.trim(name))


def rrf(rank: Column, k: int = 60) -> Column:
    """Reciprocal rank of a 0-based rank."""
    return F.lit(1.0) / (F.lit(k) + rank + 1)


def decay(access_count: Column, idle_days: Column, base: Column, weight: float = 0.5, days: float = 14.0) -> Column:
    """base + weight * exp(-idle / ((1 + uses) * days))."""
    return base + F.lit(weight) * F.exp(-idle_days / ((1 + access_count) * F.lit(days)))


def squared_distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, d) -> s + d)")


def cosine(a: str, b: str) -> Column:
    dot = lambda p, q: f"aggregate(zip_with({p}, {q}, (x, y) -> double(x) * double(y)), 0D, (s, d) -> s + d)"
    return F.expr(f"try_divide({dot(a, b)}, sqrt({dot(a, a)}) * sqrt({dot(b, b)}))")


#: Characters of Han.
HAN = r"[㐀-䶿一-鿿豈-﫿]"


def han_tokens(text: Column) -> Column:
    """Runs of Han become overlapping pairs (single ones stay), other words stay as they are."""
    runs = F.regexp_extract_all(text, F.lit(rf"{HAN}+|[^\s\p{{P}}㐀-䶿一-鿿豈-﫿]+"), F.lit(0))
    pairs = lambda w: F.when(w.rlike(f"^{HAN}{{2,}}$"), F.transform(F.sequence(F.lit(1), F.char_length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))
    return F.flatten(F.transform(runs, pairs))
