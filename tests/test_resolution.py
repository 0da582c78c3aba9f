"""Names resolved in order, against a loop that keeps the store itself."""

from __future__ import annotations

import random
import re

import pytest

from tessera.operators.resolution import resolve


def variants(name):
    n = name.strip(" ").lower()
    m = re.match(r"(?s)^(.*)[(（]([^(（]*)[)）][^)）]*$", n)
    out = [m.group(1).strip(" "), n, m.group(2).strip(" ")] if m else [n]
    return {v for v in out if v}


def same(a, b):
    words = lambda v: [w for w in re.split(r"\s+", v) if w]
    initials = lambda v: "".join(w[0] for w in words(v)) if len(words(v)) > 1 and all(w[0].isalnum() for w in words(v)) else None
    for x in variants(a):
        for y in variants(b):
            if x == y or x == initials(y) or y == initials(x):
                return True
            if len(x) >= 3 and len(y) >= 3 and (set(words(x)) <= set(words(y)) or set(words(y)) <= set(words(x))):
                return True
    return False


def first(name):
    found = re.findall(r"[^\W_]+", name.lower())
    return found[0] if found else None


def one_by_one(known, aliases, new):
    """The store as a list in the order of creation."""
    store = [(i, n, True) for i, n in sorted(known)]
    called = {}
    for i, a in sorted(aliases):
        called.setdefault(a.strip(" ").lower(), (i, True))
    out = []
    for i, name in sorted(new, key=lambda r: r[0]):
        norm = (name or "").strip(" ").lower()
        if not norm:
            out.append((i, "unnamed", None, None, None, None))
            continue
        hit = next(((j, k) for j, n, k in store if n.strip(" ").lower() == norm), None) or called.get(norm)
        hit = hit or next(((j, k) for j, n, k in store if same(n, name)), None)
        if hit:
            called.setdefault(norm, hit)
            out.append((i, "resolved", *hit, None, None))
            continue
        waiting = next(((j, k) for j, n, k in store if first(n) is not None and first(n) == first(name)), None)
        store.append((i, name, False))
        out.append((i, "created, pair queued" if waiting else "created", i, False, *(waiting or (None, None))))
    return sorted(out)


def check(spark, known, aliases, new):
    frame = lambda rows, c: spark.createDataFrame(rows, f"id bigint, {c} string")
    got = resolve(frame(known, "name"), frame(aliases, "alias"), frame(new, "name")).collect()
    assert sorted(tuple(r) for r in got) == one_by_one(known, aliases, new)


def test_chain_of_waiting_names(spark):
    """Each name is the same object as the one before and the one after it, so every second one is created."""
    check(spark, [], [], [(k, f"w{k} w{k + 1} (w{k + 1} w{k + 2})") for k in range(7)])


def test_cases(spark):
    new = [
        (1, None), (2, "   "), (3, "Apache Spark"), (4, "apache spark "), (5, "AS"), (6, "Spark (big data)"), (7, "big data"), (8, "dsh-kanban"),
        (9, "dsh-graph"), (10, "IBM"), (11, "international business machines"), (12, "x"), (13, "X"), (14, "x y"), (15, "b a"), (16, "a b"), (17, "???"), (18, "???!"),
        (19, "Ledger (Old) book"), (20, "known one"), (21, "nick"), (22, "Known-two"), (23, "two known words"), (24, "标签（旧）"), (25, "旧"),
    ]
    known = [(50, "Known One"), (51, "words"), (52, "known one")]
    check(spark, known, [(51, "nick"), (50, "NICK")], new)
    check(spark, [], [], new)


def test_one_name_for_a_third_of_all(spark):
    new = [(k, "hub") if k % 3 == 0 else (k, f"hub n{k}") if k % 3 == 1 else (k, f"n{k - 1} m{k}") for k in range(90)]
    check(spark, [], [], new)
    check(spark, [], [], [(90 - k, n) for k, n in new])


@pytest.mark.parametrize("seed", range(3))
def test_random_names(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice(["red", "blue", "ab", "rb", "c", "gear", "ring", "rg", "br"])
    name = lambda: " ".join(word() for _ in range(r.randint(1, 4))) + (f" ({word()} {word()})" if r.random() < 0.2 else "")
    new = [(k, name()) for k in r.sample(range(1000), 60)]
    check(spark, [(k, name()) for k in range(r.randint(0, 3))], [(0, name())], new)


def test_empty_tables_and_other_columns(spark):
    check(spark, [(1, "a name")], [], [])
    names = spark.createDataFrame([(1, "red gear", "v", 7), (1, "blue gear", "w", 8), (2, "blue gear", "x", 9)], "id bigint, name string, node string, entity bigint")
    got = resolve(names.limit(0), names.limit(0).withColumnRenamed("name", "alias"), names).collect()
    assert sorted(tuple(r) for r in got) == [(1, "created", 1, False, None, None), (2, "resolved", 1, False, None, None)]
