"""Line dedup, hard negatives and the filter audit against brute force: nulls, empty and long texts, ties, repeated rows, hot groups, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.conftest import SF, rows

from tessera.llm import filter_audit, hard_negatives, line_dedup
from tessera.llm import queries as Q

BLANKS = " \t\n\v\f\r"
LOW = -(1 << 63)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_line_dedup", "op13_filter_audit"])
def test_query_matches_sql(spark, duck, name):
    assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(Q.ORACLE_SQL[name]).df())


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(texts):
    key = lambda s: fold(s.strip(BLANKS))
    holders = defaultdict(set)
    for i, t in texts:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40:
                holders[key(s)].add((LOW if i is None else i, t or ""))
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(key(s), ())) >= 5 and max(x for x, _ in h) > (LOW if i is None else i) for s in lines]
        out.append((i, len(lines), sum(gone), hashlib.sha256("\n".join(s for s, g in zip(lines, gone, strict=True) if not g).encode()).hexdigest()))
    return Counter(out)


LINES = ["All rights reserved. Copying is allowed for every reader. " * 2, "ÉCOLE " * 9, "日本語" * 14, "x" * 40, "X" * 39, "short", "", "  \t "]


def line_texts(seed, n=60):
    r = random.Random(seed)
    dress = lambda s: r.choice(["", " ", "\t\v"]) + (s.upper() if r.random() < 0.2 and s.isascii() else s) + r.choice(["", "\r", " \f"])
    texts = [(k, "\n".join(dress(r.choice(LINES)) for _ in range(r.randint(0, 7)))) for k in range(n)]
    return texts + [(None, None), (None, "x" * 40), (3, texts[3][1]), (3, "x" * 40 + "\nother"), (9, ""), (500, "\n".join(f"line {k} {'y' * 40}" for k in range(3000)))]


@pytest.mark.parametrize("seed, low", [(1, False), (2, True)])
def test_line_dedup(spark, monkeypatch, seed, low):
    """Also with all hashes hot and bitmaps joined by a shuffle."""
    if low:
        for name, value in (("HOT", 1 << 30), ("SAMPLED", 1), ("SAMPLE", 1), ("PARTS", 3), ("MOST_BROADCAST", 0)):
            monkeypatch.setattr(line_dedup, name, value)
    texts = line_texts(seed)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5).withColumns({"key_a": F.lit("clash"), "row_id": F.lit(1), "runs": F.lit(2), "n_dropped": F.lit(3), "lines": F.lit(4)})
    assert Counter(tuple(r) for r in line_dedup.digest(docs).collect()) == brute_lines(texts)
    whole = line_dedup.deduplicated(docs)
    assert sorted(whole.columns) == sorted([*docs.columns, "n_lines", "kept_sha256"])
    got = whole.collect()
    assert {(r.key_a, r.row_id, r.runs, r.lines) for r in got} == {("clash", 1, 2, 4)}
    assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == r.kept_sha256 for r in got)
    assert line_dedup.digest(docs.limit(0)).count() == 0


def test_drop_bitmaps_are_runs(spark):
    texts = [(k, "\n".join(["x" * 40, "own", "y" * 50, "z" * 60, "own again"])) for k in range(6)]
    docs = line_dedup.named(spark.createDataFrame(texts, "doc_id long, text string"), "text")
    got = {r.row_id: [tuple(x) for x in r.runs] for r in line_dedup.drops(docs).collect()}
    assert got == {k: [(0, 0), (2, 3)] for k in range(5)}


def brute_audit(texts, labels):
    """texts: (doc_id, source, text)."""
    word = lambda t: [w for w in fold_blanks(t).split(" ") if w]
    fold_blanks = lambda t: "".join(" " if c in BLANKS else c for c in t)
    place = lambda i: 1 << 63 if i is None else i
    least = {}
    for i, _, t in texts:
        least[t or ""] = min(least.get(t or "", 1 << 63), place(i))
    facts = []
    for i, source, t in texts:
        t = t or ""
        w = word(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": least[t] < place(i)}
        mine = [x for x in labels if x[0] == i and i is not None]
        facts.append((source or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {f[0] for f in facts}:
        share = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                own = [x for x in facts if x[0] == part]
                here = [x for x in own if f in x[1] and not x[1] & before]
                share[f] += len(here)
                out[part, "".join(order), step] = [sum(not x[1] & (before | {f}) for x in own), len(here), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in here), sum(x[3] for x in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    r = random.Random(4)
    words = ["a", "B", "é", "日本", "word", "Word", "x" * 20, "x" * 21, "#", "und"]
    text = lambda n: r.choice([" ", "\n", "\t \v"]).join(r.choice(words) + (str(r.randint(0, 99)) if r.random() < 0.7 else "") for _ in range(n))
    texts = [(k, r.choice(["s1", "s2", None, ""]), text(r.choice([0, 1, 49, 50, 51, 200]))) for k in range(80)]
    texts += [(100 + k, "s1", texts[k % 5][2]) for k in range(40)] + [(None, "s3", texts[0][2]), (None, None, None), (3, "s1", texts[3][2]), (7, "s9", text(3000)), (8, "s9", "y" * 100_000)]
    labels = [(k, r.choice([0, 1, None, 7]), r.choice([0, 1])) for k in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string").repartition(3).withColumns({"part": F.lit("clash"), "digest": F.lit(1), "place": F.lit(1)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    got = {tuple(x[:3]): tuple(x[3:]) for x in filter_audit.audit(docs, marks).collect()}
    assert got == brute_audit(texts, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).count() == len(got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB é日\t\n#$😀\x85\x00"), max_size=40), min_size=1, max_size=8))
def test_transducer(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    begin, end, of, total = filter_audit.transduce(data, np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    assert [(o, bytes(data[a:b])) for a, b, o in zip(begin, end, of, strict=True)] == [(k, w) for k, x in enumerate(raw) for w in x.split()]
    assert total["n_words"].tolist() == [len(x.split()) for x in raw]
    assert total["n_points"].tolist() == [len(t) for t in texts]
    assert total["n_capitals"].tolist() == [sum("A" <= c <= "Z" for c in t) for t in texts]
    assert total["n_symbols"].tolist() == [sum(c in "#$%&*|" for c in t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text("abé", min_size=1, max_size=19), max_size=20), min_size=1, max_size=5))
def test_hash_table_is_verified(texts):
    """A table that is nearly full makes different words meet; equal words of other texts count on their own."""
    raw = [" ".join(t).encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    begin, end, of, _ = filter_audit.transduce(data, np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    want = [len(set(t)) for t in texts]
    assert filter_audit.distinct(data, begin, end, of, len(raw)).tolist() == want
    assert filter_audit.distinct(data, begin, end, of, len(raw), max(1, len(begin).bit_length())).tolist() == want


def brute_negatives(given_):
    seen, kept = set(), []
    for i, v, label in given_:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * c) for c in v))
        if row not in seen:
            seen.add(row)
            kept.append(row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for i, label, v in (x for x in kept if x[0] % 100 == 0):
        scored = sorted((-dot(v, w), j, m) for j, m, w in kept if (j, m, w) != (i, label, v))
        for ps, p in [(-s, j) for s, j, m in scored if m == label][:5]:
            fits = [(-s, j) for s, j, m in scored if m != label and 30 * ps <= -100 * s <= 90 * ps][:10]
            out.update((i, p, k, j, ps, s) for k, (s, j) in enumerate(fits, 1))
    return out


def vectors(seed, n, d=6, centres=4):
    r = random.Random(seed)
    c = [[r.gauss(0, 1) for _ in range(d)] for _ in range(centres)]
    out = [(k, [float(np.float32(x + r.gauss(0, 0.4))) for x in c[k % centres]], k % centres if r.random() < 0.8 else r.randint(0, 9)) for k in range(n)]
    same = out[5][1]
    out += [(1000 + k, same, k % 3) for k in range(120)]  # a third or so shares one vector
    return out + [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")] * d, 2), (2003, [float("inf")] * d, 2), (None, same, 1), (2004, same, None), (2100, same[:3], 1), (2200, [], 2), out[7], (300, [9.0] * d, 5), (2300, [0.0] * d, 77)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 16, "PART": 40, "TILE": 2, "SLICE": 64, "ZONES": 2}, {"BLOCK": 1, "PART": 8, "PARTS": 3, "ZONES": 1}])
def test_hard_negatives(spark, monkeypatch, limits):
    """With all limits low there are many blocks, tiles, slices and groups of zone maps."""
    for name, value in limits.items():
        monkeypatch.setattr(hard_negatives, name, value)
    given_ = vectors(3, 330)
    frame = spark.createDataFrame(given_, SCHEMA).repartition(3).withColumns({"block": F.lit("clash"), "curve": F.lit(1), "score": F.lit(2)})
    assert Counter(tuple(r) for r in hard_negatives.mined(frame).collect()) == brute_negatives(given_)
    assert hard_negatives.mined(frame.limit(0)).count() == hard_negatives.mined(frame.filter("label is null")).count() == 0


def test_huge_components(spark):
    """Scores that doubles would round are exact."""
    big = [(100, [2.0**18.5, 3.0], 1), (1, [2.0**18.5 + 1 / 256, 5.0], 1), (2, [2.0**18, 7.0], 2), (3, [2.0**18, 7 + 1 / 256], 2), (4, [2.0**18 + 1 / 256, 1.0], 3)]
    got = Counter(tuple(r) for r in hard_negatives.mined(spark.createDataFrame(big, SCHEMA.replace("float", "double"))).collect())
    assert got == brute_negatives(big)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 3))
def test_hilbert_curve(dims, bits):
    """Neighbours on the curve differ by one in one dimension, and every cell comes once."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hard_negatives.hilbert(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=lambda k: keys[k])]
    assert (np.abs(np.diff(walk.astype(int), axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000))
def test_bounds_hold(seed):
    r = np.random.default_rng(seed)
    a, x = r.integers(-300, 300, (5, 7)).astype(float), r.integers(-300, 300, (9, 7)).astype(float)
    lower, upper = hard_negatives.bounds(a, x.min(axis=0)[None, :], x.max(axis=0)[None, :])
    scores = hard_negatives.products(a, x)
    assert (lower[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= upper[:, 0]).all()


def test_texts_without_ids_stay_apart(spark, monkeypatch):
    """Different texts of one id, or of none, never get one another's ranges, even where their hashes are equal."""
    from tests.llm.test_operators import brute_bytes, brute_words, text

    from tessera.llm import frames, substring_dedup, suffix_array_dedup

    monkeypatch.setattr(frames, "text_hash", lambda seed, body, real=frames.text_hash: F.pmod(real(seed, body), F.lit(2)) if seed < 2 else real(seed, body))
    shared = text(120)
    texts = [(None, shared), (None, text(150)), (None, shared + " " + text(40)), (7, shared), (7, text(130)), (7, "x" * 900), (8, text(30) + " " + shared), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in suffix_array_dedup.digest(docs).collect()) == brute_bytes(texts)
    assert Counter(tuple(r) for r in substring_dedup.digest(docs).collect()) == brute_words(texts)


@pytest.mark.parametrize("run", [" ", "\t", "\n", "日", "a", "　"])
def test_runs_that_no_splitter_takes(run):
    from tokenizers import Tokenizer

    from tessera.llm.bpe import ForcedBoundaryCodec

    vocabulary = Q.vocabulary()
    for t in ("a" + run * 2_000_000 + "b", run * 20_000, "a" + run * 20_000 + " <|endoftext|>" + run * 20_000 + "7"):
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        ids, _ = ForcedBoundaryCodec(vocabulary).encode(data, np.array([0, len(data)]))
        assert ids.tolist() == Tokenizer.from_file(vocabulary).encode(t, add_special_tokens=False).ids
