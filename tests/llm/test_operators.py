"""The ten operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.conftest import SF, rows

from tessera.llm import bpe, chat, decontaminate, near_dup, quality_grade, quality_rules, repeats, substring_dedup, suffix_array_dedup, toxicity, url_filter
from tessera.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "é", "日本", "x" * 30]


def text(n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


LONG, PASSAGE = text(3000), text(90)
#: Null and empty texts, copies, near copies, a shared passage, repeats inside a text, a very long text, a repeated row.
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG), (7, LONG.replace("alpha1 ", "omega ")), (8, text(40) + "\n" + PASSAGE), (9, PASSAGE + " " + text(60)),
    (10, "a b c d e f g h " * 8), (11, "x" * 2000), (12, text(13)), (13, text(12)), (14, text(100)), (14, text(50)), (15, "same\nsame\n\nsame # * $"), (15, "same\nsame\n\nsame # * $"), (None, PASSAGE),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 3, "h1"), "n_chars": F.char_length("text").cast("long"), "key_id": F.lit("clash"), "gone": F.lit(1), "_words": F.lit(2)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def brute_words(texts, n=13):
    first: dict[tuple, float] = {}
    order = [(float("inf") if i is None else i, WORD.findall(t or "")) for i, t in texts]
    for i, w in order:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, float("inf")), i)
    out = []
    for (i, w), (doc, _) in zip(order, texts, strict=True):
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup(docs, none):
    got = Counter(tuple(r) for r in substring_dedup.digest(docs).collect())
    assert got == brute_words(TEXTS)
    assert substring_dedup.deduplicated(docs).columns == [*docs.columns, "n_words", "n_removed", "kept_sha256"]
    assert substring_dedup.digest(none).count() == 0


def brute_bytes(texts, n=400):
    raw = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[k : k + n] for _, b in raw for k in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        mask = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                mask[k : k + n] = True
        spans = int(np.diff(np.concatenate(([0], mask.astype(int)))).clip(0).sum())
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~mask])).hexdigest()))
    return Counter(out)


def test_suffix_array_dedup(docs, none):
    assert Counter(tuple(r) for r in suffix_array_dedup.digest(docs).collect()) == brute_bytes(TEXTS)
    assert suffix_array_dedup.digest(none).count() == 0


def test_repeats_of_given_documents(spark):
    """Both kinds of repeats on the smallest tables."""
    rows_ = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    d = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in suffix_array_dedup.digest(d).collect()) == brute_bytes(rows_)
    assert Counter(tuple(r) for r in substring_dedup.digest(d).collect()) == brute_words(rows_)


def test_very_long_texts(spark):
    """A text of 200,000 words, its near copy, and 300,000 bytes without white space."""
    from tokenizers import Tokenizer

    r = random.Random(9)
    long = " ".join(r.choice(WORDS) + str(r.randint(0, 10**6)) for _ in range(200_000))
    texts = [(1, long), (2, long.replace("alpha1", "omega ")), (3, "x9é" * 75_000), (4, "short")]
    d = spark.createDataFrame([(*t, "en", "h", 1) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id: x.class_id for x in near_dup.near_duplicates(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {x.doc_id: x.n_words for x in quality_rules.verdicts(d).collect()} == {i: len(WORD.findall(t)) for i, t in texts}
    t = Tokenizer.from_file(Q.vocabulary())
    assert {x.doc_id: x.n_tokens for x in bpe.digest(d, Q.vocabulary()).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts}
    item = " ".join(long.split()[150_000:150_040])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(d, bench).collect()} >= {(1, 7)}
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(d, labels).count() == quality_grade.selected(d, labels).count() == 4
    gone = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.digest(d).collect()}
    assert gone[1] == (200_000, 0) and gone[2][1] > 100_000
    conv = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long[:400_000])], "conv_id long, turn long, role string, text string")
    assert chat.digest(conv).first().loss_chars == 400_000


def bodies(raw: list[bytes], ids: list[int], anchor: int) -> repeats.Bodies:
    n = np.arange(len(raw))
    return repeats.Bodies(b"".join(raw), np.array([len(x) for x in raw]), np.ones(len(raw), dtype=np.uint64), np.full(len(raw), anchor), np.zeros(len(raw), dtype=bool), n, np.array(ids), n, n * 0)


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 30), st.lists(st.text("ab", min_size=30, max_size=120), min_size=2, max_size=6, unique=True))
def test_burrows_wheeler_search(length, texts):
    raw = [b.encode() for b in texts]
    old, suffix_array_dedup.LENGTH = suffix_array_dedup.LENGTH, length
    try:
        n, got = suffix_array_dedup.solve(bodies(raw, list(range(len(raw))), 0))
    finally:
        suffix_array_dedup.LENGTH = old
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    assert got.tolist() == [seen[b[k : k + length]] > 1 for b in raw for k in range(len(b) - length + 1)] and n.tolist() == [len(b) - length + 1 for b in raw]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a ", "b ", "é "]), min_size=13, max_size=17), min_size=2, max_size=30), st.integers(0, 10))
def test_suffix_trees(texts, anchor):
    """Windows that hold the anchor at one place and are equal get the smallest of their ids."""
    anchor = min(anchor, 10)
    r = random.Random(anchor)
    texts = [t for t in texts if len(t) - 13 <= anchor]
    if not texts:
        return
    b = bodies(["".join(t).encode() for t in texts], [r.randint(0, 9) for _ in texts], anchor)
    n, got = substring_dedup.solve(b)
    least: dict = {}
    windows = [(anchor - k, tuple(t[k : k + 13]), i) for t, i in zip(texts, b.id.tolist(), strict=True) for k in range(len(t) - 12)]
    for at, w, i in windows:
        least[at, w] = min(least.get((at, w), i), i)
    assert got.tolist() == [least[at, w] for at, w, _ in windows] and n.tolist() == [len(t) - 12 for t in texts]


def test_long_texts_are_searched_in_stretches():
    h = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint64) << np.uint64(40)
    want = [k + int(np.argmin(h[k : k + 20])) for k in range(len(h) - 19)]
    assert repeats.anchors(h, 20).tolist() == repeats.anchors(h, 20, 6).tolist() == want


def test_repeats_with_all_limits_low(spark, monkeypatch):
    """Hot prefixes, many buckets and the second exchange give what brute force gives."""
    r = random.Random(8)
    passages = [" ".join(r.choice(WORDS) for _ in range(r.randint(60, 200))) for _ in range(6)]
    texts = [(k, "\n ".join(r.choice(passages) if r.random() < 0.6 else text(r.randint(1, 90)) for _ in range(r.randint(0, 9)))) for k in range(60)]
    texts += [(100 + k, texts[k][1]) for k in range(10)] + [(3, texts[3][1]), (None, texts[5][1])]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    for name, value in {"HOT": 3, "BUCKET_BYTES": 5_000, "COARSE": 3, "SLICE": 20_000, "CHUNK": 2_000}.items():
        monkeypatch.setattr(repeats, name, value)
    for most in (0, 1000):
        monkeypatch.setattr(repeats, "COPIES_MOST", most)
        assert Counter(tuple(x) for x in substring_dedup.digest(d).collect()) == brute_words(texts)
        assert Counter(tuple(x) for x in suffix_array_dedup.digest(d).collect()) == brute_bytes(texts)


def test_near_duplicates(docs, none):
    got = {(r.doc_id): r.class_id for r in near_dup.near_duplicates(docs).filter("doc_id < 14").collect()}
    assert got[6] == 5 and got[7] == 5
    assert all(got[k] == k for k in (1, 2, 3, 4, 8, 9, 10, 11, 12, 13))
    assert near_dup.near_duplicates(none).count() == 0
    left = near_dup.keep(docs)
    assert left.columns == docs.columns and {5} == {r.doc_id for r in left.filter("doc_id in (5, 6, 7)").collect()}


def test_near_duplicates_of_given_documents(spark):
    """All pairs by inverted index, similarity of labelled shingles, components by union."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = {}
    for r in d.collect():
        w, seen, out = WORD.findall(r.text or ""), Counter(), set()
        for k in range(max(len(w) - 4, 1 if w else 0)):
            s = tuple(w[k : k + 5])
            out.add((s, seen[s]))
            seen[s] += 1
        labelled[r.doc_id] = out
    ids, top = sorted(labelled), {i: i for i in labelled}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(labelled[a] & labelled[b])
            if both and both >= 0.8 * (len(labelled[a]) + len(labelled[b]) - both):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(d).collect()} == {i: root(i) for i in ids}


def brute_classes(texts):
    """All pairs by longest common subsequence of labelled shingles (a table, no band), classes by union."""
    seqs = []
    for _, t in texts:
        w, seen, out = WORD.findall(t or ""), Counter(), []
        for k in range(max(len(w) - 4, 1 if w else 0)):
            s = tuple(w[k : k + 5])
            out.append(hash((s, seen[s])))
            seen[s] += 1
        seqs.append(np.array(out))
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, x in enumerate(seqs):
        for b, y in enumerate(seqs[:a]):
            if len(x) and len(y) and 1.8 * len(set(x) & set(y)) >= 0.8 * (len(x) + len(y)) - 1e-9:
                line = np.zeros(len(y) + 1, dtype=int)
                for v in x:
                    line[1:] = np.maximum.accumulate(np.maximum(line[1:], np.where(y == v, line[:-1] + 1, 0)))
                if line[-1] >= 0.8 * (len(x) + len(y) - line[-1]) - 1e-9 and root(a) != root(b):
                    top[max(root(a), root(b))] = min(root(a), root(b))
    ids = [i for i, _ in texts]
    return {ids[k]: min(ids[j] for j in range(len(ids)) if root(j) == root(k)) for k in range(len(ids))}


def test_large_groups_of_near_copies(spark):
    """Copies with few and many edits, a chain that drifts, copies cut at any length, swapped halves, and two clusters of one stem."""
    r = random.Random(4)
    fresh = lambda n: [f"w{r.randint(0, 10**9)}" for _ in range(n)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            k = r.randrange(len(words))
            words[k : k + r.randint(0, 2)] = fresh(r.randint(0, 2))
        return words

    base = fresh(140)
    texts = [edited(base, r.choice([0, 1, 2, 3, 5, 7, 9, 12])) for _ in range(70)]
    chain = base
    for _ in range(40):
        chain = edited(chain, 2)
        texts.append(chain)
    texts += [base[: r.randint(40, 140)] for _ in range(25)] + [base[70:] + base[:70], base[50:] + base[:50]]
    other = edited(base, 6)
    texts += [edited(other, r.randint(1, 4)) for _ in range(30)]
    texts = [(k, " ".join(t)) for k, t in enumerate(texts)]
    r.shuffle(texts)
    d = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_classes(texts)
    assert {x.doc_id: x.class_id for x in near_dup.near_duplicates(d).collect()} == want and 20 < len(set(want.values())) < len(want) - 60


def test_unlinked_texts_of_a_group_are_not_all_paired(spark, monkeypatch):
    """Texts that share a passage which their pivot lacks, but no more with each other: no all pairs (the code before passed this, too)."""
    r = random.Random(8)
    fresh = lambda n: [f"w{r.randint(0, 10**9)}" for _ in range(n)]
    base = fresh(150)
    stem = base[:112] + fresh(38)
    texts = [stem[:40] + fresh(30) + stem[70:] for _ in range(400)] + [base[:k] + fresh(2) + base[k:] for k in range(150)]
    n, compared = [], near_dup.compared
    monkeypatch.setattr(near_dup, "compared", lambda pairs, k, words: n.append(k) or compared(pairs, k, words))
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(d).collect()}
    assert got == {k: min(k, 400) for k in range(550)} and sum(n) < 40 * len(texts), n


def test_longer_open_texts_keep_their_partners(spark):
    """Text x (100 shingles) holds y (85) and is not linked with the pivot; the first that both have stands at place 15 of x."""
    x, y = list(range(15)) + list(range(100, 106)), list(range(100, 118))
    first = spark.createDataFrame([("x", "p", False, 100, x), ("y", "p", True, 85, y)], "node string, pivot string, linked boolean, n long, first array<long>")
    assert {"x", "y"} <= {k.node for k in near_dup.differences(first).collect()}


def test_one_row_of_each_class_stays(spark):
    """Repeated rows, two near copies of one id, a class without ids."""
    r = random.Random(6)
    a, b = ([f"w{r.randint(0, 10**9)}" for _ in range(60)] for _ in range(2))
    near = lambda w: " ".join([*w, "end"])
    texts = [(1, " ".join(a)), (1, " ".join(a)), (1, near(a)), (2, near(a)), (None, " ".join(b)), (None, " ".join(b)), (None, near(b)), (3, None), (3, None), (4, "x")]
    d = spark.createDataFrame([(*t, k) for k, t in enumerate(texts)], "doc_id long, text string, times int")
    got = near_dup.near_duplicates(d).collect()
    assert sorted((-1 if x.class_id is None else x.class_id) for x in got if x.kept) == [-1, 1, 3, 4] and len(got) == len(texts)
    left = near_dup.keep(d)
    assert left.columns == d.columns and sorted(str(x.doc_id) for x in left.collect()) == ["1", "3", "4", "None"]


def test_short_near_duplicates_are_all_found(spark):
    """Texts of n shingles, and those that lost as many as SIMILARITY allows, for each n up to SHORT."""
    pairs = []
    for n in [n for n in range(5, near_dup.LISTED + 1) if -(-4 * n // 5) <= near_dup.SHORT] * 3:
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(n + 4)]
        pairs.append((" ".join(words), " ".join(words[: -(-4 * n // 5) + 4])))
    d = spark.createDataFrame([(2 * k + end, t) for k, pair in enumerate(pairs) for end, t in enumerate(pair)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(d).collect()} == {i: i - i % 2 for i in range(2 * len(pairs))}


def test_alignment_follows_order():
    x = np.arange(100, dtype=np.uint64)
    assert near_dup.aligned(x, x) == 100
    assert near_dup.aligned(x, np.roll(x, 50)) == 0 and not near_dup.similar(x, np.concatenate((x[50:], x[:50])))
    assert near_dup.similar(x, np.delete(x, [3, 50]))


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary())
    want = Counter()
    for i, x in TEXTS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digest(docs, Q.vocabulary()).collect()) == want
    assert bpe.digest(none, Q.vocabulary()).count() == 0
    ids = bpe.encode(docs, Q.vocabulary())
    assert ids.columns == [*docs.columns, "ids"]
    assert bpe.decode(ids, Q.vocabulary()).filter("decoded != coalesce(text, '')").count() == 0


def test_bpe_cuts_change_nothing(monkeypatch):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(Q.vocabulary()), bpe.codec(Q.vocabulary())
    monkeypatch.setattr(bpe, "FRAGMENT", 3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "'s", "<|endoftext|>", "é", "12", ".", "日本", "🙂", "\x85", "\x1c", "_"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        raw = np.frombuffer(x.encode(), dtype=np.uint8)
        got = c.encode(raw, np.array([0, len(raw)]))[0].tolist()
        assert got == t.encode(x, add_special_tokens=False).ids and c.decode(got) == x


def test_every_token_is_its_own_encoding():
    """With this, merging by rank of the joined token is merging by the listed pairs."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(Q.vocabulary()).model
    of = {b: c for c, b in bpe.byte_of_char().items()}
    c = bpe.codec(Q.vocabulary())
    for i in range(0, 50256, 7):
        assert [x.id for x in model.tokenize("".join(of[b] for b in c.bpe.decode_single_token_bytes(i)))] == [i]


def test_quality_rules(docs, none):
    got = {r.doc_id: r for r in quality_rules.verdicts(docs).collect()}
    assert (got[1].n_words, got[1].base_failed, got[10].n_repeat_words, got[10].base_failed) == (0, True, 64, True)
    assert (got[15].n_dup_lines, got[15].n_symbols, got[15].word_chars) == (1, 3, 15)
    assert got[8].kept and not got[4].kept
    assert quality_rules.verdicts(none).count() == 0 and quality_rules.keep(none).count() == 0
    left = quality_rules.keep(docs)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in quality_rules.verdicts(docs).collect())


def test_hosts_are_shrunk(spark):
    judged = spark.createDataFrame([("bad", k < 195) for k in range(200)] + [("good", k < 5) for k in range(200)] + [("small", True)], "host string, base_failed boolean")
    rate = {r.host: r.rate for r in quality_rules.host_rates(judged).collect()}
    assert rate["bad"] > 0.9 > rate["small"] > rate["good"]
    assert [r.host for r in quality_rules.rejected_hosts(judged)[0].collect()] == ["bad"]


TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "a " * 50), (1, 2, "assistant", "</s>[INST] \\ [\\INST] <s>"), (1, 3, "user", None), (1, 3, "user", None), (1, 4, "assistant", "b " * 400),
    (1, 5, None, "odd [/ROLE][TURN]"), (2, None, "tool", "x"), (2, 0, "assistant", ""), (None, 0, "user", "lost"),
]


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (60, 20), (5, 0)])
def test_chat_round_trip(spark, budget, history):
    conv = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    want = {}
    for c in (1, 2, None):
        turns = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x in TURNS if k == c))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(conv, budget, history).collect()}
    assert got == want
    assert chat.digest(conv.limit(0)).count() == 0
    late = [r for r in chat.format_windows(conv, 60, 20).filter("conv_id = 1 and new_from > 0").collect()]
    assert late and all("[SYS]be brief[/SYS]" in r.formatted[: r.new_from] and all(x["from"] >= r.new_from for x in r.loss) for r in late)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(Q.ORACLE_SQL[name]).df())


def test_url_filter_edges(spark):
    urls = [None, "", "no scheme/es/", "HTTP://Example.ORG/es/1?x#y", "http://a.example.org/en/1", "http://notexample.org/es/", "http://org", "x://COM/fr/", "http://spam.net", "http://b.spam-x.de/?q", "http://?/fr/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id long, url string, rule int")).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/1", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert got[5] == ("notexample.org", "/es/", "org/", "allow") and got[6] == ("org", "", None, "allow") and got[7] == ("com", "/fr/", "com/fr/", "allow")
    assert got[8] == ("spam.net", "", None, "block") and got[9][3] == "block"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    pages = spark.createDataFrame([(k, f"http://h{k % 300}.net/") for k in range(600)] * 2, "page_id long, url string")
    listed = spark.createDataFrame([(f"H{k}.net",) for k in range(0, 400, 2)] + [(None,)], "host string")
    verdicts = url_filter.judge(pages, hosts=listed).collect()
    assert len(verdicts) == 1200 and all((r.verdict == "block") == (r.page_id % 300 % 2 == 0) for r in verdicts)


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("hash(key) % 10 = 0")
    old, url_filter.SHARD_KEYS = url_filter.SHARD_KEYS, 700
    try:
        filters, shards = url_filter.build(listed, universe)
    finally:
        url_filter.SHARD_KEYS = old
    assert shards > 1
    found = url_filter.member(universe.groupBy(F.expr("int(substring(key, 2)) % 50").alias("g")).agg(F.collect_list("key").alias("keys")), "keys", filters, shards)
    assert found.select(F.explode(F.arrays_zip("keys", "listed")).alias("x")).filter("x.listed != (hash(x.keys) % 10 = 0)").count() == 0


def test_decontamination(spark):
    items = [(1, "Who wrote the long book about whales and the sea. It was Herman in New York"), (2, "single sentence without an answer part here"), (3, None), (None, "x y z"), (4, "")]
    held = items[0][1].upper()
    d = [(1, text(300) + " " + held + " " + text(300)), (2, "Who wrote the long book about whales and the sea. " + text(30)), (3, None), (4, ""), (5, "so: " + items[1][1]), (6, text(200)), (6, held), (6, held)]
    docs = spark.createDataFrame([(*x, 0) for x in d], "doc_id long, text string, score int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for x in ("ÀÉÖØÞ ΑΒΡΣΩ ЖЩЯЁ ×÷", "straße"):
        up, low = (decontaminate.terms(np.frombuffer(y.encode(), dtype=np.uint8), np.array([0, len(y.encode())]))[0].tolist() for y in (x, x.lower()))
        assert up == low
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 1), (5, 2), (6, 1)]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_search_misses_nothing():
    """All passages and items scored without any bound give the same hits."""
    r = random.Random(1)
    rows_ = [{"item": k, "words": [r.randint(0, 300) ** 2 // 300 for _ in range(r.randint(3, 20))], "n_question": 2} for k in range(60)]
    idf = {w: 1 / (1 + sum(w in x["words"] for x in rows_)) for x in rows_ for w in x["words"]}
    index = decontaminate.Index(rows_, idf, 10.0)
    words = np.array([r.randint(0, 300) ** 2 // 300 for _ in range(4000)], dtype=np.int64)
    first = np.array([0, 1500, 1500, 4000])
    got = {(int(a), int(s), int(i)) for a, s, i, _ in zip(*index.search(words, first), strict=True)}
    want = set()
    for row in range(3):
        for start in range(first[row], first[row + 1], index.longest):
            seen = set(words[start : min(start + 2 * index.longest, first[row + 1])].tolist())
            for i in range(60):
                e = slice(index.item_first[i], index.item_first[i + 1])
                if sum(w for t, w in zip(index.term[e], index.impact[e], strict=True) if int(index.vocabulary[t]) in seen) >= decontaminate.THRESHOLD - 1e-9:
                    want.add((row, int(start), i))
    assert got == want and want


def test_toxicity_held_out(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.scored(d, labels).join(labels, "doc_id").toPandas()
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]
    held = got[got["held_out"]]
    assert ((held["score"] >= 0.5) == (held["toxic"] == 1)).mean() > 0.93 and held[held["toxic"] == 0]["predicted"].mean() < 0.02
    assert got["score"].between(0, 1).all()


def test_toxicity_edges(docs, none):
    labels = docs.sparkSession.createDataFrame([(1, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.scored(docs, labels).collect()} == {0}
    assert toxicity.scored(none, labels).count() == 0
    assert {r.kept for r in quality_grade.selected(docs, labels.withColumn("quality", F.col("toxic"))).collect()} == {True}


def test_grades_are_ordered(spark):
    r = random.Random(3)
    kinds = [["bad", "junk", "spam"], ["fair", "plain", "mid"], ["fine", "great", "best"]]
    data = [(k, " ".join(r.choice(kinds[k % 3]) + r.choice(["", " of", " and"]) for _ in range(40)), k % 3) for k in range(300)]
    d = spark.createDataFrame(data, "doc_id long, text string, g int")
    model = quality_grade.train(d, d.select("doc_id", "g"), F.col("g"), lambda i: i < 200)
    got = quality_grade.grade(d.filter("doc_id >= 200").withColumn("tail", F.lit(0)), model).toPandas()
    assert (got["expected_grade"].round() == got["g"]).mean() > 0.95
    assert all(dict(t)[0] == 1.0 and dict(t)[1] >= dict(t)[2] for t in got["tail"])


def test_quality_of_held_out_rows(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_grade.selected(d, labels).join(labels, "doc_id").toPandas()
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]
    held = got[got["held_out"]]
    good, bad = (held[held["quality"] == q] for q in (1, 0))
    above = (good["tail_probability"].to_numpy()[:, None] > bad["tail_probability"].to_numpy()).mean()
    assert good["kept"].mean() > 0.95 and above > 0.8, (good["kept"].mean(), bad["kept"].mean(), above)


def test_fit_has_the_greatest_likelihood():
    """No step away from the fitted weights and thresholds lowers the penalised loss, computed row by row."""
    r = np.random.default_rng(2)
    size = 6
    x = r.random((400, size)) < 0.4
    z = x @ np.array([2.0, -1.5, 1.0, 0.5, 0.0, -0.5]) + r.logistic(size=400)
    target = np.digitize(z, [0.0, 1.5])
    table = pa.table({"target": pa.array(target, pa.int32()), "features": pa.array([np.flatnonzero(row).tolist() for row in x], pa.list_(pa.int32()))})
    got = quality_grade.fit(table, size, [0, 1, 2]).to_pandas()["weight"].to_numpy()

    def loss(w):
        tail = lambda t, k: 1.0 if k == 0 else 0.0 if k == 3 else 1 / (1 + np.exp(w[size + k - 1] - t))
        return -np.mean([np.log(tail(row @ w[:size], g) - tail(row @ w[:size], g + 1)) for row, g in zip(x, target, strict=True)]) + 5e-4 * (w[:size] ** 2).sum()

    best = loss(got)
    for k in range(size + 2):
        for step in (-0.15, 0.15):
            moved = got.copy()
            moved[k] += step
            assert loss(moved) > best - 1e-4


def test_fit_of_thresholds():
    """Rising thresholds come out of graded ratings, and the shared weight points upwards."""
    target = np.repeat([0, 1, 2], 100)
    features = [[0] * 0 if g == 0 else [0] if g == 1 else [0, 1] for g in target]
    got = quality_grade.fit(pa.table({"target": pa.array(target, pa.int32()), "features": pa.array(features, pa.list_(pa.int32()))}), 2, [0, 1, 2]).to_pandas()["weight"].tolist()
    assert got[0] > 0 and got[1] > 0 and got[2] < got[3]
