"""Rules on authored fixtures that the given tables do not hold."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators.communities import by_community, levels, modularity
from tessera.operators.graph import components, retrieve
from tessera.operators.memory import IGNORABLE, decided, difference, judge, judged, only_ignorable, overlap, packed
from tessera.operators.relational import optional, visible_to
from tessera.functions.text import han_tokens
from tessera.operators import extraction
from tessera.operators.retrieval import Legs, fused, keyword_stages, nearest
from tessera.operators.text_rules import PREF, REQUIREMENT, candidates, chunks, expanded, marked, sentences
from tessera.operators.wiki import citations
from tessera.sources.checkpoints import ensure_folder
from tests.conftest import SF


def packed_chunks(text, target, overlap):
    """Sections, hard cuts and packing by plain loops."""
    out, at, sections = [], 0, []
    for raw in text.split("\n\n"):
        body = raw.strip()
        if body:
            start = at + len(raw[: len(raw) - len(raw.lstrip())].encode())
            if body.startswith("#") or not sections:
                sections.append([])
            k = 0
            while True:
                piece = body[k : k + target]
                sections[-1].append((start + len(body[:k].encode()), piece))
                if k + target >= len(body):
                    break
                k += target - overlap
        at += len(raw.encode()) + 2
    for pieces in sections:
        now = None
        for start, piece in pieces:
            if now and len(now[2]) + len(piece) + 2 > target:
                out.append(now)
                now = None
            end = start + len(piece.encode())
            now = (now[0], end, now[2] + "\n\n" + piece) if now else (start, end, piece)
        out.append(now)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab é\n# ", max_size=70), min_size=1, max_size=8))
def test_chunks(spark, parts):
    text = "\n\n".join(parts)
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = chunks(docs, 20, 5).orderBy("start", "end", "section").collect()
    assert [(r.start, r.end, r.text) for r in got] == sorted(packed_chunks(text, 20, 5))


def test_chunks_of_long_paragraphs(spark):
    docs = spark.createDataFrame([(1, "a" * 1700), (2, "# one\n\n" + "é" * 400 + "\n\n# two\n\nx"), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.start, r.end, len(r.text)) for r in chunks(docs).orderBy("doc_id", "start").collect()]
    assert got == [(1, 0, 800, 800), (1, 700, 1500, 800), (1, 1400, 1700, 300), (2, 0, 807, 407), (2, 809, 817, 8)]
    section = expanded(spark.createDataFrame([(1, 1)], "doc_id long, chunk long"), docs).collect()
    assert [(r.chunk, r.text) for r in section] == [(1, "a" * 1700)]


def test_sentences(spark):
    df = spark.createDataFrame([(1, "Version 1.2 is  out. 好的。真的！x"), (2, None), (3, "a; b\n\nlast")], "doc_id long, text string")
    assert [tuple(r) for r in sentences(df).orderBy("doc_id", "start").collect()] == [(1, 0, "Version 1.2 is out."), (1, 20, "好的。"), (1, 30, "真的！"), (3, 0, "a;"), (3, 6, "last")]


@pytest.mark.parametrize(
    ("text", "found"),
    [("I prefer tabs", True), ("他说他需要更多时间", False), ("如果需要的话我可以补", False), ("需要说明的是这个", False), ("she wrote “i like it” there", False), ('he "i like it"', False), ("> i like it", False), ("i don't always use it", False),
     ("用不用我的", True), ("never call it x, call it y", True), ("", False), ("不需要", False), ("要不要用它", False)],
)
def test_requirement_guards(spark, text, found):
    df = spark.createDataFrame([(text.lower(),)], "low string")
    assert df.select(marked("low", PREF, *REQUIREMENT)).first()[0] is found


def test_entity_and_relation_candidates(spark):
    text = "# 1. Query Planner (QP)\n\nThe Spark Engine is a `planner`. We run `x.py` on Spark Engine.\nSee [[Data Lake|lake]] and [[Data Lake]].\n知识图谱 和 知识图谱 和 知识图谱。\n## Notes\nHere `if` uses `planner`. Here `x.py` uses `planner`. Now `x.py` uses `planner`!"
    d = spark.createDataFrame([(1, text), (2, ""), (3, "One Two. One Two. One Two.")], "doc_id long, text string")
    e = extraction.entities(extraction.windowed(d))
    got = {(r.doc_id, r.name): (r.rule, r.kind, r.df) for r in e.collect()}
    assert got == {
        (1, "Query Planner (QP)"): ("heading_entity", "concept", 1), (1, "Data Lake"): ("wiki_link", "concept", 2), (1, "planner"): ("inline_code_identifier", "concept", 4), (1, "x.py"): ("inline_code_identifier", "tool", 3),
        (1, "Spark Engine"): ("proper_noun_phrase", "concept", 2), (1, "Engine"): ("proper_noun_phrase", "concept", 2), (1, "知识图谱"): ("chinese_term_run", "concept", 3),
    }
    r = {(x.src, x.relation, x.dst): x.support for x in extraction.relations(extraction.windowed(d), e).collect()}
    assert r == {("Spark Engine", "is_a", "planner"): 1, ("x.py", "uses", "planner"): 2}


def test_long_documents_end_at_a_blank_line(spark):
    long = "a" * 1000 + "\n\n" + "é" * extraction.MOST_TEXT
    d = spark.createDataFrame([(1, long), (2, "é" * extraction.MOST_TEXT), (3, "short"), (4, "x" + "é" * extraction.MOST_TEXT)], "doc_id long, text string")
    got = {r.doc_id: (len(r.text.encode()), r.skipped) for r in extraction.windowed(d).collect()}
    n = extraction.MOST_TEXT
    assert got == {1: (1002, 2 * n), 2: (n, n), 3: (5, 0), 4: (n - 1, n + 2)}


def test_memory_candidates(spark):
    turns = [(1, 0, "user", "I prefer tabs. Do you? 我觉得可能行。"), (1, 1, "assistant", "Note that it requires root."), (1, 2, "user", "No, actually we decided on docker."), (1, 3, "assistant", "A gotcha, maybe."), (1, 4, "user", "i prefer TABS"), (2, 0, "user", "Perfect."), (2, 1, "user", None)]
    got = {(r.conv_id, r.turn, r.rule): (r.store, r.confidence) for r in candidates(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {
        (1, 0, "user_preference"): ("profile", "unconfirmed"), (1, 0, "hedged_statement"): ("observation", "hedged"), (1, 2, "user_correction"): ("observation", "corrected"),
        (1, 2, "user_decision"): ("procedure", "unconfirmed"), (1, 3, "lesson_learned"): ("lesson", "hedged"), (2, 0, "user_preference"): ("profile", "confirmed"),
    }


def test_han_pairs(spark):
    df = spark.createDataFrame([("知识图谱 and 库",)], "t string")
    assert df.select(han_tokens(F.col("t"))).first()[0] == ["知识", "识图", "图谱", "and", "库"]


def test_citations(spark):
    df = spark.createDataFrame([(1, "intro\n## A\nx <!-- cite:doc/a#3 --> y\n## B\n<!-- cite:b#4 -->")], "page_id long, text string")
    assert [tuple(r) for r in citations(df).orderBy("chunk").collect()] == [(1, 1, "doc/a", 3), (1, 2, "b", 4)]


@pytest.mark.parametrize(
    ("old", "new", "verdict"),
    [("Use tabs.", "use TABS", "same"), ("use tabs", "please use tabs", "mergeable"), ("use tabs", "please use the tabs", "content"), ("use tabs", "never use tabs", "polarity"), ("use tabs", "use spaces", "content"), ("", "x", "empty"), (None, "", "same"),
     ("用户偏好使用简体中文交流。", "用户使用简体中文进行交流。", "mergeable"), ("用户偏好简体中文", "用户不使用简体中文", "polarity"), ("note it", "nothing", "content")],
)
def test_judge(old, new, verdict):
    assert judge(old, new) == verdict


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=25), st.text("abc", max_size=25))
def test_common_subsequences(x, y):
    """Lengths and differences as by the full table."""
    d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            d[i][j] = d[i + 1][j + 1] + 1 if x[i] == y[j] else max(d[i + 1][j], d[i][j + 1])
    out, j, shared = "", 0, ""
    for i, c in enumerate(x):
        if y[j : j + 1] == c or d[i][j] > d[i + 1][j]:
            j, shared = y.index(c, j) + 1, shared + c
        else:
            out += c
    assert overlap(x, y) == d[0][0] == len(shared) and difference(x, y) == out
    left = iter(y)
    assert all(c in left for c in shared)


@settings(max_examples=200, deadline=None)
@given(st.text("anduserthe我们", max_size=20))
def test_ignorable_words(text):
    """As taking out each word's first occurrence until there is none, one word after the other."""
    rest = text
    for w in IGNORABLE:
        while (at := rest.find(w)) >= 0:
            rest = rest[:at] + rest[at + len(w) :]
    assert only_ignorable(text) == (rest == "")


def test_difference_of_long_texts():
    """A quarter of a million characters, of which a few rows are kept at a time."""
    import tracemalloc

    x = "".join(f"{k * 7919 % 100003} " for k in range(50_000))
    x, y = x[:250_000], x[:100_000] + "new" + x[100_400:250_000]
    tracemalloc.start()
    assert len(difference(y, x)) >= 3 and len(difference(x, y)) >= 400
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_merge_decisions(spark):
    new = "please use tabs for go"
    rows_ = [(1, 10, 0.9, "use tabs for go", new), (1, 11, 0.99, "use spaces", new), (2, 12, 0.99, "xx", "use tabs"), (2, 13, 0.96, "use tags", "use tabs"), (3, 14, 0.99, "never use tabs", "use tabs"), (4, 15, 0.5, "abc", "def"), (5, 16, None, "Use it", "use it!")]
    got = {r.new: r for r in decided(judged(spark.createDataFrame(rows_, "row long, old_id long, cosine double, old string, new string")).withColumnRenamed("row", "new")).collect()}
    assert [(got[k].decision, got[k].rests_on) for k in range(1, 6)] == [("merge", 10), ("needs_judgement", 13), ("refused", 14), ("new", None), ("same", 16)]
    assert got[2].escalated_from == 12 and got[2].reason == "candidates=2 anchor=13 escalated_from=12 over_tau=12,13 polarity_refused=none rule=embedding_scope verdict=needs_judgement"


def test_context_budget(spark):
    items = [(1, k, tag, "2024-05-01" if k % 2 else "", text, k == 3) for k, (tag, text) in enumerate([("b", "x" * 30), ("a", " y "), ("b", "z" * 90), ("c", "low"), ("d", "w" * 300)])]
    d = spark.createDataFrame([*items, (2, 0, "a", None, None, False)], "query long, seq long, tag string, date string, content string, low boolean")
    got = {r["query"]: r for r in packed(d, 100, 210).collect()}
    assert got[1].context == "<b>\n" + "x" * 30 + "\n" + "z" * 69 + "\n... 22 chars cut\n</b>\n<a>\n[2024-05-01] y\n</a>\n<c>\n[unverified] [2024-05-01] low\n</c>\n(1 items left out)\n"
    assert (got[1].used_chars, got[1].dropped_items) == (len(got[1].context), 1) and got[2].context == "<a>\n\n</a>\n"


def retrieved(edges, seeds, hops, beam, most_paths, most_facts):
    """Evidence paths by plain loops, over current facts."""
    import math

    now = [e for e in edges if e[5] is None]
    rel = {r: sum(e[3] == r for e in now) for r in {e[3] for e in edges}}
    deg = {n: sum((e[1] == n) + (e[2] == n) for e in now) for n in {x for e in edges for x in e[1:3]}}
    weight = {e[0]: round(0.5 / (1 + math.log(1 + rel[e[3]])) / (1 + math.log(1 + deg[e[1]] + deg[e[2]])), 12) for e in now}
    out = {}
    for q in sorted({s[0] for s in seeds}):
        front, pool, cuts = [([n], [], s) for k, n, s in seeds if k == q], [], []
        key = lambda p: (-p[2], len(p[1]), p[0], p[1])
        for hop in range(1, hops + 1):
            grown = {}
            for nodes, path, score in front:
                for e in now:
                    if nodes[-1] in e[1:3]:
                        other = e[2] if e[1] == nodes[-1] else e[1]
                        if other not in nodes:
                            p = ([*nodes, other], [*path, e[0]], round(score * weight[e[0]], 12))
                            grown[tuple(p[1])] = min(grown.get(tuple(p[1]), p), p, key=key)
            level = sorted(grown.values(), key=key)
            if len(level) > beam:
                cuts.append("beam")
            front = level[:beam]
            pool += front
            if front and hop == hops:
                cuts.append("hops")
        pool.sort(key=key)
        why = "paths" if len(pool) > most_paths else cuts[0] if cuts else None
        used, kept = set(), []
        for p in pool[:most_paths]:
            if len(used | set(p[1])) > most_facts and kept:
                why = "facts"
                continue
            used |= set(p[1])
            kept.append(p)
        out |= {(q, k): (p[2], p[0], p[1], why) for k, p in enumerate(kept)}
    return out


@pytest.mark.parametrize(("hops", "beam", "most_paths", "most_facts"), [(3, 3, 5, 6), (2, 8, 12, 24), (3, 20, 30, 5), (1, 2, 9, 9)])
def test_beams(spark, hops, beam, most_paths, most_facts):
    import datetime as dt

    r = random.Random(hops)
    day = dt.datetime(2024, 1, 1)
    edges = [(k, f"n{r.randint(0, 9)}", f"m{r.randint(0, 9)}", r.choice("abc"), day, r.choice([None, None, None, day]), "extracted") for k in range(40)]
    seeds = [(1, "n1", 1.0), (1, "n2", 0.9), (2, "m3", 0.5), (3, "nowhere", 1.0)]
    graph = spark.createDataFrame(edges, "edge_id long, src string, dst string, relation string, valid_at timestamp_ntz, invalid_at timestamp_ntz, event_time_source string")
    got = retrieve(spark.createDataFrame(seeds, "query long, node string, score double"), graph, hops, beam, most_paths, most_facts).collect()
    assert {(x["query"], x["rank"]): (x.score, x.nodes, x.edges, x.cut) for x in got} == retrieved(edges, seeds, hops, beam, most_paths, most_facts)


def test_visibility(spark):
    df = spark.createDataFrame([("user",), ("project:a",), ("project:b",)], "ns string")
    assert {r.ns for r in df.filter(visible_to(F.col("ns"), "project:a")).collect()} == {"user", "project:a"}
    assert df.filter(visible_to(F.col("ns"), "global")).count() == 3
    assert optional(df, ns=None).count() == 3 and optional(df, ns="user").count() == 1


def test_fusion_needs_a_leg(spark):
    for bad in (Legs(w_semantic=0.0), Legs(w_keyword=float("nan")), Legs(w_semantic=float("inf")), Legs(keyword=False, w_keyword=float("nan"))):
        with pytest.raises(ValueError, match="weight"):
            bad.weights()
    assert Legs(keyword=False, w_keyword=-1.0).weights() == (2.0, 0.0) and Legs(keyword=False).disabled() == ["keyword"]
    assert Legs().label() == "rrf(k=60,w_sem=2,w_kw=1)"
    s = spark.createDataFrame([(1, 1, 0, 1.0), (1, 2, 1, 3.0)], "item_id long, doc_id long, rank long, distance double")
    k = spark.createDataFrame([(1, 2, 0, 5.0, "precision")], "item_id long, doc_id long, rank long, score double, stage string")
    got = {r.doc_id: (r.fused, r.relevance) for r in fused(s, k).collect()}
    assert got[2][0] > got[1][0] and got[1][1] == 0.5 and got[2][1] == 0.0
    alone = {r.doc_id: r.fused for r in fused(s, k, Legs(semantic=False)).collect()}
    assert set(alone) == {2} and alone[2] == round(1 / 61, 9)


def test_every_stage_of_the_ladder(spark):
    docs = spark.createDataFrame([(1, "the red fox runs"), (2, "red foxes run"), (3, "知识图谱很大"), (4, "图谱 and 知识"), (5, "underlying"), (6, None), (7, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "fox red"), (2, "fox blue"), (3, "识图谱"), (4, "derly"), (5, "zz qq"), (6, None), (7, "谱很"), (8, "ru")], "item_id long, text string")
    got = {}
    for r in keyword_stages(docs, items).collect():
        got.setdefault((r.item_id, r.stage), set()).add(r.doc_id)
    assert got == {(1, "precision"): {1}, (2, "prefix"): {1, 2}, (3, "bigram"): {3}, (4, "substring"): {5}, (7, "bigram"): {3}}


def test_pages_begin_alike(spark):
    """The first ten hits are the same however long the page is."""
    from tessera.operators.retrieval import search

    short, long = ({(r.item_id, r.rank): r.doc_id for r in search(spark, SF, n).collect()} for n in (5, 30))
    assert short == {k: v for k, v in long.items() if k[1] < 5} and short


def test_nearest_skips_other_lengths_and_keeps_ties(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0]), (5, None), (6, [0.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [0.0, 1.0]), (8, [1.0]), (9, None)], "item_id long, q array<float>")
    assert [(r.item_id, r.vec_id, r.value) for r in nearest(v, q, 2).orderBy("item_id", "rank").collect()] == [(7, 1, 0.0), (7, 2, 0.0), (8, 4, 0.0)]
    assert {(r.item_id, r.vec_id) for r in nearest(v, q, 9, cosine=True, floor=0.5).collect()} == {(7, 1), (7, 2), (8, 4)}


def test_components_and_communities(spark):
    ensure_folder(spark)
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(30, 31)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert {got[k] for k in range(1, 21)} == {1} and got[31] == 30
    two = [(f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(5) for j in range(i)] + [("x0", "y0")]
    found = levels(spark.createDataFrame([*two, ("z1", "z2")], "a string, b string"), 12, 1)
    by = {r.node: r.community for r in found.filter("level = 0").collect()}
    assert {by[f"x{k}"] for k in range(1, 5)}.isdisjoint({by[f"y{k}"] for k in range(1, 5)}) and by["z2"] == by["z1"] == "z1"


@pytest.mark.parametrize("n, groups, parts", [(60, 4, 1), (200, 8, 5)])
def test_levels_against_brute_force(spark, n, groups, parts):
    """Every level is a partition whose communities lie in one of the next, modularity as counted by hand never falls, and planted groups are found."""
    r = random.Random(n)
    links = {(min(a, b), max(a, b)) for a in range(n) for b in r.sample(range(n), 14) if a != b and (a % groups == b % groups or r.random() < 0.02)} | {(n + k, n + k + 1) for k in range(3)}
    df = spark.createDataFrame([*links, (5, 5), *list(links)[:9]], "a long, b long").repartition(parts)
    frame = levels(df)
    found = [(x.level, x.node, x.component, x.community, x.parent, x.k, x.k_in) for x in frame.collect()]
    degree = {v: sum(v in e for e in links) for e in links for v in e}
    top, last = max(x[0] for x in found), -1.0
    qs = {x.level: x.q for x in modularity(frame).collect()}
    for level in range(top + 1):
        own = {x[1]: x for x in found if x[0] == level}
        assert set(own) == set(degree) and all(x[5] == degree[v] for v, x in own.items())
        assert all(x[6] == sum(own[b][3] == x[3] for a, b in [*links, *((b, a) for a, b in links)] if a == v) for v, x in own.items())
        groups_of = {}
        for v, x in own.items():
            groups_of.setdefault(x[3], set()).add(v)
        assert all(min(c) == k for k, c in groups_of.items())
        q = 0.0
        for c in groups_of.values():
            m2 = sum(degree[v] for v in own if own[v][2] == own[min(c)][2])
            q += sum(own[v][6] for v in c) - sum(degree[v] for v in c) ** 2 / m2
        assert q >= last - 1e-6 and abs(q - qs[level]) < 1e-4
        last = q
        if level < top:
            assert all(x[4] == next(y[3] for y in found if y[0] == level + 1 and y[1] == v) for v, x in own.items())
    assert {x[3] for x in found if x[1] >= n} == {n}
    best = [x for x in found if x[0] == top and x[1] < n]
    pure = sum(max(sum(y[1] % groups == g for y in best if y[3] == c) for g in range(groups)) for c in {x[3] for x in best})
    assert pure > 0.8 * len(best)
    assert by_community(frame).agg(F.sum("n_nodes")).first()[0] == len(found)


def test_hashes(spark):
    from tessera.functions.hashing import embedder, fact_hash, fnv1a

    assert fnv1a([b"", b"a", b"foobar"]).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    df = spark.createDataFrame([("A  b\nB",), (None,), ("--",)], "t string")
    got = df.select(embedder(8)(F.col("t")).alias("v"), fact_hash("t").alias("h")).collect()
    assert abs(sum(x * x for x in got[0].v) - 1) < 1e-6 and not any(got[1].v) and not any(got[2].v)
    assert got[0].h == f"{int(fnv1a([b'a b b'])[0]):016x}"


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_keys_are_keys(spark, sf):
    from tessera.sources.tables import facts, memories

    for rows_, key in ((facts, "edge_id"), (memories, "memory_id")):
        ids = rows_(spark, f"/root/testdata/sf{sf}").select(key)
        assert ids.count() == ids.distinct().count() > 0


def greedy(sizes, budget):
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        more = held + n + (2 if held else 0)
        if i > start and more > budget:
            start, more = i, n
            out.append(i)
        held = more
    return [0, *out]


@pytest.mark.parametrize("budget", [1, 50, 200, 10_000])
def test_turn_windows(spark, budget):
    """Equal to packing turn by turn: empty conversations of one turn, turns beyond the budget, long conversations, repeated sizes."""
    from tessera.operators.windows import windows

    r = random.Random(budget)
    convs = {c: [r.choice([1, 7, 48, 49, 50, 51, 199, 300]) for _ in range(n)] for c, n in enumerate([1, 2, 3, 40, 700])}
    df = spark.createDataFrame([(c, 3 * k, n) for c, sizes in convs.items() for k, n in enumerate(sizes)], "conv long, turn long, bytes long").repartition(5)
    got = {}
    for x in windows(df, budget).collect():
        got.setdefault(x.conv, {}).setdefault(x.window, []).append(x.turn // 3)
    for c, sizes in convs.items():
        begins = greedy(sizes, budget)
        assert [sorted(v) for _, v in sorted(got[c].items())] == [list(range(a, b)) for a, b in zip(begins, [*begins[1:], len(sizes)], strict=True)]
        assert all(len(v) == 1 or sum(sizes[k] for k in v) + 2 * (len(v) - 1) <= budget for v in got[c].values())


def test_answers_are_read_tolerantly(spark):
    from tessera.operators.windows import parsed

    cases = {
        'Sure:\n```json\n{"candidates": [{"store": "profile", "content": "a } b", "confidence": 0.9}], "relations": []}\n```': ("parsed", ["a } b"]),
        '{"candidates": [{"content": "x"}]}': ("parsed", ["x"]), "{}": ("parsed", None), "nothing": ("no json", None), "": ("no json", None), None: ("no json", None),
        '{"candidates": [{"content": "cut': ("no closing brace", None), '{"candidates": [{"content": "cut"}': ("malformed", None), '{"candidates": "text"}': ("parsed", None), "} {": ("no closing brace", None), "{}, {}": ("malformed", None), "{} ] [ {}": ("malformed", None), "{} and {}": ("malformed", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {x.raw: (x.p.status, [c.content for c in x.p.value.candidates] if x.p.value and x.p.value.candidates else None) for x in df.select("raw", parsed(F.col("raw")).alias("p")).collect()}
    assert got == cases


@pytest.mark.parametrize("whole, low", [(False, False), (True, False), (False, True), (True, True)])
def test_names_in_texts(spark, monkeypatch, whole, low):
    """Equal to looking for every name in every text, also in many blocks and slices; names inside names, shared names, Han, empty and null ones."""
    from tessera.operators import containment

    if low:
        monkeypatch.setattr(containment, "NAME_BYTES", 8)
        monkeypatch.setattr(containment, "TEXT_BYTES", 40)
    names = [(1, "red"), (2, "red car"), (3, "car"), (4, "red"), (5, "数据"), (6, ""), (7, None), (8, "a"), (9, "C++"), (10, "aa")]
    texts = [(1, "a red car"), (2, "redcar, car"), (3, "大数据库"), (4, None), (5, ""), (6, "aaa c++ C++"), (7, "scared"), (8, "red"), (8, "红 red-car 数据")]
    edge = lambda c: c.isalnum()
    want = set()
    for q, t in texts:
        for i, n in names:
            at = [k for k in range(len(t)) if t.startswith(n, k)] if t and n else []
            if any(not whole or not (edge(t[k - 1 : k]) or edge(t[k + len(n) : k + len(n) + 1])) for k in (at[:1] if whole else at)):
                want.add((q, i))
    found = containment.contained(spark.createDataFrame(texts, "query long, text string"), spark.createDataFrame(names, "id long, name string"), whole).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
