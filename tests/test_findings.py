"""Inputs on which a query once gave other rows than its SQL, or took more than it may."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tessera.operators import containment, extraction, records, retrieval
from tessera.operators.retrieval import closest
from tessera.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import rows


def same(spark, folder, name, **tables):
    """The rows of a query and of its SQL over the given tables."""
    import duckdb

    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert rows(QUERIES[name](spark, str(folder)).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())


def talks(*turns):
    names = ("conv_id", "turn", "role", "text")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return {n: pa.array([t[k] for t in turns], kinds[k]) for k, n in enumerate(names)}


def test_f4_words_end_at_letters_beyond_ascii(spark, tmp_path):
    texts = ["Yes\u00f3asga", "\u00e9might", "yes_", "x yes", "yes1", "MAYBE.", None, ""]
    same(spark, tmp_path, "confidence_levels", conversations=talks(*((1, k, "user", t) for k, t in enumerate(texts))))


def test_f5_tails_count_the_whole_text_up_to_their_bound(spark, tmp_path):
    turns = [(c, k, "user" if k else None, "x" * n) for c, n in ((1, 749), (2, 750), (3, 751), (4, 900), (5, 10)) for k in (0, 1)]
    same(spark, tmp_path, "transcript_tails", conversations=talks(*turns, (6, 0, "user", None), (7, 0, "user", "a"), (7, 1, None, None), (8, 0, "user", "")))


def test_f1_coarse_buckets_are_split_in_their_task(spark, monkeypatch):
    """More buckets than payloads need no second exchange of all bodies, and give what few buckets give."""
    from tessera.llm import repeats, substring_dedup, suffix_array_dedup

    texts = [(k, " ".join(str((k // 3 * 5 + n) % 97) for n in range(40 + k * 7))) for k in range(40)] + [(50, None), (51, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    digests = lambda: [sorted(map(tuple, op.digest(d).collect())) for op in (substring_dedup, suffix_array_dedup)]
    want = digests()
    cuts, real = [], repeats.cut
    monkeypatch.setattr(repeats, "cut", lambda df: cuts.append(df.columns) or real(df))
    size = sum(len(t or "") for _, t in texts)
    for name, value in {"COARSE": 4, "FEWEST": 2, "BUCKET_BYTES": size // 8}.items():
        monkeypatch.setattr(repeats, name, value, raising=False)
    assert digests() == want
    assert not [c for c in cuts if "payload" in c]


@pytest.mark.parametrize("cosine", [True, False])
def test_f6_products_of_many_queries_stay_small(cosine):
    r = np.random.default_rng(3)
    q, x = r.normal(size=(4096, 16)), r.normal(size=(10_000, 16))
    x[5000:] = x[0]
    tracemalloc.start()
    got = list(closest(q, (q * q).sum(axis=1), x, (x * x).sum(axis=1), 4, cosine))
    assert tracemalloc.get_traced_memory()[1] < 600 << 20
    tracemalloc.stop()
    item, row, value = (np.concatenate(c) for c in zip(*got, strict=True))
    for k in (0, 1000, 4095):
        want = -(x @ q[k]) / np.sqrt((x * x).sum(axis=1) * (q[k] @ q[k])) if cosine else ((x - q[k]) ** 2).sum(axis=1)
        mine = value[item == k]
        assert np.allclose(np.sort(-mine if cosine else mine)[:4], np.sort(want)[:4])
        assert set(np.argsort(want, kind="stable")[:4]) <= set(row[item == k])


def test_f8_f9_f10_f13_sums_of_scores_are_dealt_by_their_rows(spark, monkeypatch):
    """More scored rows take more tasks, with the same scores."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + n) % 11}" for n in range(k % 9))) for k in range(60)], "doc_id long, text string")
    queries = retrieval.query_terms(spark.createDataFrame([(k, f"w{k} w{k + 1} zz") for k in range(6)], "item_id long, text string"))
    want = sorted(map(tuple, retrieval.bm25(docs, queries).collect()))
    monkeypatch.setattr(retrieval, "SCORED_ROWS", 20, raising=False)
    dealt, real = [], DataFrame.repartition
    monkeypatch.setattr(type(docs), "repartition", lambda df, *a: dealt.append(a) or real(df, *a))
    got = retrieval.bm25(docs, queries)
    assert sorted(map(tuple, got.collect())) == want and want
    assert [a[1] for a in dealt] == ["doc_id"] and dealt[0][0] > 4


def test_f7_names_meet_the_first_pages_of_an_entity_only(spark):
    """An entity of every page makes as many rows with a name as the name may have pages."""
    names = spark.createDataFrame([("red car",), ("car",), ("blue",)], "name string")
    held = [(p, "car") for p in range(100, 400)] + [(p, "old red car") for p in (7, 250, 3)] + [(500, "red"), (501, "sky blue")]
    found = containment.related(names, spark.createDataFrame(held, "page_id long, entity string"))
    assert sorted(map(tuple, found.collect())) == [("blue", 501), ("car", 3), ("car", 7), ("car", 100), ("red car", 3), ("red car", 7), ("red car", 100)]
    assert str(found._jdf.queryExecution().optimizedPlan()).count("Window [") == 2


@pytest.fixture
def plans(monkeypatch):
    """The physical plans of all that the loops over graphs write."""
    from tessera.operators import communities, graph

    seen = []
    for module, name in ((communities, "written"), (graph, "cut")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, real=real: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    return seen


def test_f14_f22_components_broadcast_no_labels(spark, plans):
    from tessera.operators.graph import components

    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(60, 61), (61, 61)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {60: 60, 61: 60}
    assert plans and not [p for p in plans if "Broadcast" in p]


def test_f2_f3_f11_a_round_deals_the_links_once(spark, plans):
    from tessera.operators.communities import levels

    links = [(f"{g}{i}", f"{g}{j}") for g in "xyz" for i in range(6) for j in range(i)] + [("x0", "y0"), ("y1", "z1")]
    found = levels(spark.createDataFrame(links, "a string, b string"))
    assert found.filter("level = 0").count() == 18
    assert plans and not [p for p in plans if "Broadcast" in p or "SortMergeJoin" in p]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_f20_what_a_hop_meets_is_dealt_by_its_rows(spark, monkeypatch):
    from tessera.operators import graph

    links = spark.createDataFrame([(a, b) for a in range(8) for b in range(8, 14)] + [(b, a) for a in range(8) for b in range(8, 14)], "a long, b long")
    monkeypatch.setattr(graph, "TASK_MET", 4, raising=False)
    dealt, real = [], DataFrame.repartition
    monkeypatch.setattr(type(links), "repartition", lambda df, *a: dealt.append(a) or real(df, *a))
    found = graph.within(spark.createDataFrame([(0,), (9,)], "seed long"), links, 2)
    want = {(0, n, 1) for n in range(8, 14)} | {(0, n, 2) for n in range(1, 8)} | {(9, n, 1) for n in range(8)} | {(9, n, 2) for n in range(8, 14) if n != 9}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert dealt == [(4, "seed", "node"), (24, "seed", "node")]


def test_f16_equal_texts_are_looked_up_once_and_empty_ones_too(spark, tmp_path, monkeypatch):
    """Copies of a part ask the same, so they add nothing to what meets the entities; a text without terms is held by every entity."""
    names = ["red bolt", "red nut", "", "--", None, "tin ring"]
    part = {"p_partkey": pa.array([20 * (k // 2) + k % 2 for k in range(240)], pa.int64()), "p_name": pa.array([names[k % 6] for k in range(240)], pa.string()), "p_brand": pa.array([f"Brand#{k % 3}" for k in range(240)]), "p_type": pa.array([["SMALL", "red"][k // 6 % 2] for k in range(240)])}
    met, real = [], DataFrame.groupBy
    monkeypatch.setattr(DataFrame, "groupBy", lambda self, *c: met.append(self.count()) or real(self, *c) if "id" in [x for x in c if isinstance(x, str)] else real(self, *c))
    same(spark, tmp_path, "entity_search", part=part)
    assert met[0] <= 12 * 12


def test_f23_edges_are_folded_in_as_many_parts_as_their_writes_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "TASK_EDGES", 10, raising=False)
    lines = [(k % 23 if k % 11 else None, k % 7 if k % 13 else None, k % 8 if k % 9 else None) for k in range(400)]
    columns = {n: pa.array([x[c] for x in lines], pa.int64()) for c, n in enumerate(("l_orderkey", "l_partkey", "l_linenumber"))}
    same(spark, tmp_path, "task_edge_upsert", lineitem=columns)
    assert QUERIES["task_edge_upsert"](spark, str(tmp_path)).rdd.getNumPartitions() == 40


def test_f15_f17_f19_texts_are_split_once_for_all_rules(spark, monkeypatch):
    """Entities and relations share one split of the texts, and it gives the sentences and headings that single rules would."""
    import re

    blank = "\\s\x0b\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    lines = ["# One. Two", "#", "###", "a # b", " ## Tool X: a  b!# no", "\t# `x`", "#x", "#\u00a0x", "###\u0085", "x. # y", "Alpha Beta uses Gamma. (Alpha Beta) \u00a0 \u2003uses Gamma", "\u3000z\u3000\u3000z", "\"Alpha\" Beta, \u00c9a", "", "run `a.py` [[B c]] B\u1680\u1680d"]
    texts = [(k, "\n".join(lines[(k * 7 + n * (k % 3 + 1)) % len(lines)] for n in range(9)) + "\n" * (k % 2)) for k in range(30)]
    calls, real = [], extraction.pieces
    monkeypatch.setattr(extraction, "pieces", lambda d: calls.append(1) or real(d))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    s = extraction.seen(d)
    extraction.relations(d, extraction.entities(d, s), s).collect()
    assert calls == [1]
    want = []
    for k, text in texts:
        starts, at = set(), 0
        for line in text.split("\n"):
            if re.match(r"[ \t\n\x0b\f\r]*#{1,6}([ \t\n\x0b\f\r]|\x85?$)", line):
                starts.add(at)
            at += len(line.encode()) + 1
        at = 0
        for raw in re.sub(rf"([!?\u3002\uff01\uff1f\n]|[.;](?=[{blank}]))", "\\1\x01", text).split("\x01"):
            sentence = re.sub(f"[{blank}]+", " ", raw).strip(" ")
            if len(sentence) >= 2:
                want.append((k, at, sentence, at in starts))
            at += len(raw.encode())
    assert sorted(map(tuple, s.select("doc_id", "at", "sentence", "in_heading").collect())) == sorted(want)


def test_f12_f18_whole_items_are_scored_by_their_rarest_term_only(spark, monkeypatch):
    words = ["the", "red", "bolt", "redder", "boltless", "tin"]
    texts = [(k if k % 17 else None, " ".join(words[(k * m) % 6] for m in range(1, k % 5 + 1))) for k in range(60)]
    items = spark.createDataFrame([(1, "the red"), (2, "bolt the the"), (3, "tin missing"), (4, ""), (5, "bol re")], "item_id long, text string")
    held = retrieval.query_terms(items)
    size = held.groupBy("item_id").count()
    for more in ([], [(5, "the the red the"), (5, "red")]):
        sized = retrieval.tokens(spark.createDataFrame(texts + more, "doc_id long, text string"))
        hits = retrieval.term_hits(sized, held)
        full = retrieval.scored(hits, held).join(size, "item_id").filter("n_terms = count").drop("count")
        assert sorted(map(str, retrieval.scored(hits, held, whole=True).select(full.columns).collect())) == sorted(map(str, full.collect()))
        by_word = sorted(map(str, retrieval.term_hits(sized, held, prefix=True).collect()))
        with monkeypatch.context() as m:
            m.setattr(retrieval, "MOST_HEADS", 0)
            assert sorted(map(str, retrieval.term_hits(sized, held, prefix=True).collect())) == by_word


def test_f21_a_key_takes_few_calls_to_its_state():
    """Every call to the state store is a round trip, which costs more than the rows of a key."""
    from tessera.streaming.events import LEGAL
    from tessera.streaming.runs import IDLE, Machine

    calls: list[str] = []

    class State:
        value = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("update", "put"):
                    self.value = args[0]
                if name == "clear":
                    self.value = None
                return {"get": self.value, "exists": self.value is not None}.get(name)

            return call

    class Handle:
        getValueState = getListState = lambda self, *a: State()  # noqa: E731, N815
        registerTimer = deleteTimer = lambda self, at: calls.append("timer")  # noqa: E731, N815

    m = Machine(LEGAL, IDLE)
    m.init(Handle())
    assert list(m.advanced(("a",), [(5_000_000, 1, "view"), (6_000_000, 2, "click")], 0)) == []
    assert calls == ["get", "timer", "update"]
    out = list(m.advanced(("a",), [], 10**9, expired=True))
    assert out[0].values.tolist() == [["a", 5_000_000, 6_000_000 + IDLE, "click", 2, 0]]
    assert calls[3:] == ["get", "clear"]


def planted(n, groups, seed, prefix=""):
    """Links of a graph with planted groups."""
    import random

    r = random.Random(seed)
    links = {(min(a, b), max(a, b)) for a in range(n) for b in r.sample(range(n), 8) if a != b and (a % groups == b % groups or r.random() < 0.1)}
    return [(f"{prefix}{a}", f"{prefix}{b}") for a, b in sorted(links)]


def test_f1_f2_f3_components_go_by_themselves_and_leave_one_table(spark, monkeypatch):
    """A component has the same communities alone, beside others, in one task and over all; what a step wrote goes when it was read."""
    import os

    from tessera.operators import communities
    from tessera.sources.checkpoints import ensure_folder

    ensure_folder(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    rounds = lambda: {f for f in os.listdir(folder) if f.startswith("rounds-")}
    graphs = [planted(120, 5, 1, "x"), planted(90, 3, 2, "y"), [("z1", "z2"), ("z2", "z3"), ("z3", "z3")]]
    get = lambda links, *a: sorted((r.level, r.node, r.component, r.community, r.k, r.k_in, r.parent or "") for r in communities.levels(spark.createDataFrame(links, "a string, b string"), *a).collect())
    before = rounds()
    both = get([x for g in graphs for x in g])
    assert len(rounds() - before) == 1
    top = max(r[0] for r in both)
    assert top > 0 and len(both) == (top + 1) * len({v for g in graphs for x in g for v in x})
    alone, members = get(graphs[1]), {v for x in graphs[1] for v in x}
    mine = [r for r in both if r[1] in members]
    assert [r[:6] for r in mine if r[0] <= alone[-1][0]] == [r[:6] for r in alone]
    want = get(graphs[0], 4, 2)
    monkeypatch.setattr(communities, "LOCAL_LINKS", 0)
    assert get(graphs[0], 4, 2) == want


def test_f1_f2_f3_whole_components_are_solved_however_their_rows_come(monkeypatch):
    import random

    from tessera.operators import moves

    rows, r = [], random.Random(3)
    for c, n in enumerate([30, 3, 50, 2, 40, 9]):
        links = {(c * 1000 + min(a, b), c * 1000 + max(a, b)) for a in range(n) for b in (a + 1, a * 7 % n) if a != b < n}
        rows += [(c * 1000, a, None, f"n{a}", " ".join(str(r.randrange(512)) for _ in range(9))) for a in sorted({v for x in links for v in x})] + [(c * 1000, a, b, None, None) for a, b in sorted(links)]
    names = ["component", "a", "b", "name", "bits"]
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)], names)
    want = moves.solved(table, 8, 3).to_pylist()
    assert len(want) == 134 and {len(x["of"]) for x in want} > {1}
    for size, bundle in ((1, 1), (7, 20), (64, 100), (500, 1)):
        monkeypatch.setattr(moves, "BUNDLE", bundle)
        got = [x for b in moves.bundles(8, 3)(iter(table.to_batches(size))) for x in b.to_pylist()]
        assert got == want


def test_f4_relations_use_whole_texts_and_all_their_names(spark, tmp_path):
    """What stands behind the first 256 KB counts, and so do names that 96 others of a text outdo."""
    long = "Filler words, nothing else.\n" * 11_000
    assert len(long) > extraction.MOST_TEXT
    many = " ".join(f"See [[Name {k}]] here." for k in range(120) for _ in range(4))
    texts = [long + "\n\nAlso `zeta` uses `x9.py`. Again `zeta` uses `x9.py`.", many, "short", ""]
    same(spark, tmp_path, "graph_ingest", documents={"doc_id": pa.array([1, 2, 3, 4], pa.int64()), "text": texts})
    found = {(r.doc_id, r.src, r.relation, r.dst): r.support for r in QUERIES["relation_pairs"](spark, str(tmp_path)).collect()}
    assert found[1, "zeta", "uses", "x9.py"] == 2 and found[2, "tool_2", "uses", "x2.py"] == 2


def test_f4_sides_of_connectors_meet_names_by_their_ends(spark):
    """Sides are no longer than names, and of cuts with equal ends each sentence counts."""
    pad = "so " * 80
    text = f"{pad}`alpha` uses (`beta`) {pad}. {pad}`alpha` uses `beta` and `alpha` uses `beta` {pad}. The beta uses an alpha"
    d = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    names = spark.createDataFrame([(1, "alpha"), (1, "beta"), (1, "lpha"), (1, "be"), (2, "gamma")], "doc_id long, name string")
    got = {(r.doc_id, r.src, r.relation, r.dst): r.support for r in extraction.relations(d, names).collect()}
    assert got == {(1, "alpha", "uses", "beta"): 2}
