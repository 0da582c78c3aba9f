"""The read tools with their parameters."""

from __future__ import annotations

import hashlib

import pytest
from tests.conftest import SF

from tessera.operators.retrieval import Legs
from tessera.plans import tools


def test_memory_tools(spark):
    first = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").first()
    got = tools.memory_search(spark, SF, first.text, reader="global").collect()
    assert got[0].memory_id == first.conv_id * 100 + first.turn and set(got[0].legs) == {"keyword", "semantic"}
    assert tools.memory_get(spark, SF, first.conv_id * 100 + first.turn).first().content == first.text
    assert tools.memory_rows(spark, SF, store="observation", limit=3).count() == 3
    report = {r.surface: r.n for r in tools.memory_forget_report(spark, SF, hashlib.sha256(first.text.encode()).hexdigest()).collect()}
    assert report["memories"] >= 1 and report["backups"] is None
    stubs = tools.memory_recall(spark, SF, first.text, "conservative").collect()
    assert {r.section for r in stubs} == {"memory", "knowledge"} and all(len(r.text) <= 80 for r in stubs)
    with pytest.raises(ValueError, match="strategy"):
        tools.memory_recall(spark, SF, "x", "wild")
    assert tools.context(spark, SF, first.text).first().used_chars <= 4096


def test_knowledge_tools(spark):
    doc = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 300").orderBy("doc_id").first()
    got = tools.knowledge_search(spark, SF, doc.text[:200]).collect()
    assert doc.doc_id in {r.doc_id for r in got} and got[0].fusion == "rrf(k=60,w_sem=2,w_kw=1)"
    assert tools.knowledge_search(spark, SF, "x", legs=Legs(semantic=False, keyword=False)).count() == 0
    assert tools.knowledge_search(spark, SF, doc.text[:200], legs=Legs(semantic=False)).filter("relevance is not null").count() == 0
    assert tools.knowledge_expand(spark, SF, doc.doc_id, 0).first().text == doc.text.strip()
    assert [r.chunk for r in tools.knowledge_ingest(spark, 1, "# a\n\nb\n\n# c").orderBy("start").collect()] == [0, 0]


def test_graph_tools(spark):
    assert tools.graph_entity(spark, SF, "s1").filter("depth = 1").count() > 0
    assert tools.graph_search(spark, SF, "small ring ECONOMY").first() is not None
    paths = tools.graph_retrieve(spark, SF, ["s1"], hops=9).collect()
    assert 0 < len(paths) <= 12 and max(r.hops for r in paths) <= 3


def test_record_tools(spark):
    assert tools.list_tasks(spark, SF, "running", 5, 5).count() == 5
    assert tools.run_get(spark, SF, 3).count() == 1 and tools.agents_list(spark, SF).count() > 0
    assert tools.routing_show(spark, SF).filter("source = 'pin'").count() > 0
    assert tools.pending_pairs(spark, SF).count() > 0 and tools.distill_status(spark, SF, 3).count() > 0
    assert tools.wiki_pages(spark, SF).filter("n_problems > 0").count() > 0 and tools.wiki_links(spark, SF).count() > 0
    assert tools.distill_session(spark, SF, 0).columns == ["conv_id", "turn", "rule", "store", "confidence", "content"]
