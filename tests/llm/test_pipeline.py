"""The pipeline's stages on the smallest tables, each against a brute-force version."""

from __future__ import annotations

import hashlib
import re

import corpus_pipeline as P
from tests.conftest import SF
from tests.llm.test_operators import WORD, brute_classes

from tessera.llm import quality_rules
from tessera.llm.queries import vocabulary


def brute_dedup(rows):
    """Texts without the words of 13-word windows that also start in a smaller doc_id; those without words left are gone."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first: dict = {}
    for i, w in words.items():
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words[i]
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        if len(gone) < len(w) or not w:
            out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    return out


def shares(part: list[str], doc: list[str], n: int = 5) -> float:
    n = min(n, len(part))
    held = {tuple(doc[k : k + n]) for k in range(len(doc) - n + 1)}
    grams = [tuple(part[k : k + n]) for k in range(len(part) - n + 1)] if n else []
    return sum(g in held for g in grams) / len(grams) if grams else 1.0


def test_stages_against_brute_force(spark, duck, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns == (first.columns if k < len(P.STAGES) - 1 else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    texts = lambda name: {r.doc_id: r.text for r in kept[name]}

    assert set(texts("quality_rules")) == {r[0] for r in duck.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
    assert set(texts("near_dedup")) == set(brute_classes([(r.doc_id, r.text) for r in kept["quality_rules"]]).values())
    assert texts("substring_dedup") == brute_dedup([(r.doc_id, r.text) for r in kept["near_dedup"]])
    assert all(r.n_chars == len(r.text) for r in kept["substring_dedup"])
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [r[0] for r in duck.sql("SELECT text FROM benchmark WHERE text IS NOT NULL").fetchall()]
    parts = [m.groups() if (m := re.match(r"(?s)^(.*[.!?])\s+(\S.*)$", t)) else (t, "") for t in items]
    left = set(texts("decontamination"))
    for r in kept["substring_dedup"]:
        w = words(r.text)
        whole = " ".join(w)
        if any(words(t) and f" {' '.join(words(t))} " in f" {whole} " for t in items):
            assert r.doc_id not in left
        elif not any(shares(words(q), w) >= 0.5 and shares(words(a), w) >= 0.5 for q, a in parts):
            assert r.doc_id in left
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    for r, d in zip(sorted(kept["bpe"]), sorted(kept["decontamination"], key=lambda d: d.doc_id), strict=True):
        ids = t.encode(d.text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rows_without_id_and_repeats(spark):
    """Leaked rows go by id and text, and of repeated rows one stays."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, item), (None, "clean " * 3), (1, item), (1, "clean text of the same id"), (2, None)]
    d = spark.createDataFrame([(i, t, "en", "h", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = P.decontaminated(spark, d, SF).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == [("1", "clean text of the same id"), ("2", ""), ("None", "clean " * 3)]
    assert P.one_of_each(spark, d.unionByName(d), SF).count() == 4


def test_run_gives_the_last_stage(spark):
    assert P.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
