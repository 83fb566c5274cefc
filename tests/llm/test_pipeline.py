"""The pipeline's stages, each against a plain-Python version on its own input."""

import re

import public_tokenizers as P
from llm_fixtures import SF_SMALL, edge_docs, no_docs  # noqa: F401
from test_decontam import brute as contaminated
from test_neardup import brute as components
from test_secrets import brute as secret_spans
from tokenizers import Tokenizer

import corpus_pipeline as C
from rollbook.llm.common import stored


def test_stages(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    source = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in C.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "secret_scan", "bpe_encoding"]
    out = {}
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), name)
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out[name] = docs.collect()
    text = lambda rows: [(r["doc_id"], r["text"]) for r in rows]
    assert len(out["language_id"]) >= 0.95 * len(source) and all(r["text"] == source[r["doc_id"]]["text"] for r in out["language_id"])
    kept = {int(c[0]) for c in components(text(out["language_id"]), 80, 5) if c[3]}
    assert sorted(r["doc_id"] for r in out["near_duplicates"]) == sorted(kept)
    clean = [(i, t) for i, t in text(out["near_duplicates"]) if not contaminated(t, items)[1]]
    assert sorted(text(out["decontamination"])) == sorted(clean)

    def masked(t):
        spans, at, done = sorted((a, b) for a, _, _, b in secret_spans(t)), 0, ""
        for a, b in spans:
            if b > at:
                done, at = done + (t[at:a] + "[SECRET]" if a >= at else ""), b
        return done + t[at:]

    assert sorted(text(out["secret_scan"])) == sorted((i, masked(t)) for i, t in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in out["secret_scan"])
    assert not any(re.search(r"AKIA[A-Z0-9]{16}", r["text"]) for r in out["secret_scan"])
    final = {r["doc_id"]: r for r in out["bpe_encoding"]}
    assert sorted(final) == sorted(r["doc_id"] for r in out["secret_scan"])
    for r in out["secret_scan"]:
        assert final[r["doc_id"]]["ids"] == library.encode(r["text"], add_special_tokens=False).ids


def test_run_on_an_empty_table(spark, no_docs, monkeypatch):
    monkeypatch.setattr(C, "documents", lambda s, d: no_docs)
    assert C.run(spark, SF_SMALL).collect() == []


def test_run_on_awkward_rows(spark, edge_docs, monkeypatch):
    monkeypatch.setattr(C, "documents", lambda s, d: edge_docs)
    got = sorted(str(r["doc_id"]) for r in C.run(spark, SF_SMALL).collect())
    assert "1" not in got and "2" not in got and "6" not in got and "0" in got
