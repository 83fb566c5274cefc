"""Sharding: the law, groups, slots, and packing against a plain loop."""

import zlib
from collections import defaultdict

import numpy as np
from llm_fixtures import SF_MID, edge_docs, no_docs  # noqa: F401

from rollbook.llm import sharding as S


def test_law_and_slots(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = S.shard(docs, 40).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    load, slots = defaultdict(int), defaultdict(list)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(load) == list(range(40))
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 40
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for measure in (lambda r: r["tokens"], lambda r: 1):  # the other two measures stay balanced
        of = defaultdict(int)
        for r in got:
            of[r["shard"]] += measure(r)
        assert max(of.values()) - min(of.values()) <= 0.25 * sum(of.values()) / 40


def test_tokens_hold_for_any_script(spark):
    rows = [(1, "plain words here"), (2, "日本語の文章です"), (3, "a" * 60), (4, "x=1234;"), (5, ""), (6, None)]
    got = {r["doc_id"]: r["tokens"] for r in S.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == {1: 3, 2: 8, 3: 10, 4: 5, 5: 0, 6: 0}


def test_a_group_that_fits_stays_whole(spark):
    """Half a shard of rows with one text: not dealt out, whatever its size against the others."""
    rows = [(k, "the very same text") for k in range(40)] + [(100 + k, f"another text {k:04d}!") for k in range(280)]
    got = S.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()
    assert len({r["shard"] for r in got if r["doc_id"] < 100}) == 1


def test_equal_texts_stay_together_unless_very_many(spark):
    few = [(k, f"text {k // 3} " + "x" * 40) for k in range(900)]
    many = [(1000 + k, "the same text for a third of all rows") for k in range(450)]
    got = S.shard(spark.createDataFrame(few + many, "doc_id bigint, text string"), 8).collect()
    at = defaultdict(set)
    for r in got:
        if r["doc_id"] < 1000:
            at[r["doc_id"] // 3].add(r["shard"])
    assert all(len(v) == 1 for v in at.values())
    load = np.bincount([r["shard"] for r in got], [r["size"] for r in got], 8)
    assert load.max() - load.min() <= 0.05 * load.mean()


def test_pack_follows_the_dot_product():
    rng = np.random.default_rng(1)
    items = rng.random((60, 3)) * [100, 10, 1]
    share = items / (items.sum(axis=0) / 5)
    left, want = np.ones((5, 3)), {}
    for i in sorted(range(60), key=lambda i: (-share[i].max(), -share[i].sum(), i)):
        s = max(range(5), key=lambda s: (float(np.dot(left[s], share[i])), -s))
        left[s] -= share[i]
        want[i] = s
    assert S.pack(items, 5).tolist() == [want[i] for i in range(60)]


def test_level_narrows_and_keeps_items():
    rng = np.random.default_rng(2)
    items, shard = rng.integers(1, 1000, (500, 3)).astype(float), rng.integers(0, 10, 500)
    out = S.level(items, shard, 10)
    spread = lambda at, k: np.ptp(np.bincount(at, items[:, k], 10))
    assert spread(out, 0) < 0.05 * spread(shard, 0)
    assert all(spread(out, k) < spread(shard, k) for k in (1, 2))
    packed = S.pack(items, 10)
    out = S.level(items, packed, 10)
    aim = items.sum(axis=0) / 10
    assert spread(out, 0) <= max(spread(packed, 0), 2e-3 * aim[0]) and all(spread(out, k) < 0.05 * aim[k] for k in (1, 2))


def test_awkward_rows(spark, edge_docs, no_docs):
    got = S.shard(edge_docs, 3).collect()
    assert len(got) == edge_docs.count()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert [r["size"] for r in got if r["doc_id"] == 1] == [16]
    assert S.shard(no_docs, 4).collect() == []
