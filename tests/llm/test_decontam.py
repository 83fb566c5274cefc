"""Benchmark decontamination against brute force."""

import random
import re

from llm_fixtures import EDGE_SCHEMA, edge_docs, no_docs  # noqa: F401

from rollbook.llm.decontam import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, items, n=10):
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        k = min(len(v), n)
        for i in range(len(v) - k + 1 if v else 0):
            for p in range(len(w) - k + 1):
                if w[p:p + k] == v[i:i + k]:
                    hit |= set(range(p, p + k))
                    if item_id is not None:
                        ids.add(str(item_id))
    return len(w), len(hit), sorted(ids)


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, win string, h string, len string")
    b = spark.createDataFrame(items, "item_id bigint, text string, doc_id int, pos int")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], list(r["item_ids"])) for r in contamination(d, b).collect())
    pairs = [(i[0], i[1]) for i in items]
    assert got == sorted((r[0] if r[0] is not None else -1, *brute(r[1], pairs)) for r in docs)


def test_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(30)] + ["Été", "日本", "É", "X1"]
    text = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", ".", "!"]) for _ in range(n))
    items = [(k, text(rnd.choice([12, 15, 10])), 1, 1) for k in range(6)] + [(9, "short one", 0, 0), (10, "Short, ONE!", 0, 0), (11, None, 0, 0), (12, "..", 0, 0), (None, text(11), 0, 0)]
    docs = []
    for k in range(30):
        parts = [text(20)]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(items)[1] or "", text(rnd.randint(0, 8))]
        docs.append((k, " ".join(parts).upper() if k % 3 == 0 else "\n".join(parts), "x", "y", "z"))
    docs += [(90, None, None, None, None), (91, "", None, None, None), (92, "short", None, None, None), (None, items[0][1], None, None, None),
             (93, "short one " * 3, None, None, None), (93, "short one " * 3, None, None, None), (93, "another text", None, None, None)]
    check(spark, docs, items)


def test_items_missing(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r["n_hit"] == 0 for r in contamination(edge_docs, none).collect())
    assert contamination(no_docs, none).collect() == []
    assert decontaminate(edge_docs, none).count() == edge_docs.count()


def test_removal(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"Keep this, {item.upper()}! and that.", "en", 1), (2, "clean", "en", 2), (None, None, None, None)], EDGE_SCHEMA)
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["text"] for r in kept.collect()))) == ["None", "clean"]
    cut = {r["doc_id"]: r["text"] for r in decontaminate(docs, items, remove="spans").collect()}
    assert cut == {1: "Keep this! and that.", 2: "clean", None: None}
