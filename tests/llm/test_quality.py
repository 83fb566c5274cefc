"""Line quality: base counts and Viterbi against brute force, held-out verdicts."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_fixtures import SF_MID, edge_docs, no_docs  # noqa: F401

from rollbook.llm import quality as Q
from rollbook.llm.flat import text_bytes


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:]))
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_base_counts(spark, edge_docs, no_docs):
    rnd = random.Random(2)
    parts = ["a", "b", "c", "é", "日本", "#x", "%%%", " ", " ", " ", "\n", "\n\n", "\t", "🙂", "\x0b", "a b c", "<p>"]
    rows = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 120))), "en", 1) for k in range(150)]
    docs = edge_docs.union(spark.createDataFrame(rows, edge_docs.schema))
    want = sorted((str(r["doc_id"]), *brute(r["text"])) for r in docs.collect())
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in Q.quality(docs, None).collect())
    assert got == want
    assert Q.quality(no_docs, None).collect() == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    field = Q.Field(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    sizes = [0, 1, 5, 9, 2, 0, 7]
    first = np.cumsum([0, *sizes])
    x = rng.normal(size=(first[-1], 3))
    got = field.decode(x, first)
    emit = x @ field.weights
    for a, b in zip(first[:-1], first[1:]):
        best = max(itertools.product((0, 1), repeat=b - a), key=lambda p: sum(emit[a + i, y] for i, y in enumerate(p)) + sum(field.moves[u, v] for u, v in zip(p, p[1:])))
        assert got[a:b].tolist() == list(best)


def test_training_raises_the_likelihood_and_tells_labels_apart():
    good = ["A plain line of prose that goes on.\nAnd one more that ends well."] * 20
    bad = ["BUY!! NOW!! BUY!! NOW!!\nHOT | DEAL | HOT | DEAL |"] * 20
    field = Q.train(good + bad, [Q.CONTENT] * 20 + [Q.BOILERPLATE] * 20)
    buf, offsets = text_bytes(pa.array([good[0] + "\n" + bad[0]]))
    t = Q.analyse(buf, offsets)
    assert field.decode(t.features, t.line_first).tolist() == [0, 0, 1, 1]
    assert Q.train([], []) is None and Q.train(["x"], [0]) is None


def test_held_out_verdicts(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    field = Q.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = Q.quality(docs, field).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.2


def test_no_labels(spark, edge_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert Q.fit(edge_docs, none) is None
    assert all(r["kept"] == (not r["base_failed"]) for r in Q.quality(edge_docs, None).collect())


def mixed(texts, labels, seed):
    """Held-out documents with a planted run of the other label: (text, label of each line)."""
    out, marks = Q.splice(texts, labels, seed)
    return list(zip(out, marks))[len(texts):]


def test_lines_of_mixed_documents(spark):
    """Texts that were not learned from, with boilerplate at their beginning, middle or end: lines are told apart inside a document."""
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    field = Q.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").where("text is not null").select("text", "quality").collect()
    made = [(t, m) for t, m in mixed([r["text"] for r in rows], [Q.CONTENT if r["quality"] else Q.BOILERPLATE for r in rows], 8) if len(set(m)) == 2]
    right, wrong, both = 0, 0, 0
    for text, want in made:
        buf, offsets = text_bytes(pa.array([text]))
        t = Q.analyse(buf, offsets)
        got = field.decode(t.features, t.line_first).tolist()
        assert len(got) == len(want)
        right, wrong, both = right + sum(a == b for a, b in zip(got, want)), wrong + sum(a != b for a, b in zip(got, want)), both + (len(set(got)) == 2)
    print("line accuracy", right / (right + wrong), "documents with both labels", both, "of", len(made))
    assert right / (right + wrong) >= 0.85 and both >= 0.6 * len(made)


def test_content_share_and_verdict_against_a_plain_version(spark):
    rng = np.random.default_rng(3)
    field = Q.Field(4 * rng.normal(size=(19, 2)), np.zeros((2, 2)))
    field.weights[0] = 0
    rnd = random.Random(5)
    line = lambda: " ".join(rnd.choice(["word", "BUY!!", "a|b|c", "123", "Nice", "day."]) + str(rnd.randrange(900)) for _ in range(rnd.randint(0, 12)))
    rows = [(k, "\n".join(line() for _ in range(rnd.randint(0, 14)))) for k in range(60)] + [(90, None), (91, "")]
    got = {r["doc_id"]: r for r in Q.quality(spark.createDataFrame(rows, "doc_id bigint, text string"), field, keep_labels=True).collect()}
    shares = set()
    for k, text in rows:
        lines = Q.lines_with_words(text or "")
        sizes, labels = [len(x.split()) for x in lines], got[k]["labels"]
        assert len(labels) == len(lines)
        share = sum(n for n, y in zip(sizes, labels) if y == Q.CONTENT) / max(sum(sizes), 1)
        assert abs(got[k]["content_share"] - share) < 1e-12
        assert got[k]["kept"] == (share >= 0.5 and not got[k]["base_failed"])
        shares.add(round(share, 2))
    assert len(shares) > 10


def test_conflicting_labels_take_the_lowest(spark, edge_docs):
    twice = spark.createDataFrame([(0, 1), (0, 0), (4, 1), (9, 0)], "doc_id bigint, quality int")
    once = spark.createDataFrame([(0, 0), (4, 1), (9, 0)], "doc_id bigint, quality int")
    a, b = Q.fit(edge_docs, twice), Q.fit(edge_docs, once)
    assert (a is None) == (b is None) and (a is None or np.array_equal(a.weights, b.weights))
