"""Near-duplicates against all pairs in Python, and components against union-find."""

import random

import numpy as np
import pytest
from llm_fixtures import edge_docs, no_docs  # noqa: F401

from rollbook.llm import neardup as N
from rollbook.llm.components import connected

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "")).translate(FOLD).split(" ") if x]
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute(rows, threshold, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    u = Union()
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        u.find(i)
        for j, t in sets[:k]:
            if j is not None and (i == j or s and t and 100 * len(s & t) >= threshold * len(s | t)):
                u.join(i, j)
    return sorted((str(i), len(s), u.find(i) if i is not None else None, i is None or u.find(i) == i) for i, s in sets)


def check(spark, rows, threshold, width):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs, threshold, width).collect()), key=str)
    assert got == sorted(brute(rows, threshold, width), key=str)


def make_rows(seed, bases=12, copies=14, length=80):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(bases):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(3, length))]
        for _ in range(rnd.randint(1, copies)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                base = w                                     # chains that drift away
            rows.append((k * 7 % 1009, rnd.choice([" ", "\n", "  "]).join(x.upper() if rnd.random() < 0.1 else x for x in w)))
            k += 1
    return rows


@pytest.mark.parametrize("seed,threshold,width", [(1, 85, 3), (2, 80, 5)])
def test_all_pairs(spark, seed, threshold, width):
    check(spark, make_rows(seed), threshold, width)


def test_awkward_rows(spark, no_docs):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "one two three"), (None, "one two three"), (None, None),
            (9, "x " * 40_000), (10, "x " * 40_001), (11, "other text here now"), (11, "one two three"), (11, "other text here now"), (12, "É é"), (13, "é é")]
    check(spark, rows, 85, 3)
    assert N.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("width", [3, 5])
def test_chunks_of_fewer_words_than_a_shingle(spark, width):
    """A short document may be alone in its chunk, batch or partition."""
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(7)]
    for t in texts:
        buf = np.frombuffer(t.encode(), np.uint8)
        (one,) = N.shingle_sets(buf, np.array([0, len(buf)]), width)
        assert len(one) == len(shingles(t, width))
    rows = [(k, t) for k, t in enumerate(texts)] + [(10 + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id bigint, text string")
    assert docs.rdd.glom().map(len).collect() == [1] * len(rows)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs, 80, width).collect())
    assert got == brute(rows, 80, width)


@pytest.mark.parametrize("leaders,thin,block", [(1, 0, 3), (1, 2, 7)])
def test_rounds_and_blocks_change_no_component(spark, monkeypatch, leaders, thin, block):
    """Groups that a leader does not settle end in the same components, however the rest is compared."""
    monkeypatch.setattr(N, "LEADER_ROUNDS", leaders)
    monkeypatch.setattr(N, "THIN_ROUNDS", thin)
    monkeypatch.setattr(N, "PAIRS_PER_NODE", 0)
    monkeypatch.setattr(N, "BLOCK", block)
    check(spark, make_rows(3, bases=4, copies=25, length=40), 85, 3)


def test_repeated_ids_lose_no_link(spark):
    """Every text of an id links it, whichever of them comes first and whatever their sizes."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    near = lambda t: t + " more"
    rows = []
    for k, (one, two, other) in enumerate([(a, b, 1), (b, a, 1), (a, b, 9), (b, a, 9)]):  # four families of ids, told apart by their words
        own = lambda t: " ".join(f"{w}_{k}" for w in t.split())  # noqa: B023, E731
        rows += [(100 * k + 5, own(one)), (100 * k + 5, own(two)), (100 * k + other, own(near(b))), (100 * k + other + 1, own(near(a)))]
    rows += [(905, a), (905, b), (909, near(b)), (909, "c " * 30), (903, "c " * 31)]
    check(spark, rows, 85, 3)


def test_look_alikes_that_do_not_link(spark, monkeypatch):
    """Texts of one template, about 0.7 alike: a fixed number of rounds, hardly a set is read, each pair once, and the few that link are found."""
    rnd = random.Random(9)
    template, rows = [f"t{i}" for i in range(300)], []
    for k in range(700):
        w = list(template)
        for at in rnd.sample(range(300), 9):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, rows[k][1] + " end") for k in range(0, 700, 100)]
    kept, rounds, compared = N.stored, [], []

    def stored(df, name):
        out = kept(df, name)
        rounds.append(name)
        if name == "near":
            compared.append(out.count())
        return out

    monkeypatch.setattr(N, "stored", stored)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs, 85, 3).collect()}
    assert {d: c for d, c in got.items() if d != c} == {1000 + k: k for k in range(0, 700, 100)}
    assert rounds.count("open") == N.LEADER_ROUNDS + 1 and rounds.count("components") <= 2 + N.LEADER_ROUNDS + N.THIN_ROUNDS
    assert compared[0] <= len(rows)  # of 250,000 pairs


def test_pigeonhole():
    """Any two signatures within the distance share a key, wherever they differ, and agree in a first chunk."""
    rng = np.random.default_rng(1)
    for values in (24, N.VALUES):
        m = max(N.chunk_count(values, 85), -(-values // N.LANES))
        edges = N.chunk_edges(values, m)
        assert sum(c for _, c in edges) == values and max(c for _, c in edges) <= N.LANES
        for _ in range(200):
            a = rng.integers(0, 2**N.LANE, values)
            b = a.copy()
            at = rng.permutation(values)[:2 * m - 1]
            b[at] ^= rng.integers(1, 2**N.LANE, len(at))
            assert min(int((a[f:f + c] != b[f:f + c]).sum()) for f, c in edges) <= 1


def test_packed_errors(spark):
    """Differing values counted in packed chunks, against a plain count."""
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = [rng.randrange(2**N.LANE) for _ in range(N.LANES)]
        b = [x if rng.random() < 0.6 else rng.randrange(2**N.LANE) for x in a]
        pack = lambda v: sum(x << (N.LANE * k) for k, x in enumerate(v))
        pairs.append((pack(a), pack(b), sum(x != y for x, y in zip(a, b))))
    df = spark.createDataFrame(pairs, "p_c0 bigint, q_c0 bigint, want int")
    assert df.where(N._errors(0, "p_", "q_") != N.F.col("want")).count() == 0


def test_bit_maps_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    for _ in range(100):
        common = rng.integers(0, 2**63, rng.integers(1, 3000)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, rng.integers(0, 400)).astype(np.uint64)])) for _ in range(2))
        one, two = N.parity_maps([a, b])
        assert np.bitwise_count((one ^ two).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_signature_recall():
    """Far fewer pairs at the threshold are missed than the bound allows to see."""
    rng = np.random.default_rng(2)
    m = max(N.chunk_count(N.VALUES, 85), -(-N.VALUES // N.LANES))
    lanes = np.arange(N.LANES) * N.LANE
    missed = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 340).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 30).astype(np.uint64)])) for _ in range(2))
        one, two = N.signatures([a, b], N.VALUES, m)
        errors = ((((one ^ two)[:, None] >> lanes) & (2**N.LANE - 1)) != 0).sum(axis=1)
        missed += errors.min() > 1
    assert missed == 0


def test_drop_keeps_rows_and_columns(spark, edge_docs):
    got = N.drop_near_duplicates(edge_docs)
    assert got.columns == edge_docs.columns and got.count() == edge_docs.count()
    two = spark.createDataFrame([(1, "a b c d e f g", 1), (2, "a b c d e f g", 2), (None, "a b c d e f g", 3)], "doc_id bigint, text string, node int")
    assert sorted(str(r["doc_id"]) for r in N.drop_near_duplicates(two).collect()) == ["1", "None"]


def test_components(spark):
    rnd = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rnd.randrange(100, 300), rnd.randrange(100, 300)) for _ in range(150)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: u.find(x) for x in {n for a, b in edges if a != b for n in (a, b)}}
