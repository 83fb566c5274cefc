"""Merkle manifest: whole results against a plain recursion, the smallest multiproof, subsets and awkward rows."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
from llm_fixtures import SF_SMALL, edge_docs  # noqa: F401
from pyspark.sql import functions as F

from rollbook.llm import manifest as M
from rollbook.llm import queries_structure as Q

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree int, hash string"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain(hashes):
    """(root, proof of each leaf as (position in its run, run) by level)."""
    paths, at, now = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(now) > 1:
        runs = [now[k:k + 8] for k in range(0, len(now), 8)]
        for p, i in zip(paths, at):
            p.append((i % 8, runs[i // 8]))
        now, at = [H("".join(r)) for r in runs], [i // 8 for i in at]
    return now[0], paths


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r[:5]))) for g in names}
    built = {g: plain([leaf(*r[:5]) for r in trees[g]]) for g in names}
    root, tops = plain([built[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for r, path in zip(trees[g], built[g][1]):
            proof = path + top
            forged = r[4].translate({k: k + 32 for k in range(65, 91)}) if r[4] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]
            value = leaf(*r[:4], forged)
            for p, run in proof:
                value = H("".join([*run[:p], value, *run[p + 1:]]))
            flat = "".join(h for p, run in proof for k, h in enumerate(run) if k != p)
            out.append((r[0], leaf(*r[:5]), built[g][0], root, H(flat), value, value == root))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def sample(n, seed=0):
    rng = random.Random(seed)
    langs = [None, "", "en", "en", "en", "zz", "é"]
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "web", ""]), rng.choice(langs), rng.choice([None, 3]),
             rng.choice([None, "", "Some Text %d" % k, "lower", "Ünïcode Text"]), 7, "clash") for k in range(n)]
    return rows + rows[:5] + [(4, "web", "solo", 1, "A" * 300_000, 7, "clash")]


def test_whole_result_against_a_plain_recursion(spark):
    for n in (1, 9, 700):
        rows = sample(n, n)
        assert result(Q.proofs(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_blocks_of_several_tiers(spark, monkeypatch):
    monkeypatch.setattr(M, "TIER", 1)
    rows = [(k, "s", "en", 1, f"Text {k}", 0, "") for k in range(600)]
    assert result(Q.proofs(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_one_tree_one_leaf_and_none(spark):
    rows = [(7, None, None, None, None, 0, "")]
    assert result(Q.proofs(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
    assert Q.proofs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_missing_is_the_smallest_set():
    """No coordinate of the set can be left out."""
    def enough(held, n, given):
        known = {(0, i) for i in held} | set(given)
        wide = M.widths(n)
        for level, width in enumerate(wide[:-1]):
            for p in range(wide[level + 1]):
                if all((level, c) in known for c in range(8 * p, min(8 * p + 8, width))):
                    known.add((level + 1, p))
        need = {(level, c) for i in held for level, width in enumerate(wide[:-1])
                for c in range(i // 8**(level + 1) * 8, min(i // 8**(level + 1) * 8 + 8, width))}
        return need <= known

    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 30)
        held = rng.sample(range(n), rng.randint(1, n))
        got = M.missing(held, n)
        assert enough(held, n, got)
        assert not got or not any(enough(held, n, less) for less in itertools.combinations(got, len(got) - 1))


def test_proofs_of_a_subset_fold_to_the_root(spark):
    rows = [(k, "s", "en" if k % 3 else "de", 1, f"Text {k}", 0, "") for k in range(900)]
    m = M.row_manifest(spark.createDataFrame(rows, SCHEMA))
    some = m.leaves.where(F.col("doc_id") % 97 == 0)
    got = M.prove(m, some, keep_proofs=True).collect()
    want = {e[0]: e for e in expected([(*r[:4], r[4], 0, "") for r in rows])}
    assert sorted(r["doc_id"] for r in got) == [k for k in range(900) if k % 97 == 0]
    for r in got:
        assert (r["root"], r["folded_root"], r["proof_sha256"]) == (want[r["doc_id"]][3], want[r["doc_id"]][3], want[r["doc_id"]][4])
        assert H("".join(r["proof"])) == r["proof_sha256"]


def test_sql_agrees_on_awkward_rows(spark):
    rows = [(k, *r[1:5]) for k, r in enumerate(sample(300, 5))]  # ids differ: SQL orders ties by nothing else
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    cols = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert sorted(con.execute(f"SELECT {cols} FROM ({Q.OP11_SQL})").fetchall(), key=repr) == expected([(*r, 0, "") for r in rows])


def test_query_names(spark):
    df = Q.op11_merkle_manifest(spark, SF_SMALL)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
