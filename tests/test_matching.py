"""Fuzzy join (JN5) against brute force, and the exact phases (JN3, JN4, JN6)."""

import random
import string

from pyspark.sql import functions as F

from rollbook.functions.similarity import min_shared, ratio_py
from rollbook.operators import matching as M


def _names(rnd, n):
    words = ["an", "binh", "chi", "dung", "hoa", "lan", "minh", "nam", "phuong", "quang", "thu", "van"]
    out = []
    for _ in range(n):
        out.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 3))))
    return out


def _edit(rnd, s):
    i = rnd.randrange(len(s))
    op = rnd.choice("dis")
    c = rnd.choice(string.ascii_lowercase)
    return s[:i] + s[i + 1:] if op == "d" else (s[:i] + c + s[i:] if op == "i" else s[:i] + c + s[i + 1:])


def brute_force_best(inputs, targets, threshold):
    """Best target per input by exhaustive scoring."""
    out = {}
    for a in inputs:
        best = None
        for s, ro in targets:
            r = ratio_py(a, s)
            if r >= threshold and (best is None or r > best[0] or (r == best[0] and ro < best[2])):
                best = (r, s, ro)
        if best:
            out[a] = best
    return out


def test_bounds_hold_on_random_strings():
    """Shared grams and places of matched characters, against the matching blocks themselves."""
    from collections import Counter
    from difflib import SequenceMatcher

    rnd = random.Random(2)
    for _ in range(3000):
        a = "".join(rnd.choice("abc ") for _ in range(rnd.randint(2, 30)))
        b = a
        for _ in range(rnd.randint(0, 4)):
            b = _edit(rnd, b) if b else b
        if len(b) < 2 or (ratio := ratio_py(a, b)) < 0.7:
            continue
        for q in (2, 3):
            grams = lambda s: Counter(s[k:k + q] for k in range(len(s) - q + 1))
            assert sum((grams(a) & grams(b)).values()) >= min_shared(q, len(a) + len(b), ratio)
        reach = max(len(a), len(b)) - ratio / 2 * (len(a) + len(b)) + 1e-9
        assert all(abs(m.a - m.b) <= reach for m in SequenceMatcher(None, a, b).get_matching_blocks()[:-1])


def test_candidates_of_all_lengths(spark):
    """Short, repetitive and long strings: every scheme, places that repeat, and keys that are split."""
    rnd = random.Random(8)
    make = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    targets = sorted({make(n, letters) for n in range(2, 26) for letters in ("ab", "abcdefgh") for _ in range(6)} | {"nguyen " + make(6, "abc") for _ in range(60)})
    inputs = sorted({e for s in targets for e in (s, _edit(rnd, s), _edit(rnd, _edit(rnd, s) or "x")) if len(e) >= 2})
    kept, M.HOT_KEY = M.HOT_KEY, 3
    try:
        for t in (0.85, 0.95):
            cand = {(r.a, r.b) for r in M.fuzzy_candidates(spark.createDataFrame([(s,) for s in inputs], "s string"),
                                                           spark.createDataFrame([(s,) for s in targets] + [(None,)], "s string"), t).collect()}
            need = {(x, y) for x in inputs for y in targets if ratio_py(x, y) >= t}
            assert need <= cand
    finally:
        M.HOT_KEY = kept


def test_candidates_grow_no_faster_than_names(spark):
    """Ten times the names: about ten times the candidates."""
    from rollbook.plans import entities as EN

    counts = []
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        items = EN.compare_inputs(spark, path).where("kind = 'names'").select(F.lower("item").alias("s"))
        names = EN.person_records(spark, path).select(F.col("full_name").alias("s"))
        counts.append((names.count(), M.fuzzy_candidates(items, names).count()))
    (n0, c0), (n1, c1) = counts
    assert c1 / c0 < 1.3 * n1 / n0


def test_candidates_are_lossless(spark):
    rnd = random.Random(11)
    targets = sorted(set(_names(rnd, 150)))
    inputs = sorted(set(_edit(rnd, rnd.choice(targets)) for _ in range(120)) | set(_names(rnd, 40)))
    a = spark.createDataFrame([(s,) for s in inputs], "s string")
    b = spark.createDataFrame([(s,) for s in targets], "s string")
    cand = {(r.a, r.b) for r in M.fuzzy_candidates(a, b, 0.85).collect()}
    need = {(x, y) for x in inputs for y in targets if len(x) >= 2 and len(y) >= 2 and ratio_py(x, y) >= 0.85}
    assert need <= cand
    assert len(cand) < len(inputs) * len(targets)  # blocking prunes


def test_keys_that_meet_become_rows_only_if_bit_maps_allow(spark, monkeypatch):
    """Names that share a word, and so many keys, and little else: few rows behind the join on keys."""
    rnd = random.Random(3)
    make = lambda n: "".join(rnd.choice("aeiounhtrlsmkvbd") for _ in range(n))
    targets = sorted({"nguyen " + make(6) + " " + make(8) for _ in range(300)})
    inputs = [s[:-1] for s in targets[:100]] + ["nguyen " + make(6) + " " + make(8) for _ in range(100)]
    frames, kept = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df, *name: (frames.append(kept(df, *name)), frames[-1])[1])
    found = M.fuzzy_candidates(spark.createDataFrame([(s,) for s in inputs], "s string"), spark.createDataFrame([(s,) for s in targets], "s string"))
    met = {(r.a, r.b) for r in found.collect()}
    assert {(x, y) for x in inputs for y in targets if ratio_py(x, y) >= 0.85} <= met
    pairs = [f for f in frames if f.columns == ["a", "b"]]
    assert len(pairs) == 1 and pairs[0].count() < len(inputs) * len(targets) / 4
    assert not any("key" in f.columns and "len" in f.columns for f in frames)  # keys are not written out


def test_inputs_with_a_close_target_are_not_looked_up_again(spark, monkeypatch):
    asked, plain = [], M.fuzzy_candidates
    monkeypatch.setattr(M, "fuzzy_candidates", lambda a, b, t: (asked.append((t, {r.s for r in a.select("s").collect()})), plain(a, b, t))[1])
    targets = spark.createDataFrame([("hoang thi thu huong", 1), ("hoang thi thu hien", 2), ("tran van binh minh", 3)], "s string, row_ord long")
    inputs = spark.createDataFrame([("hoang thi thu huon",), ("tran van binj mink",), ("le x",), (None,)], "s string")
    got = {r.a: (r.b, r.row_ord) for r in M.best_fuzzy(inputs, targets, 0.85).collect()}
    assert got == {"hoang thi thu huon": ("hoang thi thu huong", 1), "tran van binj mink": ("tran van binh minh", 3)}
    assert [t for t, _ in asked] == [0.925, 0.85] and "hoang thi thu huon" not in asked[1][1] and "tran van binj mink" in asked[1][1]


def test_best_fuzzy_matches_brute_force(spark):
    rnd = random.Random(5)
    targets = _names(rnd, 120)
    rows = [(s, i) for i, s in enumerate(targets)]
    inputs = sorted(set(_edit(rnd, rnd.choice(targets)) for _ in range(80)))
    got = {r.a: (round(r.score, 12), r.row_ord) for r in
           M.best_fuzzy(spark.createDataFrame([(s,) for s in inputs], "s string"),
                        spark.createDataFrame(rows, "s string, row_ord long")).collect()}
    want = {a: (round(v[0], 12), v[2]) for a, v in brute_force_best(inputs, rows, 0.85).items()}
    assert got == want


def test_bound_is_positive_only_above_two_thirds():
    assert min_shared(2, 20, 0.85) >= 4
    assert min_shared(2, 20, 0.6) == 0


def test_exact_phases_and_resolution(spark):
    recs = spark.createDataFrame(
        [(1, "2001200001", "nguyen van an"), (2, "2001200002", "tran thi binh"),
         (3, "2001200003", "tran thi binh"), (4, "2001200004", "le van chi")],
        "row_ord long, student_id string, full_name string")
    items = spark.createDataFrame(
        [("mssv", "2001200002", 1), ("names", "Tran Thi Binh", 2), ("names", "le van chy", 3),
         ("names", "Nguyen Van An", 4)], "kind string, item string, input_order long")
    out = {r.student_id: (r.match_type, r.input_order) for r in M.match_extracted(items, recs).collect()}
    # id wins record 2; the exact name then takes the next record with that name (3)
    assert out["2001200002"] == ("mssv_exact", 1)
    assert out["2001200003"] == ("name_exact_combined", 2)
    assert out["2001200004"][0] == "name_fuzzy_combined"
    assert out["2001200001"] == ("name_exact_combined", 4)


def test_match_tie_takes_earlier_record(spark):
    targets = spark.createDataFrame([("hoang anh", 7), ("hoang ang", 3)], "s string, row_ord long")
    best = M.best_fuzzy(spark.createDataFrame([("hoang anx",)], "s string"), targets).collect()
    assert len(best) == 1 and best[0].row_ord == 3


def test_pair_score(spark):
    pairs = spark.createDataFrame([("2001", "2001", "x"), ("nguyen van a", "9", "nguyen van an"),
                                   ("zzz", "9", "nguyen")], "i string, id string, n string")
    out = [r.match_type for r in M.pair_score(pairs, "i", "id", "n").collect()]
    assert out == ["mssv_exact", "name_fuzzy", "no_match"]
    assert F is not None


def test_jn5_on_tables_matches_brute_force(spark):
    from conftest import SF_SMALL
    from rollbook.plans import entities as EN

    items = [(r.kind, r.item, r.input_order) for r in EN.compare_inputs(spark, SF_SMALL).collect()]
    recs = [(r.row_ord, r.student_id, r.full_name) for r in EN.person_records(spark, SF_SMALL).collect()]
    id_hits = {i for k, i, _ in items if k == "mssv"} & {sid for _, sid, _ in recs}
    eligible = sorted((ro, name) for ro, sid, name in recs if sid not in id_hits)
    names = {n for _, n in eligible}
    want = {}
    for kind, item, order in items:
        q = item.strip().lower()
        if kind != "names" or q in names:
            continue
        best = None
        for ro, name in eligible:
            r = ratio_py(q, name)
            if r >= 0.85 and (best is None or r > best[0]):
                best = (r, ro)
        if best:
            want[item] = (round(best[0], 6), best[1])
    got = {r.input_value: (round(r.match_score, 6), r.row_ord)
           for r in EN.jn5_fuzzy_name(spark, SF_SMALL).collect()}
    assert got == want and want
