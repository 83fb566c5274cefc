"""
resolution cardinality, upsert idempotence, first-by-key against a window."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.functions import text as TX
from rollbook.functions.labels import SCORE_EDGES
from rollbook.operators import matching as M
from rollbook.operators import ranking as R
from rollbook.operators import search as SR
from rollbook.operators import stats as S
from rollbook.operators import upsert as U

SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.floats(min_value=-2, max_value=12, allow_nan=False).map(lambda x: round(x, 1)),
                min_size=1, max_size=60))
def test_histogram_counts_sum_to_in_range(spark, scores):
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    out = S.score_histogram(df, "s").collect()
    in_range = sum(1 for s in scores if SCORE_EDGES[0] <= s <= SCORE_EDGES[-1])
    assert sum(r["count"] for r in out) == in_range
    assert len(out) == len(SCORE_EDGES) - 1


@SETTINGS
@given(st.lists(st.sampled_from(["2001200001", "2001200002", "An", "Binh", "14A1", "15B2", "01/02/2000",
                                 " ", "nobody", "2001200009"]), min_size=1, max_size=25))
def test_lookup_one_row_per_input_in_order(spark, values):
    target = spark.createDataFrame(
        [(1, "2001200001", "An", "14A1", "01/02/2000"), (2, "2001200002", "Binh", "14A1", "02/02/2000"),
         (3, "2001200003", "An", "15B2", "01/02/2000")], "ord long, mssv string, ten string, lop string, ns string")
    inputs = spark.createDataFrame(list(enumerate(values)), "input_order long, input_value string")
    roles = {"mssv": [("mssv", "mssv")], "name": [("ten", "ten")], "class": [("lop", "lop")],
             "date": [("ns", "ns")]}
    out = [r.input_order for r in SR.typed_lookup(inputs, target, roles, "ord", ["ten"]).collect()]
    assert out == sorted(set(out))  # at most one row per input, input order kept


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["mssv", "names"]),
                          st.sampled_from(["2001200001", "2001200002", "an nguyen", "binh tran", "an nguyn"])),
                min_size=1, max_size=12))
def test_resolution_one_row_per_record_and_input(spark, items):
    recs = spark.createDataFrame([(1, "2001200001", "an nguyen"), (2, "2001200002", "binh tran"),
                                  (3, "2001200003", "an nguyen")], "row_ord long, student_id string, full_name string")
    rows = sorted({(k, v) for k, v in items})
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "kind string, item string, input_order long")
    out = M.match_extracted(df, recs).collect()
    assert len({r.student_id for r in out}) == len(out)
    assert len({r.input_order for r in out}) == len(out)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 100)), min_size=1, max_size=40))
def test_upsert_idempotent_and_first_by_key(spark, pairs):
    rows = [(k, float(v), i) for i, (k, v) in enumerate(pairs)]
    cur = spark.createDataFrame(rows[: len(rows) // 2] or rows[:1], "k long, v double, ord long")
    inc = spark.createDataFrame(rows[len(rows) // 2:], "k long, v double, ord long")
    once = sorted(tuple(r) for r in U.upsert(cur, inc, "k", "ord").collect())
    twice = sorted(tuple(r) for r in U.upsert(U.upsert(cur, inc, "k", "ord"), inc, "k", "ord").collect())
    assert once == twice
    both = cur.unionByName(inc)
    w = Window.partitionBy("k").orderBy(F.desc("v"), F.asc("ord"))
    want = sorted(tuple(r) for r in both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
                  .select("k", "v", "ord").collect())
    got = sorted(tuple(r) for r in R.first_by_key(both, ["k"], [("v", False), ("ord", True)])
                 .select("k", "v", "ord").collect())
    assert got == want


def test_display_helpers(spark):
    df = spark.createDataFrame([(8.0, 0.95, 512.0), (8.25, 0.5, 2048.0), (None, 0.0, 5 * 1024 * 1024.0)],
                               "v double, s double, b double")
    out = df.select(TX.display_value("v").alias("d"), TX.percent_text("s").alias("p"),
                    TX.size_text("b").alias("z")).collect()
    assert [tuple(r) for r in out] == [("8", "95%", "512 B"), ("8.25", "50%", "2.0 KB"), ("", "0%", "5.0 MB")]


def test_value_counts_tie_break(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "c string")
    assert [(r.c, r.n) for r in S.value_counts(df, "c", 2).collect()] == [("a", 2), ("b", 2)]


def test_class_extremes_ties_take_smallest_class(spark):
    means = spark.createDataFrame([("B", 5.0), ("A", 5.0), ("C", 7.0), ("D", 7.0)], "c string, mean double")
    r = S.class_extremes(means, "c").first()
    assert (r.best_class, r.worst_class, r.class_count, r.gap) == ("C", "A", 4, 2.0)


def test_text_search_regex_and_cap(spark):
    df = spark.createDataFrame([(i, f"Nguyen {i}") for i in range(5)] + [(9, "Tran")], "k long, n string")
    assert [r.k for r in R.text_search(df, "nguyen", order=["k"], cap=3).collect()] == [0, 1, 2]
    assert [r.k for r in R.text_search(df, "^tr", order=["k"], regex=True).collect()] == [9]
