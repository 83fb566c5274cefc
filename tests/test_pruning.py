"""What is not read or shuffled: files skipped by grams, joins of bucketed tables; and locale order."""

import random
import tempfile

from pyspark.sql import functions as F

from rollbook.operators import matching as M
from rollbook.operators import ranking as R
from rollbook.plans import views as V
from rollbook.sources import grams as G
from rollbook.sources import sinks as SK


def test_search_skips_files_and_loses_no_row(spark):
    rnd = random.Random(1)
    words = ["red widget", "blue bolt", "small ring", "Nguyễn Văn", "tiny gear", "old nut"]
    rows = [(rnd.choice(words), rnd.choice(["CNTT1", "14DHTH", None]), k) for k in range(600)]
    df = spark.createDataFrame(rows, "name string, lop string, k int")
    path = tempfile.mkdtemp() + "/t"
    G.write_searchable(df.repartitionByRange(6, "name"), path)
    every = len(spark.read.parquet(f"{path}/data").inputFiles())
    for q in ("red widget", "WIDGET", "nguyễn", "cntt", "ng", "zzz", "d w"):
        got = sorted(r["k"] for r in G.search(spark, path, q).collect())
        assert got == sorted(r["k"] for r in R.text_search(df, q).collect())
    files = G.candidate_files(spark, path, "red widget")
    assert 0 < len(files) < every / 2 and G.candidate_files(spark, path, "zzz") == [] and G.candidate_files(spark, path, "ng") is None


def test_bucketed_tables_join_without_a_shuffle(spark):
    make = lambda cols: spark.range(300).select(F.col("id").cast("string").alias(V.KEY), *cols)
    null = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    tables = [make([null("ho_dem"), null("ten"), null("lop")]), make([F.lit(1.0).alias("diem_10")]), make([F.lit(3.0).alias(V.GPA), null("ghi_chu")])]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = [SK.write_bucketed(t, f"bucketed_{k}_{random.randrange(10**9)}", V.KEY, tempfile.mkdtemp() + "/t", 4) for k, t in enumerate(tables)]
        out = V.student_summary(*read)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert out.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_vietnamese_order(spark):
    want = ["1", "2", "10", "an", "az", "ăn", "ân", "binh", "da", "đa", "e", "ê", "o", "ô", "ơ", "u", "ư", "y"]
    mixed = list(want)
    random.Random(2).shuffle(mixed)
    df = spark.createDataFrame([(w,) for w in mixed], "w string")
    assert [r["w"] for r in df.orderBy(*R.mixed_sort_keys("w", collation="vi")).collect()] == want
    assert [r["w"] for r in df.orderBy(*R.mixed_sort_keys("w", descending=True, collation="vi")).collect()] == ["10", "2", "1", *want[:2:-1]]


def test_names_without_regard_to_accents(spark):
    names = spark.createDataFrame([("Nguyen Van An", 1), ("TRẦN THỊ BÌNH", 2), ("le an", 3)], "item string, input_order long")
    records = spark.createDataFrame([(5, "a", "nguyễn văn ân"), (6, "b", "tran thi binh"), (7, "c", "lê anh")], "row_ord long, student_id string, full_name string")
    none = records.limit(0)
    assert M.match_exact_names(names, records, none).count() == 0
    got = {r["input_order"]: r["student_id"] for r in M.match_exact_names(names, records, none, "UNICODE_CI_AI").collect()}
    assert got == {1: "a", 2: "b"}
