"""Whole rows at any size: long keys, total orders, fixed partition numbers, shared folders."""

import random
import types

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook import session
from rollbook.operators import ranking as R
from rollbook.operators import stats as S
from rollbook.operators import upsert as U
from rollbook.plans.registry import padded
from rollbook.sources import files as FS
from rollbook.sources import sinks as SK
from rollbook.streaming import streams as ST


def test_long_ids_are_never_cut(spark):
    ids = [7, 1234567, 12345678901]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(padded(F.col("i"), 6)).collect()
    assert [r[0] for r in got] == ["000007", "1234567", "12345678901"]


@pytest.fixture
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def test_change_log_without_exchange_reuse(spark, no_reuse):
    n = 1_000_000
    rows = spark.range(n).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), (F.xxhash64("id") % 100_000).alias("ts"),
                                 F.col("id").alias("tie"), (F.col("id") * 7 % 1000).cast("double").alias("v"))
    got = U.change_log(rows, "k", "ts", "v", ["tie"])
    w = Window.partitionBy("k").orderBy("ts", "tie")
    want = rows.withColumn("old", F.lag("v").over(w)).withColumn("rn", F.row_number().over(w)).where("rn > 1")
    digest = lambda d, old, new, ts: d.agg(F.count("*"), F.sum(F.xxhash64("k", F.col(ts), "tie", F.col(old), F.col(new)).cast("decimal(38,0)"))).first()
    assert tuple(digest(got, "old_value", "new_value", "change_date")) == tuple(digest(want, "old", "v", "ts"))


def test_global_row_number_without_exchange_reuse(spark, no_reuse):
    rows = spark.range(200_000).select((F.xxhash64("id") % 1000).alias("a"), F.col("id").alias("b"))
    wrong = SK.global_row_number(rows, ["a", "b"]).withColumn("want", F.row_number().over(Window.orderBy("a", "b"))).where("want <> row_no")
    assert wrong.count() == 0


def test_first_by_key_orders_any_type_and_puts_null_last(spark):
    rows = spark.createDataFrame([(1, "b", 5, None), (1, "a", None, "z"), (1, None, 9, "y"), (2, None, None, None)], "k int, t string, n long, x string") \
        .withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.coalesce("n", F.lit(0)).cast("int"))).withColumn("ts", F.col("d").cast("timestamp_ntz"))
    first = lambda order: {r.k: (r.t, r.n) for r in R.first_by_key(rows, ["k"], order).collect()}
    assert first([("t", True)])[1] == ("a", None)
    assert first([("t", False)])[1] == ("b", 5)
    assert first([("n", False)])[1] == (None, 9) and first([("n", True)])[1] == ("b", 5)
    assert first([("d", False), ("n", True)])[1] == (None, 9) and first([("ts", False), ("t", True)])[1] == (None, 9)
    assert first([("n", False), ("t", True)])[2] == (None, None)


def test_append_and_import_of_repeated_rows(spark):
    old = spark.createDataFrame([("1", "x", 0)], "k string, v string, o int")
    new = spark.createDataFrame([("2", "b", 1), ("2", "a", 1), ("2", "c", None), ("3", "d", 2), ("3", "d", 2), ("1", "y", 0), ("4", " ", 0)], old.schema)
    got = sorted(tuple(r) for r in U.append_checked(old, new, "k", ["k", "v"], ["o"]).collect())
    assert got == [("1", "x", 0), ("2", "a", 1), ("3", "d", 2)]
    status = sorted((r.k, r.v, r.status) for r in U.classify_import(old, new, "k", ["o"], ["k", "v"]).collect())
    assert status == [("1", "y", "skipped_existing"), ("2", "a", "imported"), ("2", "b", "skipped_duplicate"), ("2", "c", "skipped_duplicate"),
                      ("3", "d", "imported"), ("3", "d", "skipped_duplicate"), ("4", " ", "rejected")]
    up = {r.k: r.v for r in U.upsert(old, new, "k", "o").collect()}
    assert up["2"] in ("a", "b") and up["1"] == "y"


def test_quantiles_of_all_distinct_scores(spark):
    rnd = random.Random(1)
    values = [rnd.random() * 10 for _ in range(20_001)]
    row = S.quantile_row(spark.createDataFrame([(v,) for v in values], "s double"), "s", (0.0, 0.25, 0.5, 0.9, 1.0)).first()
    values.sort()
    at = lambda q: values[int(q * 20_000)]
    assert row["mode"] == values[0] and row["q"] == pytest.approx([at(q) for q in (0.0, 0.25, 0.5, 0.9, 1.0)])
    assert S.quantile_row(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (9.0,)], "s double"), "s").first() == (2.0, [1.75, 2.0, 3.75])
    assert S.describe_scores(spark.createDataFrame([], "s double"), "s").first()["n"] == 0


def test_a_cluster_must_name_the_shared_folder():
    conf = {"spark.master": "spark://host:7077"}
    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
    conf["spark.master"] = "local-cluster[3,2,1024]"
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(fake)


def test_a_search_cap_needs_an_order(spark):
    d = spark.createDataFrame([(k, "text") for k in range(150)], "k int, t string")
    assert R.text_search(d, "tex").count() == 150
    with pytest.raises(ValueError):
        R.text_search(d, "tex", cap=100)


def test_change_log_stream_hot_key_and_replay(spark, tmp_path):
    """Three micro-batches, one key in half of all rows; then the last batch is written again."""
    rows = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).alias("k"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"),
                                    F.col("id").alias("e"), (F.col("id") % 11).cast("double").alias("v"))
    drop = str(tmp_path / "drop")
    for part in range(3):
        rows.where((F.col("e") >= part * 1000) & (F.col("e") < (part + 1) * 1000)).coalesce(1).write.mode("append").parquet(drop)
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(drop)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    _, log = ST.change_log_stream(spark, src, "k", "ts", "v", ["e"], out, ckpt)
    want = sorted((r.k, r.e, r.old_value, r.new_value) for r in U.change_log(rows, "k", "ts", "v", ["e"]).collect())
    read = lambda: sorted((r.k, r.e, r.old_value, r.new_value) for r in spark.read.parquet(log).collect())
    assert read() == want
    (tmp_path / "ckpt" / "commits" / "2").unlink()  # as if the query had died before the commit
    for crc in (tmp_path / "ckpt" / "commits").glob(".2.crc"):
        crc.unlink()
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(drop)
    ST.change_log_stream(spark, src, "k", "ts", "v", ["e"], out, ckpt)
    assert read() == want


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [("" if k % 7 == 0 else f" line {k} ") for k in range(1, 5001)]
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {(r.file[-5:], r.line_no, r.line) for r in FS.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(n, k, v.strip()) for n in ("a.txt", "b.txt") for k, v in enumerate(lines, 1) if v.strip()}
