"""Upserts, imports and change logs (SO3, SO4, SO6, SO7)."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.operators import upsert as U


def test_reimport_last_row_wins(spark):
    cur = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2)], "k string, v double, ord long")
    inc = spark.createDataFrame([("a", 5.0, 1), ("a", 6.0, 2), ("c", 3.0, 3)], "k string, v double, ord long")
    out = {r.k: r.v for r in U.upsert(cur, inc, "k", "ord").collect()}
    assert out == {"a": 6.0, "b": 2.0, "c": 3.0}
    again = {r.k: r.v for r in U.upsert(U.upsert(cur, inc, "k", "ord"), inc, "k", "ord").collect()}
    assert again == out  # idempotent


def test_batch_duplicate_second_skipped(spark):
    cur = spark.createDataFrame([("x", "X")], "k string, name string")
    batch = spark.createDataFrame([("n", "N", 1), ("n", "N2", 2), ("x", "X", 3), ("m", " ", 4)],
                                  "k string, name string, ord long")
    st = {r.ord: r.status for r in U.classify_import(cur, batch, "k", "ord", ["k", "name"]).collect()}
    assert st == {1: "imported", 2: "skipped_duplicate", 3: "skipped_existing", 4: "rejected"}
    loose = {r.ord: r.status for r in U.classify_import(cur, batch, "k", "ord", ["k", "name"],
                                                         skip_duplicates=False).collect()}
    assert loose == {1: "imported", 2: "imported", 3: "imported", 4: "rejected"}


def test_dedupe_by_key(spark):
    df = spark.createDataFrame([("1", "A", 0), ("1", "B", 1), (None, "C", 2), ("", "C", 3), (None, None, 4)],
                               "id string, name string, o int")
    out = sorted((r._dedupe_key, r.o) for r in U.dedupe_by_key(df, "id", "name", ["o"]).collect())
    assert out == [("mssv_1", 0), ("name_C", 2)]


def test_change_log_matches_lag_with_hot_key(spark):
    rnd = random.Random(1)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = 0 if i % 3 == 0 else rnd.randint(1, 50)  # key 0 holds a third of all rows
        rows.append((i, key, t0 + timedelta(minutes=rnd.randint(0, 60 * 24 * 5)), float(rnd.randint(0, 3))))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double")
    got = sorted((r.user_id, r.event_id, r.old_value, r.new_value)
                 for r in U.change_log(df, "user_id", "ts", "value", ["event_id"]).collect())
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = sorted((r.user_id, r.event_id, r.o, r.value) for r in
                  df.withColumn("o", F.lag("value").over(w)).withColumn("rn", F.row_number().over(w))
                  .where("rn > 1").collect())
    assert got == want
    # same-value updates are logged too
    assert any(o == n for _, _, o, n in got)


def test_snapshot_changes(spark):
    schema = "k long, a string, v double, b int"
    before = spark.createDataFrame([(1, "x", 1.0, None), (2, "y", 2.0, 2), (3, "z", None, 3), (4, None, 4.0, 4), (None, "n", 5.0, 5)], schema)
    after = spark.createDataFrame([(1, "x", 1.0, None), (2, "y", 2.5, 2), (3, "z", None, 9), (5, "new", 6.0, 1), (None, "n", 5.0, 5)], schema)
    got = sorted(tuple(r) for r in U.snapshot_changes(before, after.select("b", "v", "k", "a"), "k", "v").collect())
    assert got == [(2, "UPDATE", 2.0, 2.5), (3, "UPDATE", None, None), (4, "DELETE", 4.0, None), (5, "INSERT", None, 6.0)]
    hot = spark.createDataFrame([(9, f"r{k}", 1.0, 1) for k in range(500)], schema)  # a repeated key counts once
    assert U.snapshot_changes(hot, hot.limit(0), "k", "v").count() == 1
