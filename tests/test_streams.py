"""Streams drained with availableNow equal their batch twins (ST1-ST3)."""

from pyspark.sql import functions as F

from rollbook.operators import upsert as U
from rollbook.session import read_table
from rollbook.streaming import streams as ST

from conftest import SF_SMALL


def _events_stream(spark):
    schema = read_table(spark, SF_SMALL, "events").schema
    return ST.file_stream(spark, SF_SMALL, "events.parquet", schema)


def test_kpi_stream_equals_batch(spark):
    _, out = ST.kpi_stream(spark, _events_stream(spark), "event_type", "value", 10.0)
    got = {r.event_type: (r.n, round(r.mean, 9)) for r in ST.latest_snapshot(spark, out).collect()}
    batch = ST.kpi_aggregate(read_table(spark, SF_SMALL, "events"), "event_type", "value", 10.0)
    assert got == {r.event_type: (r.n, round(r.mean, 9)) for r in batch.collect()}


def test_change_log_stream_equals_lag(spark):
    _, out = ST.change_log_stream(spark, _events_stream(spark), "user_id", "ts", "value", ["event_id"])
    got = sorted((r.user_id, r.event_id, r.old_value, r.new_value) for r in spark.read.parquet(out).collect())
    ev = read_table(spark, SF_SMALL, "events")
    want = sorted((r.user_id, r.event_id, r.old_value, r.new_value)
                  for r in U.change_log(ev, "user_id", "ts", "value", ["event_id"]).collect())
    assert got == want and got


def test_ingest_stream_skips_known_keys(spark):
    orders = read_table(spark, SF_SMALL, "orders")
    base = orders.where(F.col("o_orderkey") < 100).select("o_orderkey", "o_custkey")
    src = ST.file_stream(spark, SF_SMALL, "orders.parquet", orders.schema).select("o_orderkey", "o_custkey")
    _, root = ST.ingest_stream(spark, src, "o_orderkey", base)
    table = spark.read.parquet(root)
    assert table.count() == orders.count()
    assert table.select("o_orderkey").distinct().count() == orders.count()


def test_csv_drop_folder_ingest(spark):
    import os
    import tempfile

    from pyspark.sql import types as T

    drop = tempfile.mkdtemp()
    for i, body in enumerate(["mssv,ho_ten\n2001200001,An\n2001200002,Binh\n",
                              "mssv,ho_ten\n2001200002,Binh again\n2001200003,\n2001200004,Dung\n"]):
        path = os.path.join(drop, f"upload{i}.csv")
        with open(path, "w", encoding="utf-8") as f:
            f.write(body)
        os.utime(path, (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))  # arrival order = file order
    with open(os.path.join(drop, "notes.txt"), "w") as f:
        f.write("ignored")
    schema = T.StructType([T.StructField("mssv", T.StringType()), T.StructField("ho_ten", T.StringType())])
    base = spark.createDataFrame([("2001200001", "An")], schema)
    src = ST.file_stream(spark, drop, "*.csv", schema, max_files_per_trigger=1, fmt="csv")
    _, root = ST.ingest_stream(spark, src, "mssv", base, required=["ho_ten"])
    got = sorted((r.mssv, r.ho_ten) for r in spark.read.parquet(root).collect())
    assert got == [("2001200001", "An"), ("2001200002", "Binh"), ("2001200004", "Dung")]


def test_change_log_state_carries_across_batches(spark):
    import os
    import tempfile
    from datetime import datetime, timedelta

    drop = tempfile.mkdtemp()
    t0 = datetime(2024, 1, 1)
    first = [(i, i % 3, t0 + timedelta(minutes=i), float(i)) for i in range(12)]
    second = [(100 + i, i % 3, t0 + timedelta(days=1, minutes=i), float(50 + i)) for i in range(9)]
    schema = "event_id long, user_id long, ts timestamp_ntz, value double"
    for k, rows in enumerate([first, second]):
        path = os.path.join(drop, f"part{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(os.path.join(path, f), (1_700_000_000 + 60 * k, 1_700_000_000 + 60 * k))
    src = (spark.readStream.schema(spark.createDataFrame(first, schema).schema)
           .option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(drop))
    q, out = ST.change_log_stream(spark, src, "user_id", "ts", "value", ["event_id"])
    assert sum(1 for p in q.recentProgress if p["numInputRows"] > 0) == 2  # really two micro-batches
    got = sorted((r.user_id, r.event_id, r.old_value, r.new_value) for r in spark.read.parquet(out).collect())
    both = spark.createDataFrame(first + second, schema)
    want = sorted((r.user_id, r.event_id, r.old_value, r.new_value)
                  for r in U.change_log(both, "user_id", "ts", "value", ["event_id"]).collect())
    assert got == want and len(got) == 21 - 3


def _drop_files(spark, parts, schema):
    """A folder of one file for each part, in order of arrival."""
    import os
    import tempfile

    drop = tempfile.mkdtemp()
    for k, rows in enumerate(parts):
        path = os.path.join(drop, f"part{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(os.path.join(path, f), (1_700_000_000 + 60 * k, 1_700_000_000 + 60 * k))
    return (spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(drop))


def test_rows_late_across_batches_are_logged_in_order(spark):
    """Shuffled arrival over five batches equals lag; rows beyond the delay are kept apart; only touched buckets are rewritten."""
    import random
    from datetime import datetime, timedelta

    schema = "event_id long, user_id long, ts timestamp_ntz, value double"
    rnd, t0 = random.Random(3), datetime(2024, 1, 1)
    rows = [(i, rnd.randrange(4), t0 + timedelta(minutes=i), float(i % 7)) for i in range(100)]
    late = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rnd.randrange(30)))
    parts = [late[k:k + 20] for k in range(0, 100, 20)]
    hopeless = (500, 1, t0 - timedelta(days=1), 9.0)
    src = _drop_files(spark, [*parts[:4], [*parts[4], hopeless]], schema)
    q, out = ST.change_log_stream(spark, src, "user_id", "ts", "value", ["event_id"], delay=timedelta(minutes=31), buckets=8)
    assert sum(1 for p in q.recentProgress if p["numInputRows"] > 0) == 5
    got = sorted((r.user_id, r.event_id, r.old_value, r.new_value) for r in spark.read.parquet(out).collect())
    want = sorted((r.user_id, r.event_id, r.old_value, r.new_value)
                  for r in U.change_log(spark.createDataFrame(rows, schema), "user_id", "ts", "value", ["event_id"]).collect())
    assert got == want
    assert [r.event_id for r in spark.read.parquet(out.replace("/log", "/late")).collect()] == [500]
    early = [spark.read.parquet(f"{out}/batch={n:012d}").count() for n in (0, 2, 4, 6, 8)]
    assert 0 < sum(early) < len(want)  # logged as soon as the delay allows, the rest at the stream's end


def test_sketches_merge_over_batches(spark):
    schema = "k string, user long, v double"
    parts = [[("a" if i % 3 else "b", (i * 7) % 500, float(i % 1000)) for i in range(n, n + 1000)] for n in (0, 1000, 2000)]
    src = _drop_files(spark, parts, schema)
    _, out = ST.sketch_stream(spark, src, "k", "v", "user")
    rows = ST.latest_snapshot(spark, out)
    got = {r["k"]: r for r in ST.read_sketches(rows).collect()}
    every = [r for p in parts for r in p]
    for k in "ab":
        mine = sorted(v for c, _, v in every if c == k)
        users = len({u for c, u, _ in every if c == k})
        assert got[k]["n"] == len(mine) and abs(got[k]["n_distinct"] - users) <= 0.06 * users
        assert abs(got[k]["quantiles"][1] - mine[len(mine) // 2]) <= 0.01 * 1000
    one = ST.read_sketches(ST.merge_sketches(rows)).first()
    assert one["n"] == 3000 and abs(one["n_distinct"] - 500) <= 30


def test_half_written_snapshots_are_not_read(spark):
    import os
    import tempfile

    out = tempfile.mkdtemp()
    for n in (0, 1):
        spark.range(n + 1).write.parquet(f"{out}/batch={n:012d}")
    os.remove(f"{out}/batch={1:012d}/_SUCCESS")
    assert ST.latest_snapshot(spark, out).count() == 1


def test_bucket_table_rewrites_what_a_batch_touches(spark):
    import os
    import tempfile

    from rollbook.sources.buckets import BucketTable

    path = tempfile.mkdtemp() + "/t"
    t = BucketTable(spark, path, "k", 16)
    base = spark.createDataFrame([(k, k * 10, 0) for k in range(200)], "k long, v long, ord int")
    t.write(base, 0)
    before = {p: os.stat(p.replace("file:", "")).st_mtime_ns for p in t.newest().values()}
    assert len(before) == 16
    assert U.upsert_buckets(t, spark.createDataFrame([(7, 1, 1), (7, 2, 2)], base.schema), "ord") == 1
    after = t.newest()
    assert len([p for p in after.values() if p not in before]) == 1
    assert all(os.stat(p.replace("file:", "")).st_mtime_ns == before[p] for p in after.values() if p in before)
    rows = {r["k"]: r["v"] for r in t.read().collect()}
    assert len(rows) == 200 and rows[7] == 2 and rows[8] == 80
    assert {r["k"]: r["v"] for r in t.read(before=1).collect()}[7] == 70
    t.expire(1)
    assert {r["k"]: r["v"] for r in t.read().collect()} == rows
    new = BucketTable(spark, path + "2", "k", 4)
    assert new.read() is None and U.upsert_buckets(new, base, "ord") == 0 and new.read().count() == 200
