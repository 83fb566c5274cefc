"""Registered queries: streaming twins (ST1-ST3), each drained with ``availableNow`` and
returned as the batch read of its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.plans import changes as CH
from rollbook.plans.registry import register, rounded
from rollbook.session import read_table
from rollbook.streaming import streams as ST

PASS_VALUE = 10.0


def _stream(spark, sf, name):
    return ST.file_stream(spark, sf, f"{name}.parquet", read_table(spark, sf, name).schema)


@register("st1_stream_kpi", "ST1 AG1 AG10", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std_dev,
       round(min(value), 6) AS min, round(max(value), 6) AS max,
       round(avg(CASE WHEN value >= 10 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pass_rate
FROM events GROUP BY event_type""")
def st1_stream_kpi(spark, sf):
    _, out = ST.kpi_stream(spark, _stream(spark, sf, "events"), "event_type", "value", PASS_VALUE)
    return rounded(ST.latest_snapshot(spark, out))


def _incoming_from(df):
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")) \
             .otherwise(F.col("o_totalprice") + F.lit(100.0))
    clerk = F.when(F.col("o_orderstatus") == "P", F.lit("")) \
             .otherwise(F.concat(F.lit("Clerk#"), F.col("o_custkey").cast("string")))
    return (df.where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
            .select("o_orderkey", "o_custkey", price.alias("o_totalprice"), "o_orderstatus", "o_orderpriority",
                    clerk.alias("clerk"), F.col("o_orderkey").alias("ord")))


@register("st2_stream_ingest", "ST2 SO1 SO3 JN8", CH.SQL_SPLIT + """
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderstatus, o_orderpriority,
       NULL::VARCHAR AS clerk, ord FROM cur
UNION ALL
SELECT o_orderkey, o_custkey, round(o_totalprice, 6), o_orderstatus, o_orderpriority, clerk, ord FROM inc
WHERE regexp_replace(clerk, '^\\s+|\\s+$', '', 'g') <> '' AND o_orderkey NOT IN (SELECT o_orderkey FROM cur)""")
def st2_stream_ingest(spark, sf):
    base = CH.current(spark, sf).withColumn("clerk", F.lit(None).cast("string")) \
             .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "clerk", "ord")
    src = _incoming_from(_stream(spark, sf, "orders"))
    _, root = ST.ingest_stream(spark, src, "o_orderkey", base, required=["clerk"], order="ord")
    return rounded(spark.read.parquet(root).drop("batch", "bucket"))


@register("st3_stream_change_log", "ST3 SO7", """
SELECT user_id, 'UPDATE' AS change_type, round(old_value, 6) AS old_value, round(new_value, 6) AS new_value,
       change_date, event_id FROM (
  SELECT user_id, lag(value) OVER w AS old_value, value AS new_value, ts AS change_date, event_id,
         row_number() OVER w AS rn
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE rn > 1""")
def st3_stream_change_log(spark, sf):
    _, out = ST.change_log_stream(spark, _stream(spark, sf, "events"), "user_id", "ts", "value", ["event_id"], buckets=16)
    return rounded(spark.read.parquet(out).drop("batch"))


@register("st1_stream_sketches", "ST1 AG2 AG6", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, true AS distinct_near, true AS quartiles_near FROM events GROUP BY event_type""")
def st1_stream_sketches(spark, sf):
    """Sketches of a stream, and whether their estimates lie within the stated bounds of the exact figures: distinct users within 6 % (over three
    standard errors), quartiles between the values whose ranks are half a per cent off."""
    _, out = ST.sketch_stream(spark, _stream(spark, sf, "events"), "event_type", "value", "user_id")
    got = ST.read_sketches(ST.latest_snapshot(spark, out))
    shares = [x for s in (0.25, 0.5, 0.75) for x in (s - 0.005, s + 0.005)]
    exact = read_table(spark, sf, "events").groupBy(F.col("event_type").alias("t")).agg(
        F.count_distinct("user_id").alias("users"), F.percentile("value", F.array(*map(F.lit, shares))).alias("ends"))
    near = [(F.col("quantiles")[k] >= F.col("ends")[2 * k] - 1e-9) & (F.col("quantiles")[k] <= F.col("ends")[2 * k + 1] + 1e-9) for k in range(3)]
    return rounded(got.join(exact, F.col("event_type") == F.col("t")).select(
        "event_type", "n", "mean", (F.abs(F.col("n_distinct") - F.col("users")) <= 0.06 * F.col("users")).alias("distinct_near"), (near[0] & near[1] & near[2]).alias("quartiles_near")))


@register("st3_stream_late_rows", "ST3 SO7", """
SELECT user_id, 'UPDATE' AS change_type, round(old_value, 6) AS old_value, round(new_value, 6) AS new_value, change_date, event_id FROM (
  SELECT user_id, lag(value) OVER w AS old_value, value AS new_value, ts AS change_date, event_id, row_number() OVER w AS rn
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE rn > 1""")
def st3_stream_late_rows(spark, sf):
    """All events, dealt over four files by a hash and streamed one file at a time, so that most rows of a batch are late for the batch before."""
    from datetime import timedelta

    from rollbook.session import scratch_path

    path = scratch_path(spark, "st3-shuffled")
    events = read_table(spark, sf, "events")
    events.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4))).repartition(4, "part").sortWithinPartitions("part").drop("part").write.parquet(path)
    source = ST.file_stream(spark, path, "*.parquet", events.schema, max_files_per_trigger=1)
    _, out = ST.change_log_stream(spark, source, "user_id", "ts", "value", ["event_id"], delay=timedelta(days=36500), buckets=16)
    return rounded(spark.read.parquet(out).drop("batch"))
