"""Registered queries: appends, imports, upserts, de-duplication and change logs
(SO1-SO4, SO6, SO7, JN8).

``orders`` is split by date into the table as it stands ("current": orders before 2000)
and an incoming batch (orders from 1999 on, so 1999 overlaps). Incoming orders that are
not urgent carry a changed price; orders with status 'P' arrive without a clerk name
(a required field), so they are rejected where names are required.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import upsert as U
from rollbook.plans.registry import register, rounded
from rollbook.session import read_table

KEY = "o_orderkey"


def current(spark, sf):
    o = read_table(spark, sf, "orders")
    return (o.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
            .select(KEY, "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
                    F.col(KEY).alias("ord")))


def incoming(spark, sf):
    o = read_table(spark, sf, "orders")
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")) \
             .otherwise(F.col("o_totalprice") + F.lit(100.0))
    clerk = F.when(F.col("o_orderstatus") == "P", F.lit("")) \
             .otherwise(F.concat(F.lit("Clerk#"), F.col("o_custkey").cast("string")))
    return (o.where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
            .select(KEY, "o_custkey", price.alias("o_totalprice"), "o_orderstatus", "o_orderpriority",
                    clerk.alias("clerk"), F.col(KEY).alias("ord")))


SQL_SPLIT = """WITH cur AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, o_orderkey AS ord
             FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
inc AS (SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE o_totalprice + 100.0::DOUBLE END AS o_totalprice,
               o_orderstatus, o_orderpriority,
               CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Clerk#' || CAST(o_custkey AS VARCHAR) END AS clerk,
               o_orderkey AS ord
        FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01')
"""


@register("jn8_new_orders", "JN8", SQL_SPLIT + """
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderstatus, o_orderpriority, clerk, ord
FROM inc WHERE o_orderkey NOT IN (SELECT o_orderkey FROM cur)""")
def jn8_new_orders(spark, sf):
    return rounded(U.anti_existing(incoming(spark, sf), current(spark, sf), KEY))


@register("so2_widening_union", "SO2", SQL_SPLIT + """
SELECT o_orderkey, o_orderstatus, NULL::DOUBLE AS o_totalprice FROM cur
UNION ALL SELECT o_orderkey, NULL::VARCHAR, round(o_totalprice, 6) FROM inc""")
def so2_widening_union(spark, sf):
    return rounded(U.widen_union(current(spark, sf).select(KEY, "o_orderstatus"),
                                 incoming(spark, sf).select(KEY, "o_totalprice")))


def import_batch(spark, sf):
    """Incoming rows, some sent again later, some twice at once, some without an order."""
    inc = incoming(spark, sf).withColumn("resend", F.lit(0))
    again = inc.where(F.col("o_orderpriority") == "2-HIGH").withColumn("resend", F.lit(1))
    twice = inc.where(F.col("o_orderpriority") == "3-MEDIUM")
    unordered = inc.where(F.col("o_orderpriority") == "5-LOW").withColumn("ord", F.lit(None).cast("bigint")) \
                   .withColumn("o_totalprice", F.lit(-1.0))
    return inc.unionByName(again).unionByName(twice).unionByName(unordered)


SQL_IMPORT = SQL_SPLIT + """,
batch AS (SELECT *, 0 AS resend FROM inc UNION ALL SELECT *, 1 FROM inc WHERE o_orderpriority = '2-HIGH'
          UNION ALL SELECT *, 0 FROM inc WHERE o_orderpriority = '3-MEDIUM'
          UNION ALL SELECT o_orderkey, o_custkey, -1.0::DOUBLE, o_orderstatus, o_orderpriority, clerk, NULL, 0
          FROM inc WHERE o_orderpriority = '5-LOW'),
flag AS (SELECT *, regexp_replace(clerk, '^\\s+|\\s+$', '', 'g') <> '' AND o_orderkey IS NOT NULL AS ok FROM batch),
valid AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY resend, ord NULLS LAST) AS rn FROM flag WHERE ok),
status AS (
  SELECT *, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM cur) THEN 'skipped_existing'
                 WHEN rn > 1 THEN 'skipped_duplicate' ELSE 'imported' END AS status FROM valid
  UNION ALL SELECT *, NULL AS rn, 'rejected' AS status FROM flag WHERE NOT ok)
"""


@register("so1_append_checked", "SO1 JN8", SQL_IMPORT + """
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderstatus, o_orderpriority,
       NULL::VARCHAR AS clerk, ord FROM cur
UNION ALL
SELECT o_orderkey, o_custkey, round(o_totalprice, 6), o_orderstatus, o_orderpriority, clerk, ord FROM status
WHERE status = 'imported'""")
def so1_append_checked(spark, sf):
    return rounded(U.append_checked(current(spark, sf), import_batch(spark, sf), KEY, [KEY, "clerk"], ["resend", "ord"]).drop("resend"))


@register("so3_import_counts", "SO3 CS5", SQL_IMPORT + "SELECT status, count(*) AS n FROM status GROUP BY status")
def so3_import_counts(spark, sf):
    cls = U.classify_import(current(spark, sf), import_batch(spark, sf), KEY, ["resend", "ord"], [KEY, "clerk"])
    return U.import_counts(cls)


SQL_UPSERT = SQL_IMPORT + """,
tagged AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, NULL::VARCHAR AS clerk, ord,
                  0 AS batch FROM cur
           UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, clerk, ord, 1 FROM batch)
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderstatus, o_orderpriority, clerk, ord
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY batch DESC, ord DESC NULLS LAST) AS rn FROM tagged)
WHERE rn = 1"""


@register("so4_upsert", "SO4", SQL_UPSERT)
def so4_upsert(spark, sf):
    return rounded(U.upsert(current(spark, sf), import_batch(spark, sf).drop("resend"), KEY, "ord"))


@register("so4_upsert_buckets", "SO4", SQL_UPSERT)
def so4_upsert_buckets(spark, sf):
    """The same upsert on a written table, of which the batch's buckets alone are rewritten."""
    from rollbook.session import scratch_path
    from rollbook.sources.buckets import BucketTable

    batch = import_batch(spark, sf).drop("resend")
    table = BucketTable(spark, scratch_path(spark, "so4"), KEY, buckets=16)
    table.write(U.upsert(current(spark, sf), batch.limit(0), KEY, "ord"), 0)
    U.upsert_buckets(table, batch, "ord")
    return rounded(table.read())


def people(spark, sf):
    c = read_table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("mssv"), F.col("c_name").alias("ho_ten"),
        F.lit(0).alias("src"), F.col("c_custkey").alias("rec"))
    s = read_table(spark, sf, "supplier").select(
        F.lit(None).cast("string").alias("mssv"), F.col("s_name").alias("ho_ten"),
        F.lit(1).alias("src"), F.col("s_suppkey").alias("rec"))
    o = read_table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("mssv"), F.lit(None).cast("string").alias("ho_ten"),
        F.lit(2).alias("src"), F.col("o_orderkey").alias("rec"))
    return c.unionByName(s).unionByName(o)


@register("so6_dedupe_by_key", "SO6", """
WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS mssv, c_name AS ho_ten, 0 AS src, c_custkey AS rec FROM customer
           UNION ALL SELECT NULL, s_name, 1, s_suppkey FROM supplier
           UNION ALL SELECT CAST(o_custkey AS VARCHAR), NULL, 2, o_orderkey FROM orders),
k AS (SELECT *, coalesce(CASE WHEN trim(mssv) <> '' THEN 'mssv_' || trim(mssv) END,
                         CASE WHEN trim(ho_ten) <> '' THEN 'name_' || trim(ho_ten) END) AS dedupe_key FROM p)
SELECT dedupe_key, mssv, ho_ten, src, rec FROM (
  SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY src, rec) AS rn FROM k WHERE dedupe_key IS NOT NULL)
WHERE rn = 1""")
def so6_dedupe_by_key(spark, sf):
    d = U.dedupe_by_key(people(spark, sf), "mssv", "ho_ten", ["src", "rec"])
    return d.select(F.col("_dedupe_key").alias("dedupe_key"), "mssv", "ho_ten", "src", "rec")


@register("so7_change_log", "SO7", """
SELECT user_id, 'UPDATE' AS change_type, round(old_value, 6) AS old_value, round(new_value, 6) AS new_value,
       change_date, event_id FROM (
  SELECT user_id, lag(value) OVER w AS old_value, value AS new_value, ts AS change_date, event_id,
         row_number() OVER w AS rn
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE rn > 1""")
def so7_change_log(spark, sf):
    ev = read_table(spark, sf, "events")
    return rounded(U.change_log(ev, "user_id", "ts", "value", ["event_id"]))


@register("so7_snapshot_changes", "SO7", """
WITH b AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'),
a AS (SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'FURNITURE' THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey,
             CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')
SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'INSERT' WHEN a.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS change_type,
       round(b.c_acctbal, 6) AS old_value, round(a.c_acctbal, 6) AS new_value
FROM b FULL JOIN a ON a.c_custkey = b.c_custkey
WHERE b.c_custkey IS NULL OR a.c_custkey IS NULL OR a.c_nationkey <> b.c_nationkey OR a.c_acctbal <> b.c_acctbal""")
def so7_snapshot_changes(spark, sf):
    """Customers before and after: one segment is new, one gone, two changed, the rest rewritten as it was."""
    c = read_table(spark, sf, "customer")
    segment = F.col("c_mktsegment")
    before = c.where(segment != "BUILDING").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    after = c.where(segment != "HOUSEHOLD").select(
        "c_custkey", F.when(segment == "FURNITURE", F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"), "c_name",
        F.when(segment == "MACHINERY", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return rounded(U.snapshot_changes(before, after, "c_custkey", "c_acctbal"))
