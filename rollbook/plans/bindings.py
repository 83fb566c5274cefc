"""Bindings of the canonical grade-book frames to the driver's TPC-H-like tables.

Each binding is a projection (plus, for the score tables, the status that defines *which*
orders are semester or cumulative records). The same definitions
are spelled in SQL (``SQL_*``) so the DuckDB oracle reads exactly the same rows.

  students    <- customer: key c_custkey, name parts from c_name, class c_mktsegment
  semester    <- orders with status 'P': score10 = o_totalprice / 50000
  cumulative  <- orders with status 'F': gpa4 = o_totalprice / 125000,
                 note = o_orderpriority, credits = floor(o_totalprice / 5000),
                 year of study = year(o_orderdate) - 1997
  Score tables are keyed by student like the upsert (SO4) keys them: the latest order
  (highest order key) per customer is the current record.
  gradebook   <- lineitem: class l_suppkey, score10 = l_quantity / 5, gpa4 = l_quantity / 12.5
  roster      <- part: id p_partkey, name p_name, class p_brand, score10 = p_size / 5
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.session import read_table

# (l_orderkey, l_linenumber) repeats in the generated data; these five columns are unique.
GRADEBOOK_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

WARNING_PATTERN = "%URGENT%"
WITHDRAWN_PATTERN = "%LOW%"


def students(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("ma_sinh_vien"),
                    F.substring_index("c_name", "#", 1).alias("ho_dem"),
                    F.substring_index("c_name", "#", -1).alias("ten"),
                    F.col("c_mktsegment").alias("lop"),
                    F.col("c_nationkey").alias("nation"))


SQL_STUDENTS = """students AS (
  SELECT c_custkey AS ma_sinh_vien, split_part(c_name, '#', 1) AS ho_dem,
         split_part(c_name, '#', 2) AS ten, c_mktsegment AS lop, c_nationkey AS nation
  FROM customer)"""


def _latest_per_student(df: DataFrame, ref: str) -> DataFrame:
    from rollbook.operators.ranking import first_by_key
    return first_by_key(df, ["ma_sinh_vien"], [(ref, False)]).select(*df.columns)


def semester(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return _latest_per_student(
        o.where(F.col("o_orderstatus") == "P")
        .select(F.col("o_custkey").alias("ma_sinh_vien"),
                (F.col("o_totalprice") / F.lit(50000.0)).alias("diem_10"),
                F.col("o_orderkey").alias("sem_ref")), "sem_ref")


SQL_SEMESTER = """semester AS (
  SELECT ma_sinh_vien, diem_10, sem_ref FROM (
    SELECT o_custkey AS ma_sinh_vien, o_totalprice / CAST(50000 AS DOUBLE) AS diem_10, o_orderkey AS sem_ref,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn
    FROM orders WHERE o_orderstatus = 'P') WHERE rn = 1)"""


def cumulative(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return _latest_per_student(
        o.where(F.col("o_orderstatus") == "F")
        .select(F.col("o_custkey").alias("ma_sinh_vien"),
                (F.col("o_totalprice") / F.lit(125000.0)).alias("diem_4_tich_luy"),
                F.col("o_orderpriority").alias("ghi_chu"),
                F.floor(F.col("o_totalprice") / F.lit(5000.0)).cast("bigint").alias("so_tc_tich_luy"),
                (F.year("o_orderdate") - F.lit(1997)).cast("bigint").alias("nam_thu"),
                F.col("o_orderkey").alias("cum_ref")), "cum_ref")


SQL_CUMULATIVE = """cumulative AS (
  SELECT ma_sinh_vien, diem_4_tich_luy, ghi_chu, so_tc_tich_luy, nam_thu, cum_ref FROM (
    SELECT o_custkey AS ma_sinh_vien, o_totalprice / CAST(125000 AS DOUBLE) AS diem_4_tich_luy,
           o_orderpriority AS ghi_chu, CAST(floor(o_totalprice / CAST(5000 AS DOUBLE)) AS BIGINT) AS so_tc_tich_luy,
           CAST(year(o_orderdate) - 1997 AS BIGINT) AS nam_thu, o_orderkey AS cum_ref,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn
    FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1)"""


def gradebook(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(*GRADEBOOK_KEY, F.col("l_suppkey").alias("lop"),
                     (F.col("l_quantity") / F.lit(5.0)).alias("score10"),
                     (F.col("l_quantity") / F.lit(12.5)).alias("gpa4"),
                     "l_returnflag", "l_linestatus", "l_shipdate")


SQL_GRADEBOOK = """gradebook AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_suppkey AS lop,
         l_quantity / CAST(5 AS DOUBLE) AS score10, l_quantity / CAST(12.5 AS DOUBLE) AS gpa4,
         l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)"""


def roster(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("ma_sinh_vien"), F.col("p_name").alias("ho_ten"),
                    F.col("p_brand").alias("lop"), F.col("p_type").alias("xep_loai"),
                    (F.col("p_size") / F.lit(5.0)).alias("diem_10"))


SQL_ROSTER = """roster AS (
  SELECT p_partkey AS ma_sinh_vien, p_name AS ho_ten, p_brand AS lop, p_type AS xep_loai,
         p_size / CAST(5 AS DOUBLE) AS diem_10
  FROM part)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
