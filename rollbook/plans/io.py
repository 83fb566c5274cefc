"""Registered queries: sources, sinks, schema resolution and cleaning (SC1-SC4, SC7, SC8,
SK1-SK4, CS1, CS2, CS4, CS5, CL1-CL7, SF12, SF14).

Files are written from the driver's tables to a fresh folder under the shared checkpoint
directory and read back, so every round trip grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions import text as TX
from rollbook.operators import ranking as R
from rollbook.operators import search as SR
from rollbook.plans import bindings as B
from rollbook.plans import views as V
from rollbook.plans.registry import padded, register, rounded
from rollbook.session import read_table, scratch_path
from rollbook.sources import files as FS
from rollbook.sources import schema as SC
from rollbook.sources import sinks as SK

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType())])


def _customer_csv(spark, sf, header=True):
    path = scratch_path(spark, "customer-csv")
    c = read_table(spark, sf, "customer").select(*CUSTOMER_SCHEMA.fieldNames())
    c.write.mode("overwrite").option("header", header).csv(path)
    return path


@register("sc1_csv_roundtrip", "SC1", """
SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer""")
def sc1_csv_roundtrip(spark, sf):
    df = FS.read_csv(spark, _customer_csv(spark, sf), CUSTOMER_SCHEMA)
    return rounded(df.where(F.col(FS.CORRUPT).isNull()).drop(FS.CORRUPT))


@register("sc2_headerless_csv", "SC2", """
SELECT CAST(c_custkey AS VARCHAR) AS Column_1, c_name AS Column_2, CAST(c_nationkey AS VARCHAR) AS Column_3,
       CAST(c_acctbal AS VARCHAR) AS Column_4, c_mktsegment AS Column_5 FROM customer""")
def sc2_headerless_csv(spark, sf):
    return FS.read_headerless(spark, _customer_csv(spark, sf, header=False), 5)


@register("sc3_multi_schema_files", "SC3 SO2", """
SELECT CAST(c_custkey AS VARCHAR) AS ma, c_name AS ten, c_mktsegment AS lop, '' AS so_du FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, '', CAST(s_acctbal AS VARCHAR) FROM supplier""")
def sc3_multi_schema_files(spark, sf):
    a, b = scratch_path(spark, "sc3-a"), scratch_path(spark, "sc3-b")
    read_table(spark, sf, "customer").select(F.col("c_custkey").alias("ma"), F.col("c_name").alias("ten"),
                                             F.col("c_mktsegment").alias("lop")) \
        .write.mode("overwrite").option("header", True).csv(a)
    read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ma"), F.col("s_name").alias("ten"),
                                             F.col("s_acctbal").alias("so_du")) \
        .write.mode("overwrite").option("header", True).csv(b)
    return FS.read_mixed(spark, [(a, ["ma", "ten", "lop"]), (b, ["ma", "ten", "so_du"])])


@register("sc4_text_files", "SC4 SF2", """
WITH d AS (SELECT string_split(text, chr(10)) AS parts FROM documents)
SELECT regexp_replace(parts[i], '^\\s+|\\s+$', '', 'g') AS line FROM d, range(1, len(parts) + 1) r(i)
WHERE regexp_replace(parts[i], '^\\s+|\\s+$', '', 'g') <> ''""")
def sc4_text_files(spark, sf):
    path = scratch_path(spark, "docs-text")
    read_table(spark, sf, "documents").select("text").write.mode("overwrite").text(path)
    return FS.read_lines(spark, path).select("line")


@register("sc4_line_numbers", "SC4", """
SELECT CAST(sum(len(text) - len(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines, true AS numbered_once FROM documents""")
def sc4_line_numbers(spark, sf):
    """Lines of all files by their last line numbers (a mark ends each file), and that no number is given twice."""
    path = scratch_path(spark, "docs-text")
    docs = read_table(spark, sf, "documents").select("text")
    parts = docs.withColumn("p", F.spark_partition_id()).withColumn("last", F.lit(0))
    ends = parts.select("p").distinct().select(F.lit("end of file 7f3a").alias("text"), "p", F.lit(1).alias("last"))
    both = parts.unionByName(ends).repartition("p").sortWithinPartitions("p", "last")
    both.select("text").write.text(path)
    lines = FS.read_lines(spark, path)
    files = lines.groupBy("file").agg(F.max("line_no").alias("last"), F.count(F.lit(1)).alias("n"), F.countDistinct("line_no").alias("d"),
                                      F.sum((F.col("line") == "end of file 7f3a").cast("int")).alias("marks"))
    return files.agg(F.sum(F.col("last") - F.col("marks")).cast("bigint").alias("lines"), F.min(F.col("n") == F.col("d")).alias("numbered_once"))


@register("sc7_ingest_audit", "SC7", """
SELECT CAST(sum(rows) AS BIGINT) AS rows, max(5) AS columns, true AS dated, true AS sized FROM (SELECT count(*) AS rows FROM customer)""")
def sc7_ingest_audit(spark, sf):
    """Totals of the audit over all files (their names and number are Spark's choice)."""
    audit = FS.ingest_audit(FS.read_csv(spark, _customer_csv(spark, sf), CUSTOMER_SCHEMA))
    return audit.agg(F.sum("rows").cast("bigint").alias("rows"), F.max("columns").alias("columns"),
                     F.min(F.col("modified").isNotNull()).alias("dated"), F.min(F.col("file_size") > 0).alias("sized"))


@register("sc8_ingest_guard", "SC8", """
SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment, NULL::VARCHAR AS reason, NULL::BIGINT AS rows FROM customer
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'extension', count(*) FROM customer""")
def sc8_ingest_guard(spark, sf):
    """The rows of accepted files, and a row per reason with the rows of the files rejected for it: the
    customers once more under an extension that is not allowed. The size limit is the documented one."""
    path = scratch_path(spark, "sc8")
    c = read_table(spark, sf, "customer").select(*CUSTOMER_SCHEMA.fieldNames())
    c.write.option("header", True).option("maxRecordsPerFile", 100_000).csv(f"{path}/good")
    c.write.option("header", True).option("extension", "exe").csv(f"{path}/bad")
    accepted, rejected = FS.guarded(FS.read_csv(spark, [f"{path}/good", f"{path}/bad"], CUSTOMER_SCHEMA))
    left = rejected.groupBy("reason").agg(F.sum("rows").cast("bigint").alias("rows"))
    return rounded(accepted.drop(FS.CORRUPT).unionByName(left, allowMissingColumns=True))


@register("sk1_export_results", "SK1 CL7", B.with_ctes(B.SQL_STUDENTS, B.SQL_CUMULATIVE) + """
SELECT DISTINCT s.ma_sinh_vien AS "Mã Sinh Viên", trim(concat_ws(' ', s.ho_dem, s.ten)) AS "Họ Tên",
       s.lop AS "Lớp", round(c.diem_4_tich_luy, 6) AS "Điểm TB", c.ghi_chu AS "Xếp Loại",
       c.so_tc_tich_luy AS "TC Tích Lũy", c.ghi_chu AS "Ghi Chú"
FROM students s JOIN cumulative c ON s.ma_sinh_vien = c.ma_sinh_vien
WHERE s.lop ILIKE '%BUILD%' AND c.diem_4_tich_luy >= 3.4""")
def sk1_export_results(spark, sf):
    res = V.class_pattern_high_gpa(B.students(spark, sf), B.cumulative(spark, sf), "%BUILD%")
    frame = SK.export_frame(res, "ma_sinh_vien", "ho_dem", "ten", "lop", "diem_trung_binh", "ghi_chu",
                            "so_tc_tich_luy", "ghi_chu")
    path = scratch_path(spark, "sk1")
    SK.write_csv(frame, path)
    schema = T.StructType([T.StructField(h, t) for h, t in zip(
        SK.EXPORT_HEADERS, [T.LongType(), T.StringType(), T.StringType(), T.DoubleType(), T.StringType(),
                            T.LongType(), T.StringType()])])
    back = spark.read.schema(schema).option("header", True).csv(path)
    return rounded(back)


@register("sk2_match_export", "SK2 SR1", B.with_ctes(B.SQL_ROSTER) + """
SELECT row_number() OVER (ORDER BY ma_sinh_vien) AS "STT", 'red widget' AS "Dữ liệu đầu vào",
       CAST(CAST(round(score * 100) AS BIGINT) AS VARCHAR) || '%' AS "Độ khớp",
       CAST(ma_sinh_vien AS VARCHAR) AS "MSSV", ho_ten AS "Họ tên", lop AS "Lớp",
       CAST(diem_10 AS VARCHAR) AS "Điểm", xep_loai AS "Xếp loại"
FROM (SELECT *, CASE WHEN lower(ho_ten) = 'red widget' THEN 0.95
                     WHEN contains(lower(ho_ten), 'red widget') OR contains('red widget', lower(ho_ten)) THEN 0.85
                     ELSE 0.7 * ((CASE WHEN contains(lower(ho_ten), 'red') THEN 1 ELSE 0 END)
                               + (CASE WHEN contains(lower(ho_ten), 'widget') THEN 1 ELSE 0 END)) / 2.0 END AS score
      FROM roster) WHERE score > 0.3""")
def sk2_match_export(spark, sf):
    r = B.roster(spark, sf)
    hits = SR.scored_search(r, "red widget", [], F.col("ho_ten"), [], ["ma_sinh_vien"]) \
             .withColumn("input", F.lit("red widget"))
    frame = SK.match_export_frame(hits, ["ma_sinh_vien"], "input", "match_score", "ma_sinh_vien", "ho_ten",
                                  "lop", "diem_10", "xep_loai")
    path = scratch_path(spark, "sk2")
    SK.write_csv(frame, path, quote_all=True)
    schema = T.StructType([T.StructField(h, T.LongType() if i == 0 else T.StringType())
                           for i, h in enumerate(SK.MATCH_HEADERS)])
    return spark.read.schema(schema).option("header", True).csv(path)


# The wide grade file's 26 columns from customer, each in Spark's and DuckDB's spelling.
_WIDE = {"stt": ("c_custkey", "c_custkey"), "ma_sinh_vien": ("lpad(c_custkey, greatest(length(c_custkey), 10), '0')",
         "lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(length(CAST(c_custkey AS VARCHAR)), 10) AS INTEGER), '0')"),
         "ho_dem": ("substring_index(c_name, '#', 1)", "split_part(c_name, '#', 1)"), "ten": ("substring_index(c_name, '#', -1)", "split_part(c_name, '#', 2)"),
         "lop": ("c_mktsegment", "c_mktsegment"),
         "ngay_sinh": ("date_format(date_add(DATE '1995-01-01', CAST(c_custkey % 3650 AS INT)), 'dd/MM/yyyy')", "DATE '1995-01-01' + CAST(c_custkey % 3650 AS INTEGER)")}


def _wide_expr(i: int, c: str) -> tuple[str, str]:
    if c in _WIDE:
        return _WIDE[c]
    if c in SC.INT_COLUMNS:
        return (f"c_custkey % {i + 7}",) * 2
    if c in SC.DOUBLE_COLUMNS:
        return f"(c_custkey % 1000) / {float(i)}D", f"(c_custkey % 1000) / CAST({i} AS DOUBLE)"
    return f"concat('t{i} ', c_mktsegment)", f"concat('t{i} ', c_mktsegment)"


def _sk3_sql() -> str:
    cols = []
    for i, c in enumerate(SC.WIDE_COLUMNS):
        e = _wide_expr(i, c)[1]
        cols.append(f"CAST({e} AS BIGINT) AS {c}" if c in SC.INT_COLUMNS else f"round({e}, 6) AS {c}" if c in SC.DOUBLE_COLUMNS else
                    f"strftime({e}, '%Y-%m-%d') AS {c}" if c == "ngay_sinh" else f"{e} AS {c}")
    return f"SELECT {', '.join(cols)}, substring(c_mktsegment, 1, 2) AS khoa FROM customer"


@register("sk3_split_load", "SK3 SC1 CL1 CL2 SO4", _sk3_sql())
def sk3_split_load(spark, sf):
    """The wide file as CSV, read as text, invalid keys dropped, typed, written as the three tables, and
    all of them read back and joined: every one of the 26 columns."""
    path = scratch_path(spark, "sk3-csv")
    read_table(spark, sf, "customer").selectExpr(*[f"{_wide_expr(i, c)[0]} AS {c}" for i, c in enumerate(SC.WIDE_COLUMNS)]) \
        .write.option("header", True).csv(path)
    text = FS.read_csv(spark, path, SC.WIDE_TEXT_SCHEMA).drop(FS.CORRUPT)
    paths = SK.write_tables(SC.type_wide(text.where(TX.is_valid_key("ma_sinh_vien"))), scratch_path(spark, "sk3"))
    st = SK.read_partitioned(spark, paths["students"], ["khoa"])
    joined = st.join(spark.read.parquet(paths["semester_scores"]), "ma_sinh_vien").join(spark.read.parquet(paths["cumulative_scores"]), "ma_sinh_vien")
    return rounded(joined.withColumn("ngay_sinh", F.date_format("ngay_sinh", "yyyy-MM-dd")).select(*SC.WIDE_COLUMNS, "khoa"))


@register("sk4_json_records", "SK4", B.with_ctes(B.SQL_ROSTER) + """
SELECT ma_sinh_vien, CASE WHEN diem_10 > 5 THEN ho_ten END AS ho_ten, lop, xep_loai, round(diem_10, 6) AS diem_10, diem_10 <= 5 AS null_kept FROM roster""")
def sk4_json_records(spark, sf):
    """Every record written as a line of JSON, NULLs kept, and its fields parsed back from the files."""
    r = B.roster(spark, sf).withColumn("ho_ten", F.when(F.col("diem_10") > 5, F.col("ho_ten")))
    path = scratch_path(spark, "sk4")
    SK.json_records(r).write.text(path)
    lines = spark.read.text(path)
    back = lines.select("value", F.from_json("value", r.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).alias("r"))
    return rounded(back.select("r.*", F.col("value").contains('"ho_ten":null').alias("null_kept")))


# ---------------------------------------------------------------- schema resolution
def _headed_customer(spark, sf):
    c = read_table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("Mã sinh viên"), F.col("c_name").alias("Họ và tên"),
                    F.col("c_mktsegment").alias("Lớp"), F.col("c_acctbal").cast("string").alias("Điểm 10"),
                    F.col("c_nationkey").cast("string").alias("Ghi chú"))


@register("cs1_resolve_roles", "CS1", """
SELECT CAST(c_custkey AS VARCHAR) AS mssv, c_name AS full_name, c_mktsegment AS class,
       CAST(c_acctbal AS VARCHAR) AS score FROM customer""")
def cs1_resolve_roles(spark, sf):
    return SC.canonical_projection(_headed_customer(spark, sf))


def _text_scores(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select(F.lit("n/a").alias("Điểm chữ"),
                     F.when(F.col("l_linenumber") == 7, F.lit("x")).otherwise(
                         (F.col("l_quantity") / F.lit(5.0)).cast("string")).alias("Điểm 10"),
                     F.col("l_returnflag").alias("Xếp loại"))


@register("cs2_score_detect", "CS2 CL4", """
SELECT 'Điểm chữ' AS "column", 0 AS position, CAST(0 AS BIGINT) AS n_numeric
UNION ALL SELECT 'Điểm 10', 1, count(*) FILTER (WHERE l_linenumber <> 7) FROM lineitem""")
def cs2_score_detect(spark, sf):
    return SC.score_column_counts(_text_scores(spark, sf))


@register("cs4_first_non_blank", "CS4 SF2", """
SELECT c_custkey,
  coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_name END,
           CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN NULL ELSE 'Customer ' || CAST(c_custkey AS VARCHAR) END,
           c_mktsegment) AS ho_ten
FROM customer""")
def cs4_first_non_blank(spark, sf):
    c = read_table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    a = F.when(seg == "BUILDING", F.lit("   ")).when(seg == "MACHINERY", F.lit(None)).otherwise(F.col("c_name"))
    b = F.when(seg == "AUTOMOBILE", F.lit("")).otherwise(F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", SC.first_non_blank(a, b, seg).alias("ho_ten"))


@register("cs5_import_normalise", "CS5 SO3", """
SELECT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS mssv,
       CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN NULL
            ELSE 'Khach ' || CAST(o_custkey AS VARCHAR) END AS ho_ten,
       o_orderpriority AS lop,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE round(o_totalprice / CAST(50000 AS DOUBLE), 6) END AS diem,
       NULL::VARCHAR AS email, NULL::VARCHAR AS so_dien_thoai, o_orderstatus AS trang_thai,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'missing id'
            WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'missing name' END AS reject_reason
FROM orders""")
def cs5_import_normalise(spark, sf):
    o = read_table(spark, sf, "orders")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    raw = o.select(
        F.when((st == "P") & (pr == "1-URGENT"), F.lit(" ")).otherwise(F.col("o_orderkey").cast("string"))
        .alias("MSSV"),
        F.when((st == "F") & (pr == "5-LOW"), F.lit("nan")).otherwise(F.lit("Khach")).alias("Họ đệm"),
        F.when((st == "F") & (pr == "5-LOW"), F.lit(None)).otherwise(F.col("o_custkey").cast("string")).alias("Tên"),
        pr.alias("Lớp"),
        F.when(st == "O", F.lit("n/a")).otherwise((F.col("o_totalprice") / F.lit(50000.0)).cast("string"))
        .alias("Điểm 10"),
        st.alias("Trạng thái"))
    return rounded(SC.normalise_import(raw))


# ---------------------------------------------------------------- cleaning
def _planted(spark, sf):
    """Key and number columns cast to text with junk planted by line number."""
    li = read_table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    key10 = padded(F.col("l_orderkey"), 10)
    key = (F.when(n == 1, key10).when(n == 2, F.concat(F.lit(" "), key10)).when(n == 3, F.concat(key10, F.lit(".0")))
           .when(n == 4, F.lit(None)).when(n == 5, F.substring(key10, 2, 9)).otherwise(key10))
    q = F.col("l_quantity")
    num = (F.when(n == 1, q.cast("string")).when(n == 2, F.concat(F.lit(" "), q.cast("string"), F.lit(" ")))
           .when(n == 3, F.lit("")).when(n == 4, F.concat(q.cast("bigint").cast("string"), F.lit("d")))
           .when(n == 5, F.lit("8,5")).when(n == 6, F.lit("1e3")).otherwise(F.lit("NaN")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                     key.alias("key_text"), num.alias("num_text"))


SQL_PLANTED = """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE l_linenumber WHEN 1 THEN lpad(CAST(l_orderkey AS VARCHAR), CAST(greatest(length(CAST(l_orderkey AS VARCHAR)), 10) AS INTEGER), '0')
       WHEN 2 THEN ' ' || lpad(CAST(l_orderkey AS VARCHAR), CAST(greatest(length(CAST(l_orderkey AS VARCHAR)), 10) AS INTEGER), '0')
       WHEN 3 THEN lpad(CAST(l_orderkey AS VARCHAR), CAST(greatest(length(CAST(l_orderkey AS VARCHAR)), 10) AS INTEGER), '0') || '.0'
       WHEN 4 THEN NULL WHEN 5 THEN substring(lpad(CAST(l_orderkey AS VARCHAR), CAST(greatest(length(CAST(l_orderkey AS VARCHAR)), 10) AS INTEGER), '0'), 2, 9)
       ELSE lpad(CAST(l_orderkey AS VARCHAR), CAST(greatest(length(CAST(l_orderkey AS VARCHAR)), 10) AS INTEGER), '0') END AS key_text,
  CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS VARCHAR) WHEN 2 THEN ' ' || CAST(l_quantity AS VARCHAR) || ' '
       WHEN 3 THEN '' WHEN 4 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'd' WHEN 5 THEN '8,5'
       WHEN 6 THEN '1e3' ELSE 'NaN' END AS num_text
  FROM lineitem)
"""


@register("cl1_valid_keys", "CL1", SQL_PLANTED + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 6) AS l_extendedprice, key_text
FROM p WHERE regexp_full_match(key_text, '[0-9]{10}')""")
def cl1_valid_keys(spark, sf):
    p = _planted(spark, sf)
    return rounded(p.where(TX.is_valid_key("key_text")).drop("num_text"))


@register("cl2_clean_numbers", "CL2 CL3 CL5 CL6 UD2", SQL_PLANTED + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 6) AS l_extendedprice,
  CASE WHEN regexp_full_match(regexp_replace(num_text, '^\\s+|\\s+$', '', 'g'),
                              '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
       THEN TRY_CAST(regexp_replace(num_text, '^\\s+|\\s+$', '', 'g') AS DOUBLE) END AS num,
  regexp_replace(num_text, '^\\s+|\\s+$', '', 'g') AS num_trimmed,
  regexp_replace(regexp_replace(key_text, '^\\s+|\\s+$', '', 'g'), '\\.0$', '') AS key_id
FROM p""")
def cl2_clean_numbers(spark, sf):
    p = _planted(spark, sf)
    return rounded(p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                            TX.clean_number("num_text").alias("num"), TX.clean_text("num_text").alias("num_trimmed"),
                            TX.id_text("key_text").alias("key_id")))


@register("cl7_full_names", "CL7 SF12", B.with_ctes(B.SQL_STUDENTS) + """
SELECT ma_sinh_vien,
  trim(concat_ws(' ', CASE WHEN lop = 'BUILDING' THEN NULL ELSE ho_dem END, ten)) AS null_safe,
  (CASE WHEN lop = 'BUILDING' THEN NULL ELSE ho_dem END) || ' ' || ten AS propagating,
  substring(lop, 1, 2) AS khoa
FROM students""")
def cl7_full_names(spark, sf):
    s = B.students(spark, sf)
    first = F.when(F.col("lop") == "BUILDING", F.lit(None)).otherwise(F.col("ho_dem"))
    return s.select("ma_sinh_vien", TX.full_name(first, "ten").alias("null_safe"),
                    TX.full_name(first, "ten", null_safe=False).alias("propagating"),
                    TX.cohort("lop", 2).alias("khoa"))


@register("sf14_display_text", "SF14 CL6 SK2", """
SELECT c_custkey, CAST(CAST(round((c_acctbal / CAST(10000 AS DOUBLE)) * 100) AS BIGINT) AS VARCHAR) || '%' AS pct,
       CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR)
            ELSE CAST(c_acctbal AS VARCHAR) END AS shown,
       CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', b / CAST(1024 AS DOUBLE))
            ELSE format('{:.1f} MB', b / CAST(1048576 AS DOUBLE)) END AS size,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey), '%d/%m/%Y %H:%M') AS stamp
FROM (SELECT *, c_custkey * c_custkey * 7 AS b FROM customer)""")
def sf14_display_text(spark, sf):
    c = read_table(spark, sf, "customer")
    return c.select("c_custkey", TX.percent_text(F.col("c_acctbal") / F.lit(10000.0)).alias("pct"),
                    TX.display_value("c_acctbal").alias("shown"), TX.size_text(F.col("c_custkey") * F.col("c_custkey") * 7).alias("size"),
                    TX.stamp_text(F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") * 60).cast("timestamp_ntz")).alias("stamp"))


@register("sc3_folder_of_forms", "SC3 CS1 SO2", """
SELECT CAST(c_custkey AS VARCHAR) AS mssv, c_name AS full_name, c_mktsegment AS class, '' AS score, '' AS note FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, '', '', 'a, "b"' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, '', CAST(s_acctbal AS VARCHAR), '' FROM supplier
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR), '', '' FROM nation
UNION ALL SELECT '', p_name, '', '', '' FROM part""")
def sc3_folder_of_forms(spark, sf):
    """Five forms of headers in one folder, none of them named by the caller."""
    path = scratch_path(spark, "sc3-folder")
    write = lambda df, name: df.write.option("header", True).csv(f"{path}/{name}")
    c = read_table(spark, sf, "customer")
    write(c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("MSSV"), F.col("c_name").alias("Họ và tên"), F.col("c_mktsegment").alias("Lớp")), "a")
    write(c.where("c_mktsegment = 'BUILDING'").select(F.lit('a, "b"').alias("note"), F.col("c_name").alias("Full name"), F.col("c_custkey").alias("Student ID")), "b")
    write(read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("Mã sinh viên"), F.col("s_acctbal").alias("Điểm"), F.col("s_name").alias("Họ tên")), "c")
    write(read_table(spark, sf, "nation").select(F.col("n_name").alias("Họ tên"), F.col("n_nationkey").alias("mssv"), F.col("n_regionkey").alias("class")), "d")
    write(read_table(spark, sf, "part").select(F.col("p_name").alias("Full name")), "e")
    return FS.read_folder(spark, path).select("mssv", "full_name", "class", "score", "note")


@register("sc7_folder_audit", "SC7 SC8 SF6", """
SELECT 'ok' AS status, 'a' AS name, true AS sized, count(*) AS lines, count(*) AS items FROM customer
UNION ALL SELECT 'ok', 'b', true, count(*), 0 FROM supplier
UNION ALL SELECT 'empty', 'c', false, 0, 0
UNION ALL SELECT 'extension', 'd', true, 0, 0
UNION ALL SELECT 'size', 'e', true, 0, 0""")
def sc7_folder_audit(spark, sf):
    """Ids, lines without items, an empty file, one of a kind that is not allowed, one too large: each has a row."""
    path = scratch_path(spark, "sc7-folder")
    put = lambda df, name, ext="txt": df.coalesce(1).write.option("extension", ext).option("header", False).csv(f"{path}/{name}") if ext != "txt" else df.coalesce(1).write.text(f"{path}/{name}")
    ids = read_table(spark, sf, "customer").select((F.col("c_custkey") + 2000000000).cast("string").alias("value"))
    put(ids, "a")
    put(read_table(spark, sf, "supplier").select(F.concat(F.lit("-- "), F.col("s_suppkey").cast("string")).alias("value")), "b")
    put(ids.limit(0), "c")
    put(ids, "d", "exe")
    large = ids.select(F.repeat("value", 2).alias("value"))
    put(large.unionByName(large), "e")
    limit = 40 * ids.count()  # bytes: lines of ids take 11, those of the last file 42 together
    audit = FS.folder_audit(spark, path, max_bytes=limit)
    return audit.select("status", F.when(F.col("status") == "extension", "d").when(F.col("status") == "size", "e").when(F.col("status") == "empty", "c")
                        .when(F.col("items") > 0, "a").otherwise("b").alias("name"), (F.col("file_size") > 0).alias("sized"), "lines", "items")


@register("pf8_ingest_ordinals", "PF8 SC1", """
SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_ord, c_custkey, c_name || chr(10) || 'second line' AS note FROM customer""")
def pf8_ingest_ordinals(spark, sf):
    """Rows of several CSV files, with line breaks inside quotes, numbered in order of file and place, written for look-ups and read back."""
    path, table = scratch_path(spark, "pf8-csv"), scratch_path(spark, "pf8-table")
    c = read_table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit("\nsecond line")).alias("note"))
    c.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").write.option("header", True).option("quoteAll", True).csv(path)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("note", T.StringType())])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).csv(path)
    FS.write_ordinals(FS.with_ordinals(rows), table)
    return spark.read.parquet(table).select("row_ord", "c_custkey", "note")
