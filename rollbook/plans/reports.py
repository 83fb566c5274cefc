"""Registered queries: the SQL-side views and reports (JN1, JN2, VW1-VW3, VW6, AG11-AG17,
PF1, PF6, PF7, TK3, TK10, SF10-SF12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions import labels as L
from rollbook.operators import stats as S
from rollbook.plans import bindings as B
from rollbook.plans import views as V
from rollbook.plans.registry import register, rounded
from rollbook.session import read_table

CLASS_PATTERN = "%BUILD%"
SUPPLIER_PATTERN = "%7%"


def sql_bands(gpa: str) -> str:
    """Counts of the grade bands of class views: between one mark and the next above."""
    marks = [L.BAND_EXCELLENT, L.BAND_GOOD, L.BAND_FAIR, L.BAND_AVERAGE]
    names = ["sv_xuat_sac", "sv_gioi", "sv_kha", "sv_trung_binh", "sv_yeu_kem"]
    tests = [" AND ".join([f"{gpa} >= {low}"] * (low is not None) + [f"{gpa} < {high}"] * (high is not None))
             for low, high in zip([*marks, None], [None, *marks])]
    return ", ".join(f"count(CASE WHEN {t} THEN 1 END) AS {n}" for t, n in zip(tests, names))


def summary(spark, sf):
    return V.student_summary(B.students(spark, sf), B.semester(spark, sf), B.cumulative(spark, sf),
                             B.WARNING_PATTERN, B.WITHDRAWN_PATTERN)


SQL_SUMMARY = B.with_ctes(B.SQL_STUDENTS, B.SQL_SEMESTER, B.SQL_CUMULATIVE, """summary AS (
  SELECT s.ma_sinh_vien, s.lop, s.nation, s.ho_dem || ' ' || s.ten AS ho_ten_day_du,
         sem.diem_10, sem.sem_ref, cum.diem_4_tich_luy, cum.ghi_chu, cum.so_tc_tich_luy, cum.nam_thu, cum.cum_ref,
         CASE WHEN cum.diem_4_tich_luy >= 3.60 THEN 'Xuất sắc' WHEN cum.diem_4_tich_luy >= 3.20 THEN 'Giỏi'
              WHEN cum.diem_4_tich_luy >= 2.50 THEN 'Khá' WHEN cum.diem_4_tich_luy >= 2.00 THEN 'Trung bình'
              WHEN cum.diem_4_tich_luy >= 1.00 THEN 'Yếu' ELSE 'Kém' END AS phan_loai_hoc_luc,
         CASE WHEN cum.ghi_chu ILIKE '%URGENT%' THEN 'Cảnh báo' WHEN cum.ghi_chu ILIKE '%LOW%' THEN 'Thôi học'
              ELSE 'Bình thường' END AS tinh_trang_hoc_tap
  FROM students s LEFT JOIN semester sem ON s.ma_sinh_vien = sem.ma_sinh_vien
                  LEFT JOIN cumulative cum ON s.ma_sinh_vien = cum.ma_sinh_vien)""")

SUMMARY_COLS_SQL = """ma_sinh_vien, lop, nation, ho_ten_day_du, round(diem_10, 6) AS diem_10, sem_ref,
  round(diem_4_tich_luy, 6) AS diem_4_tich_luy, ghi_chu, so_tc_tich_luy, nam_thu, cum_ref,
  phan_loai_hoc_luc, tinh_trang_hoc_tap"""


@register("jn1_class_high_gpa", "JN1 PF1 TK10 AG17", B.with_ctes(B.SQL_STUDENTS, B.SQL_CUMULATIVE) + """
SELECT DISTINCT s.ma_sinh_vien, s.ho_dem, s.ten, s.lop, round(c.diem_4_tich_luy, 6) AS diem_trung_binh,
       c.so_tc_tich_luy, c.ghi_chu
FROM students s JOIN cumulative c ON s.ma_sinh_vien = c.ma_sinh_vien
WHERE s.lop ILIKE '%BUILD%' AND c.diem_4_tich_luy >= 3.4 AND c.diem_4_tich_luy IS NOT NULL""")
def jn1_class_high_gpa(spark, sf):
    return rounded(V.class_pattern_high_gpa(B.students(spark, sf), B.cumulative(spark, sf), CLASS_PATTERN))


@register("vw1_student_summary", "VW1 JN2 CL7 SF10 SF11", SQL_SUMMARY + f"SELECT {SUMMARY_COLS_SQL} FROM summary")
def vw1_student_summary(spark, sf):
    return rounded(summary(spark, sf))


@register("jn2_bucketed_summary", "JN2 SK3 VW1", SQL_SUMMARY + f"SELECT {SUMMARY_COLS_SQL} FROM summary")
def jn2_bucketed_summary(spark, sf):
    """VW1 over three tables that are written bucketed by the student key: nothing is shuffled to join them."""
    import uuid

    from rollbook.session import scratch_path
    from rollbook.sources import sinks as SK

    tag = uuid.uuid4().hex[:12]  # a name of its own in the session's catalog, a folder of its own in the shared one
    put = lambda df, name: SK.write_bucketed(df, f"{name}_{tag}", V.KEY, scratch_path(spark, name), buckets=16)
    return rounded(V.student_summary(put(B.students(spark, sf), "students"), put(B.semester(spark, sf), "semester"), put(B.cumulative(spark, sf), "cumulative"),
                                     B.WARNING_PATTERN, B.WITHDRAWN_PATTERN))


@register("vw2_high_gpa_class", "VW2 PF1 TK10", SQL_SUMMARY + f"""
SELECT {SUMMARY_COLS_SQL} FROM summary WHERE lop ILIKE '%BUILD%' AND diem_4_tich_luy >= 3.4""")
def vw2_high_gpa_class(spark, sf):
    return rounded(V.high_gpa_view(summary(spark, sf), CLASS_PATTERN))


@register("vw3_class_statistics", "VW3 AG11", SQL_SUMMARY + """
SELECT lop, count(*) AS so_luong_sv, """ + sql_bands("diem_4_tich_luy") + """,
  round(avg(diem_4_tich_luy), 6) AS diem_tb_lop, round(max(diem_4_tich_luy), 6) AS diem_cao_nhat,
  round(min(diem_4_tich_luy), 6) AS diem_thap_nhat
FROM summary WHERE diem_4_tich_luy IS NOT NULL GROUP BY lop""")
def vw3_class_statistics(spark, sf):
    return rounded(S.class_bands(summary(spark, sf), "lop", V.GPA))


@register("vw6_transcript", "VW6", SQL_SUMMARY + f"SELECT {SUMMARY_COLS_SQL} FROM summary WHERE ma_sinh_vien = 42")
def vw6_transcript(spark, sf):
    return rounded(V.transcript(summary(spark, sf), 42))


@register("pf7_at_risk", "PF7 VW7 TK10", SQL_SUMMARY + """
SELECT ma_sinh_vien, ho_ten_day_du, lop, round(diem_4_tich_luy, 6) AS diem_4_tich_luy, ghi_chu
FROM summary WHERE tinh_trang_hoc_tap = 'Cảnh báo'""")
def pf7_at_risk(spark, sf):
    return rounded(V.at_risk(summary(spark, sf)))


@register("tk3_top_gpa", "TK3 VW7", SQL_SUMMARY + """
SELECT ma_sinh_vien, ho_ten_day_du, lop, round(diem_4_tich_luy, 6) AS diem_4_tich_luy, cum_ref, sem_ref
FROM summary WHERE diem_4_tich_luy IS NOT NULL
ORDER BY diem_4_tich_luy DESC, ma_sinh_vien, cum_ref, sem_ref NULLS FIRST LIMIT 10""")
def tk3_top_gpa(spark, sf):
    top = V.top_gpa(summary(spark, sf), 10, ("ma_sinh_vien", "cum_ref", "sem_ref"))
    return rounded(top.select("ma_sinh_vien", "ho_ten_day_du", "lop", V.GPA, "cum_ref", "sem_ref"))


@register("pf6_low_credit", "PF6", SQL_SUMMARY + """
SELECT ma_sinh_vien, ho_ten_day_du, lop, so_tc_tich_luy, nam_thu, round(diem_4_tich_luy, 6) AS diem_4_tich_luy,
       ghi_chu, cum_ref, sem_ref
FROM summary WHERE so_tc_tich_luy < 50 AND nam_thu >= 3""")
def pf6_low_credit(spark, sf):
    from rollbook.operators.ranking import low_credit
    out = low_credit(summary(spark, sf), "so_tc_tich_luy", "nam_thu", 50, 3, ("ma_sinh_vien", "cum_ref"))
    return rounded(out.select("ma_sinh_vien", "ho_ten_day_du", "lop", "so_tc_tich_luy", "nam_thu", V.GPA,
                              "ghi_chu", "cum_ref", "sem_ref"))


SQL_GRADEBOOK = B.with_ctes(B.SQL_GRADEBOOK)


@register("ag11_class_bands", "AG11", SQL_GRADEBOOK + """
SELECT lop, count(*) AS so_luong_sv, """ + sql_bands("gpa4") + """,
  round(avg(gpa4), 6) AS diem_tb_lop, round(max(gpa4), 6) AS diem_cao_nhat, round(min(gpa4), 6) AS diem_thap_nhat
FROM gradebook WHERE gpa4 IS NOT NULL GROUP BY lop""")
def ag11_class_bands(spark, sf):
    return rounded(S.class_bands(B.gradebook(spark, sf), "lop", "gpa4"))


@register("ag12_cohort_stats", "AG12 SF12", """
SELECT substring(p.p_brand, 1, 7) AS khoa, count(*) AS tong_sv,
       count(CASE WHEN l.l_quantity / CAST(12.5 AS DOUBLE) >= 3.4 THEN 1 END) AS sv_gioi_xuat_sac,
       round(avg(l.l_quantity / CAST(12.5 AS DOUBLE)), 2) AS diem_tb_khoa
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY substring(p.p_brand, 1, 7)""")
def ag12_cohort_stats(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_partkey", (F.col("l_quantity") / F.lit(12.5)).alias("gpa4"))
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("lop"))
    return rounded(S.cohort_stats(li.join(p, "l_partkey"), "lop", "gpa4", width=7))


@register("ag13_class_distribution", "AG13", SQL_GRADEBOOK + """
SELECT lop, count(*) AS so_luong_sv, """ + sql_bands("gpa4") + """,
  round(avg(gpa4), 2) AS diem_tb_lop, round(max(gpa4), 2) AS diem_cao_nhat
FROM gradebook WHERE gpa4 IS NOT NULL AND CAST(lop AS VARCHAR) ILIKE '%7%' GROUP BY lop""")
def ag13_class_distribution(spark, sf):
    return rounded(S.class_distribution(S.class_bands(B.gradebook(spark, sf), "lop", "gpa4"), "lop", SUPPLIER_PATTERN))


@register("ag14_result_summary", "AG14", B.with_ctes(B.SQL_STUDENTS, B.SQL_CUMULATIVE) + """,
hits AS (SELECT DISTINCT s.ma_sinh_vien, s.ho_dem, s.ten, s.lop, c.diem_4_tich_luy AS diem_trung_binh,
                c.so_tc_tich_luy, c.ghi_chu
         FROM students s JOIN cumulative c ON s.ma_sinh_vien = c.ma_sinh_vien
         WHERE s.lop ILIKE '%BUILD%' AND c.diem_4_tich_luy >= 3.4)
SELECT lop, count(*) AS n,
  CASE WHEN grouping(lop) = 1 THEN round(max(diem_trung_binh), 6) END AS max_gpa,
  CASE WHEN grouping(lop) = 1 THEN round(min(diem_trung_binh), 6) END AS min_gpa,
  CASE WHEN grouping(lop) = 1 THEN round(avg(diem_trung_binh), 6) END AS mean_gpa
FROM hits GROUP BY ROLLUP (lop)""")
def ag14_result_summary(spark, sf):
    hits = V.class_pattern_high_gpa(B.students(spark, sf), B.cumulative(spark, sf), CLASS_PATTERN)
    return rounded(S.result_summary(hits, "lop", "diem_trung_binh"))


@register("ag15_store_stats", "AG15", SQL_GRADEBOOK + """
SELECT lop, count(*) AS n, count(CASE WHEN gpa4 >= 3.4 THEN 1 END) AS n_honours,
       CAST(grouping(lop) AS INTEGER) AS is_total
FROM gradebook WHERE CAST(lop AS VARCHAR) ILIKE '%7%' GROUP BY ROLLUP (lop)""")
def ag15_store_stats(spark, sf):
    return S.store_stats(B.gradebook(spark, sf), "lop", "gpa4", SUPPLIER_PATTERN)


@register("ag16_distinct_classes", "AG16", SQL_GRADEBOOK + "SELECT DISTINCT lop FROM gradebook WHERE lop IS NOT NULL")
def ag16_distinct_classes(spark, sf):
    return S.distinct_values(B.gradebook(spark, sf), "lop")


@register("ag17_row_distinct", "AG17", SQL_GRADEBOOK + """
SELECT DISTINCT lop, l_returnflag, l_linestatus FROM gradebook""")
def ag17_row_distinct(spark, sf):
    return B.gradebook(spark, sf).select("lop", "l_returnflag", "l_linestatus").distinct()
