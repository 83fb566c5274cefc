"""Registered queries: statistics and rule reports on the grade book (AG1-AG10, AG18-AG20,
VW4, RU1, RU2, CL4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions.labels import SCORE_EDGES, SCORE_LABELS
from rollbook.operators import stats as S
from rollbook.plans import bindings as B
from rollbook.plans.registry import register, rounded
from rollbook.session import read_table

NUM_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def sql_clean_number(expr: str) -> str:
    """DuckDB spelling of CL2 (guarded cast of the trimmed text)."""
    t = f"regexp_replace(CAST({expr} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
    return f"(CASE WHEN regexp_matches({t}, '{NUM_RE}') THEN TRY_CAST({t} AS DOUBLE) END)"


SQL_SCORES = B.with_ctes(B.SQL_GRADEBOOK, """s AS (SELECT score10 AS score, lop FROM gradebook
  WHERE score10 IS NOT NULL AND NOT isnan(score10))""")

SQL_MOMENTS = SQL_SCORES + """,
m AS (SELECT count(score) AS n, avg(score) AS mean, stddev_samp(score) AS std_dev, var_samp(score) AS variance,
             min(score) AS mn, max(score) AS mx,
             quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS q2, quantile_cont(score, 0.75) AS q3,
             avg(CASE WHEN score >= 5 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS pass_rate,
             avg(CASE WHEN score >= 8 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS excellent_rate FROM s),
md AS (SELECT score AS mode FROM s GROUP BY score ORDER BY count(*) DESC, score ASC LIMIT 1),
sk AS (SELECT avg(power(s.score - m.mean, 3)) AS m3 FROM s, m)
"""


def gradebook(spark, sf):
    return B.gradebook(spark, sf)


@register("ag1_kpi", "AG1 AG2 CL4", SQL_SCORES + """
SELECT count(*) AS total_students, count(DISTINCT lop) AS total_classes,
       round(coalesce(avg(score10), 0), 2) AS average_score,
       round(coalesce(avg(CASE WHEN score10 >= 5 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 0), 1) AS pass_rate
FROM gradebook""")
def ag1_kpi(spark, sf):
    return rounded(S.kpi(gradebook(spark, sf), "score10", "lop"))


@register("ag3_value_counts", "AG3", SQL_SCORES + """
SELECT lop, count(*) AS n FROM gradebook WHERE lop IS NOT NULL GROUP BY lop ORDER BY n DESC, lop LIMIT 10""")
def ag3_value_counts(spark, sf):
    return S.value_counts(gradebook(spark, sf), "lop", 10)


_BINS = ", ".join(
    f"({i}, '{SCORE_LABELS[i]}', {SCORE_EDGES[i]}, {SCORE_EDGES[i + 1]}, {str(i == len(SCORE_LABELS) - 1).upper()})"
    for i in range(len(SCORE_LABELS)))


@register("ag4_histogram", "AG4", SQL_SCORES + f""",
bins(bin, label, lo, hi, last) AS (VALUES {_BINS}),
tot AS (SELECT count(*) AS total FROM s)
SELECT b.bin, b.label, count(s.score) AS count,
       round(CASE WHEN max(tot.total) > 0 THEN count(s.score) * 100.0::DOUBLE / max(tot.total) ELSE 0 END, 6) AS percentage
FROM bins b CROSS JOIN tot
LEFT JOIN s ON s.score >= b.lo AND (s.score < b.hi OR (b.last AND s.score <= b.hi))
GROUP BY b.bin, b.label""")
def ag4_histogram(spark, sf):
    return rounded(S.score_histogram(gradebook(spark, sf), "score10"))


@register("ag5_basic_stats", "AG5", SQL_MOMENTS + """
SELECT n, round(mean, 6) AS mean, round(q2, 6) AS median, round(md.mode, 6) AS mode, round(std_dev, 6) AS std_dev,
       round(variance, 6) AS variance, round(mn, 6) AS min, round(mx, 6) AS max, round(mx - mn, 6) AS range
FROM m, md""")
def ag5_basic_stats(spark, sf):
    d = S.describe_scores(gradebook(spark, sf), "score10")
    return rounded(d.select("n", "mean", "median", "mode", "std_dev", "variance", "min", "max", "range"))


@register("ag6_quartiles", "AG6", SQL_MOMENTS + """
SELECT round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr FROM m""")
def ag6_quartiles(spark, sf):
    return rounded(S.quantile_row(gradebook(spark, sf), "score10").select(
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")))


@register("ag7_shape", "AG7", SQL_MOMENTS + """
SELECT round(CASE WHEN mean <> 0 THEN std_dev / mean * 100 ELSE 0 END, 6) AS coefficient_variation,
       round(CASE WHEN std_dev > 0 THEN sk.m3 / power(std_dev, 3) ELSE 0 END, 6) AS skewness
FROM m, sk""")
def ag7_shape(spark, sf):
    return rounded(S.score_moments(gradebook(spark, sf), "score10").select("coefficient_variation", "skewness"))


@register("ag8_rates", "AG8", SQL_MOMENTS + """
SELECT round(pass_rate, 6) AS pass_rate, round(excellent_rate, 6) AS excellent_rate FROM m""")
def ag8_rates(spark, sf):
    return rounded(S.describe_scores(gradebook(spark, sf), "score10").select("pass_rate", "excellent_rate"))


@register("ag9_outliers", "AG9", SQL_MOMENTS + """,
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM m),
o AS (SELECT count(*) AS n, count(CASE WHEN s.score < b.lo OR s.score > b.hi THEN 1 END) AS oc FROM s, b)
SELECT oc AS outlier_count, round(CASE WHEN n > 0 THEN oc * 100.0::DOUBLE / n ELSE 0 END, 1) AS outlier_percentage,
       (CASE WHEN n > 0 THEN oc * 100.0::DOUBLE / n ELSE 0 END) > 5 AS outlier_flag,
       round(b.lo, 6) AS lower_bound, round(b.hi, 6) AS upper_bound
FROM o, b""")
def ag9_outliers(spark, sf):
    return rounded(S.outliers(gradebook(spark, sf), "score10"))


@register("vw4_detailed_stats", "VW4 AG4 AG5 AG6 AG7 AG8 AG9", SQL_MOMENTS + f""",
bins(bin, label, lo, hi, last) AS (VALUES {_BINS}),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM m),
o AS (SELECT count(*) AS n, count(CASE WHEN s.score < b.lo OR s.score > b.hi THEN 1 END) AS oc FROM s, b),
h AS (SELECT bins.label, count(s.score) AS c, count(s.score) * 100.0::DOUBLE / (SELECT count(*) FROM s) AS pct
      FROM bins LEFT JOIN s ON s.score >= bins.lo AND (s.score < bins.hi OR (bins.last AND s.score <= bins.hi)) GROUP BY bins.label),
r AS (
  SELECT 'basic' AS section, unnest(['n', 'mean', 'median', 'mode', 'std_dev', 'variance', 'min', 'max', 'range']) AS name,
         unnest([n, mean, q2, md.mode, std_dev, variance, mn, mx, mx - mn]) AS value FROM m, md
  UNION ALL SELECT 'quartiles', unnest(['q1', 'q2', 'q3', 'iqr']), unnest([q1, q2, q3, q3 - q1]) FROM m
  UNION ALL SELECT 'advanced', unnest(['coefficient_variation', 'skewness', 'pass_rate', 'excellent_rate']),
         unnest([CASE WHEN mean <> 0 THEN std_dev / mean * 100 ELSE 0 END, CASE WHEN std_dev > 0 THEN sk.m3 / power(std_dev, 3) ELSE 0 END,
                 pass_rate, excellent_rate]) FROM m, sk
  UNION ALL SELECT 'outliers', unnest(['outlier_count', 'outlier_percentage']),
         unnest([CAST(oc AS DOUBLE), round(CASE WHEN n > 0 THEN oc * 100.0::DOUBLE / n ELSE 0 END, 1)]) FROM o
  UNION ALL SELECT 'distribution_count', label, CAST(c AS DOUBLE) FROM h
  UNION ALL SELECT 'distribution_percentage', label, pct FROM h)
SELECT section, name, round(CAST(value AS DOUBLE), 6) AS value FROM r""")
def vw4_detailed_stats(spark, sf):
    return rounded(S.statistics_document(gradebook(spark, sf), "score10", SCORE_EDGES, SCORE_LABELS))


@register("ag10_class_analysis", "AG10", SQL_SCORES + """
SELECT lop, count(score) AS student_count, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median,
       round(stddev_samp(score), 6) AS std_dev, round(min(score), 6) AS min, round(max(score), 6) AS max,
       round(avg(CASE WHEN score >= 5 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pass_rate,
       round(avg(CASE WHEN score >= 8 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS excellent_rate
FROM s WHERE lop IS NOT NULL GROUP BY lop""")
def ag10_class_analysis(spark, sf):
    return rounded(S.class_analysis(gradebook(spark, sf), "lop", "score10"))


def text_scores(spark, sf):
    """Scores as text with planted junk on line 7 of every order (CL4 coercion input)."""
    g = gradebook(spark, sf)
    return g.withColumn("score_text", F.when(F.col("l_linenumber") == 7, F.lit("n/a"))
                        .otherwise(F.col("score10").cast("string")))


SQL_TEXT_SCORES = f""",
ts AS (SELECT lop, CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(score10 AS VARCHAR) END AS score_text FROM gradebook),
cm AS (SELECT lop, avg({sql_clean_number('score_text')}) AS mean FROM ts GROUP BY lop
       HAVING avg({sql_clean_number('score_text')}) IS NOT NULL)
"""


@register("ag19_class_means", "AG19 CL4 UD3", SQL_SCORES + SQL_TEXT_SCORES + """
SELECT lop, round(mean, 6) AS mean FROM cm""")
def ag19_class_means(spark, sf):
    return rounded(S.class_means(text_scores(spark, sf), "lop", "score_text"))


@register("ag18_class_extremes", "AG18", SQL_SCORES + SQL_TEXT_SCORES + """
SELECT (SELECT count(*) FROM cm) AS class_count,
       (SELECT lop FROM cm ORDER BY mean DESC, lop LIMIT 1) AS best_class,
       (SELECT round(mean, 6) FROM cm ORDER BY mean DESC, lop LIMIT 1) AS best_mean,
       (SELECT lop FROM cm ORDER BY mean ASC, lop LIMIT 1) AS worst_class,
       (SELECT round(mean, 6) FROM cm ORDER BY mean ASC, lop LIMIT 1) AS worst_mean,
       (SELECT round(max(mean) - min(mean), 6) FROM cm) AS gap""")
def ag18_class_extremes(spark, sf):
    return rounded(S.class_extremes(S.class_means(text_scores(spark, sf), "lop", "score_text"), "lop"))


@register("ag20_excellent_count", "AG20", SQL_SCORES + """
SELECT count(CASE WHEN score >= 8 THEN 1 END) AS excellent_count, count(*) AS n FROM s""")
def ag20_excellent_count(spark, sf):
    return S.excellent_count(gradebook(spark, sf), "score10")


@register("ru1_dataset_rules", "RU1", SQL_MOMENTS + """
SELECT * FROM (
  SELECT 1 AS rule_order, 'warning' AS type, 'Tỷ lệ qua môn thấp' AS title, 'high' AS priority,
         format('Chỉ có {:.1f}% sinh viên đạt điểm qua môn. Cần có biện pháp hỗ trợ học tập.', pass_rate) AS message,
         round(pass_rate, 6) AS value FROM m WHERE pass_rate < 70
  UNION ALL SELECT 2, 'info', 'Sự phân tán điểm cao', 'medium',
            format('Độ lệch chuẩn {:.2f} cho thấy sự chênh lệch lớn giữa sinh viên. Cần phân loại và hỗ trợ theo nhóm.', std_dev), round(std_dev, 6) FROM m WHERE std_dev > 2.0
  UNION ALL SELECT 3, 'error', 'Điểm trung bình thấp', 'high',
            format('Điểm trung bình {:.2f} dưới mức qua môn. Cần xem xét lại phương pháp giảng dạy.', mean), round(mean, 6) FROM m WHERE mean < 5.0
  UNION ALL SELECT 3, 'success', 'Chất lượng học tập tốt', 'low',
            format('Điểm trung bình {:.2f} ở mức cao. Cần duy trì và phát huy.', mean), round(mean, 6) FROM m
            WHERE mean >= 5.0 AND mean > 8.0)""")
def ru1_dataset_rules(spark, sf):
    return rounded(S.dataset_rules(gradebook(spark, sf), "score10"))


SQL_BANDS = SQL_SCORES + """,
cl AS (SELECT l_returnflag || CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS VARCHAR) AS klass, l_quantity / CAST(5 AS DOUBLE) AS score10 FROM lineitem),
bm AS (SELECT klass, avg(score10) AS mean FROM cl GROUP BY klass),
ov AS (SELECT avg(score10) AS mean, stddev_samp(score10) AS std FROM cl),
ex AS (SELECT (SELECT count(*) FROM bm) AS class_count,
              (SELECT klass FROM bm ORDER BY mean DESC, klass LIMIT 1) AS best_class, (SELECT max(mean) FROM bm) AS best_mean,
              (SELECT klass FROM bm ORDER BY mean ASC, klass LIMIT 1) AS worst_class, (SELECT min(mean) FROM bm) AS worst_mean)
"""


@register("ru2_class_rules", "RU2 AG18", SQL_BANDS + """
SELECT 1 AS rule_order, 'warning' AS type, 'Lớp ' || worst_class || ' cần hỗ trợ' AS title, 'medium' AS priority,
       format('Lớp {} có điểm trung bình {:.2f}, thấp hơn đáng kể so với mức chung.', worst_class, worst_mean) AS message,
       round(worst_mean, 6) AS value FROM ex, ov WHERE class_count > 1 AND worst_mean < ov.mean - ov.std
UNION ALL
SELECT 2, 'success', 'Lớp ' || best_class || ' xuất sắc', 'low',
       format('Lớp {} đạt điểm trung bình {:.2f}, có thể làm mô hình cho các lớp khác.', best_class, best_mean), round(best_mean, 6)
FROM ex, ov WHERE class_count > 1 AND best_mean > ov.mean + ov.std""")
def ru2_class_rules(spark, sf):
    """Classes by return flag and band of quantities, of which the lowest and the highest stand out."""
    li = read_table(spark, sf, "lineitem")
    klass = F.concat("l_returnflag", F.floor(F.col("l_quantity") / 10).cast("bigint").cast("string"))
    return rounded(S.class_rules(li.select(klass.alias("klass"), (F.col("l_quantity") / F.lit(5.0)).alias("score10")), "klass", "score10"))
