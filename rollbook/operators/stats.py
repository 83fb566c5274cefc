"""Descriptive statistics, grouped bands and rule reports (AG1-AG20, RU1, RU2, VW4).

Each function is one aggregation plan: partial aggregation on the map side, a single
final merge, no collect. Exact quantiles and mode count the values by a shuffle and range-partition the counts; ``approx=True`` uses
sketches of fixed size instead, and no shuffle of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import labels as L
from rollbook.functions.text import as_col, numeric_or_null


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(c, str) and c in df.columns and df.schema[c].dataType.simpleString() == "string"


def scores_only(df: DataFrame, score: str, coerce: bool = False) -> DataFrame:
    """CL4: keep rows with a usable score, as column ``score``. Text columns are always
    coerced (guarded parse); numeric ones are only widened to double."""
    s = numeric_or_null(score) if (coerce or _is_text(df, score)) else as_col(score).cast("double")
    return df.withColumn("score", s).where(F.col("score").isNotNull() & ~F.isnan("score"))


# ---------------------------------------------------------------- AG1 / AG2
def kpi(df: DataFrame, score: str, klass: str | None, pass_mark: float = L.PASS_MARK,
        approx_distinct: bool = False) -> DataFrame:
    """AG1: rows, distinct classes, mean score (2 dp) and pass rate (1 dp), one pass.

    Mean and pass rate are over the rows whose score parses; row count over all rows.
    """
    s = numeric_or_null(score) if _is_text(df, score) else as_col(score).cast("double")
    distinct = (F.lit(1).cast("bigint") if klass is None else
                (F.approx_count_distinct(klass) if approx_distinct else F.count_distinct(klass)))
    return df.agg(
        F.count(F.lit(1)).alias("total_students"),
        distinct.cast("bigint").alias("total_classes"),
        F.round(F.coalesce(F.avg(s), F.lit(0.0)), 2).alias("average_score"),
        F.round(F.coalesce(F.avg(F.when(s.isNotNull(), F.when(s >= pass_mark, 100.0).otherwise(0.0))),
                           F.lit(0.0)), 1).alias("pass_rate"),
    )


# ---------------------------------------------------------------- AG3
def value_counts(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """AG3: most frequent values, ties broken by the value (pandas leaves them undefined)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(key)).limit(k))


# ---------------------------------------------------------------- AG4
def score_histogram(df: DataFrame, score: str, edges: Sequence[float] = L.SCORE_EDGES,
                    bin_labels: Sequence[str] = L.SCORE_LABELS) -> DataFrame:
    """AG4: one row per bin (empty bins included) with count and share of all scores.

    The per-bin counts are one aggregate with a conditional count per bin, so the plan is
    a single partial/final aggregation and the k bins come out by ``stack``.
    """
    sc = scores_only(df, score)
    b = L.histogram_bin("score", edges)
    k = len(edges) - 1
    counts = sc.agg(F.count(F.lit(1)).alias("total"),
                    *[F.count(F.when(b == i, 1)).alias(f"c{i}") for i in range(k)])
    stack = ", ".join(f"{i}, '{bin_labels[i].replace(chr(39), chr(39) * 2)}', c{i}" for i in range(k))
    return counts.select(
        "total", F.expr(f"stack({k}, {stack}) as (bin, label, count)")
    ).select(
        F.col("bin").cast("int").alias("bin"), "label",
        F.col("count").cast("bigint").alias("count"),
        F.when(F.col("total") > 0, F.col("count") * 100.0 / F.col("total")).otherwise(0.0).alias("percentage"),
    )


# ---------------------------------------------------------------- AG5 - AG9
def score_moments(df: DataFrame, score: str) -> DataFrame:
    """AG5, AG7, AG8: what one aggregate of bounded state gives: count, mean, spread, range, coefficient of
    variation, skewness (third central moment over the *sample* std cubed), pass and excellent rates."""
    s = F.col("score")
    row = scores_only(df, score).agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std_dev"), F.var_samp(s).alias("variance"),
        F.min(s).alias("min"), F.max(s).alias("max"), F.skewness(s).alias("_skew_pop"),
        F.avg(F.when(s >= L.PASS_MARK, 100.0).otherwise(0.0)).alias("pass_rate"),
        F.avg(F.when(s >= L.EXCELLENT_MARK, 100.0).otherwise(0.0)).alias("excellent_rate"))
    n = F.col("n").cast("double")
    return row.select(
        F.col("n").cast("bigint").alias("n"), "mean", "std_dev", "variance", "min", "max", (F.col("max") - F.col("min")).alias("range"),
        F.when(F.col("mean") != 0, F.col("std_dev") / F.col("mean") * 100).otherwise(0.0).alias("coefficient_variation"),
        # population skewness rescaled to the sample std: g1 * ((n-1)/n)^1.5
        F.when(F.col("std_dev") > 0, F.col("_skew_pop") * F.pow((n - 1) / n, 1.5)).otherwise(0.0).alias("skewness"),
        "pass_rate", "excellent_rate")


#: Items that the sketch of frequent values returns, and those it keeps track of.
MODE_KEPT, MODE_ROOM = 1000, 10000


def quantile_row(df: DataFrame, score: str, shares: Sequence[float] = (0.25, 0.5, 0.75), approx: bool = False) -> DataFrame:
    """AG6 and the mode: one row with ``mode`` (the smallest of the most frequent) and ``q`` (an array,
    linear interpolation).

    Values are counted first, by a shuffle on the value; the counts are range-partitioned, and a running count
    (inside each partition, behind the sum of the partitions before) says which values hold the wanted
    ranks. So no task ever holds all distinct values, even if every score is another. ``approx`` takes both from sketches of fixed size in one pass:
    quantiles that are values of the column, of a rank that is off by a ten-thousandth at most, and as the mode the most frequent of the values that a sketch of frequent items
    keeps (exact while there are fewer distinct values than it has room for).
    """
    from rollbook.session import cut_lineage

    sc = scores_only(df, score)
    if approx:
        # first of equal counts: the sketch gives (item, count) pairs
        top = F.expr(f"approx_top_k(score, {MODE_KEPT}, {MODE_ROOM})")
        row = sc.agg(top.alias("_t"), F.percentile_approx("score", list(shares), 10000).alias("q"))
        best = F.array_min(F.transform("_t", lambda x: F.struct((-x["count"]).alias("n"), x["item"].alias("item"))))
        return row.select(best["item"].alias("mode"), "q")
    counts = sc.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # the partition numbers are fixed once; sampled bounds may differ when an exchange runs again
    fixed = cut_lineage(counts.repartitionByRange("score").withColumn("_pid", F.spark_partition_id()))
    mode = fixed.orderBy(F.desc("n"), F.asc("score")).limit(1).select("score").scalar()
    every = Window.orderBy("_pid")  # a row per partition
    sizes = fixed.groupBy("_pid").agg(F.sum("n").alias("_size")).select(
        "_pid", F.coalesce(F.sum("_size").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    inside = F.sum("n").over(Window.partitionBy("_pid").orderBy("score"))
    placed = fixed.withColumn("_inside", inside).join(F.broadcast(sizes), "_pid").withColumn("_upto", F.col("_before") + F.col("_inside"))
    rank = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("score")))
    ends = placed.agg(F.max("_total").alias("_total"), *[x for i, q in enumerate(shares) for x in (
        at(F.floor(rank(q))).alias(f"lo{i}"), at(F.ceil(rank(q))).alias(f"hi{i}"))])
    return ends.select(mode.alias("mode"), F.array(*[
        F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (rank(q) - F.floor(rank(q))) for i, q in enumerate(shares)]).alias("q"))


def describe_scores(df: DataFrame, score: str, approx: bool = False, quantiles: DataFrame | None = None) -> DataFrame:
    """AG5-AG8: basic stats, quartiles (linear interpolation), IQR, coefficient of variation, skewness, pass and
    excellent rates, in one row. ``quantiles`` is a :func:`quantile_row` already at hand."""
    ranks = (quantiles if quantiles is not None else quantile_row(df, score, approx=approx)).select(F.struct("mode", "q").alias("r")).scalar()
    row = score_moments(df, score).withColumn("_r", ranks)
    q = F.col("_r.q")
    return row.select(
        "n", "mean", q[1].alias("median"), F.col("_r.mode").alias("mode"), "std_dev", "variance", "min", "max", "range",
        q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"),
        "coefficient_variation", "skewness", "pass_rate", "excellent_rate")


def outliers(df: DataFrame, score: str, k: float = 1.5, flag_share: float = 5.0,
             approx: bool = False, quantiles: DataFrame | None = None) -> DataFrame:
    """AG9: scores outside ``[q1 - k*iqr, q3 + k*iqr]``: count, share, flag when share > 5 %.

    Two passes: the quartile row, used as a scalar subquery (evaluated once, no join),
    then one conditional count.
    """
    sc = scores_only(df, score)
    row = quantiles if quantiles is not None else quantile_row(df, score, approx=approx)
    quart = row.select("q").scalar()  # one subquery, evaluated once
    lo = quart[0] - F.lit(k) * (quart[2] - quart[0])
    hi = quart[2] + F.lit(k) * (quart[2] - quart[0])
    out = sc.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when((F.col("score") < lo) | (F.col("score") > hi), 1)).alias("outlier_count"),
        F.first(lo).alias("lower_bound"), F.first(hi).alias("upper_bound"))
    share = F.when(F.col("n") > 0, F.col("outlier_count") * 100.0 / F.col("n")).otherwise(0.0)
    return out.select(
        F.col("outlier_count").cast("bigint").alias("outlier_count"),
        F.round(share, 1).alias("outlier_percentage"),
        (share > flag_share).alias("outlier_flag"), "lower_bound", "upper_bound")


def statistics_document(df: DataFrame, score: str, edges: Sequence[float], bin_labels: Sequence[str], approx: bool = False) -> DataFrame:
    """VW4: the whole statistics report as rows (section, name, value): basic statistics, quartiles, rates, outliers
    and the grade distribution (count and share of every bin)."""
    one = lambda section, row, names: row.select(F.explode(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")
    from rollbook.session import cut_lineage

    quantiles = cut_lineage(quantile_row(df, score, approx=approx), "quantiles")  # one row, for both parts
    stats = cut_lineage(describe_scores(df, score, approx, quantiles), "stats")
    out = one("basic", stats, ["n", "mean", "median", "mode", "std_dev", "variance", "min", "max", "range"])
    out = out.unionByName(one("quartiles", stats, ["q1", "q2", "q3", "iqr"]))
    out = out.unionByName(one("advanced", stats, ["coefficient_variation", "skewness", "pass_rate", "excellent_rate"]))
    out = out.unionByName(one("outliers", outliers(df, score, quantiles=quantiles), ["outlier_count", "outlier_percentage"]))
    bins = score_histogram(df, score, edges, bin_labels)
    for n in ("count", "percentage"):
        out = out.unionByName(bins.select(F.lit(f"distribution_{n}").alias("section"), F.col("label").alias("name"), F.col(n).cast("double").alias("value")))
    return out


# ---------------------------------------------------------------- AG10 / AG19 / AG18 / AG20
def class_medians(sc: DataFrame, klass: str) -> DataFrame:
    """(class, median): like :func:`quantile_row` for every class, the values range-partitioned on (class,
    score), so that a class with a third of all rows is spread over many tasks."""
    from rollbook.session import cut_lineage

    counts = sc.groupBy(klass, "score").agg(F.count(F.lit(1)).alias("n"))
    fixed = cut_lineage(counts.repartitionByRange(klass, "score").withColumn("_pid", F.spark_partition_id()))
    parts = Window.partitionBy(klass).orderBy("_pid")  # a row per class and partition
    sizes = fixed.groupBy(klass, "_pid").agg(F.sum("n").alias("_size")).select(
        klass, "_pid", F.coalesce(F.sum("_size").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    inside = F.sum("n").over(Window.partitionBy(klass, "_pid").orderBy("score"))
    placed = fixed.withColumn("_inside", inside).join(sizes, [klass, "_pid"])
    upto, mid = F.col("_before") + F.col("_inside"), F.lit(0.5) * (F.col("_total") - 1)
    at = lambda r: F.min(F.when(upto > r, F.col("score")))
    return placed.groupBy(klass).agg(((at(F.floor(mid)) + at(F.ceil(mid))) / 2).alias("median"))


def class_analysis(df: DataFrame, klass: str, score: str, approx: bool = False,
                   coerce: bool = False) -> DataFrame:
    """AG10: per class n, mean, median, std (null for one row), min, max, pass and excellent
    rates; classes without a usable score are dropped; best mean first."""
    sc = scores_only(df.where(F.col(klass).isNotNull()), score, coerce=coerce)
    s = F.col("score")
    sketch = [F.percentile_approx(s, 0.5, 10000).alias("median")] if approx else []
    out = sc.groupBy(klass).agg(
        F.count(s).alias("student_count"), F.avg(s).alias("mean"), *sketch,
        F.stddev_samp(s).alias("std_dev"), F.min(s).alias("min"), F.max(s).alias("max"),
        F.avg(F.when(s >= L.PASS_MARK, 100.0).otherwise(0.0)).alias("pass_rate"),
        F.avg(F.when(s >= L.EXCELLENT_MARK, 100.0).otherwise(0.0)).alias("excellent_rate"))
    if not approx:
        out = out.join(class_medians(sc, klass), klass)
    return (out.select(klass, "student_count", "mean", "median", "std_dev", "min", "max", "pass_rate", "excellent_rate")
        .orderBy(F.desc("mean"), F.asc(klass)))


def class_means(df: DataFrame, klass: str, score: str) -> DataFrame:
    """AG19: per-class mean of a text score coerced inline (no UDF); all-missing classes dropped."""
    return (df.groupBy(klass).agg(F.avg(numeric_or_null(score)).alias("mean"))
            .where(F.col("mean").isNotNull()))


def class_extremes(means: DataFrame, klass: str, mean: str = "mean") -> DataFrame:
    """AG18: best and worst class (ties -> smallest class key), class count, gap of means."""
    m, k = F.col(mean), F.col(klass)
    return means.agg(
        F.count(F.lit(1)).cast("bigint").alias("class_count"),
        F.min_by(F.struct(m.alias("m"), k.alias("k")), F.struct(-m, k)).alias("_best"),
        F.min_by(F.struct(m.alias("m"), k.alias("k")), F.struct(m, k)).alias("_worst"),
        (F.max(m) - F.min(m)).alias("gap"),
    ).select(
        "class_count",
        F.col("_best.k").alias("best_class"), F.col("_best.m").alias("best_mean"),
        F.col("_worst.k").alias("worst_class"), F.col("_worst.m").alias("worst_mean"),
        "gap")


def excellent_count(df: DataFrame, score: str, mark: float = L.EXCELLENT_MARK) -> DataFrame:
    """AG20: exact head-count of excellent scores (no round trip through a rate)."""
    sc = scores_only(df, score)
    return sc.agg(F.count_if(F.col("score") >= mark).cast("bigint").alias("excellent_count"),
                  F.count(F.lit(1)).cast("bigint").alias("n"))


# ---------------------------------------------------------------- AG11 - AG15 (SQL-side stats)
def class_bands(df: DataFrame, klass: str, gpa: str) -> DataFrame:
    """AG11 (view of class statistics): per class head-count, banded counts, avg/max/min GPA;
    rows without GPA excluded; best average first."""
    g = F.col(gpa)
    return (df.where(g.isNotNull()).groupBy(klass).agg(
        F.count(F.lit(1)).alias("so_luong_sv"),
        F.count_if(g >= L.BAND_EXCELLENT).alias("sv_xuat_sac"),
        F.count_if((g >= L.BAND_GOOD) & (g < L.BAND_EXCELLENT)).alias("sv_gioi"),
        F.count_if((g >= L.BAND_FAIR) & (g < L.BAND_GOOD)).alias("sv_kha"),
        F.count_if((g >= L.BAND_AVERAGE) & (g < L.BAND_FAIR)).alias("sv_trung_binh"),
        F.count_if(g < L.BAND_AVERAGE).alias("sv_yeu_kem"),
        F.avg(g).alias("diem_tb_lop"), F.max(g).alias("diem_cao_nhat"), F.min(g).alias("diem_thap_nhat"))
        .orderBy(F.desc("diem_tb_lop"), F.asc(klass)))


def cohort_stats(df: DataFrame, klass: str, gpa: str, width: int = 2,
                 honours: float = L.HONOURS_GPA) -> DataFrame:
    """AG12: group by the first ``width`` characters of the class; head-count, honours count,
    average GPA rounded to 2."""
    g = F.col(gpa)
    return (df.where(g.isNotNull()).groupBy(F.substring(F.col(klass), 1, width).alias("khoa")).agg(
        F.count(F.lit(1)).alias("tong_sv"), F.count_if(g >= honours).alias("sv_gioi_xuat_sac"),
        F.round(F.avg(g), 2).alias("diem_tb_khoa")).orderBy("khoa"))


def class_distribution(bands: DataFrame, klass: str, pattern: str) -> DataFrame:
    """AG13: the class-statistics view filtered by a class pattern, averages rounded."""
    return (bands.where(F.col(klass).cast("string").ilike(pattern)).select(
        klass, "so_luong_sv", "sv_xuat_sac", "sv_gioi", "sv_kha", "sv_trung_binh", "sv_yeu_kem",
        F.round("diem_tb_lop", 2).alias("diem_tb_lop"), F.round("diem_cao_nhat", 2).alias("diem_cao_nhat"))
        .orderBy(F.desc("diem_tb_lop"), F.asc(klass)))


def result_summary(df: DataFrame, klass: str, gpa: str) -> DataFrame:
    """AG14: count per class plus one total row (class NULL) carrying max/min/mean GPA."""
    g = F.col(gpa)
    out = df.rollup(klass).agg(F.count(F.lit(1)).alias("n"), F.max(g).alias("max_gpa"),
                               F.min(g).alias("min_gpa"), F.avg(g).alias("mean_gpa"),
                               F.grouping(klass).alias("_total"))
    return out.select(
        klass, F.col("n").cast("bigint").alias("n"),
        *[F.when(F.col("_total") == 1, F.col(c)).alias(c) for c in ("max_gpa", "min_gpa", "mean_gpa")])


def store_stats(df: DataFrame, klass: str, gpa: str, pattern: str | None = None,
                honours: float = L.HONOURS_GPA) -> DataFrame:
    """AG15: row count per (matching) class with a total line (ROLLUP), and the honours count."""
    d = df if pattern is None else df.where(F.col(klass).cast("string").ilike(pattern))
    return d.rollup(klass).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(gpa) >= honours).alias("n_honours"),
        F.grouping(klass).cast("int").alias("is_total"))


def distinct_values(df: DataFrame, key: str) -> DataFrame:
    """AG16: distinct non-null values, sorted."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)


# ---------------------------------------------------------------- RU1 / RU2
# Rule texts (type, title, priority, message); %s is the class or the value.
RULE_LOW_PASS = ("warning", "Tỷ lệ qua môn thấp", "high",
                 "Chỉ có %.1f%% sinh viên đạt điểm qua môn. Cần có biện pháp hỗ trợ học tập.")
RULE_SPREAD = ("info", "Sự phân tán điểm cao", "medium",
               "Độ lệch chuẩn %.2f cho thấy sự chênh lệch lớn giữa sinh viên. Cần phân loại và hỗ trợ theo nhóm.")
RULE_LOW_MEAN = ("error", "Điểm trung bình thấp", "high",
                 "Điểm trung bình %.2f dưới mức qua môn. Cần xem xét lại phương pháp giảng dạy.")
RULE_HIGH_MEAN = ("success", "Chất lượng học tập tốt", "low", "Điểm trung bình %.2f ở mức cao. Cần duy trì và phát huy.")
RULE_WEAK_CLASS = ("warning", "Lớp {} cần hỗ trợ", "medium", "Lớp %s có điểm trung bình %.2f, thấp hơn đáng kể so với mức chung.")
RULE_STRONG_CLASS = ("success", "Lớp {} xuất sắc", "low", "Lớp %s đạt điểm trung bình %.2f, có thể làm mô hình cho các lớp khác.")


def _rule(cond: Column, rule: tuple[str, str, str, str], order: int, value: Column,
          title: Column | None = None, klass: Column | None = None) -> Column:
    args = [value] if klass is None else [klass, value]
    return F.when(cond, F.struct(F.lit(order).alias("rule_order"), F.lit(rule[0]).alias("type"),
                                 (title if title is not None else F.lit(rule[1])).alias("title"),
                                 F.format_string(rule[3], *args).alias("message"),
                                 F.lit(rule[2]).alias("priority"), value.alias("value")))


def dataset_rules(df: DataFrame, score: str, min_pass: float = 70.0, max_std: float = 2.0,
                  low_mean: float = 5.0, high_mean: float = 8.0) -> DataFrame:
    """RU1: pass rate < 70 (warning); std > 2 (info); mean < 5 (error) else mean > 8 (success)."""
    st = scores_only(df, score).agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
        F.avg(F.when(F.col("score") >= L.PASS_MARK, 100.0).otherwise(0.0)).alias("pass_rate"))
    m, sd, pr = F.col("mean"), F.col("std"), F.col("pass_rate")
    rules = F.array(
        _rule(pr < min_pass, RULE_LOW_PASS, 1, pr),
        _rule(sd > max_std, RULE_SPREAD, 2, sd),
        _rule(m < low_mean, RULE_LOW_MEAN, 3, m),
        _rule((m >= low_mean) & (m > high_mean), RULE_HIGH_MEAN, 3, m))
    return st.select(F.explode(F.array_compact(rules)).alias("r")).select("r.*")


def class_rules(df: DataFrame, klass: str, score: str) -> DataFrame:
    """RU2: only with two or more classes: worst class mean < mean - std (warning); best class
    mean > mean + std (success). The overall row enters as scalar subqueries."""
    overall = scores_only(df, score).agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))
    row = class_extremes(class_means(df, klass, score), klass).select(
        "*", overall.select("mean").scalar().alias("mean"), overall.select("std").scalar().alias("std"))
    worst = F.col("worst_class").cast("string")
    best = F.col("best_class").cast("string")
    rules = F.array(
        _rule((F.col("class_count") > 1) & (F.col("worst_mean") < F.col("mean") - F.col("std")),
              RULE_WEAK_CLASS, 1, F.col("worst_mean"),
              F.format_string(RULE_WEAK_CLASS[1].replace("{}", "%s"), worst), worst),
        _rule((F.col("class_count") > 1) & (F.col("best_mean") > F.col("mean") + F.col("std")),
              RULE_STRONG_CLASS, 2, F.col("best_mean"),
              F.format_string(RULE_STRONG_CLASS[1].replace("{}", "%s"), best), best))
    return row.select(F.explode(F.array_compact(rules)).alias("r")).select("r.*")
