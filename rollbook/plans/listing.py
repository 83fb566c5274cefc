"""Registered queries: listing, filters, ranking and paging on the roster (PF2-PF5, PF8,
TK1, TK2, TK4-TK9, CS3, VW5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.functions.text import full_name, id_text
from rollbook.operators import ranking as R
from rollbook.operators import stats as ST
from rollbook.plans import bindings as B
from rollbook.plans.registry import register, rounded
from rollbook.session import cut_lineage, read_table

SQL_ROSTER = B.with_ctes(B.SQL_ROSTER)
ROSTER_COLS = "ma_sinh_vien, ho_ten, lop, xep_loai, round(diem_10, 6) AS diem_10"
ROLES = {"name": "ho_ten", "id": "ma_sinh_vien", "class": "lop", "score": "diem_10"}


def roster(spark, sf):
    return B.roster(spark, sf)


def _medal_sql(rank: str) -> str:
    return (f"CASE WHEN {rank} = 1 THEN 'gold' WHEN {rank} = 2 THEN 'silver' "
            f"WHEN {rank} = 3 THEN 'bronze' END")


def _placed(ordered):
    """The whole sorted frame with each row's place, from 1: a global sort's partitions follow each
    other, so a row's place is its number in its partition and the rows of the ones before."""
    fixed = cut_lineage(ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()))
    sizes = fixed.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_mono").alias("_low"))
    before = sizes.select("_pid", "_low", F.coalesce(F.sum("n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    return fixed.join(F.broadcast(before), "_pid").withColumn("place", F.col("_before") + F.col("_mono") - F.col("_low") + 1).drop(
        "_pid", "_mono", "_low", "_before")


@register("tk1_top10", "TK1 TK6", SQL_ROSTER + f"""
SELECT ma_sinh_vien, ho_ten, lop, round(diem_10, 6) AS score,
       row_number() OVER (ORDER BY diem_10 DESC, ma_sinh_vien) AS rank,
       {_medal_sql("row_number() OVER (ORDER BY diem_10 DESC, ma_sinh_vien)")} AS medal
FROM roster WHERE diem_10 IS NOT NULL ORDER BY diem_10 DESC, ma_sinh_vien LIMIT 10""")
def tk1_top10(spark, sf):
    t = R.top_k(roster(spark, sf), "diem_10", ["ma_sinh_vien"], 10)
    return rounded(t.select("ma_sinh_vien", "ho_ten", "lop", "score",
                            F.col("rank").cast("bigint").alias("rank"), "medal"))


@register("tk2_bottom10", "TK2", SQL_ROSTER + """
SELECT ma_sinh_vien, ho_ten, lop, round(diem_10, 6) AS score,
       row_number() OVER (ORDER BY diem_10 ASC, ma_sinh_vien) AS rank
FROM roster WHERE diem_10 IS NOT NULL AND diem_10 < 5 ORDER BY diem_10 ASC, ma_sinh_vien LIMIT 10""")
def tk2_bottom10(spark, sf):
    t = R.bottom_k(roster(spark, sf), "diem_10", ["ma_sinh_vien"], 10)
    return rounded(t.select("ma_sinh_vien", "ho_ten", "lop", "score", F.col("rank").cast("bigint").alias("rank")))


@register("tk4_sort_by_score", "TK4 TK10", SQL_ROSTER + f"""
SELECT {ROSTER_COLS}, row_number() OVER (ORDER BY diem_10 DESC NULLS LAST, ma_sinh_vien) AS place FROM roster""")
def tk4_sort_by_score(spark, sf):
    return rounded(_placed(R.sort_listing(roster(spark, sf), "score", ROLES, ["ma_sinh_vien"])))


@register("tk4_sort_by_name_page2", "TK4 TK5", SQL_ROSTER + f"""
SELECT {ROSTER_COLS} FROM roster ORDER BY ho_ten ASC NULLS LAST, ma_sinh_vien LIMIT 20 OFFSET 20""")
def tk4_sort_by_name_page2(spark, sf):
    r = roster(spark, sf)
    return rounded(R.page(r, [F.col("ho_ten").asc_nulls_last(), F.asc("ma_sinh_vien")], 2))


@register("tk5_page3_filtered", "TK5 PF3", SQL_ROSTER + f"""
SELECT {ROSTER_COLS} FROM roster WHERE contains(lower(ho_ten), 'widget')
ORDER BY ho_ten, ma_sinh_vien LIMIT 20 OFFSET 40""")
def tk5_page3_filtered(spark, sf):
    r = roster(spark, sf)
    hits = R.keyword_search(r, "widget", ["ho_ten"])
    return rounded(R.page(hits, [F.col("ho_ten").asc_nulls_last(), F.asc("ma_sinh_vien")], 3))


@register("tk5_page_info", "TK5", SQL_ROSTER + """
SELECT (SELECT count(*) FROM roster WHERE contains(lower(ho_ten), 'widget')) AS filtered_count,
       (SELECT count(*) FROM roster) AS total_count,
       CAST(ceil((SELECT count(*) FROM roster WHERE contains(lower(ho_ten), 'widget')) / 20.0) AS BIGINT) AS page_count""")
def tk5_page_info(spark, sf):
    r = roster(spark, sf)
    return R.page_info(R.keyword_search(r, "widget", ["ho_ten"]), r)


def _mixed(spark, sf):
    p = B.read_table(spark, sf, "part")
    return p.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_name"))
                    .otherwise(F.col("p_retailprice").cast("string")).alias("mixed"))


@register("tk9_mixed_sort", "TK9", """
WITH m AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE CAST(p_retailprice AS VARCHAR) END AS mixed
           FROM part)
SELECT p_partkey, mixed, row_number() OVER (
  ORDER BY (TRY_CAST(mixed AS DOUBLE) IS NULL), TRY_CAST(mixed AS DOUBLE), mixed, p_partkey) AS place FROM m""")
def tk9_mixed_sort(spark, sf):
    m = _mixed(spark, sf)
    return _placed(m.orderBy(*R.mixed_sort_keys("mixed"), F.asc("p_partkey")))


_VI_NAMES = ("an", "az", "\u0103n", "\u00e2n", "da", "\u0111a", "em", "\u00eam", "on", "\u00f4n", "\u01a1n", "um", "\u01b0m")
#: Each Vietnamese letter sorts behind all words that begin with its plain letter.
_VI_KEY = "replace(replace(replace(replace(replace(replace(replace(word, '\u0103', 'a~1'), '\u00e2', 'a~2'), '\u0111', 'd~'), '\u00ea', 'e~'), '\u00f4', 'o~1'), '\u01a1', 'o~2'), '\u01b0', 'u~')"


@register("tk9_locale_sort", "TK9", f"""
WITH m AS (SELECT p_partkey, [{", ".join(f"'{w}'" for w in _VI_NAMES)}][p_partkey % {len(_VI_NAMES)} + 1] || ' ' || p_name AS word FROM part)
SELECT p_partkey, word, row_number() OVER (ORDER BY {_VI_KEY}, p_partkey) AS place FROM m""")
def tk9_locale_sort(spark, sf):
    """Names in Vietnamese order."""
    p = read_table(spark, sf, "part")
    word = F.concat(F.element_at(F.array(*map(F.lit, _VI_NAMES)), (F.col("p_partkey") % len(_VI_NAMES) + 1).cast("int")), F.lit(" "), "p_name")
    m = p.select("p_partkey", word.alias("word"))
    return _placed(m.orderBy(*R.mixed_sort_keys("word", collation="vi"), F.asc("p_partkey")))


@register("pf2_skipping_search", "PF2 TK8", SQL_ROSTER + f"""
SELECT {ROSTER_COLS} FROM roster
WHERE contains(lower(ho_ten), 'red widget') OR contains(lower(lop), 'red widget') OR contains(lower(xep_loai), 'red widget')""")
def pf2_skipping_search(spark, sf):
    """The hits of a search on a table whose files are skipped by their bit maps of grams."""
    from rollbook.session import scratch_path
    from rollbook.sources import grams as G

    path = scratch_path(spark, "pf2")
    G.write_searchable(roster(spark, sf).repartitionByRange(16, "ho_ten"), path)
    return rounded(G.search(spark, path, "red widget"))


@register("pf2_text_search", "PF2 TK8", SQL_ROSTER + f"""
SELECT {ROSTER_COLS} FROM roster
WHERE contains(lower(ho_ten), 'red widget') OR contains(lower(lop), 'red widget') OR contains(lower(xep_loai), 'red widget')
ORDER BY ma_sinh_vien LIMIT 100""")
def pf2_text_search(spark, sf):
    return rounded(R.text_search(roster(spark, sf), "red widget", order=["ma_sinh_vien"], cap=R.SEARCH_CAP))


@register("pf3_keyword_search", "PF3", SQL_ROSTER + f"""
SELECT {ROSTER_COLS} FROM roster WHERE contains(lower(ho_ten), 'widget')""")
def pf3_keyword_search(spark, sf):
    return rounded(R.keyword_search(roster(spark, sf), "widget", ["ho_ten"]))


@register("pf4_class_equal", "PF4", SQL_ROSTER + f"""
SELECT {ROSTER_COLS} FROM roster WHERE trim(lop) = 'Brand#13'""")
def pf4_class_equal(spark, sf):
    return rounded(R.class_equals(roster(spark, sf), "lop", "Brand#13"))


@register("pf5_min_score", "PF5", SQL_ROSTER + f"""
SELECT {ROSTER_COLS} FROM roster WHERE diem_10 >= 9.0""")
def pf5_min_score(spark, sf):
    return rounded(R.min_score(roster(spark, sf), "diem_10", 9.0))


@register("pf8_point_lookup", "PF8", SQL_ROSTER + f"SELECT {ROSTER_COLS} FROM roster WHERE ma_sinh_vien = 42")
def pf8_point_lookup(spark, sf):
    return rounded(R.point_lookup(roster(spark, sf), "ma_sinh_vien", 42))


@register("cs3_listing_projection", "CS3", """
SELECT p_partkey AS mssv, p_name AS ho_ten, p_brand AS lop,
       round(p_retailprice / CAST(200 AS DOUBLE), 6) AS diem, p_type AS xep_loai FROM part""")
def cs3_listing_projection(spark, sf):
    p = B.read_table(spark, sf, "part")
    # a wide file where the semester and cumulative blocks repeat the same header
    wide = p.select(F.col("p_partkey").alias("Mã sinh viên"), F.col("p_name").alias("Họ và tên"),
                    F.col("p_brand").alias("Lớp"), (F.col("p_size") / F.lit(5.0)).alias("Điểm 10"),
                    F.lit("-").alias("Xếp loại"),
                    (F.col("p_retailprice") / F.lit(200.0)).alias("Điểm 10"), F.col("p_type").alias("Xếp loại"))
    prefs = [(["Mã sinh viên", "MSSV"], "mssv"), (["Họ và tên", "Họ tên"], "ho_ten"), (["Lớp"], "lop"),
             (["Điểm 10"], "diem"), (["Xếp loại"], "xep_loai")]
    return rounded(R.listing_projection(wide, prefs))


_SQL_LISTING = """WITH r AS (
  SELECT p_partkey, split_part(p_name, ' ', 1) AS ho_dem, substring(p_name, length(split_part(p_name, ' ', 1)) + 2) AS ten, p_brand AS lop,
         p_type AS xep_loai, p_size / CAST(5 AS DOUBLE) AS diem_10 FROM part),
hits AS (SELECT * FROM r WHERE contains(lower(trim(concat_ws(' ', ho_dem, ten))), 'widget') AND lop = 'Brand#15'),
pg AS (SELECT *, row_number() OVER (ORDER BY diem_10 DESC NULLS LAST, p_partkey) AS place FROM hits
       ORDER BY diem_10 DESC NULLS LAST, p_partkey LIMIT 20)
"""


@register("vw5_paged_listing", "VW5 PF3 PF4 TK4 TK5 CS3 CL5 CL7 AG16", _SQL_LISTING + """
SELECT 'row' AS section, place, CAST(p_partkey AS VARCHAR) AS mssv, trim(concat_ws(' ', ho_dem, ten)) AS ho_ten, lop, round(diem_10, 6) AS diem,
       xep_loai, NULL::BIGINT AS filtered_count, NULL::BIGINT AS total_count, NULL::BIGINT AS page_count FROM pg
UNION ALL SELECT 'class', NULL, NULL, NULL, lop, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT lop FROM r WHERE lop IS NOT NULL)
UNION ALL SELECT 'pages', NULL, NULL, NULL, NULL, NULL, NULL, (SELECT count(*) FROM hits), (SELECT count(*) FROM r),
       CAST(ceil((SELECT count(*) FROM hits) / 20.0) AS BIGINT)""")
def vw5_paged_listing(spark, sf):
    """The whole listing report: the page's rows in display columns (ids without ``.0``, names joined), the classes
    to choose from, and the counts, after a search and a class filter."""
    p = read_table(spark, sf, "part")
    r = p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".0")).alias("ma_sinh_vien"), "p_partkey",
                 F.substring_index("p_name", " ", 1).alias("ho_dem"), F.expr("substring(p_name, length(substring_index(p_name, ' ', 1)) + 2)").alias("ten"),
                 F.col("p_brand").alias("lop"), F.col("p_type").alias("xep_loai"), (F.col("p_size") / F.lit(5.0)).alias("diem_10")) \
         .withColumn("ho_ten", full_name("ho_dem", "ten"))
    hits = R.class_equals(R.keyword_search(r, "widget", ["ho_ten"]), "lop", "Brand#15")
    order = [F.col("diem_10").desc_nulls_last(), F.asc("p_partkey")]
    shown = R.page(hits, order, 1).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # one page
    shown = R.listing_projection(shown.withColumn("ma_sinh_vien", id_text("ma_sinh_vien")), [
        (["place"], "place"), (["Mã sinh viên", "ma_sinh_vien"], "mssv"), (["Họ và tên", "ho_ten"], "ho_ten"), (["Lớp", "lop"], "lop"),
        (["Điểm 10", "diem_10"], "diem"), (["Xếp loại", "xep_loai"], "xep_loai")]).withColumn("section", F.lit("row"))
    classes = ST.distinct_values(r, "lop").withColumn("section", F.lit("class"))
    pages = R.page_info(hits, r).withColumn("section", F.lit("pages"))
    out = shown.unionByName(classes, allowMissingColumns=True).unionByName(pages, allowMissingColumns=True)
    return rounded(out.select("section", "place", "mssv", "ho_ten", "lop", "diem", "xep_loai", "filtered_count", "total_count", "page_count"))
