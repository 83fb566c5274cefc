"""Sinks (SK1-SK4): CSV exports, the three-table load and JSON records.

Writes are plain DataFrame writes (one file per task, in parallel); nothing is funnelled
through one task. Outputs go to a new folder per run; a re-run with ``overwrite`` of the
same folder replaces it as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.text import full_name, percent_text
from rollbook.sources import schema as S

# Display headers of the query-result export (SK1), in output order.
EXPORT_HEADERS = ("Mã Sinh Viên", "Họ Tên", "Lớp", "Điểm TB", "Xếp Loại", "TC Tích Lũy", "Ghi Chú")
# Headers of the match-result export (SK2), in output order.
MATCH_HEADERS = ("STT", "Dữ liệu đầu vào", "Độ khớp", "MSSV", "Họ tên", "Lớp", "Điểm", "Xếp loại")


def export_frame(results: DataFrame, id_col: str, first: str, last: str, klass: str, gpa: str,
                 rank: str, credits: str, note: str) -> DataFrame:
    """SK1: the query result with the full name derived (null-safe), the two name parts
    dropped, seven display columns in order."""
    return results.select(
        F.col(id_col).alias(EXPORT_HEADERS[0]), full_name(first, last).alias(EXPORT_HEADERS[1]),
        F.col(klass).alias(EXPORT_HEADERS[2]), F.col(gpa).alias(EXPORT_HEADERS[3]),
        F.col(rank).alias(EXPORT_HEADERS[4]), F.col(credits).alias(EXPORT_HEADERS[5]),
        F.col(note).alias(EXPORT_HEADERS[6]))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    (df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all)
     .option("encoding", "UTF-8").csv(path))


def global_row_number(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """A 1-based running number under a total order without a single-partition window:
    range-partition on the order, number rows inside each partition, and add the row
    count of all earlier partitions (a table with one row per partition, broadcast). The
    partition numbers are fixed by a reliable checkpoint: the sampled bounds, and so the numbers,
    would differ if the exchange ran twice."""
    from rollbook.session import cut_lineage

    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    sizes = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_offset", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(offsets.select("_pid", "_offset")), "_pid")
            .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
            .drop("_pid", "_local", "_offset"))


def match_export_frame(matches: DataFrame, order: list[str], input_col: str, score: str, id_col: str,
                       name: str, klass: str, value: str, rank: str) -> DataFrame:
    """SK2: running number, input value, score as ``NN%``, id, name, class, score, rank."""
    numbered = global_row_number(matches, order)
    return numbered.select(
        F.col("row_no").alias(MATCH_HEADERS[0]), F.col(input_col).cast("string").alias(MATCH_HEADERS[1]),
        percent_text(score).alias(MATCH_HEADERS[2]), F.col(id_col).cast("string").alias(MATCH_HEADERS[3]),
        F.col(name).alias(MATCH_HEADERS[4]), F.col(klass).alias(MATCH_HEADERS[5]),
        F.col(value).cast("string").alias(MATCH_HEADERS[6]), F.col(rank).alias(MATCH_HEADERS[7]))


def split_wide(wide: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SK3: one wide grade frame -> (students, semester, cumulative) projections."""
    cols = set(wide.columns)
    pick = lambda names: wide.select(*[c for c in names if c in cols])
    return pick(S.STUDENT_COLUMNS), pick(S.SEMESTER_COLUMNS), pick(S.CUMULATIVE_COLUMNS)


def write_tables(wide: DataFrame, root: str, cohort_width: int | None = 2) -> dict[str, str]:
    """SK3: write the three tables as parquet; students are partitioned by cohort (the
    first characters of the class) and the score tables sorted by key within files, so
    key and cohort filters skip files and row groups."""
    students, semester, cumulative = split_wide(wide)
    paths = {"students": f"{root}/students", "semester_scores": f"{root}/semester_scores",
             "cumulative_scores": f"{root}/cumulative_scores"}
    w = students
    if cohort_width and "lop" in students.columns:
        w = students.withColumn("khoa", F.substring("lop", 1, cohort_width))
        w.write.mode("overwrite").partitionBy("khoa").parquet(paths["students"])
    else:
        w.write.mode("overwrite").parquet(paths["students"])
    semester.sortWithinPartitions("ma_sinh_vien").write.mode("overwrite").parquet(paths["semester_scores"])
    cumulative.sortWithinPartitions("ma_sinh_vien").write.mode("overwrite").parquet(paths["cumulative_scores"])
    return paths


def write_bucketed(df: DataFrame, name: str, key: str, path: str, buckets: int) -> DataFrame:
    """JN2/SK3: write a table of the session's catalog bucketed and sorted by ``key``, and read it back. Tables written with equal buckets on
    their join key join without a shuffle, as often as they are joined."""
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def read_partitioned(spark, path: str, text_partitions: list[str]) -> DataFrame:
    """Read a partitioned table keeping the named partition columns as text (cohort ``05``
    must not come back as the number 5)."""
    from pyspark.sql import types as T

    inferred = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in text_partitions else f
                           for f in inferred.fields])
    return spark.read.schema(schema).parquet(path)


def json_records(df: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """SK4: each row as one JSON object text (nulls written as ``null`` by default)."""
    opts = {"ignoreNullFields": "false"} if keep_nulls else {}
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), opts).alias("json"))
