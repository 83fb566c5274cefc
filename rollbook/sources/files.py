"""File sources (SC1-SC4, SC7, SC8).

CSV is always read with an explicit schema (ids stay text, nothing is inferred) and in
PERMISSIVE mode with a corrupt-record column, so a bad line is kept and flagged rather
than failing the job. Row order inside a file is kept as ``(file, row_in_file)`` from the
scan, which is deterministic for a given input layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.text import utrim
from rollbook.session import cut_lineage

CORRUPT = "_corrupt_record"
MAX_FILE_BYTES = 16 * 1024 * 1024
# File extensions accepted for upload.
ALLOWED_EXTENSIONS = ("csv", "xlsx", "xls", "txt", "docx")


def _with_corrupt(schema: T.StructType) -> T.StructType:
    if CORRUPT in schema.fieldNames():
        return schema
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, header: bool = True,
             positional: bool = True) -> DataFrame:
    """SC1: CSV with a header line, typed by ``schema``.

    ``positional=True`` binds columns by position (``enforceSchema``), the only safe
    choice for files whose header names repeat; the file's own header line is skipped.
    """
    return (spark.read.schema(_with_corrupt(schema)).option("header", header)
            .option("enforceSchema", positional).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("encoding", "UTF-8")
            .csv(path))


def read_headerless(spark: SparkSession, path: str | Sequence[str], n_columns: int) -> DataFrame:
    """SC2: CSV without a header; columns are ``Column_1`` .. ``Column_n`` (text)."""
    schema = T.StructType([T.StructField(f"Column_{i + 1}", T.StringType()) for i in range(n_columns)])
    return spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").csv(path)


def read_mixed(spark: SparkSession, groups: Sequence[tuple[str, Sequence[str]]], blank: str = "") -> DataFrame:
    """SC3: several files with different columns into one record set. Each group is
    ``(path, column names)`` read as text; groups are unioned by name and missing cells
    become ``blank``."""
    out = None
    for path, names in groups:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.fillna(blank) if blank is not None else out


def file_headers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, header): the first line of every file, NULL for a file without lines. Of each split only those at a file's start count, so no line order
    is needed beyond a split's own."""
    listed = list_files(spark, path).select("file")
    lines = (spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), "value")
             .where("_at = 0").withColumn("_n", F.monotonically_increasing_id()))
    first = lines.groupBy("file").agg(F.min_by("value", "_n").alias("header"))
    plain = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file:/*", "/")  # noqa: E731 - the two sources spell paths differently
    return (listed.withColumn("_k", plain(F.col("file"))).join(first.select(plain(F.col("file")).alias("_k"), "header"), "_k", "left")
            .select("file", F.regexp_replace("header", "^\ufeff|\r$", "").alias("header")))


def read_folder(spark: SparkSession, path: str | Sequence[str], blank: str | None = "", max_forms: int = 1000) -> DataFrame:
    """SC3 + CS1 over a folder of CSV files whose headers differ and are not known: every form of header becomes one scan of its files.

    Columns are named by the role that the header resolves to (CS1: ``mssv``, ``full_name``, ``class``, ``score`` ...), others by their own text; where
    a file repeats a name the first column of it counts. Files of all forms are unioned by name, cells that a form lacks become ``blank``, and
    ``_file`` says where a row comes from. Files without lines give no rows. Headers are parsed as CSV; their distinct forms are what reaches the driver,
    ``max_forms`` at most (more raise a ``ValueError``: such a folder has no headers).
    """
    import csv

    from rollbook.sources.schema import header_role

    forms = (file_headers(spark, path).where("header IS NOT NULL").groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
             .orderBy("header").limit(max_forms + 1).collect())
    if len(forms) > max_forms:
        raise ValueError(f"more than {max_forms} forms of headers under {path}")
    out = None
    for form in forms:
        names, kept = [], []
        for i, cell in enumerate(next(csv.reader([form["header"]]), [])):
            name = header_role(cell) or cell.strip() or f"Column_{i + 1}"
            names.append(f"c{i}")
            if name.lower() not in [k.lower() for _, k in kept]:
                kept.append((f"c{i}", name))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(form["files"])
        rows = rows.select(F.col("_metadata.file_path").alias("_file"), *[F.col(n).alias(k) for n, k in kept])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "_file string")
    return out.fillna(blank) if blank is not None else out


def list_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, file_name, file_size, modified) of all files under a folder, also empty ones, which Spark's own scans leave out.
    Metadata only; names that begin with ``_`` or ``.`` are the writers' own."""
    from datetime import datetime, timezone

    found = []
    for p in [path] if isinstance(path, str) else path:
        root = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().getName()
            if name[:1] not in "_.":
                found.append((f.getPath().toString(), name, f.getLen(), datetime.fromtimestamp(f.getModificationTime() / 1000, timezone.utc)))
    return spark.createDataFrame(found, "file string, file_name string, file_size long, modified timestamp")


def folder_audit(spark: SparkSession, path: str | Sequence[str], max_bytes: int = MAX_FILE_BYTES, extensions: Sequence[str] = ALLOWED_EXTENSIONS) -> DataFrame:
    """SC7 with a row for every file there is: name, size, time, status (``ok``, ``empty``, ``extension``, ``size``), lines that are not blank and items
    extracted from them (SF6). The listing reads no content; of rejected files none is read at all."""
    from rollbook.operators.extraction import extract_items

    listed = list_files(spark, path)
    known = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1)).isin(*extensions)
    listed = (listed.withColumn("status", F.when(~known, "extension").when(F.col("file_size") > max_bytes, "size").otherwise("ok")))
    good = "{" + ",".join(f"*.{e}" for e in extensions) + "}"
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", good).text(path).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_size").alias("_size"), utrim("value").alias("line"))
    lines = lines.where((F.col("_size") <= max_bytes) & (F.col("line") != ""))
    key = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file:/*", "/")
    rows = lines.groupBy(key(F.col("_f")).alias("_k")).agg(F.count(F.lit(1)).alias("lines"))
    items = extract_items(lines.select("_f", "line")).groupBy(key(F.col("_f")).alias("_k")).agg(F.count(F.lit(1)).alias("items"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = listed.withColumn("_k", key(F.col("file"))).join(rows, "_k", "left").join(items, "_k", "left")
    status = F.when((F.col("status") == "ok") & F.col("lines").isNull(), "empty").otherwise(F.col("status"))
    return out.select("file_name", "file_size", "modified", status.alias("status"), zero("lines"), zero("items"))


#: Rows of one folder of a table written with ordinals.
ORDINAL_BLOCK = 100_000


def with_ordinals(df: DataFrame) -> DataFrame:
    """PF8: the rows of a file scan with ``row_ord``, their place in the files in order of path (from 0).

    One pass counts the rows of each split, the second numbers on from those counts; no data is copied and no file is read into one task. Records with
    quoted line breaks need a scan with ``multiLine``, which takes every file as one split.
    """
    raw = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    splits = cut_lineage(raw.groupBy("_f", "_at").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n")), "splits")
    earlier = F.sum("_n").over(Window.orderBy("_f", "_at").rowsBetween(Window.unboundedPreceding, -1))  # a row per split
    splits = splits.select("_f", "_at", "_low", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return raw.join(splits, ["_f", "_at"]).withColumn("row_ord", F.col("_before") + F.col("_id") - F.col("_low")).select(*df.columns, "row_ord")


def write_ordinals(df: DataFrame, path: str, block: int = ORDINAL_BLOCK) -> None:
    """Write rows with ``row_ord`` so that a look-up reads one folder: ``ord_block=<row_ord / block>``, sorted inside."""
    blocks = df.withColumn("ord_block", F.floor(F.col("row_ord") / F.lit(block)))
    blocks.repartition("ord_block").sortWithinPartitions("ord_block", "row_ord").write.partitionBy("ord_block").parquet(path)


def row_at(spark: SparkSession, path: str, ordinal: int, block: int = ORDINAL_BLOCK) -> DataFrame:
    """PF8: the row with this ordinal (no row beyond the last); other folders are pruned before the scan."""
    return spark.read.parquet(path).where((F.col("ord_block") == ordinal // block) & (F.col("row_ord") == ordinal)).drop("ord_block")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SC4: text files as trimmed, non-blank lines with file name and line number (from 1, blank
    lines counted).

    Files are read in splits. One pass counts each split's rows (a number a split is all that it keeps, no text), and the second numbers the
    rows of a split on from the file's earlier splits: no file is read into one row or one task, and no text is written.
    Both passes read the same splits, as they are planned alike.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = cut_lineage(raw.groupBy("file", "_at").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n")), "splits")
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "_at", "_low", F.coalesce(before, F.lit(0)).alias("_before"))
    lines = raw.select("file", "_at", "_id", utrim("value").alias("line"))
    return (lines.where(F.col("line") != "").join(splits, ["file", "_at"])
            .select("file", (F.col("_before") + F.col("_id") - F.col("_low") + 1).alias("line_no"), "line"))


def ingest_audit(df: DataFrame) -> DataFrame:
    """SC7: per input file: name, size, modification time, rows and columns (one aggregate)."""
    n_cols = len([c for c in df.columns if c != CORRUPT])
    return (df.groupBy(F.col("_metadata.file_name").alias("file_name"))
            .agg(F.first("_metadata.file_size").alias("file_size"),
                 F.first("_metadata.file_modification_time").alias("modified"),
                 F.count(F.lit(1)).cast("bigint").alias("rows"))
            .withColumn("columns", F.lit(n_cols)))


def guarded(df: DataFrame, max_bytes: int = MAX_FILE_BYTES,
            extensions: Sequence[str] = ALLOWED_EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """SC8: split rows into those from acceptable files (size and extension) and an audit
    frame of rejected files with the reason."""
    name = F.col("_metadata.file_name")
    size = F.col("_metadata.file_size")
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    ok_ext = ext.isin(*extensions)
    ok_size = size <= max_bytes
    accepted = df.where(ok_ext & ok_size)
    rejected = (df.where(~(ok_ext & ok_size))
                .groupBy(name.alias("file_name"), size.alias("file_size"))
                .agg(F.count(F.lit(1)).alias("rows"))
                .withColumn("reason", F.when(~F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
                                             .isin(*extensions), F.lit("extension"))
                            .otherwise(F.lit("size"))))
    return accepted, rejected
