"""Extraction of ids, names, classes and dates from text lines (SC5, SF5-SF7, SF9, SO5).

Lines are ``(src, rec_id, line_no, line)``. Each rule is a column expression; a line's
items are built as an array and exploded, so the whole extraction is one narrow
projection per partition followed, for the result sets, by one partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import extract as X
from rollbook.functions.text import utrim

KIND_ID, KIND_NAME, KIND_CLASS, KIND_DATE = "mssv", "names", "classes", "dates"


def text_to_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """SC4/SC5: split a text column on newlines into trimmed, non-blank lines with their
    position. Whole texts are split; the position is the 0-based raw line index."""
    # trimmed before the explosion: a filter on a projected line would be pushed below it and trim every line twice
    return (df.select(*keys, F.posexplode(F.transform(F.split(F.col(text), "\n"), utrim)).alias("line_no", "line"))
            .where(F.col("line") != ""))


def _tag(kind: str, arr: Column) -> Column:
    return F.transform(F.array_distinct(arr), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))


def mixed_items(line) -> Column:
    """SF9: every id, capitalised name run, class and date found inside the line. All but the names hold a digit, so lines without one are searched for names alone."""
    names = _tag(KIND_NAME, X.find_names(line))
    return F.when(X.has_digit(line), F.concat(_tag(KIND_ID, X.find_ids(line)), names, _tag(KIND_CLASS, X.find_classes(line)), _tag(KIND_DATE, X.find_dates(line)))).otherwise(names)


def extract_items(lines: DataFrame, line: str = "line") -> DataFrame:
    """SF6: per line, the whole line under the first rule that fits, or else the mixed
    parse; long form ``(..., kind, item, via_rule)``."""
    ln = F.col(line)
    whole = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), ln.alias("item"), F.lit(True).alias("via_rule")))
    # one chain, exploded as an expression: a column of its own would be inferred non-empty below
    # the projection, which parses every line a second time
    items = (F.when(X.is_pure_id(ln), whole(KIND_ID)).when(X.is_name_line(ln), whole(KIND_NAME))
             .when(X.is_class_line(ln), whole(KIND_CLASS)).when(X.is_date_line(ln), whole(KIND_DATE))
             .otherwise(F.transform(mixed_items(ln), lambda x: F.struct(x["kind"].alias("kind"), x["item"].alias("item"), F.lit(False).alias("via_rule")))))
    return (lines.select(*lines.columns, F.explode(items).alias("_it"))
            .select(*lines.columns, F.col("_it.kind").alias("kind"), F.col("_it.item").alias("item"), F.col("_it.via_rule").alias("via_rule")))


def mixed_parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """SF9 on every line (regardless of the whole-line rules)."""
    return (lines.select(*lines.columns, F.explode(mixed_items(F.col(line))).alias("_it"))
            .select(*lines.columns, F.col("_it.kind").alias("kind"), F.col("_it.item").alias("item")))


def compare_items(lines: DataFrame, line: str = "line") -> DataFrame:
    """SF7: ids and names only. Whole-line id (6-10 digits), whole-line name (2-5 words,
    no digit, 5-40 characters); else ids found inside the line, and names found inside
    the line only when it holds a digit (2-5 words of two letters or more, 5-40 long)."""
    ln = F.col(line)
    whole_id = X.is_compare_id(ln)
    whole_name = ~whole_id & X.is_compare_name_line(ln)
    inner = F.concat(_tag(KIND_ID, X.find_ids(ln)),
                     F.when(X.has_digit(ln), _tag(KIND_NAME, X.find_names(ln, max_len=40, min_word=2)))
                     .otherwise(F.array().cast("array<struct<kind:string,item:string>>")))
    items = (F.when(whole_id, F.array(F.struct(F.lit(KIND_ID).alias("kind"), ln.alias("item"))))
             .when(whole_name, F.array(F.struct(F.lit(KIND_NAME).alias("kind"), ln.alias("item"))))
             .otherwise(inner))
    return (lines.select(*lines.columns, F.explode(items).alias("_it"))
            .select(*lines.columns, F.col("_it.kind").alias("kind"), F.col("_it.item").alias("item")))


def item_sets(items: DataFrame, order: list[str]) -> DataFrame:
    """SO5: distinct items per kind, each with its first position (the original used an
    unordered set; keeping the first position makes the order reproducible)."""
    first = F.min(F.struct(*[F.col(c) for c in order]))
    return (items.groupBy("kind", "item").agg(first.alias("_first"), F.count(F.lit(1)).alias("n"))
            .select("kind", "item", *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order],
                    F.col("n").cast("bigint").alias("n")))


# Header keywords of an uploaded lookup list (lower case).
HEADER_WORDS = ("họ tên", "mssv", "name", "student")


def sniff_lookup_lines(lines: DataFrame, file: str = "file", line_no: str = "line_no",
                       line: str = "line") -> DataFrame:
    """SC6: turn the lines of uploaded lookup lists into inputs.

    A line holding a header keyword is skipped wherever it occurs. After the first header
    of its file, a line with a comma is split, blank parts dropped, and the second part
    is taken when it is an id (all digits, 6 or more), else the first part; any other line
    is taken whole. "After the first header" comes from one partial aggregate per file
    (the first header position) joined back on the file, not from a window over the file.
    """
    ln = F.col(line)
    low = F.lower(ln)
    is_header = F.lit(False)
    for w in HEADER_WORDS:
        is_header = is_header | low.contains(w)
    flagged = lines.withColumn("_hdr", is_header)
    first_hdr = (flagged.where("_hdr").groupBy(file)
                 .agg(F.min(line_no).alias("_first_hdr")))
    j = flagged.join(first_hdr, file, "left")
    parts = F.filter(F.transform(F.split(ln, ","), lambda p: utrim(p)), lambda p: p != "")
    pick = (F.when(F.size(parts) >= 2,
                   F.when(parts[1].rlike("^[0-9]{6,}$"), parts[1]).otherwise(parts[0]))
            .when(F.size(parts) == 1, parts[0]))
    seen = F.col("_first_hdr").isNotNull() & (F.col(line_no) > F.col("_first_hdr"))
    value = F.when(ln.contains(",") & seen, pick).otherwise(ln)
    return (j.where(~F.col("_hdr")).select(file, line_no, value.alias("input_value"))
            .where(F.col("input_value").isNotNull()))
