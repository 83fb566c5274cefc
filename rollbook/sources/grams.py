"""A table that containment searches (PF2, PF3) skip files of: per file a bit map of the grams in its text columns.

A text that holds the query holds all of the query's grams, so a file without one of them holds no hit and is not opened. Grams of three
characters, lower case, are hashed to ``BITS`` bits, kept as (file, word, bits) rows beside the data; queries shorter than a gram read all files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BITS = 3, 1 << 16


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def write_searchable(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Write ``df`` to ``<path>/data`` and its bit maps to ``<path>/grams``. Searches prune best where rows that share words share files: sort first."""
    spark = df.sparkSession
    df.write.parquet(f"{path}/data")
    cols = list(columns) if columns else [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    rows = spark.read.schema(df.schema).parquet(f"{path}/data").select(F.col("_metadata.file_path").alias("file"), F.explode(F.array(*[F.lower(F.col(f"`{c}`")) for c in cols])).alias("t"))
    grams = rows.where(F.length("t") >= GRAM).select("file", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - GRAM + 1), lambda i: F.substring("t", i, GRAM))).alias("g"))
    bit = _bit(F.col("g"))
    maps = grams.groupBy("file", F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(g), {BITS}) % 64 AS INT))")).alias("bits"))
    maps.write.parquet(f"{path}/grams")


def candidate_files(spark: SparkSession, path: str, query: str) -> list[str] | None:
    """Files that may hold the query; None if it is too short to say."""
    q = query.strip().lower()
    if len(q) < GRAM:
        return None
    need = spark.createDataFrame([(q[i:i + GRAM],) for i in range(len(q) - GRAM + 1)], "g string").distinct()
    need = need.groupBy(F.floor(_bit(F.col("g")) / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(g), {BITS}) % 64 AS INT))")).alias("mask"))
    words = need.count()
    maps = spark.read.parquet(f"{path}/grams")
    held = maps.join(F.broadcast(need), F.col("word") == F.col("w")).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))  # a row for each gram of the query at most
    return [r["file"] for r in held.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == words).select("file").collect()]


def search(spark: SparkSession, path: str, query: str, columns: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """PF2 on a table that ``write_searchable`` wrote: the rows of ``text_search``, read from the candidate files alone."""
    from rollbook.operators.ranking import text_search

    files = candidate_files(spark, path, query)
    table = spark.read.parquet(f"{path}/data")
    if files is not None:
        table = spark.read.schema(table.schema).parquet(*files) if files else table.limit(0)
    return text_search(table, query, columns, order)
